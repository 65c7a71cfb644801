"""Joins, grids and reshaping between score tables (keys instead of row positions)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.functions import vec

MAX_CLASSES = 20_000


def checked_classes(classes: Sequence[str]) -> list[str]:
    """Class lists ride along as literals; refuse one that could grow with the data."""
    classes = list(classes)
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"{len(classes)} classes exceed the literal bound {MAX_CLASSES}")
    return classes


def class_grid(rows: DataFrame, classes: Sequence[str], out: str = "class") -> DataFrame:
    """Every row once per class: a literal explode, no join."""
    return rows.withColumn(out, F.explode(F.array(*[F.lit(c) for c in checked_classes(classes)])))


def densify_files(cells: DataFrame, file_keys: Sequence[str], classes: Sequence[str],
                  windows: int, payload: Sequence[str], win: str = "win",
                  cls: str = "class") -> DataFrame:
    """Full windows x classes grid per file; cells that are absent get null payloads.

    Cells with a window outside 0..windows-1 or an unlisted class are left out, their files stay. Of a
    repeated cell the largest payload is taken, so every slot holds one value. The cells of a file (at most windows * classes of them) are gathered into one sorted array and
    the gaps filled in one pass, so the grid costs one shuffle by file and stays partitioned by it.
    """
    classes = checked_classes(classes)
    index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    slot = F.when(F.col(win).between(0, windows - 1),
                  F.col(win) * len(classes) + F.try_element_at(index, F.col(cls)))
    value = F.struct(*payload)
    # null slots are not collected; sorted by payload inside a slot, the last of a slot is its largest
    cell = F.when(F.col("_slot").isNotNull(), F.struct(F.col("_slot").alias("slot"), value.alias("v")))
    files = (cells.withColumn("_slot", slot)
             .groupBy(file_keys[0])
             .agg(*[F.first(k).alias(k) for k in file_keys[1:]], F.array_sort(F.collect_list(cell)).alias("_cells"))
             .withColumn("_found", F.filter("_cells", lambda x, i: F.coalesce(
                 x["slot"] != F.get("_cells", i + 1)["slot"], F.lit(True)))))
    empty = F.when(F.lit(False), F.col("_found")[0]["v"])
    grid = files.select(*file_keys, F.posexplode(
        vec.dense(F.col("_found"), windows * len(classes), empty)).alias("_slot", "_cell"))
    names = F.array(*[F.lit(c) for c in classes])
    return grid.select(
        *file_keys, F.floor(F.col("_slot") / len(classes)).cast("int").alias(win),
        F.element_at(names, F.col("_slot") % len(classes) + 1).alias(cls),
        *[F.col("_cell")[p].alias(p) for p in payload])


def chosen_with_row(df: DataFrame, row_keys: Sequence[str], fields: dict[str, Column],
                    chosen: Column) -> DataFrame:
    """One line per chosen cell (`cell`) with all cells of its row (`row`), as structs of the fields.

    A row's cells are gathered once; only chosen cells, few of a row, carry them along.
    """
    cell = F.struct(*[c.alias(n) for n, c in fields.items()],
                    F.coalesce(chosen, F.lit(False)).alias("chosen"))
    return (df.groupBy(*row_keys).agg(F.collect_list(cell).alias("row"))
            .withColumn("cell", F.explode(F.filter("row", lambda e: e["chosen"]))))


def unpivot_streams(wide: DataFrame, streams: dict[str, str], model: str = "model",
                    score: str = "p") -> DataFrame:
    """Streams as columns -> one row per stream."""
    packed = F.array(*[F.struct(F.lit(m).alias(model), F.col(c).alias(score))
                       for m, c in streams.items()])
    rest = [c for c in wide.columns if c not in streams.values()]
    return wide.select(*rest, F.inline(packed))


def attach_labels(windows: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    return windows.join(labels, key, "inner")


def align_zero_fill(rows: DataFrame, scores: DataFrame, keys: Sequence[str],
                    score: str = "p") -> DataFrame:
    return (rows.join(scores.select(*keys, score), list(keys), "left")
            .withColumn(score, F.coalesce(F.col(score), F.lit(0.0))))


def attach_taxon(df: DataFrame, taxonomy: DataFrame, default: str = "Aves",
                 cls: str = "class") -> DataFrame:
    """Left lookup; Spark broadcasts the taxonomy when its size is under the threshold."""
    return (df.join(taxonomy.select(cls, "taxon"), cls, "left")
            .withColumn("taxon", F.coalesce("taxon", F.lit(default))))


def map_vocabulary(taxonomy: DataFrame, vocabulary: DataFrame, name: str = "scientific_name",
                   sentinel: int = -1) -> DataFrame:
    hit = taxonomy.join(vocabulary.select(name, "vocab_index"), name, "left")
    return (hit.withColumn("is_mapped", F.col("vocab_index").isNotNull())
            .withColumn("vocab_index", F.coalesce("vocab_index", F.lit(sentinel))))


def genus_proxy(scores: DataFrame, targets: DataFrame, row_keys: Sequence[str],
                cls: str = "class", score: str = "p") -> DataFrame:
    """Unmapped targets take the maximum score of the vocabulary classes of their genus."""
    return (scores.join(targets.select("genus", F.col(cls).alias("target")), "genus")
            .groupBy(*row_keys, "target").agg(F.max(score).alias(score)))


def drop_holdout(df: DataFrame, holdout: DataFrame, key: str = "file_id") -> DataFrame:
    return df.join(holdout.select(key).distinct(), key, "left_anti")


def keep_shared_labels(other: DataFrame, current: DataFrame, taxonomy: DataFrame,
                       label: str = "label") -> DataFrame:
    """Rows of another year whose label exists in this year's recordings and taxonomy."""
    return (other.join(current.select(label).distinct(), label, "left_semi")
            .join(taxonomy.select(label).distinct(), label, "left_semi"))


def chunk_to_window(chunks: DataFrame, win_per_chunk: int = 4, windows: int = 12,
                    shift: int = 0) -> DataFrame:
    """Windows covered by each chunk; shifted chunks are assigned by window centre and wrap."""
    span = F.sequence(F.lit(0), F.lit(win_per_chunk - 1))
    first = F.col("chunk") * win_per_chunk + shift
    return (chunks.withColumn("_i", F.explode(span))
            .withColumn("win", ((first + F.col("_i")) % windows).cast("int")).drop("_i"))


def overlap_resegment(sliding: DataFrame, keys: Sequence[str], start: Column, length: float,
                      seg: float = 5.0, score: str = "p", weighted: bool = True) -> DataFrame:
    """Sliding windows -> fixed segments by overlap-weighted (or plain) mean.

    Each sliding window is sent to the few segments it touches, so no range join is needed.
    """
    s = start.cast("double")
    first = F.floor(s / seg)
    last = F.ceil((s + F.lit(length)) / seg) - 1
    parts = sliding.withColumn("seg", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    overlap = (F.least(s + F.lit(length), (F.col("seg") + 1) * F.lit(seg))
               - F.greatest(s, F.col("seg") * F.lit(seg))) / F.lit(seg)
    w = overlap if weighted else F.lit(1.0)
    return (parts.withColumn("_w", w).groupBy(*keys, "seg")
            .agg((F.sum(F.col("_w") * F.col(score)) / F.sum("_w")).alias(score),
                 F.count(F.lit(1)).alias("n_parts")))


def unmatched_count(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows present on one side only, as one row of counts."""
    both = (a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")))
    return both.agg(F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("n_both"),
                    F.count_if(F.col("_b") == 0).alias("only_a"),
                    F.count_if(F.col("_a") == 0).alias("only_b"))


def align_streams(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "inner")


def score_lookup(labelled: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.join(scores, list(keys), "left")


def prior_lookup(df: DataFrame, prior: DataFrame, keys: Sequence[str],
                 out: str = "prior", neutral: float = 1.0) -> DataFrame:
    return (df.join(prior.select(*keys, out), list(keys), "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(neutral))))


def gap_classes(targets: DataFrame, vocabulary: DataFrame, recordings: DataFrame,
                cls: str = "class") -> DataFrame:
    return (targets.join(vocabulary.select(cls).distinct(), cls, "left_anti")
            .join(recordings.select(cls).distinct(), cls, "left_anti"))
