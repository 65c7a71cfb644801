"""Near duplicates by MinHash with tensored banding.

Two small collections, each of `m` sub-keys of `q` minhashes, are computed per text: 2·m·q minhash
values. A table key is one sub-key of the first collection with one of the second, so m² tables of
2·q values come from about the square root of the hashing that separate tables need. With the
defaults (m = 10, q = 2) a pair of similarity 0.75 shares no key with probability 0.0005.

Steps, all distributed:
1. texts → size of the shingle set, a 128-bit digest of it, the sub-keys; equal sets become one class.
2. classes → table keys; per key the smallest id (hub) and the count, keys of one class drop out.
3. every member is compared with its hubs, links are confirmed on full sets, components are formed.
4. keys whose members still lie in several components: members outside the key's largest component
   meet all members of other components, block by block. Sketches of SKETCH further minhashes, made
   for these documents only, rule out what is far from the threshold before a pair becomes a row (a
   pair of similarity 0.75 is lost with probability below 1e-5); the rest is confirmed on full sets.
   After this step every pair that shares a key is confirmed, refused or in one component.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import arrow_rows_of, small_batches, staged, texts

BROADCAST_IDS = 1_000_000  # 8 MB of ids
# 703 of 1024 and 338 of 512 are 4.7 standard deviations below 0.75.
SKETCH, SKETCH_LEAST, SKETCH_HALF_LEAST = 1024, 703, 338
BLOCK = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS_MOST = 150_000


class _WordHash(dict):
    """64-bit hash per word, kept between batches up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASH = _WordHash()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z in lower case; short texts are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    out = np.full(n, min(len(ids), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(ids))):
            out = (out ^ ids[k:k + n]) * _MIX
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _parameters(m: int, q: int, seed: int = 20260813) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    count = 2 * m * q
    return (rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, count, dtype=np.uint64))


def _minhash(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    best, step = None, max(64, 100_000 // len(mul))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), step):
            part = (shingles[at:at + step, None] * mul + add).min(axis=0)
            best = part if best is None else np.minimum(best, part)
    return best


def _sub_keys(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray, m: int, q: int) -> np.ndarray:
    """m keys of the first collection, then m of the second."""
    part = _minhash(shingles, mul, add).reshape(2 * m, q)
    key = np.arange(1, 2 * m + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            key = (key ^ part[:, k]) * _MIX
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(docs: DataFrame, m: int, q: int, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (h1, h2), first and second sub-keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _parameters(m, q)
        for batch in small_batches(batches):
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append((0, 0))
                    keys.append(None)
                    continue
                raw = shingles.tobytes()
                digests.append((xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, seed=1)))
                keys.append(_sub_keys(shingles, mul, add, m, q))
            both = np.array(digests, np.uint64).view(np.int64).reshape(-1, 2)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()),
                pa.array(both[:, 0]), pa.array(both[:, 1]),
                pa.array([None if k is None else k[:m] for k in keys], kind),
                pa.array([None if k is None else k[m:] for k in keys], kind)],
                names=["doc_id", "n_shingles", "h1", "h2", "first", "second"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, "
                                "first array<long>, second array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids (one column, `id`)."""
    ids = staged(ids, "neardup-ids")
    if ids.count() <= BROADCAST_IDS:  # checked size; beyond it texts are shuffled to the ids
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the documents in ids, built again from their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())],
                                             names=["id", "shingles"])
    return _texts_of(docs, ids).mapInArrow(run, "id long, shingles binary")


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach den·|a∩b| >= num·|a∪b|."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                short, long = (a, b) if len(a) <= len(b) else (b, a)
                if den * len(short) < num * len(long):
                    keep.append(False)
                    continue
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                both = int((long[at] == short).sum())
                keep.append(den * both >= num * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = staged(_sets(docs, ids, width), "neardup-sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) of every id in edges (a, b): minimum labels with pointer jumping."""
    links = staged(edges.select("a", "b").union(edges.select("b", "a")), "neardup-links")
    labels = staged(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                    .select("id", F.least("id", "m").alias("comp")), "neardup-labels")
    while True:
        near = (links.join(labels.select(F.col("id").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        lower = (labels.join(near, "id")
                 .select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("low")))
        # the label's own label: chains halve with each round
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        step = staged(lower.join(jump, "low", "left")
                      .select("id", "old", F.least("low", F.coalesce("far", "low")).alias("comp")),
                      "neardup-labels")
        labels = step.select("id", "comp")
        if step.filter("old <> comp").limit(1).count() == 0:
            return labels


def _sketches(docs: DataFrame, ids: DataFrame, m: int, q: int, width: int) -> DataFrame:
    """rep, first (sub-keys), raw: all sub-keys and the low bytes of SKETCH further minhashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _parameters(m, q)
        more_mul, more_add = (x[:SKETCH] for x in _parameters(SKETCH, 1, 20260814))
        for batch in small_batches(batches):
            first, raw = [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                keys = _sub_keys(shingles, mul, add, m, q)
                sketch = (_minhash(shingles, more_mul, more_add) >> np.uint64(17)).astype(np.uint8)
                first.append(keys[:m])
                raw.append(keys.tobytes() + sketch.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.list_(pa.int64())), pa.array(raw, pa.binary())],
                names=["rep", "first", "raw"])
    return _texts_of(docs, ids).mapInArrow(run, "rep long, first array<long>, raw binary")


def _likely(left: np.ndarray, right: np.ndarray, table: int, m: int) -> np.ndarray:
    """Rows of right that first meet left in this table, share a second sub-key and have a close sketch.

    left: one row of (2m sub-keys, sketch) as bytes, right: many."""
    mine, keys = left[:16 * m].view(np.int64), right[:, :16 * m].view(np.int64)
    same = keys == mine
    at = np.flatnonzero(same[:, table] & ~same[:, :table].any(axis=1) & same[:, m:].any(axis=1))
    sketch = left[16 * m:]
    for length, least in ((SKETCH // 2, SKETCH_HALF_LEAST), (SKETCH, SKETCH_LEAST)):
        part = right[at, 16 * m:16 * m + length]
        at = at[np.count_nonzero(part == sketch[:length], axis=1) >= least]
    return at


def _block_pairs(opened: DataFrame, m: int) -> DataFrame:
    """Pairs (a, b) that share a table key but no component and whose sketches are close.

    opened: rep, comp, first, raw. A pair that shares a table key shares its first sub-key: members are
    grouped by that, dealt into blocks of about BLOCK, and blocks with members outside the group's
    largest component meet every block of the group. Only likely pairs become rows, once each.
    """
    entries = opened.select("rep", "comp", "raw", F.posexplode("first").alias("table", "sub"))
    groups = (entries.groupBy("table", "sub", "comp").agg(F.count("*").alias("c"))
              .groupBy("table", "sub").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"),
                                           F.sum("c").alias("n"))
              .filter("comps > 1").select("table", "sub", F.col("top.comp").alias("main"), "n"))
    dealt = (entries.join(staged(groups, "neardup-groups"), ["table", "sub"])
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
             .withColumn("outside", F.col("comp") != F.col("main")))
    blocks = staged(dealt.groupBy("table", "sub", "block").agg(
        F.collect_list(F.struct("rep", "comp", "raw")).alias("all"),
        F.expr("collect_list(struct(rep, comp, raw)) filter (where outside)").alias("some")), "neardup-blocks")
    x = blocks.filter("size(some) > 0").select("table", "sub", F.col("some").alias("x"))
    y = blocks.select("table", "sub", F.col("all").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = column[k].values
            raw = np.frombuffer(b"".join(rows.field("raw").to_pylist()), np.uint8)
            return (rows.field("rep").to_numpy(), rows.field("comp").to_numpy(), raw.reshape(len(rows), -1))
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for k in range(batch.num_rows):
                table = batch.column(0)[k].as_py()
                ids, comp, left = parts(batch.column(1), k)
                other, other_comp, right = parts(batch.column(2), k)
                for i in range(len(ids)):
                    at = _likely(left[i], right, table, m)
                    at = at[other_comp[at] != comp[i]]
                    found.append(np.sort(np.stack([np.full(len(at), ids[i]), other[at]], 1), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return (x.join(y, ["table", "sub"]).select("table", "x", "y").mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, m: int = 10,
                    q: int = 2, width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs.

    Null or wordless texts: no shingles, own component, kept. Rows without an id: component_id null,
    kept. Rows that repeat an id with the same text give one row each with the same answer. An empty
    table gives no rows. Other columns are not read.
    """
    source = texts(docs, id_col, text_col)
    sig = staged(signatures(source, m, q, width), "neardup-sig")
    known = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(known.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("first").alias("first"), F.first("second").alias("second")),
        "neardup-classes")
    keys = classes.select("rep", F.explode(F.expr(
        "flatten(transform(first, x -> transform(second, y -> xxhash64(x, y))))")).alias("key"))
    hubs = (keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    members = staged(keys.join(hubs, "key").select("key", "rep", "hub", "n"), "neardup-members")

    stars = staged(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
                   .distinct(), "neardup-stars")
    links = staged(confirmed(source, stars, width, num, den), "neardup-confirmed")
    comps = components(links)

    # keys of two members are settled by their star
    open_members = (members.filter("n > 2").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
                    .select("key", "rep", F.coalesce("comp", "rep").alias("comp")))
    open_keys = staged(open_members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
                       .filter("low <> high").select("key"), "neardup-open-keys")
    opened = staged(open_members.join(open_keys, "key").select("rep", "comp").distinct(), "neardup-open")
    sketches = _sketches(source, opened.select(F.col("rep").alias("id")), m, q, width)
    opened = staged(opened.join(sketches, "rep"), "neardup-open-sketches")
    with arrow_rows_of(source.sparkSession, 32):   # a row holds two blocks
        pairs = staged(_block_pairs(opened, m), "neardup-block-pairs")
    more = staged(pairs.join(stars, ["a", "b"], "left_anti"), "neardup-pairs")
    added = staged(confirmed(source, more, width, num, den), "neardup-confirmed")
    if added.limit(1).count():
        comps = components(links.union(added))

    final = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    return (sig.select("doc_id", "n_shingles", "h1", "h2").join(final, ["h1", "h2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp"))
                    .otherwise(F.col("doc_id")).alias("c"))
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def oracle_sql(table: str = "documents") -> str:
    """Exact links between all pairs that share a shingle, and their components, in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws FROM {table}),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.k + ny.k - c)),
e AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(k, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""
