"""Embedding analytics: centroids, similarities, neighbours and what is built on them."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from dawnscore.functions import vec
from dawnscore.operators import rank
from dawnscore.operators.scalars import attach

MAX_MATRIX_CELLS = 64_000_000  # 512 MB of doubles: the most a task may hold as a shared matrix


def centroids(df: DataFrame, keys: Sequence[str], emb: str = "emb", min_n: int = 1) -> DataFrame:
    """Mean vector per key by partial aggregation of whole vectors; keys with n < min_n drop out."""
    v = array_to_vector(F.col(emb))
    out = df.groupBy(*keys).agg(Summarizer.mean(v).alias("_m"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= min_n).select(*keys, "n", vector_to_array("_m").alias("centroid"))


def collect_matrix(df: DataFrame, label: str, emb: str) -> tuple[list, np.ndarray]:
    """A small vector table as labels and matrix; refuses one that could grow with the data."""
    dims = df.select(F.size(emb)).head()
    limit = max(1, MAX_MATRIX_CELLS // max(1, dims[0] if dims else 1))
    rows = df.select(label, emb).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} vectors for a shared matrix")
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def similarities(emb: Column, matrix: np.ndarray) -> Column:
    """Cosine of each row vector to every row of a small matrix, as one array column."""
    right = _unit(matrix).T

    @pandas_udf("array<double>")
    def sims(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(_unit(np.array(batch.tolist(), dtype=np.float64)) @ right))

    return sims(emb)


def centroid_similarity(df: DataFrame, cents: DataFrame, row_keys: Sequence[str],
                        emb: str = "emb", cls: str = "class",
                        classes: Sequence[str] | None = None) -> DataFrame:
    """Row x class cosines; wanted classes without a centroid give -1."""
    labels, matrix = collect_matrix(cents, cls, "centroid")
    missing = [c for c in (classes or []) if c not in set(labels)]
    names = F.array(*[F.lit(c) for c in [*labels, *missing]])
    sims = F.concat(similarities(F.col(emb), matrix),
                    F.array_repeat(F.lit(-1.0), len(missing)))
    return (df.select(*row_keys, F.arrays_zip(names.alias("c"), sims.alias("s")).alias("_z"))
            .select(*row_keys, F.explode("_z").alias("_z"))
            .select(*row_keys, F.col("_z.c").alias("class"), F.col("_z.s").alias("cos")))


def with_unit(df: DataFrame, emb: str = "emb", out: str = "unit") -> DataFrame:
    return df.withColumn(out, vec.unit(F.col(emb)))


def centred(df: DataFrame, keys: Sequence[str], emb: str = "emb", out: str = "unit") -> DataFrame:
    """Minus the mean vector of the group, renormalised."""
    c = centroids(df, keys, emb).drop("n")
    return (df.join(c, list(keys)).withColumn("_d", vec.minus(F.col(emb), F.col("centroid")))
            .withColumn(out, vec.unit(F.col("_d"))).drop("_d", "centroid"))


# --- exact nearest neighbours ---

def _top_pairs(q: pd.DataFrame, t: pd.DataFrame, k: int, exclude: Sequence[str]) -> pd.DataFrame:
    """Best k eligible targets for every query of one block pair.

    Targets pass in ascending order of their ids, so that a later one counts only with a larger similarity
    than a query's k-th so far: most of a product is compared with that bound and never sorted.
    """
    cols = {"q_id": [], "t_id": [], "sim": []}
    if len(q) and len(t):
        t = t.iloc[np.argsort(t["_id"].to_numpy(), kind="stable")]
        tm, t_ids = np.array(t["_u"].tolist()), t["_id"].to_numpy()
        other = [t[c].to_numpy() for c in exclude]
        for start in range(0, len(q), 256):
            part = q.iloc[start:start + 256]
            qm, q_ids = np.array(part["_u"].tolist()), part["_id"].to_numpy()
            own = [part[c].to_numpy() for c in exclude]
            val, at = np.full((len(part), k), -np.inf), np.full((len(part), k), len(t))
            first, width = 0, 64
            while first < len(t):
                sims = qm @ tm[first:first + width].T
                r, c = np.divmod(np.flatnonzero(sims > (val[:, -1] + 4.9e-10)[:, None]), sims.shape[1])
                v = np.round(sims[r, c], 9)
                c = c + first
                ok = (v > val[r, -1]) & (t_ids[c] != q_ids[r])
                for mine, theirs in zip(own, other, strict=True):
                    ok &= mine[r] != theirs[c]
                r, c, v = r[ok], c[ok], v[ok]
                if len(r):
                    better = np.unique(r)
                    r, c = np.r_[r, np.repeat(better, k)], np.r_[c, at[better].ravel()]
                    v = np.r_[v, val[better].ravel()]
                    order = np.lexsort((c, -v, r))
                    place = np.arange(len(r)) - np.searchsorted(r[order], r[order])
                    order = order[place < k].reshape(len(better), k)
                    val[better], at[better] = v[order], c[order]
                first, width = first + width, min(2 * width, 2048)
            ok = np.isfinite(val)
            cols["q_id"].append(np.repeat(q_ids, ok.sum(axis=1)))
            cols["t_id"].append(t_ids[at[ok]])
            cols["sim"].append(val[ok])
    return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in cols.items()})


def _best(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial lists; each query has at most k rows per target block."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("n"), "t_id"))), 1, k)
    return (partial.groupBy("q_id").agg(top.alias("_t"))
            .select("q_id", F.posexplode("_t").alias("p", "e"))
            .select("q_id", F.col("e.t_id").alias("t_id"), (-F.col("e.n")).alias("sim"),
                    (F.col("p") + 1).alias("place")))


def knn(df: DataFrame, key: str, k: int, emb: str = "emb", exclude: Sequence[str] = (),
        block: int = 4096, max_cells: int = 1024, n_probe: int | None = None,
        queries: Column | None = None) -> DataFrame:
    """k nearest by cosine, never the row itself nor rows equal in an exclude column; keys of any type.

    queries: condition on the rows that ask (all rows if none); all rows can be found. forest.index_knn
    gives the same columns through an index, in proportion to the rows.

    Queries and targets are dealt by the hash of their ids into blocks of at most about 8 * `block` rows; every
    pair of blocks is one group, whose task holds the two and returns at most k rows per query. The number of
    similarities is queries x rows, memory and rows of a task are bounded, and rows move once per block of the
    other side. n_probe limits a vector to its nearest so many cells around pivots (of at most max_cells cells),
    at the price of recall (None: exact). Returns (q_id, t_id, sim, place).
    """
    exclude = list(exclude)
    cols = ["_id", *exclude, "_u", "_asks"]
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    kind = "bigint" if whole else kind.simpleString()
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    base = df.select(F.col(key).cast(kind).alias("_id"), *exclude, vec.unit(F.col(emb)).alias("_u"), asks.alias("_asks"))
    base = base.filter("_u is not null")
    n, n_asks = base.agg(F.count(F.lit(1)), F.count_if("_asks")).first()
    n_cells = int(min(max_cells, max(1, n // block)))
    pairs = f"q_id {kind}, t_id {kind}, sim double"
    if 0 < n <= block:  # one block: nothing lies outside it
        return _best(base.groupBy().applyInPandas(
            lambda pdf: _top_pairs(pdf[pdf["_asks"]], pdf, k, exclude), pairs), k)
    if n == 0:
        return base.select(F.col("_id").alias("q_id"), F.col("_id").alias("t_id"), F.lit(0.0).alias("sim"),
                           F.lit(1).alias("place"))
    if n_probe is None:
        per = 8 * block
        n_q = max(-(-n_asks // per), min(8, -(-n_asks // block)), 1)
        n_t = -(-n // per)

        def dealt(salt: int, into: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(salt), "_id"), F.lit(into)).cast("int")

        def each(into: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(into - 1)))
        mine = base.filter("_asks").select(*cols[:-1], dealt(11, n_q).alias("_q"), each(n_t).alias("_t"))
        # aliases give the other side its own attributes; both sides come from one table
        theirs = base.select(*[F.col(c).alias(c) for c in cols[:-1]], dealt(7, n_t).alias("_t"), each(n_q).alias("_q"))
        found = mine.groupBy("_q", "_t").cogroup(theirs.groupBy("_q", "_t")).applyInPandas(
            lambda q, t: _top_pairs(q, t, k, exclude), pairs)
        return _best(found, k)
    pivots = base.orderBy(F.xxhash64("_id"), "_id").limit(n_cells)
    _, pm = collect_matrix(pivots, "_id", "_u")
    near = base.withColumn("_s", similarities(F.col("_u"), pm))
    best = F.array_max("_s")
    near = near.withColumn("_cell", F.array_position("_s", best).cast("int") - 1)
    dist = F.sqrt(F.greatest(2 - 2 * best, F.lit(0.0)))
    cells = (near.withColumn("_d", dist).groupBy("_cell")
             .agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_r")).collect())  # <= max_cells
    subs = {r["_cell"]: max(1, -(-r["_n"] // block)) for r in cells}
    radius = {r["_cell"]: r["_r"] for r in cells}
    sub_of = F.create_map(*[F.lit(x) for c in subs for x in (c, subs[c])])
    near = near.withColumn("_sub", F.pmod(F.xxhash64(F.lit(7), "_id"),
                                          F.element_at(sub_of, F.col("_cell"))).cast("int"))
    targets = near.select(*cols, "_cell", "_sub")
    first = targets.groupBy("_cell", "_sub").applyInPandas(
        lambda pdf: _top_pairs(pdf[pdf["_asks"]], pdf, k, exclude), pairs)
    kth = first.groupBy("q_id").agg(F.min("sim").alias("_kth"), F.count(F.lit(1)).alias("_got"))
    n_pivots = len(pm)
    radii = np.array([radius.get(c, -1.0) for c in range(n_pivots)])

    @pandas_udf("array<int>")
    def reachable(sims: pd.Series, kth_sim: pd.Series) -> pd.Series:
        if len(sims) == 0:
            return pd.Series([], dtype=object)
        d = np.sqrt(np.maximum(2 - 2 * np.array(sims.tolist()), 0))
        bound = np.sqrt(np.maximum(2 - 2 * kth_sim.to_numpy(dtype=float), 0))
        hit = (d - radii[None, :] <= bound[:, None] + 1e-6) & (radii >= 0)[None, :]
        if n_probe < hit.shape[1]:
            far = np.argsort(d, axis=1, kind="stable")[:, n_probe:]
            np.put_along_axis(hit, far, False, axis=1)
        return pd.Series([np.flatnonzero(h).astype(np.int32) for h in hit])

    asking = near.filter("_asks").join(kth, near["_id"] == kth["q_id"], "left").drop("q_id")
    bound = F.when(F.col("_got") >= k, F.col("_kth")).otherwise(F.lit(-1.0))
    visits = (asking.withColumn("_bound", bound)
              .select(*cols, F.col("_cell").alias("_own"), F.col("_sub").alias("_own_sub"),
                      F.explode(reachable("_s", "_bound")).alias("_cell"))
              .withColumn("_sub", F.explode(F.sequence(F.lit(0),
                                                       F.element_at(sub_of, F.col("_cell")) - 1)))
              .filter(~((F.col("_cell") == F.col("_own")) & (F.col("_sub") == F.col("_own_sub")))))
    n_chunk = max(1, -(-n // block))
    # a block may be visited by many queries: cut them in chunks and copy the block to each chunk
    chunk = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(n_chunk)).cast("int")
    visits = visits.withColumn("_chunk", chunk)
    wanted = visits.select("_cell", "_sub", "_chunk").distinct()
    copies = targets.join(wanted, ["_cell", "_sub"])
    unit_keys = ["_cell", "_sub", "_chunk"]
    # aliases give the copied side its own attributes; both sides come from one table
    copies = copies.select(*[F.col(c).alias(c) for c in (*cols, *unit_keys)])
    second = (visits.select(*cols, *unit_keys).groupBy(*unit_keys)
              .cogroup(copies.groupBy(*unit_keys))
              .applyInPandas(lambda q, t: _top_pairs(q, t, k, exclude), pairs))
    return _best(first.unionByName(second), k)


def neighbour_table(nn: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Neighbour list with the neighbour's own columns (prefixed t_) and the query's."""
    mine = rows.select(F.col(key).alias("q_id"), *columns)
    theirs = rows.select(F.col(key).alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return nn.join(theirs, "t_id").join(mine, "q_id")


def label_agreement(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Share of neighbours with a common label (mean over rows) and coverage."""
    per = table.groupBy("q_id").agg(F.avg(F.arrays_overlap("lbls", "t_lbls").cast("double")).alias("a"))
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    found = per.agg(F.avg("a").alias("agreement"), F.count(F.lit(1)).alias("_c"))
    return (attach(found, total)
            .select("agreement", (F.col("_c") / F.col("_n")).alias("coverage")))


def random_pair_agreement(rows: DataFrame, key: str, seed: int = 0,
                          per_bucket: int = 100_000) -> DataFrame:
    """Chance level: each row against the next one in a seeded order inside hash buckets."""
    buckets = max(1, rows.count() // per_bucket)
    h = F.xxhash64(F.lit(seed), key)
    w = Window.partitionBy("_b").orderBy("_h", key)
    pairs = (rows.withColumn("_h", h).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(buckets)))
             .withColumn("_o", F.lead("lbls").over(w)).filter("_o is not null"))
    return pairs.agg(F.avg(F.arrays_overlap("lbls", "_o").cast("double")).alias("agreement"),
                     F.count(F.lit(1)).alias("n_pairs"))


def jaccard_disagreement(table: DataFrame, rows: DataFrame, key: str, lists: str = "lbls") -> DataFrame:
    """1 - mean Jaccard similarity to the neighbours' label sets; no neighbour gives 0.5."""
    inter = F.size(F.array_intersect(lists, f"t_{lists}"))
    union = F.greatest(F.size(F.array_union(lists, f"t_{lists}")), F.lit(1))
    per = table.groupBy("q_id").agg((1 - F.avg(inter / union)).alias("score"))
    return (rows.select(F.col(key).alias("q_id")).join(per, "q_id", "left")
            .withColumn("score", F.coalesce("score", F.lit(0.5))))


def flip_labels(rows: DataFrame, key: str, classes: Sequence[str], share: float = 0.15,
                seed: int = 0) -> DataFrame:
    """Seeded faults: chosen rows lose one label and gain another; flag is_flipped."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1e6
    drop_at = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.size("lbls")).cast("int") + 1
    free = F.array_except(F.array(*[F.lit(c) for c in classes]), F.col("lbls"))
    add = F.try_element_at("_free", F.pmod(F.xxhash64(F.lit(seed + 2), key),
                                           F.greatest(F.size("_free"), F.lit(1))).cast("int") + 1)
    kept = F.array_except("lbls", F.array(F.element_at("lbls", drop_at)))
    return (rows.withColumn("_free", free).withColumn("is_flipped", (h < share).cast("int"))
            .withColumn("flipped", F.when(F.col("is_flipped") == 1, F.array_compact(
                F.concat(kept, F.array(add)))).otherwise(F.col("lbls"))).drop("_free"))


def recover_hidden(nn: DataFrame, rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Hide one label per row; neighbours vote, the row's known labels excluded; top-1/top-3 hits."""
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.size("lbls")).cast("int") + 1
    hid = (rows.withColumn("hidden", F.element_at("lbls", at))
           .withColumn("known", F.array_except("lbls", F.array("hidden"))))
    mine = hid.select(F.col(key).alias("q_id"), "hidden", "known")
    votes = (nn.join(rows.select(F.col(key).alias("t_id"), "lbls"), "t_id")
             .select("q_id", F.explode("lbls").alias("label")).groupBy("q_id", "label")
             .agg(F.count(F.lit(1)).alias("n"))
             .join(mine, "q_id").filter(~F.array_contains("known", F.col("label"))))
    w = Window.partitionBy("q_id").orderBy(F.desc("n"), "label")
    placed = votes.withColumn("place", F.row_number().over(w))
    hit = placed.filter(F.col("label") == F.col("hidden")).select("q_id", "place")
    return mine.join(hit, "q_id", "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.coalesce("place", F.lit(99)) <= 1).cast("double")).alias("top1"),
        F.avg((F.coalesce("place", F.lit(99)) <= 3).cast("double")).alias("top3"))


def recall_at_k(table: DataFrame, k: int, abundant: int = 20, rare: int = 10) -> DataFrame:
    """Per class: mean share of the k neighbours of its rows that carry the class too."""
    hits = (table.select("q_id", "t_lbls", F.explode("lbls").alias("class"))
            .groupBy("class", "q_id")
            .agg(F.sum(F.array_contains("t_lbls", F.col("class")).cast("int")).alias("h")))
    out = hits.groupBy("class").agg((F.avg("h") / k).alias("recall"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("grp", F.when(F.col("n") >= abundant, "abundant")
                          .when(F.col("n") <= rare, "rare").otherwise("mid"))


def leave_one_out_distance(df: DataFrame, keys: Sequence[str], emb: str = "emb") -> DataFrame:
    """1 - cosine to the class mean, taken without the row itself when it is a true member.

    (n * mean - x) / (n - 1) gives the reduced mean without a second pass; non-members use the mean.
    """
    cents = centroids(df.filter("is_tp = 1"), keys, emb)
    d = df.join(cents, list(keys))
    n = F.col("n").cast("double")
    loo = vec.blend(F.col("centroid"), F.col(emb), n / (n - 1), -1 / (n - 1))
    ref = F.when((F.col("is_tp") == 1) & (F.col("n") > 1), loo).otherwise(F.col("centroid"))
    d = d.withColumn("_ref", vec.unit(ref)).withColumn("_u", vec.unit(F.col(emb)))
    return d.withColumn("dist", F.round(1 - vec.dot(F.col("_u"), F.col("_ref")), 9)).drop("_ref", "_u")


def class_correlation(df: DataFrame, row_keys: Sequence[str], score: str,
                      classes: Sequence[str], top: int = 5) -> DataFrame:
    """Pearson between class columns; every partition adds up one classes x classes product."""
    classes = list(classes)
    c = len(classes)
    index = F.create_map(*[x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(i))])
    entry = F.struct(F.element_at(index, F.col("class")).alias("slot"),
                     F.col(score).cast("double").alias("v"))
    rows = df.groupBy(*row_keys).agg(F.array_sort(F.collect_list(entry)).alias("_m"))
    full = rows.select(vec.dense(F.col("_m"), c, F.lit(0.0)).alias("x"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, s, n = np.zeros((c, c)), np.zeros(c), 0
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist())
                g, s, n = g + x.T @ x, s + x.sum(axis=0), n + len(x)
        i, j = np.divmod(np.arange(c * c), c)
        yield pd.DataFrame({"i": i, "j": j, "sxy": g.ravel(), "sx": s[i], "sy": s[j],
                            "sxx": np.diag(g)[i], "syy": np.diag(g)[j], "n": float(n)})

    t = (full.mapInPandas(products, "i int, j int, sxy double, sx double, sy double, sxx double, "
                          "syy double, n double").groupBy("i", "j")
         .agg(*[F.sum(k).alias(k) for k in ("sxy", "sx", "sy", "sxx", "syy", "n")]))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = ((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
           * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    names = F.array(*[F.lit(k) for k in classes])
    r = t.filter("i <> j").select(
        F.element_at(names, F.col("i") + 1).alias("class"),
        F.element_at(names, F.col("j") + 1).alias("partner"),
        F.when(var > 1e-18, cov / F.sqrt(var)).alias("r"))
    w = Window.partitionBy("class").orderBy(F.desc("r"), "partner")
    return r.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def within_between(df: DataFrame, cls: str = "class", emb: str = "emb") -> DataFrame:
    """Mean cosine inside each class and to all other rows, from summed unit vectors only."""
    u = with_unit(df, emb)
    per = centroids(u, [cls], "unit")
    tot = centroids(u, [], "unit").select(F.col("n").alias("_N"), F.col("centroid").alias("_T"))
    d = attach(per, tot)
    n, big = F.col("n").cast("double"), F.col("_N").cast("double")
    own = n * n * vec.dot(F.col("centroid"), F.col("centroid"))
    cross = n * big * vec.dot(F.col("centroid"), F.col("_T")) - own
    # the n self pairs have cosine 1 up to the norm guard
    return d.select(cls, "n", F.when(n > 1, (own - n) / (n * (n - 1))).alias("within"),
                    F.when(big > n, cross / (n * (big - n))).alias("between")).withColumn(
        "gap", F.col("within") - F.col("between"))


def statistics(df: DataFrame, keys: Sequence[str], emb: str = "emb") -> DataFrame:
    """L2, max |x|, variance, participation ratio, Gini of |x|, excess kurtosis."""
    d = df.select(*keys, F.transform(emb, lambda x: x.cast("double")).alias("_x"))
    n = F.size("_x").cast("double")
    x = F.col("_x")

    def moment(k):
        return vec.fold(F.transform("_x", lambda v: F.pow(v - F.col("_mean"), F.lit(float(k))))) / n
    d = d.withColumn("_mean", vec.fold(x) / n).withColumn("_l2", vec.norm(x))
    d = d.withColumn("_var", moment(2)).withColumn("_s", F.array_sort(F.transform("_x", lambda v: F.abs(v))))
    four = vec.fold(F.transform("_x", lambda v: v * v * v * v))
    gini = vec.fold(F.transform("_s", lambda v, i: (2 * (i + 1) - n - 1) * v)) / (
        n * vec.fold(F.col("_s")) + 1e-12)
    return d.select(*keys, F.col("_l2").alias("l2"), F.element_at("_s", -1).alias("max_abs"),
                    F.col("_var").alias("var"), (F.pow("_l2", F.lit(4.0)) / (four + 1e-12)).alias("pr"),
                    gini.alias("gini"),
                    (moment(4) / (F.col("_var") * F.col("_var") + 1e-12) - 3).alias("kurtosis"))


def pool_diversity(df: DataFrame, pool: str, emb: str = "emb") -> DataFrame:
    c = centroids(df, [pool], emb)
    d = df.select(pool, emb).join(c, pool)
    gap = vec.norm(vec.minus(F.col(emb), F.col("centroid")))
    return d.groupBy(pool).agg(F.avg(gap).alias("mean_dist"), F.count(F.lit(1)).alias("n"))


def group_distance_ratio(df: DataFrame, keys: Sequence[str], fit: Column, positive: Column,
                         emb: str = "emb") -> DataFrame:
    """Euclidean distance to the mean vectors of two row groups (fit rows only) and their ratio."""
    means = centroids(df.filter(fit).withColumn("_g", positive.cast("int")), ["_g"], emb)
    one = means.agg(F.max(F.when(F.col("_g") == 1, F.col("centroid"))).alias("_p"),
                    F.max(F.when(F.col("_g") == 0, F.col("centroid"))).alias("_q"))
    d = attach(df, one)
    return d.select(*keys, vec.norm(vec.minus(F.col(emb), F.col("_p"))).alias("d_pos"),
                    vec.norm(vec.minus(F.col(emb), F.col("_q"))).alias("d_neg")).withColumn(
        "ratio", F.col("d_pos") / (F.col("d_neg") + 1e-6))


def composite_suspicion(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Mean of the unit-ranked signals."""
    r = rank.add_ranks(df, [], {s: f"r_{s}" for s in signals}, "unit")
    total = sum((F.col(f"r_{s}") for s in signals[1:]), F.col(f"r_{signals[0]}"))
    return r.withColumn("suspicion", total / len(signals))


def impostor_auc(distances: DataFrame, cls: str = "class", min_tp: int = 5,
                 min_imp: int = 3) -> DataFrame:
    """AUC of the distance for telling wrong firings (is_tp = 0) from true ones, per class."""
    from dawnscore.operators import metrics
    d = distances.withColumn("_imp", 1 - F.col("is_tp"))
    out = metrics.auc(d, [cls], "dist", "_imp")
    return (out.filter((F.col("n_neg") >= min_tp) & (F.col("n_pos") >= min_imp))
            .select(cls, F.col("n_neg").alias("n_tp"), F.col("n_pos").alias("n_imp"), "auc"))


def impostor_summary(per_class: DataFrame) -> DataFrame:
    return per_class.agg(
        F.count(F.lit(1)).alias("n_classes"), F.avg("auc").alias("mean_auc"),
        F.median("auc").alias("median_auc"),
        (F.sum(F.col("auc") * F.col("n_imp")) / F.sum("n_imp")).alias("weighted_auc"),
        F.avg((F.col("auc") > 0.5).cast("double")).alias("share_over_half"))


def ambiguous_vote(nn: DataFrame, rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Rows flagged is_ambiguous: argmax of the neighbours' mean class score; share correct."""
    ask = rows.filter("is_ambiguous").select(F.col(key).alias("q_id"))
    votes = (nn.join(ask, "q_id", "left_semi")
             .join(scores.select(F.col(key).alias("t_id"), "class", "p"), "t_id")
             .groupBy("q_id", "class").agg(F.avg("p").alias("v")))
    pick = votes.groupBy("q_id").agg(F.max_by("class", F.struct(F.round("v", 9), F.col("class"))).alias("class"))
    truth = scores.select(F.col(key).alias("q_id"), "class", "y")
    return pick.join(truth, ["q_id", "class"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.coalesce("y", F.lit(0)).cast("double")).alias("accuracy"))


def confusion_targets(table: DataFrame, unmapped: Sequence[str], min_pos: int = 3,
                      top: int = 3) -> DataFrame:
    """For unmapped classes: the mapped labels most common among the neighbours of their rows."""
    is_unmapped = F.col("class").isin(*unmapped)
    pairs = (table.select("q_id", F.explode("lbls").alias("class"), "t_lbls").filter(is_unmapped)
             .select("q_id", "class", F.explode("t_lbls").alias("target"))
             .filter(~F.col("target").isin(*unmapped)))
    n_pos = (table.select("q_id", F.explode("lbls").alias("class")).filter(is_unmapped).distinct()
             .groupBy("class").agg(F.count(F.lit(1)).alias("n_pos")))
    w = Window.partitionBy("class").orderBy(F.desc("n"), "target")
    return (pairs.groupBy("class", "target").agg(F.count(F.lit(1)).alias("n"))
            .join(n_pos.filter(F.col("n_pos") >= min_pos), "class")
            .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top))


def covariance(df: DataFrame, emb: str = "emb") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and sample covariance; partitions add up dims x dims products, the sum is checked."""
    first = df.select(F.size(emb)).head()
    dims = first[0]
    if dims * dims > MAX_MATRIX_CELLS:
        raise ValueError(f"{dims} dimensions are too many for a shared covariance")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, s, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for b in batches:
            if len(b):
                x = np.array(b["x"].tolist(), dtype=np.float64)
                g, s, n = g + x.T @ x, s + x.sum(axis=0), n + len(x)
        if n:
            yield pd.DataFrame({"i": np.arange(dims), "row": list(g), "s": s, "n": float(n)})

    parts = df.select(F.col(emb).alias("x")).mapInPandas(
        partial, "i int, row array<double>, s double, n double")
    rows = (parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("_r"),
                                   F.sum("s").alias("s"), F.sum("n").alias("n"))
            .select("i", vector_to_array("_r").alias("row"), "s", "n").orderBy("i").collect())
    n = int(rows[0]["n"])
    mean = np.array([r["s"] for r in rows]) / n
    gram = np.array([r["row"] for r in rows])
    return mean, (gram - n * np.outer(mean, mean)) / (n - 1), n


def mahalanobis(df: DataFrame, fit: DataFrame, keys: Sequence[str], emb: str = "emb",
                shrink: float = 0.1) -> DataFrame:
    """Squared distance to the fit rows under a shrunk covariance, and a decaying weight."""
    mean, cov, _ = covariance(fit, emb)
    cov = (1 - shrink) * cov + shrink * np.diag(cov).mean() * np.eye(len(cov))
    inv = np.linalg.pinv(cov)

    @pandas_udf("double")
    def distance(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=float)
        d = np.array(batch.tolist(), dtype=np.float64) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", d, inv, d))

    out = df.select(*keys, distance(F.col(emb)).alias("dist"))
    p90 = rank.global_quantile(fit.select(distance(F.col(emb)).alias("dist")), "dist", "p90", 0.9)
    return attach(out, p90).select(
        *keys, "dist", F.exp(-F.greatest(F.col("dist") - F.col("p90"), F.lit(0.0)) / F.col("p90")).alias("weight"))


def pca(df: DataFrame, keys: Sequence[str], k: int, emb: str = "emb") -> DataFrame:
    """Standardise, then project to k components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    v = df.withColumn("_v", array_to_vector(emb))
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_z", withMean=True),
                             PCA(k=k, inputCol="_z", outputCol="features")]).fit(v)
    return model.transform(v).select(*keys, "features")


def expected_information(a: int, b: int, whole: int) -> float:
    """Expected summand of mutual information in one cell of a table with fixed margins a and b (hypergeometric).

    The probabilities come from the ratio of neighbours, from the most likely count outwards; what lies
    more than 40 standard deviations off it is below double precision.
    """
    low, high = max(0, a + b - whole), min(a, b)
    mode = min(max((a + 1) * (b + 1) // (whole + 2), low), high)
    spread = 40 * int(np.sqrt(a / whole * b / whole * (whole - a) * (whole - b) / max(whole - 1, 1))) + 60
    n = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    # a, b and whole as floats: their products pass 2^63
    fa, fb, fw = float(a), float(b), float(whole)
    steps = np.log((fa - n[:-1]) * (fb - n[:-1])) - np.log(n[1:] * (fw - fa - fb + n[1:]))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    p /= p.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(n > 0, n / fw * (np.log(n) + np.log(fw) - np.log(fa) - np.log(fb)), 0.0)
    return float((p * part).sum())


def presence_information(df: DataFrame, group: str, cls: str = "class", min_pos: int = 1) -> DataFrame:
    """Groups (clusters) against the presence of each class: mutual information, normalised and adjusted.

    adjusted = (mi - expected) / (mean of both entropies - expected), expected being the exact mean over
    all tables with the same margins, summed once per distinct pair of margins. Classes that every row has,
    or with fewer than min_pos rows, drop out.
    """
    cells = df.groupBy(group, cls).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(group).agg(F.sum("n").alias("a"))
    positives = cells.groupBy(F.col(cls).alias("_c")).agg(F.sum("n").alias("b"))
    total = sizes.agg(F.sum("a").alias("w"), F.count(F.lit(1)).alias("k"))
    x = F.col("a") / F.col("w")
    of_groups = attach(sizes, total).agg((-F.sum(x * F.log(x))).alias("hg"))
    # all pairs of group sizes and class sizes that occur, each once, with the number of groups of a size
    sized = sizes.groupBy("a").agg(F.count(F.lit(1)).alias("m"))

    @pandas_udf("double")
    def chance(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([expected_information(int(i), int(j), int(k)) + expected_information(int(i), int(k) - int(j), int(k))
                          for i, j, k in zip(a, b, w)], dtype=float)
    held = F.collect_list(F.struct("a", "m")).alias("_sizes")   # distinct sizes: no more than groups, nor the root of twice the rows
    pairs = attach(positives.select("b").distinct(), sized.agg(held)).select("b", F.explode("_sizes").alias("_s"))
    pairs = attach(pairs.select("b", "_s.a", "_s.m"), total).filter("b < w")
    expected = pairs.repartition("a", "b").withColumn("e", F.col("m") * chance("a", "b", "w")).groupBy(F.col("b").alias("_b")).agg(
        F.sum("e").alias("expected"))
    t = attach(cells.join(sizes, group).join(positives, F.col(cls) == F.col("_c")), total)
    n, a, b, w = (F.col(c).cast("double") for c in ("n", "a", "b", "w"))
    with_ = n / w * F.log(n * w / (a * b))
    rest = F.when((a > n) & (w > b), (a - n) / w * F.log((a - n) * w / (a * (w - b)))).otherwise(F.lit(0.0))
    per = t.groupBy(cls).agg(F.sum(with_ + rest).alias("_mi"), F.sum("a").alias("_seen"), F.max("b").alias("n_pos"), F.max("w").alias("_w"))
    per = attach(per.filter((F.col("n_pos") < F.col("_w")) & (F.col("n_pos") >= min_pos)), of_groups)
    left = (F.col("_w") - F.col("_seen")) / F.col("_w")  # groups without the class at all
    p = F.col("n_pos") / F.col("_w")
    out = (per.withColumn("mi", F.col("_mi") + left * F.log(F.col("_w") / (F.col("_w") - F.col("n_pos"))))
           .withColumn("_h", -(p * F.log(p) + (1 - p) * F.log(1 - p))).join(expected, F.col("n_pos") == F.col("_b")))
    mean_h = (F.col("_h") + F.col("hg")) / 2
    return out.select(cls, "n_pos", "mi", (F.col("mi") / F.col("_h")).alias("nmi"),
                      F.try_divide(F.col("mi") - F.col("expected"), mean_h - F.col("expected")).alias("adjusted"))


def cluster_information(df: DataFrame, k: int, cls: str = "class", emb: str = "emb",
                        seed: int = 0, min_pos: int = 10) -> DataFrame:
    """presence_information of k-means clusters, for classes with at least min_pos rows."""
    from pyspark.ml.clustering import KMeans
    v = df.withColumn("features", array_to_vector(emb))
    found = KMeans(k=k, seed=seed).fit(v).transform(v).select("prediction", cls)
    return presence_information(found, "prediction", cls, min_pos)


def silhouette(df: DataFrame, group: str, k: int = 32, emb: str = "emb") -> DataFrame:
    """Silhouette of a grouping (site) in PCA space."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    coded = df.withColumn("prediction", F.col(group).cast("double"))
    value = ClusteringEvaluator().evaluate(pca(coded, ["prediction"], k, emb))
    return df.sparkSession.range(1).select(F.lit(group).alias("grouping"), F.lit(value).alias("silhouette"))


def pool_gaps(df: DataFrame, pool: str, emb: str = "emb") -> DataFrame:
    """Distance between the pool means, pool pairs once; the means are a small checked matrix."""
    labels, m = collect_matrix(centroids(df, [pool], emb), pool, "centroid")
    d = np.sqrt(np.maximum(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2), 0)) if len(m) < 2000 else None
    if d is None:
        raise ValueError("too many pools to compare pairwise")
    rows = [(a, b, float(d[i, j])) for i, a in enumerate(labels) for j, b in enumerate(labels) if i < j]
    kind = df.schema[pool].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"s1 {kind}, s2 {kind}, gap double")
