"""Neighbour search by an index: a forest of projection trees, several leaves a query, exact cosines.

The trees are fitted on a bounded sample (SAMPLE_ROWS rows, INDEX_CELLS numbers in all trees): a node
splits its sample rows at the median of their projections on the line between two of them. Where the
sample is used up before leaves are small enough, further bits split a leaf by common directions at the
leaf's own medians, so leaves stay near `leaf` rows at any number of rows while the index keeps its size.
Every row stands in one leaf of each tree. A query visits its own leaf in each tree and the leaves it
would reach if one of its closest decisions had gone the other way; what it meets there is compared by
exact cosine. The work is rows x trees x probes x leaf: in proportion to the rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from dawnscore.functions import vec
from dawnscore.operators import vectors

SAMPLE_ROWS = 100_000
INDEX_CELLS = 8_000_000          # numbers in the sample, and in the directions of all trees: 32 MB of floats each
LEAST_SAMPLE = 16                # sample rows in a leaf of the fitted part
MOST_BLOCKS = 8                  # blocks of an oversized leaf that one query visits


@dataclass
class Tree:
    """Nodes in one array; a node without children is a leaf. `bits` directions split each leaf further."""
    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray          # (nodes, 2), -1 for leaves
    depth: int
    more: np.ndarray              # (bits, dims)
    medians: np.ndarray           # (nodes, bits)

    def route(self, x: np.ndarray, flip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leaf number of every row, and its distance to each decision taken (infinite where none was).

        flip: per row the decision (level, or depth + bit) that goes the other way.
        """
        node = np.zeros(len(x), np.int64)
        bits = len(self.more)
        margins = np.full((len(x), self.depth + bits), np.inf, np.float32)
        for level in range(self.depth):
            inner = np.flatnonzero(self.children[node, 0] >= 0)
            at = node[inner]
            gap = np.einsum("ij,ij->i", x[inner], self.directions[at]) - self.thresholds[at]
            margins[inner, level] = np.abs(gap)
            right = gap > 0
            if flip is not None:
                right ^= flip[inner] == level
            node[inner] = self.children[at, right.astype(np.int64)]
        code = np.zeros(len(x), np.int64)
        if bits:
            gap = x @ self.more.T - self.medians[node]
            margins[:, self.depth:] = np.abs(gap)
            right = gap > 0
            if flip is not None:
                right ^= flip[:, None] == self.depth + np.arange(bits)
            code = right @ (1 << np.arange(bits))
        return node << bits | code, margins

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, probes): the own leaf, then those behind the closest single decisions; -1 where there are no more."""
        own, margins = self.route(x)
        out = np.full((len(x), probes), -1, np.int64)
        out[:, 0] = own
        closest = np.argsort(margins, axis=1, kind="stable")[:, :probes - 1]
        for p in range(closest.shape[1]):
            leaf, _ = self.route(x, closest[:, p])
            out[:, p + 1] = np.where(np.isfinite(margins[np.arange(len(x)), closest[:, p]]), leaf, -1)
        return out


def grow(sample: np.ndarray, rows: int, leaf: int, nodes: int, rng: np.random.Generator) -> Tree:
    """One tree over `sample`, which stands for `rows` rows; `nodes` bounds its size."""
    dims = sample.shape[1]
    scale = rows / max(1, len(sample))
    directions, thresholds, children, depth = [np.zeros(dims, np.float32)], [0.0], [[-1, -1]], 0
    members = {0: np.arange(len(sample))}
    level, largest = [0], 0.0
    while level and len(directions) < nodes:
        following = []
        for node in level:
            its = members[node]
            if len(its) * scale <= leaf or len(its) < 2 * LEAST_SAMPLE or len(directions) + 2 > nodes:
                continue
            a, b = sample[rng.choice(its, 2, replace=False)]
            direction = (a - b) / max(float(np.linalg.norm(a - b)), 1e-9)
            at = sample[its] @ direction
            middle = float(np.median(at))
            right = at > middle
            if not right.any() or right.all():      # copies: nothing to split by
                continue
            directions[node], thresholds[node] = direction, middle
            children[node] = [len(directions), len(directions) + 1]
            for side in (its[~right], its[right]):
                members[len(directions)] = side
                following.append(len(directions))
                directions.append(np.zeros(dims, np.float32))
                thresholds.append(0.0)
                children.append([-1, -1])
            del members[node]
        depth += bool(following)
        level = following
    largest = max((len(m) for m in members.values()), default=0) * scale
    # copies fill a leaf however it is split: bits only for what a typical leaf holds too much
    typical = float(np.median([len(m) for m in members.values()])) * scale if members else 0.0
    bits = int(np.ceil(np.log2(typical / leaf))) if typical > leaf and largest > leaf else 0
    more = rng.standard_normal((bits, dims)).astype(np.float32)
    medians = np.zeros((len(directions), bits), np.float32)
    for node, its in members.items():
        if len(its) and bits:
            medians[node] = np.median(sample[its] @ more.T, axis=0)
    return Tree(np.array(directions, np.float32), np.array(thresholds, np.float32), np.array(children), depth, more, medians)


def fit(units: DataFrame, rows: int, trees: int, leaf: int, seed: int = 0) -> list[Tree]:
    """Trees over a sample of units (_id, _u) by the hash of the id; as many rows as the bounds allow."""
    dims = len(units.select("_u").head()[0])
    wanted = min(SAMPLE_ROWS, INDEX_CELLS // dims)
    part = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) < int(min(1.0, wanted / rows) * (1 << 30))
    found = units.filter(part).orderBy("_id").select(F.transform("_u", lambda x: x.cast("float")).alias("u")).toArrow()
    if not found.num_rows:
        found = units.orderBy("_id").limit(1).select(F.transform("_u", lambda x: x.cast("float")).alias("u")).toArrow()
    sample = found.column("u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    rng = np.random.default_rng(seed)
    return [grow(sample, rows, leaf, max(3, INDEX_CELLS // (dims * trees)), rng) for _ in range(trees)]


def index_knn(df: DataFrame, key: str, k: int, emb: str = "emb", exclude: Sequence[str] = (), queries: Column | None = None,
              trees: int = 12, leaf: int = 512, probes: int = 8, seed: int = 0, chunk: int = 2048) -> DataFrame:
    """k nearest by cosine as vectors.knn gives them (q_id, t_id, sim, place), found through the index.

    queries: condition on the rows of df that ask (all rows if none); all rows are indexed and can be found.
    Never the row itself nor rows equal in an exclude column. A leaf that copies of a vector fill is dealt
    into blocks of about `leaf` rows, of which a query visits up to MOST_BLOCKS. Equal similarities go to the
    smaller id among what was met. More trees, probes or larger leaves raise the recall.
    """
    exclude = list(exclude)
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    kind = "bigint" if whole else kind.simpleString()
    units = df.select(F.col(key).cast(kind).alias("_id"), *exclude, vec.unit(F.col(emb)).alias("_u"),
                      (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("_asks"))
    units = units.filter("_u is not null")
    rows = units.count()
    pairs = f"q_id {kind}, t_id {kind}, sim double"
    if not rows:
        return df.sparkSession.createDataFrame([], f"{pairs}, place int")
    shipped = df.sparkSession.sparkContext.broadcast(fit(units, rows, trees, leaf, seed))

    def routed(many: int):
        @pandas_udf("array<long>")
        def run(u: pd.Series) -> pd.Series:
            if len(u) == 0:
                return pd.Series([], dtype=object)
            x = np.array(u.tolist(), np.float32)
            return pd.Series(list(np.concatenate([t.leaves(x, many) for t in shipped.value], axis=1)))
        return run
    cols = ["_id", *exclude, "_u"]
    place = F.posexplode(routed(1)("_u")).alias("_tree", "_leaf")
    targets = units.select(*cols, place)
    # leaves that copies fill, dealt into blocks by the hash of the id
    large = (targets.groupBy(F.col("_tree").alias("_lt"), F.col("_leaf").alias("_ll")).agg(F.count("*").alias("_n"))
             .filter(F.col("_n") > 2 * leaf).select("_lt", "_ll", F.ceil(F.col("_n") / leaf).cast("int").alias("_blocks")))

    def with_blocks(side: DataFrame) -> DataFrame:
        on = (F.col("_tree") == F.col("_lt")) & (F.col("_leaf") == F.col("_ll"))
        return side.join(large, on, "left").drop("_lt", "_ll").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), "_id"), F.col("_blocks")).cast("int")
    targets = with_blocks(targets).withColumn("_block", own).drop("_blocks")
    leaf_of = F.posexplode(routed(probes)("_u")).alias("_p", "_leaf")
    visits = (units.filter("_asks").select(*cols, leaf_of).filter("_leaf >= 0")
              .withColumn("_tree", F.floor(F.col("_p") / probes).cast("int")).drop("_p"))
    some = F.sequence(F.lit(0), F.least(F.col("_blocks"), F.lit(MOST_BLOCKS)) - 1)
    visits = (with_blocks(visits).withColumn("_own", own)
              .withColumn("_block", F.explode(F.transform(some, lambda i: F.pmod(F.col("_own") + i, F.col("_blocks")).cast("int")))))
    # blocks that very many queries visit: queries go in chunks, the block to each of them
    unit = ["_tree", "_leaf", "_block"]
    busy = (visits.groupBy(*[F.col(c).alias(f"{c}_b") for c in unit]).agg(F.count("*").alias("_n"))
            .filter(F.col("_n") > chunk).withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("int")).drop("_n"))
    same = (F.col("_tree") == F.col("_tree_b")) & (F.col("_leaf") == F.col("_leaf_b")) & (F.col("_block") == F.col("_block_b"))

    def with_chunks(side: DataFrame, cells: Column) -> DataFrame:
        return (side.join(busy, same, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
                .withColumn("_chunk", cells).select(*cols, *unit, "_chunk"))
    asking = with_chunks(visits, F.pmod(F.xxhash64(F.lit(11), "_id"), F.col("_chunks")).cast("int"))
    met = with_chunks(targets, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    met = met.select(*[F.col(c).alias(c) for c in (*cols, *unit, "_chunk")])
    keys = [*unit, "_chunk"]
    found = (asking.groupBy(*keys).cogroup(met.groupBy(*keys))
             .applyInPandas(lambda q, t: vectors._top_pairs(q, t, k, exclude), pairs))
    # a pair met in several trees counts once
    return vectors._best(found.groupBy("q_id", "t_id").agg(F.max("sim").alias("sim")), k)


def recall(found: DataFrame, exact: DataFrame, slack: float = 1e-9) -> DataFrame:
    """recall, n_queries: share of the exact neighbours whose similarity the found list reaches, place by place.

    Places count by similarity, so that one of several equal neighbours is as good as another.
    """
    have = found.select(F.col("q_id").alias("_q"), F.col("place").alias("_p"), F.col("sim").alias("_s"))
    joined = exact.join(have, (exact["q_id"] == F.col("_q")) & (exact["place"] == F.col("_p")), "left")
    hit = F.coalesce((F.col("_s") >= F.col("sim") - slack).cast("double"), F.lit(0.0))
    return joined.agg(F.avg(hit).alias("recall"), F.count_distinct("q_id").alias("n_queries"))
