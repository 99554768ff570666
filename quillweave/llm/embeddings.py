"""Embedding near-duplicates by a random-projection tree forest.

Trees split unit vectors recursively at random directions, at the median of a bounded
sample; vectors within a margin of a split go to both sides (spill). Every vector is
indexed. Within a leaf all vectors of one label are compared exactly, in double precision;
a leaf over BLOCK vectors is compared in square blocks, so none is capped.

Vectors equal in all components are one class. A leaf gives counts for each class and the
edges of a spanning forest, never its pairs: a pair that meets in several leaves is counted
in the first of the leaves that both are in.

With links at cosine 0.98 (distance 0.2) and 64 dimensions, the projections of a pair
differ by about 0.025; a margin of half of that and TREES trees miss a pair at the threshold with
a probability of some 1e-5 at depth 6. The depth follows the number of vectors at every size.

Defined cases: a null label or vector, an empty or zero vector, and one with null or
non-finite components link with nothing (n_links 0, a component of its own); vectors of
different lengths never link; rows that share an id are one node; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, table

TREES = 5
LEAF = 250  # vectors of all labels in a leaf, before spill
SAMPLE = 16_384  # classes that split points are fitted on
NODE_SAMPLE = 64  # of the sample that a node's own split point takes
BLOCK = 2048
SEED = 77


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares from overflowing
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """Directions are seeded, so only split points are kept. A node of the first `own` levels has
    its own direction and the median of the sample there; further down a sample of bounded size
    tells no node's median, and all nodes of a level share a direction and its median."""

    def __init__(self, sample: np.ndarray, depth: int, margin: float, trees: int = TREES):
        self.dim, self.depth, self.margin, self.trees = sample.shape[1], depth, margin, trees
        self.own = min(depth, max(int(math.log2(max(len(sample), 1) / NODE_SAMPLE)), 0) if len(sample) > NODE_SAMPLE else 0)
        self.cuts = np.zeros((trees, 2**self.own - 1 + depth - self.own))
        for t in range(trees):
            where, d = np.zeros(len(sample), np.int64), self.directions(t)
            for level in range(depth):
                at = self._at(level, where)
                p = np.einsum("ij,ij->i", sample, d[at])
                for k in np.unique(at).tolist():
                    self.cuts[t, k] = np.median(p[at == k])
                where = 2 * where + 1 + (p > self.cuts[t, at])

    def _at(self, level: int, node: np.ndarray) -> np.ndarray:
        """Where the directions and split points of a level's nodes are."""
        return node if level < self.own else np.full(len(node), 2**self.own - 1 + level - self.own)

    def directions(self, t: int) -> np.ndarray:
        d = np.random.default_rng([SEED, t]).standard_normal((self.cuts.shape[1], self.dim))
        return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) pairs, a row's in ascending order."""
        rows, codes = [], []
        for t in range(self.trees):
            r, node, d = np.arange(len(x)), np.zeros(len(x), np.int64), self.directions(t)
            for level in range(self.depth):
                at = self._at(level, node)
                off = np.einsum("ij,ij->i", x[r], d[at]) - self.cuts[t, at]
                left, right = off <= self.margin, off > -self.margin
                r, node = np.concatenate([r[left], r[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(r)
            codes.append(node + t * 2 ** (self.depth + 1))
        r, c = np.concatenate(rows), np.concatenate(codes)
        o = np.lexsort((c, r))
        return r[o], c[o]


def _leaf(pdf: pd.DataFrame, threshold: float) -> tuple[list, list, list, list]:
    """Of a cell (leaf, or two blocks of it): (node, links) and edges."""
    x = unit(np.array(pdf["embedding"].tolist()))
    node, n, blk = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["blk"].to_numpy()
    code = int(pdf["code"].iloc[0])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if pdf["bi"].iloc[0] != pdf["bj"].iloc[0]:
        near &= blk[:, None] != blk[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return [], [], [], []
    # a pair counts in the first leaf that both are in
    codes = [np.asarray(c) for c in pdf["codes"]]
    earlier = sorted({int(c) for cs in codes for c in cs if c < code})
    own = np.ones(len(i), bool)
    if earlier:
        at = {c: k for k, c in enumerate(earlier)}
        member = np.zeros((len(x), len(earlier)), np.float32)
        for r, cs in enumerate(codes):
            member[r, [at[int(c)] for c in cs if c < code]] = 1
        for k in range(0, len(i), 200_000):
            own[k : k + 200_000] = (member[i[k : k + 200_000]] * member[j[k : k + 200_000]]).sum(1) == 0
    links = np.bincount(i[own], weights=n[j[own]], minlength=len(x)).astype(np.int64)
    low = np.arange(len(x))
    while True:  # labels fall to the smallest index that links reach
        new = low.copy()
        np.minimum.at(new, i, low[j])
        new = new[new]
        if (new == low).all():
            break
        low = new
    a = np.flatnonzero(low != np.arange(len(x)))
    k = np.flatnonzero(links)
    return node[k].tolist(), links[k].tolist(), node[a].tolist(), node[low[a]].tolist()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vectors (vec_id, embedding, label) -> a row per vector: vec_id, n_links, component_id."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    v = v.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64("embedding", F.lit("second"), "label"))
    classes = stored(
        v.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")),
        "classes",
    )
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("h1")).select("embedding", "dim").limit(SAMPLE).toPandas()
    forests = {}
    for dim, rows in sample.groupby("dim"):
        depth = max(math.ceil(math.log2(max(total * len(rows) / len(sample) / LEAF, 1))), 1)
        distance = math.sqrt(max(2 - 2 * threshold, 0))
        forests[int(dim)] = Forest(unit(np.array(rows["embedding"].tolist())), depth, 0.5 * distance / math.sqrt(dim))
    sent = spark.sparkContext.broadcast(forests)  # TREES * (SAMPLE / NODE_SAMPLE + depth) numbers a length

    def deal(whole: bool):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for dim, part in pdf.groupby("dim"):
                    f = sent.value.get(int(dim)) or Forest(np.zeros((0, int(dim))), 1, math.inf)
                    r, c = f.leaves(unit(np.array(part["embedding"].tolist())))
                    out = {"label": part["label"].to_numpy()[r], "dim": int(dim), "code": c}
                    if whole:
                        ends = np.cumsum(np.bincount(r, minlength=len(part)))
                        own = np.split(c, ends[:-1])
                        out |= {"node": part["node"].to_numpy()[r], "n": part["n"].to_numpy()[r], "codes": [own[k] for k in r], "embedding": part["embedding"].to_numpy()[r]}
                    yield pd.DataFrame(out)

        return run

    kind = dict(classes.dtypes)["label"]
    cells = f"label {kind}, dim int, code long"
    big = stored(
        classes.select("label", "dim", "embedding").mapInPandas(deal(False), cells).groupBy("label", "dim", "code").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK), "big"
    )
    dealt = classes.select("node", "n", "label", "dim", "embedding").mapInPandas(deal(True), f"{cells}, node long, n long, codes array<long>, embedding array<double>")
    dealt = dealt.join(big, ["label", "dim", "code"], "left").withColumn("nb", F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        node, links, a, b = _leaf(pdf, threshold)
        return pd.DataFrame({"a": node + a, "b": [None] * len(node) + b, "links": links + [0] * len(a)}).astype({"b": "Int64"})

    found = stored(
        dealt.select("label", "dim", "code", "bi", "bj", "blk", "node", "n", "codes", "embedding").groupBy("label", "dim", "code", "bi", "bj").applyInPandas(compare, "a long, b long, links long"),
        "found",
    )
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b IS NOT NULL").select("a", "b"))
    of_class = stored(
        classes.select("h1", "h2", "node", "n").join(links, "node", "left").join(comp, "node", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")),
        "classlinks",
    ).where("n_links > 0")
    out = v.select("vec_id", "h1", "h2", "ok").join(of_class.withColumn("ok", F.lit(True)), ["h1", "h2", "ok"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
