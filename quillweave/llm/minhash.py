"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes a set of 64-bit hashes of its word shingles, and the set a 128-bit
   digest and a MinHash signature. Texts with equal sets are one class; classes go on.
2. The signature's bands, as many and as long as miss a pair at the threshold with a
   probability of MISS at most, deal classes into buckets.
3. Comparison goes by batches of the signature: a pair is pruned once the posterior
   probability (uniform prior) that its similarity reaches the threshold falls below MISS.
   Survivors are verified on the full sets of both texts.
4. Each bucket has a hub (the class that shares most buckets). First every member is
   compared with its hub; a hub goes once to each run of at most BLOCK of its members.
5. What a hub has not joined is compared with the other members of its buckets in cells of
   at most BLOCK by BLOCK classes: signatures first, and only classes with a survivor come
   again with their texts, once a cell. A cell verifies inside and returns the edges of a
   spanning forest of its links, so no row is ever a pair that isn't a link, no text
   travels by pair, and no bucket is capped.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer words than a shingle is one shingle; repeated rows link; rows that
share an id are one node, so their texts' groups are one; rows without an id take part by
their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, frugal, likely, slices, stored, table

WORDS = 5
PERMUTATIONS = 128
MISS = 1e-6
BATCH = 25
BLOCK = 1024
SEED = 20240611
VOCABULARY = 200_000  # word hashes that a worker keeps


class Shingler:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words split at ASCII white space."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self.mult = np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        w = (text or "").encode().lower().split()
        if not w:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > VOCABULARY:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        if len(w) < self.n:
            return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(w))], np.uint64)
        out = np.zeros(len(w) - self.n + 1, np.uint64)
        for i, m in enumerate(self.mult):
            out += h[i : i + len(out)] * m
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def banding(threshold: float, permutations: int = PERMUTATIONS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with at most `miss`."""
    for rows in range(16, 0, -1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return permutations, 1


def least_matches(threshold: float, n_hashes: int, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch: below it, the posterior
    probability of a similarity of at least the threshold is under `miss`."""
    out = []
    for n in range(batch, n_hashes + 1, batch):
        # posterior Beta(m + 1, n - m + 1); P(similarity >= t) = P(Binomial(n + 1, t) <= m)
        total, m = 0.0, 0
        for k in range(n + 2):
            total += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if total >= miss:
                m = k
                break
        out.append((n, m))
    return out


def signatures(docs: DataFrame, threshold: float, n_words: int = WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, h1, h2, sig (16 bits a hash), bands."""
    n_bands, rows = banding(threshold)

    @frugal
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n_words)
        rng = np.random.default_rng(SEED + 1)
        a = rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
        mix = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(1, 2**63, n_bands, dtype=np.uint64)
        for batch in (b for whole in batches for b in slices(whole)):
            ids, n, d, sig, bands = batch.column(0).to_pylist(), [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle(text)
                n.append(len(s))
                x = xxhash.xxh128(s.tobytes())
                d.append(np.frombuffer(x.digest(), np.int64))
                if not len(s):
                    sig.append(b"")
                    bands.append([])
                    continue
                h = (s >> np.uint64(32)).astype(np.uint32)
                low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
                for i in range(0, len(h), 1024):
                    low = np.minimum(low, (h[None, i : i + 1024] * a[:, None] + b[:, None]).min(1))
                sig.append(low.astype(np.uint16).tobytes())
                k = (low[: n_bands * rows].reshape(n_bands, rows).astype(np.uint64) * mix).sum(1) + salt
                k ^= k >> np.uint64(31)
                k *= np.uint64(0x94D049BB133111EB)
                k ^= k >> np.uint64(29)
                bands.append(k.view(np.int64))
            d = np.array(d, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "h1", "h2", "sig", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def _alive(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of x and y (signatures, pair by pair) survive all batches."""
    live, seen, done = np.arange(len(x)), np.zeros(len(x), np.int32), 0
    for n, least in steps:
        seen[live] += (x[live, done:n] == y[live, done:n]).sum(1, dtype=np.int32)
        live = live[seen[live] >= least]
        done = n
    return live


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with each key's together and in order; the keys come first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, "side")


def _enough(inter: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return (inter > 0) & (100 * inter >= percent * (n + m - inter))


def _stars(pairs: DataFrame, classes: DataFrame, texts: DataFrame | None, steps: list[tuple[int, int]], percent: int, n_words: int) -> DataFrame:
    """pairs (node, hub, run) that survive the signatures or, with texts, the comparison of sets.
    A run's hub stands before its members."""
    what = classes.select("node", F.col("sig").alias("x")) if texts is None else texts.select("node", F.col("text").alias("x"))
    members = pairs.join(what, "node").select("hub", "run", F.lit(1).alias("side"), "node", "x")
    by_sets = texts is not None
    hubs = pairs.select("hub", "run").distinct().join(what.withColumnRenamed("node", "hub"), "hub").select("hub", "run", F.lit(0).alias("side"), F.col("hub").alias("node"), "x")

    @frugal
    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hub_sig, hub_set = Shingler(n_words), None, None
        for whole in batches:
            for b in slices(whole, 512 if by_sets else 4096):
                side = b.column(2).to_numpy()
                if not by_sets:
                    x = _matrix(b.column(4))
                    at = np.maximum.accumulate(np.where(side == 0, np.arange(len(x)) + 1, 0))
                    x = np.concatenate([x[:1] if hub_sig is None else hub_sig, x])
                    live = _alive(x[1:], x[at], steps)
                    hub_sig = x[at[-1]][None]
                    live = live[side[live] == 1]
                else:
                    live = []
                    for i, (s, text) in enumerate(zip(side.tolist(), b.column(4).to_pylist(), strict=True)):
                        own = shingle(text)
                        if not s:
                            hub_set = own
                        elif _enough(len(np.intersect1d(own, hub_set, assume_unique=True)), len(own), len(hub_set), percent):
                            live.append(i)
                yield b.take(pa.array(live, pa.int64())).select([3, 0, 1])

    return _dealt(members.union(hubs), "hub", "run").mapInArrow(test, "node long, hub long, run int")


def _links(l: list[np.ndarray], r: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Those of the pairs (l[i], r[j]) of sets that reach the threshold."""
    n, m = np.array([len(x) for x in l]), np.array([len(x) for x in r])
    codes, back, count = np.unique(np.concatenate([*l, *r]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    width = int(shared[-1]) + 1 if len(codes) else 0
    if len(i) * 2e-6 + (n[i].sum() + m[j].sum()) * 2e-8 < width * len(l) * len(r) * 1e-10:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if _enough(len(np.intersect1d(l[a], r[b], assume_unique=True)), n[a], m[b], percent):
                yield a, b
        return
    row = np.repeat(np.arange(len(l) + len(r)), np.concatenate([n, m]))
    keep = count[back] > 1
    row, col = row[keep], shared[back[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(l), len(r)), np.float32)
    for c in range(0, width, 4096):
        lo, hi = np.searchsorted(col, [c, c + 4096])
        part = np.zeros((len(l) + len(r), min(4096, width - c)), np.float32)
        part[row[lo:hi], col[lo:hi] - c] = 1
        inter += part[: len(l)] @ part[len(l) :].T
    own = inter[i, j].astype(np.int64)
    good = np.flatnonzero(_enough(own, n[i], m[j], percent))
    yield from zip(i[good].tolist(), j[good].tolist(), strict=True)


def _cells(members: DataFrame, what: DataFrame, steps: list[tuple[int, int]], percent: int, n_words: int, verify: bool) -> DataFrame:
    """members (hub, r, c, side, node, comp, main), sides 0 (outside the hub's component) and 1
    (all): the classes of a cell with a survivor of the signatures, or the forest of its links."""
    with_text = ["text"] if verify else []
    rows = members.join(what, "node").select("hub", "r", "c", "side", "node", "comp", "main", "sig", *with_text)

    @frugal
    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n_words)
        for t in _runs(batches, 3):
            side = t["side"].to_numpy()
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not (len(p) and len(q)):
                continue
            x, node, comp = _matrix(t["sig"]), t["node"].to_numpy(), t["comp"].to_numpy()
            inside = comp[q] == t["main"].to_numpy()[q]
            left, right = [], []
            for k, a in enumerate(p.tolist()):
                # two classes outside main are met once: at the larger
                j = np.flatnonzero((comp[q] != comp[a]) & (inside | (node[q] < node[a])))
                live = j[_alive(np.broadcast_to(x[a], (len(j), x.shape[1])), x[q[j]], steps)]
                left.append(np.full(len(live), k))
                right.append(live)
            i, j = np.concatenate(left), np.concatenate(right)
            if not len(i):
                continue
            if not verify:
                live = np.unique(np.concatenate([p[i], q[j]]))
                yield from t.take(pa.array(live)).select(["hub", "r", "c", "side", "node", "comp", "main"]).to_batches()
                continue
            texts = t["text"]
            some, i = np.unique(i, return_inverse=True)
            others, j = np.unique(j, return_inverse=True)
            sets = lambda rows: [shingle(texts[k].as_py()) for k in rows.tolist()]  # noqa: B023, E731
            up: dict[int, int] = {}

            def top(v: int) -> int:
                while (w := up.get(v, v)) != v:  # noqa: B023
                    up[v] = v = up.get(w, w)  # noqa: B023
                return v

            a, b = node[p[some]].tolist(), node[q[others]].tolist()
            out = []
            for k, m in _links(sets(p[some]), sets(q[others]), i, j, percent):
                u, v = top(a[k]), top(b[m])
                if u != v:
                    up[u] = v
                    out.append((a[k], b[m]))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    schema = "a long, b long" if verify else "hub long, r int, c int, side int, node long, comp long, main long"
    return _dealt(rows, "hub", "r", "c").mapInArrow(test, schema)


def _texts(docs: DataFrame, wanted: DataFrame, odd: DataFrame | None, n_words: int) -> DataFrame:
    """wanted (node, doc_id) -> stored (node, text): a text of each class. Texts of ids that have
    several sets (odd), or of no id, are told by their digest."""
    plain = wanted.where("doc_id IS NOT NULL")
    if odd is not None:
        plain = plain.join(odd.select("doc_id"), "doc_id", "left_anti")
    out = likely(docs, "doc_id", plain.select("doc_id")).join(plain, "doc_id").dropDuplicates(["doc_id"]).select("node", "text")
    if odd is not None:
        unclear = docs.where("doc_id IS NULL").union(docs.join(odd.select("doc_id"), "doc_id", "left_semi").select(*docs.columns))

        @frugal
        def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(n_words)
            for whole in batches:
                for b in slices(whole):
                    h = [int(np.frombuffer(xxhash.xxh128(shingle(t).tobytes()).digest(), np.int64)[0]) for t in b.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(1)], ["node", "text"])

        found = unclear.mapInArrow(digest, "node long, text string").join(wanted, "node", "left_semi")
        out = out.union(found.select("node", "text"))
        return stored(out.groupBy("node").agg(F.first("text").alias("text")), "texts")
    # rows that repeat an id have equal sets here: the first is as good as any
    return stored(out, "texts")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n_words: int = WORDS) -> DataFrame:
    """docs (doc_id, text) -> a row per document: doc_id, n_shingles, component_id."""
    steps, percent = least_matches(threshold, PERMUTATIONS // BATCH * BATCH), round(threshold * 100)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(signatures(docs, threshold, n_words), "signatures")
    # a class is known by the first half of its digest, node; at its smallest id is its text
    classes = stored(
        signed.where("n_shingles > 0").groupBy(F.col("h1").alias("node"), "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    odd = stored(
        signed.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high OR doc_id IS NULL"), "odd"
    )
    odd = None if odd.isEmpty() else odd
    dealt = classes.select("node", F.explode("bands").alias("key"))
    buckets = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    # what shares no bucket stays out of the shuffles, but for the few that the filters let pass
    members = stored(likely(dealt, "key", buckets).join(buckets, "key"), "members")
    partners = stored(likely(classes.select("node", "doc_id", "sig"), "node", members), "partners")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    pairs = members.join(hubs, "key").where("node <> hub").select("node", "hub").distinct()
    pairs = stored(pairs, "pairs")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("runs"))
    pairs = pairs.join(sizes, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("runs")).cast("int").alias("run"))

    def texts(nodes: DataFrame) -> DataFrame:
        return _texts(docs, stored(partners.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id"), "wanted"), odd, n_words)

    live = stored(_stars(pairs, partners, None, steps, percent, n_words), "live")
    linked = _stars(live, partners, texts(live.select("node").union(live.select("hub"))), steps, percent, n_words)
    links = stored(linked.select(F.col("node").alias("a"), F.col("hub").alias("b")), "links")
    if odd is not None:  # an id's several texts are one node
        same = signed.where("n_shingles > 0").join(odd.where("doc_id IS NOT NULL"), "doc_id").groupBy("doc_id", "h1").agg(F.count("*"))
        first = same.groupBy("doc_id").agg(F.min("h1").alias("b"))
        links = stored(links.union(same.join(first, "doc_id").where("h1 <> b").select(F.col("h1").alias("a"), "b").distinct()), "links")
    comp = stored(components(links), "components")

    c = lambda name: comp.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    rest = pairs.join(c("node"), "node", "left").join(c("hub"), "hub", "left").select(
        "hub", "node", F.coalesce("node_c", "node").alias("comp"), F.coalesce("hub_c", "hub").alias("main")
    )
    # hubs are done with; what is open are classes outside main and the others of their hub
    sizes = rest.groupBy("hub").agg(F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("main")).alias("k")).where("k > 0 AND m > 1")
    sizes = sizes.select("hub", F.ceil(F.col("k") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("cols"))
    rest = stored(rest.join(sizes, "hub"), "rest")
    if not rest.isEmpty():
        m = rest.withColumn("r", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("cols")).cast("int"))
        left = m.where("comp <> main").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("side", F.lit(0))
        right = m.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("side", F.lit(1))
        cells = left.union(right.select(left.columns)).select("hub", "r", "c", "side", "node", "comp", "main")
        sig = partners.select("node", "sig")
        near = stored(_cells(cells, sig, steps, percent, n_words, False), "near")
        more = stored(_cells(near, sig.join(texts(near.select("node")), "node"), steps, percent, n_words, True), "links")
        comp = stored(components(links.union(more)), "components")

    smallest = comp.join(classes.select("node", "doc_id"), "node").union(classes.select("node", "doc_id").join(comp.select(F.col("component").alias("node")).distinct(), "node", "left_semi").select("node", F.col("node").alias("component"), "doc_id"))
    smallest = smallest.groupBy("component").agg(F.min("doc_id").alias("low"))
    of_class = classes.select("node", "h2", "doc_id", "copies").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(smallest, "component", "left")
    of_class = stored(of_class.where("copies > 1 OR low IS NOT NULL").select(F.col("node").alias("h1"), "h2", F.coalesce("low", "doc_id").alias("low")), "groups")
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    if odd is None:
        return out
    # rows of an id with several texts (one may be empty) have the smallest of their groups
    out = stored(out, "rows")
    low = out.join(odd.where("doc_id IS NOT NULL").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("low"))
    return out.join(low, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("low", "component_id").alias("component_id"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
