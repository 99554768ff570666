"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents (TOXIC and CLEAN rows, by the order of a hash, of
the training folds) are the examples. All their words and word beginnings are indexed, with
document frequencies counted over all documents, and every text's whole vector is searched
in an inverted index of all of them, common terms by products. Terms that no example has
match none and are left out of a text's length. The nearest examples are the evidence.

As a further feature, a second search runs over the lexicon alone: the terms whose rate of
label 1 is highest above the sample's, in standard deviations, and at least halfway from it
to 1. Both searches sum all postings of a text's terms and are exact. In both, the neighbours'
votes, weighted by 1 / (distance + 0.1), and the best similarity are calibrated by logistic
regression on the examples themselves (each left out of its own search), weighted so that
the classes have the shares they have among all training labels.

Labels count only outside the held-out fold; labels, language, source and id are no inputs.

Defined cases: a null or empty text, and one without a term of an example, gets the
score calibrated for no neighbours; repeated rows are scored one by one; an id with several
labels has the largest; null labels don't count; equal similarities rank by the place in the
index, which ids order; columns of docs named like the added ones are replaced; with no labels of either class every score
is the share of label 1 (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, id_fold, slices, stored, table, trim

TOXIC = 4000
CLEAN = 8000
LEXICON = 2048
LEAST_Z = 4.0
LEAST_ROWS = 4
PREFIXES = (4, 5)
K = 15
FLUSH = 400_000
TEXTS = 256  # compared at once
RUN = 1 << 18  # bytes of texts hashed at once
WHOLE_BLOCK = 256
DENSE = 20  # about where products and postings cost the same; both sum all
LEVELS = 65_535
FOLDS = 5
EVIDENCE = 3
_UPPER = bytes(range(65, 91))
_SPACES = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_UPPER + _SPACES, _UPPER.lower() + b" " * len(_SPACES))


class Terms:
    """Term ids of texts: of their words, and of the beginnings of longer ones. vocabulary: sorted
    64-bit hashes, a term's id being its place; without one, ids are the hashes. Words are runs of
    bytes, which are hashed all at once and never made Python objects."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary, self.powers = vocabulary, np.zeros(0, np.uint64)

    def _hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of data, which begins and ends with a space, begin; and a row for each with the
        hashes of its terms, where a term that is none has that of the word."""
        x = np.frombuffer(data, np.uint8)
        inside = x != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, size = edge[::2], edge[1::2] - edge[::2]
        ends = np.cumsum(size)
        if len(self.powers) <= size.max(initial=0):
            self.powers = np.cumprod(np.full(int(size.max(initial=0)) + 64, 0x9E3779B97F4A7C15, np.uint64))
        # sums of bytes times the power of their place in the word
        place = np.arange(len(x) - np.count_nonzero(~inside))
        place -= np.repeat(ends - size, size)
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum((x[inside].astype(np.uint64) + np.uint64(1)) * self.powers[place], out=sums[1:])
        h = np.empty((len(size), 1 + len(PREFIXES)), np.uint64)
        h[:, 0] = sums[ends] - sums[ends - size]
        for k, n in enumerate(PREFIXES, 1):
            h[:, k] = np.where(size > n, sums[ends - size + np.minimum(size, n)] - sums[ends - size] + np.uint64(n * 0x94D049BB133111EB % 2**64), h[:, 0])
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return begin, h ^ h >> np.uint64(32)

    @staticmethod
    def _same(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first of each number stands, by size, and the place of each in that."""
        by = np.argsort(h)
        new = np.r_[True, h[by[1:]] != h[by[:-1]]][: len(h)]
        at = np.empty(len(h), np.int64)
        at[by] = np.cumsum(new) - 1
        return by[new], at

    def _ids(self, h: np.ndarray) -> np.ndarray:
        """The ids of terms, -1 for those not in the vocabulary; a word's term stands once."""
        first, of = self._same(h.ravel())
        some = h.ravel()[first]
        if not len(self.vocabulary):
            return np.full(h.shape, -1)
        at = np.searchsorted(self.vocabulary, some).clip(max=len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == some, at, -1)[of].reshape(h.shape)
        ids[:, 1:][h[:, 1:] == h[:, :1]] = -1
        return ids

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the different terms of each text, in the order of both."""
        coded = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(c) + 1 for c in coded])
        found, last = [(np.zeros(0, np.int64), np.zeros((0, 1 + len(PREFIXES)), np.uint64))], 0
        while last < len(coded):  # about RUN bytes at once
            i, last = last, max(last + 1, int(np.searchsorted(ends, (ends[last - 1] if last else 0) + RUN)))
            begin, h = self._hashes(b"".join((b" ", b" ".join(coded[i:last]), b" ")).translate(_TABLE))
            found.append((np.searchsorted(ends[i:last] - (ends[i - 1] if i else 0), begin - 1, side="right") + i, h))
        text, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        if not len(text):
            return text, text if self.vocabulary is not None else h[:, 0], np.zeros(0)
        first, code = self._same(h[:, 0])
        pair, n = np.unique(text * np.int64(len(first)) + code, return_counts=True)
        text, code, h = pair // len(first), pair % len(first), h[first]
        if self.vocabulary is None:
            term, text, n = h[code].ravel(), np.repeat(text, h.shape[1]), np.repeat(n, h.shape[1])
            # short words stand in for terms they don't have, which a set doesn't mind
            order = np.lexsort((term, text))
            term, text, n = term[order], text[order], n[order]
            new = np.r_[True, (term[1:] != term[:-1]) | (text[1:] != text[:-1])]
            return text[new], term[new], n[new]
        term, text, n = self._ids(h)[code].ravel(), np.repeat(text, h.shape[1]), np.repeat(n, h.shape[1])
        some = term >= 0
        if not some.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # a pair and its count in one number, as whole numbers sort faster than places
        bits = np.int64(int(n.max()).bit_length())
        packed = (text[some] * np.int64(len(self.vocabulary) + 1) + term[some]) << bits | n[some]
        packed.sort()
        pair = packed >> bits
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pair, n = pair[new], np.add.reduceat(packed & ((np.int64(1) << bits) - 1), new).astype(float)
        return pair // (len(self.vocabulary) + 1), pair % (len(self.vocabulary) + 1), n


class Index:
    """Inverted index over unit vectors of (1 + log tf) * idf."""

    def __init__(self, idf: np.ndarray, examples: list[dict[int, int]], labels: np.ndarray, ids: np.ndarray):
        self.idf, self.labels, self.ids = idf, labels, ids
        post: dict[int, list[tuple[int, float]]] = {}
        for k, e in enumerate(examples):
            t, w = self.vector(e)
            for a, b in zip(t.tolist(), w.tolist(), strict=True):
                post.setdefault(a, []).append((k, b))
        self.posts = {t: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) for t, rows in post.items()}

    def vector(self, tf: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(tf), np.int64)
        w = self.idf[t] * (1 + np.log(np.array([tf[x] for x in t.tolist()], float)))
        return t, w / max(np.sqrt((w * w).sum()), 1e-300)

    def nearest(self, tf: dict[int, int], skip: int | None = None) -> list[tuple[float, int]]:
        """(similarity, example) of the K nearest with a similarity above 0, nearest first."""
        acc = np.zeros(len(self.ids))
        for t, w in zip(*self.vector(tf), strict=True):
            if int(t) in self.posts:
                doc, weight = self.posts[int(t)]
                acc[doc] += w * weight
        if skip is not None:
            acc[skip] = 0
        some = np.flatnonzero(acc > 0)
        if len(some) > K:
            here = acc[some]
            some = some[here >= np.partition(here, -K)[-K]]
        by = some[np.lexsort((some, -acc[some]))[:K]]
        return list(zip(acc[by].tolist(), by.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> list[float]:
        if not near:
            return [1.0, 0.0, 0.0, 1.0]
        w = [1 / (max(1 - s, 0) + 0.1) for s, _ in near]
        v = sum(x for x, (_, i) in zip(w, near, strict=True) if self.labels[i]) / sum(w)
        return [1.0, 2 * v - 1, (2 * v - 1) * near[0][0], 0.0]


class Whole(Index):
    """Inverted index of whole vectors, given as arrays: terms and counts of all examples
    one after another, and each example's number of terms.

    Terms in at least 1 / DENSE of the examples have their weights in matrices, a block of
    WHOLE_BLOCK examples each, in 16 bits and rounded up, and are summed by products; the
    postings of all others are short and are summed one by one. So a sum is never too small,
    and too large by no more than the rounding. What comes that near the K-th is summed once
    more in double precision, so the result is exact."""

    def __init__(self, idf: np.ndarray, ts: list[np.ndarray], tfs: list[np.ndarray], labels: np.ndarray, ids: np.ndarray):
        # cast while they are joined, without a copy of each part
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)], dtype=kind, casting="unsafe")
        self.place = np.arange(len(ts))  # of each example: as given
        self._hold(idf, join(ts, np.int32), join(tfs, np.uint32), np.array([len(t) for t in ts], np.int64), labels, ids)

    def _hold(self, idf: np.ndarray, t: np.ndarray, tf: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        self.n, self.idf, self.own_term, self.own_tf, self.sizes, self.labels, self.ids = len(sizes), idf, t, tf, sizes, labels, ids
        self.own_cuts, self.weights = np.r_[0, np.cumsum(sizes)], None

    def _build(self) -> None:
        """The index itself: built where a search is made, as its parts are larger than what they are made of,
        and example block by block, which keeps down what is held besides."""
        n, idf, t = self.n, self.idf, self.own_term
        df = np.zeros(len(idf), np.int64)
        for i in range(0, len(t), RUN):  # what is counted is cast first
            df += np.bincount(t[i : i + RUN], minlength=len(idf))
        # columns of the terms that at least 1 / DENSE of the examples have, -1 for others
        common = np.flatnonzero(df * DENSE >= max(n, 1))
        self.column, width = np.full(len(idf), -1, np.int32), len(common)
        self.column[common] = np.arange(width)
        self.edges = np.arange(0, max(n, 1), WHOLE_BLOCK)
        self.norm, self.weights, self.width = np.zeros(n), [], width
        # postings of the others stand by term, and are put there block by block
        df[common] = 0
        self.cuts = np.r_[0, np.cumsum(df)]
        self.posts = np.empty(self.cuts[-1], np.int64)  # an example and its weight in one number
        docs, weights = self.posts.view(np.int32)[::2], self.posts.view(np.float32)[1::2]
        free = self.cuts[:-1].copy()
        for e in self.edges.tolist():
            last = min(e + WHOLE_BLOCK, n)
            own = t[self.own_cuts[e] : self.own_cuts[last]]
            doc = np.repeat(np.arange(last - e), self.sizes[e:last])
            w = idf[own] * (1 + np.log(self.own_tf[self.own_cuts[e] : self.own_cuts[last]]))
            self.norm[e:last] = np.sqrt(np.bincount(doc, weights=w * w, minlength=last - e))
            w /= self.norm[e:last][doc]
            c = self.column[own]
            block = np.zeros((width, last - e), np.uint16)
            block[c[c >= 0], doc[c >= 0]] = np.minimum(np.ceil(w[c >= 0] * LEVELS), LEVELS)
            self.weights.append(block)
            own, doc, w = own[c < 0], doc[c < 0], w[c < 0]
            by = np.argsort(own, kind="stable")
            own = own[by]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            size = np.diff(np.r_[first, len(own)])
            at = np.arange(len(own)) + np.repeat(free[own[first]] - first, size)
            docs[at], weights[at] = doc[by] + e, w[by]
            free[own[first]] += size
        trim()
        self.spot, self.asked = np.zeros(len(idf)), np.zeros(len(idf), bool)
        self.logs = 1 + np.log(np.maximum(np.arange(min(int(self.own_tf.max(initial=0)), LEVELS) + 1), 1))

    def __getstate__(self) -> list[tuple[str, bytes]]:
        """What it is made of, packed array by array: an index is built where it is used."""
        steps = lambda: np.diff(self.own_term, prepend=np.int32(0))  # noqa: E731  terms ascend within an example
        tf = lambda: self.own_tf if self.own_tf.max(initial=0) > 65_535 else self.own_tf.astype(np.uint16)
        parts = (lambda: self.idf, steps, tf, lambda: self.sizes, lambda: self.labels, lambda: self.ids)
        return [((x := np.ascontiguousarray(part())).dtype.str, zlib.compress(x, 1)) for part in parts]

    def __setstate__(self, packed: list[tuple[str, bytes]]) -> None:
        parts = []
        while packed:
            kind, x = packed.pop(0)
            parts.append(np.frombuffer(zlib.decompress(x), kind))
        parts[1] = np.cumsum(parts[1], dtype=np.int32)
        self._hold(*parts)

    def _exact(self, t: np.ndarray, w: np.ndarray, some: np.ndarray) -> np.ndarray:
        spans = list(zip(self.own_cuts[some].tolist(), self.own_cuts[some + 1].tolist(), strict=True))
        term = np.concatenate([self.own_term[a:b] for a, b in spans])
        self.asked[t] = True  # small enough to stay in cache
        at = np.flatnonzero(np.take(self.asked, term, mode="clip"))
        self.asked[t] = False
        self.spot[t] = w * self.idf[t]
        ends = np.cumsum(self.sizes[some])
        hits = np.diff(np.searchsorted(at, np.r_[0, ends]))
        tf = self.own_tf[at + np.repeat(self.own_cuts[some + 1] - ends, hits)]
        own = self.spot[term[at]] * (self.logs[tf] if len(tf) and int(tf.max()) < len(self.logs) else 1 + np.log(tf))
        return np.bincount(np.repeat(np.arange(len(some)), hits), weights=own, minlength=len(some)) / self.norm[some]

    def search(self, texts: int, text: np.ndarray, t: np.ndarray, tf: np.ndarray, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Of each text, whose terms and counts stand together, (similarity, example) of the K nearest
        with a similarity above 0, nearest first; skip: an example that a text leaves out."""
        if self.weights is None:
            self._build()
        w = self.idf[t] * (1 + np.log(tf))
        w = w / np.sqrt(np.bincount(text, weights=w * w, minlength=texts))[text]
        q = np.zeros((texts, self.width), np.float32)
        c = self.column[t]
        q[text[c >= 0], c[c >= 0]] = w[c >= 0] / LEVELS
        r, u, v = text[c < 0], t[c < 0], w[c < 0]
        acc = np.empty((texts, self.n), np.float32)
        begin, size = self.cuts[u], self.cuts[u + 1] - self.cuts[u]
        some = np.searchsorted(r, np.arange(texts + 1))
        for i in range(texts):
            own = slice(some[i], some[i + 1])
            n = size[own]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(n) else 0)
            at += np.repeat(begin[own] - (ends - n), n)
            posts = np.take(self.posts, at, mode="clip")
            acc[i] = np.bincount(posts.view(np.int32)[::2], weights=np.repeat(v[own], n) * posts.view(np.float32)[1::2], minlength=self.n)
        for e, block in zip(self.edges.tolist(), self.weights, strict=True):
            acc[:, e : e + WHOLE_BLOCK] += q @ block.astype(np.float32)
        if skip is not None:
            acc[np.arange(texts), skip] = 0
        over = 1e-4 + q.sum(1)  # by single precision, and by rounding up
        out = []
        cuts = np.searchsorted(text, np.arange(texts + 1))
        for i in range(texts):
            lo, hi = cuts[i], cuts[i + 1]
            kth = np.partition(acc[i], -K)[-K] if self.n >= K else 0
            some = np.flatnonzero(acc[i] >= max(kth - over[i], 1e-9))
            if not len(some) or lo == hi:
                out.append([])
                continue
            s = self._exact(t[lo:hi], w[lo:hi], some)
            by = np.lexsort((some, -s))[:K]
            out.append([(s[k], e) for k, e in zip(by.tolist(), some[by].tolist(), strict=True) if s[k] > 0])
        return out


class Examples:
    """Both indexes, and the features of texts by their neighbours in them."""

    def __init__(self, lexicon: Index, of_lexicon: np.ndarray, whole: Whole):
        self.lexicon, self.of_lexicon, self.whole, self.votes = lexicon, of_lexicon, whole, {}

    def features(self, texts: int, text: np.ndarray, t: np.ndarray, tf: np.ndarray, skip: list[int] | None = None) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        near = self.whole.search(texts, text, t, tf, skip)
        few: list[dict[int, int]] = [{} for _ in range(texts)]
        own = np.flatnonzero(self.of_lexicon[t] >= 0)
        for i, k, c in zip(text[own].tolist(), self.of_lexicon[t[own]].tolist(), tf[own].tolist(), strict=True):
            few[i][k] = int(c)
        x = []
        for i in range(texts):
            key = None if skip is not None else tuple(few[i].items())
            vote = self.votes.get(key) if key is not None else None
            if vote is None:
                vote = self.lexicon.vote(self.lexicon.nearest(few[i], None if skip is None else skip[i]))
                if key is not None and len(self.votes) < 50_000:
                    self.votes[key] = vote
            x.append([*vote, *self.whole.vote(near[i])[1:]])
        return np.array(x, float).reshape(texts, 7), near

    def own(self, i: int, k: int) -> np.ndarray:
        """Features of the examples at places i to k, each left out of its own searches."""
        w = self.whole
        at = slice(w.own_cuts[i], w.own_cuts[k])
        skip = list(range(i, k))
        return self.features(k - i, np.repeat(np.arange(k - i), w.sizes[i:k]), w.own_term[at].astype(np.int64), w.own_tf[at], skip)[0]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    b = np.zeros(x.shape[1])
    ridge = 1.0 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, np.ndarray] | float:
    """The vocabulary and indexes, sent, and the calibration; or the share of label 1."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_fold(F.col("doc_id"), FOLDS) != 0))
    train = train.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.0
    if not (shares.get(0) and shares.get(1)):
        return share
    pick = lambda y, n: train.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = pick(1, TOXIC).union(pick(0, CLEAN))  # TOXIC + CLEAN rows of two numbers
    spark = docs.sparkSession
    sample = spark.createDataFrame(picked.toPandas(), "doc_id long, toxic int")
    texts = stored(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id"), "examples")

    @frugal
    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, size = Terms(), [], 0

        def out() -> pa.RecordBatch:
            term, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            toxic = np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=toxic).astype(np.int64))], ["term", "n", "k"])

        for b in (x for whole in batches for x in slices(whole, 128)):
            text, term, _ = find(b.column(0).to_pylist())
            held.append((term, b.column(1).to_numpy()[text]))
            size += len(term)
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    size, toxic = texts.agg(F.count("*"), F.sum("toxic")).first()
    if not size:
        return share
    rate = min(max((toxic or 0) / size, 1e-6), 1 - 1e-6)
    z = (F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    counted = stored(texts.select("text", "toxic").mapInArrow(tally, "term long, n long, k long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "terms")
    leaning = counted.where(F.col("n") >= LEAST_ROWS).withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("k") >= F.col("n") * (1 + rate) / 2))
    chosen = [r["term"] for r in leaning.orderBy(F.desc("z"), "term").limit(LEXICON).collect()]
    vocabulary = np.sort(counted.select("term").toArrow().column(0).to_numpy().view(np.uint64))  # of TOXIC + CLEAN examples
    if not len(vocabulary):
        return share
    of_lexicon = np.full(len(vocabulary), -1, np.int32)
    lexicon_ids = np.searchsorted(vocabulary, np.array(chosen, np.int64).view(np.uint64))
    of_lexicon[lexicon_ids] = np.arange(len(chosen))
    sent = spark.sparkContext.broadcast(vocabulary)

    @frugal
    def frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df = Terms(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for b in (x for whole in batches for x in slices(whole, 256)):
            df[:-1] += np.bincount(find(b.column(0).to_pylist())[1], minlength=len(sent.value))
            df[-1] += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], ["term", "df"])

    df = np.zeros(len(vocabulary) + 1)
    got = docs.select("text").mapInArrow(frequency, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    @frugal
    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Terms(sent.value)
        for b in (x for whole in batches for x in slices(whole, 128)):
            text, t, tf = find(b.column(1).to_pylist())
            cuts = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (t, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], ["doc_id", "toxic", "t", "tf"])

    got = texts.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic int, t array<int>, tf array<int>").toArrow()
    sent.destroy()
    column = lambda c: [x for chunk in got.column(c).chunks for x in (chunk[k].values.to_numpy() for k in range(len(chunk)))]
    digest = lambda *parts: hashlib.blake2b(b"".join(p.tobytes() for p in parts), digest_size=16).digest()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("toxic").to_pylist(), column("t"), column("tf"), strict=True), key=lambda r: (r[0], digest(*r[2:])))
    whole = Whole(idf, [r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows]), np.array([r[0] for r in rows]))
    del rows, got
    trim()
    y = whole.labels
    few: list[dict[int, int]] = [{} for _ in y]
    own = np.flatnonzero(of_lexicon[whole.own_term] >= 0)
    place = np.searchsorted(whole.own_cuts, own, side="right") - 1
    for i, k, c in zip(place.tolist(), of_lexicon[whole.own_term[own]].tolist(), whole.own_tf[own].tolist(), strict=True):
        few[i][k] = c
    lexicon = Index(idf[lexicon_ids], few, y, whole.ids)
    sent = spark.sparkContext.broadcast((vocabulary, Examples(lexicon, of_lexicon, whole)))  # of TOXIC + CLEAN examples
    del whole, lexicon, few, own, place, of_lexicon, vocabulary, idf, df
    trim()

    @frugal
    def own_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                x = sent.value[1].own(i, min(i + TEXTS, len(y)))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], ["id", "x"])

    got = spark.range(0, len(y), TEXTS).mapInArrow(own_features, "id long, x binary").collect()  # seven numbers an example
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 7) for r in sorted(got, key=lambda r: r["id"])])
    w = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    return sent, logistic(x, y, w)


def score(docs: DataFrame, labels: DataFrame, names: tuple[str, str, str] = ("score", "evidence", "similarity")) -> DataFrame:
    """Adds score, evidence (nearest examples' ids) and similarity (of the nearest) to docs, as
    names say; columns of docs with such a name are replaced."""
    model = fit(docs, labels)
    base = docs.drop(*names)
    if isinstance(model, float):
        return base.withColumns(dict(zip(names, (F.lit(model), F.array().cast("array<long>"), F.lit(0.0)), strict=True)))
    sent, weights = model
    at = base.columns.index("text")

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, examples = sent.value
        find, known = Terms(vocabulary), {}
        for b in (x for whole in batches for x in slices(whole, TEXTS)):
            texts = b.column(at).to_pylist()
            keys = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
            if len(known) > 20_000:
                known.clear()
                new = dict(zip(keys, texts, strict=True))
            x, near = examples.features(len(new), *find(list(new.values())))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            for k, v, n in zip(new, p.tolist(), near, strict=True):
                known[k] = v, [int(examples.whole.ids[e]) for _, e in n[:EVIDENCE]], float(n[0][0]) if n else 0.0
            own = list(zip(*(known[k] for k in keys), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own[0], pa.float64()), pa.array(own[1], pa.list_(pa.int64())), pa.array(own[2], pa.float64())], [*b.schema.names, *names])

    kinds = ("double", "array<long>", "double")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
    return base.mapInArrow(run, fields)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", F.coalesce(id_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity"
    )
