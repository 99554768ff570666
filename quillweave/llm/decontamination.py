"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents into segments of about SEGMENT_WORDS words. A segment has a
row for each of its terms, with the ascending places of the term in the segment's words,
and a row (null term) for its documents: ids and where each begins. Segments are built and
stored without a shuffle, for all terms.

A search reads the postings of the test terms only (semi-join on the term), brings each
segment's together, and intersects: for each test window the list of its rarest term in
the segment, shifted by the term's place in the window, is cut down by the other terms'
shifted lists, from rare to common. Windows are given to the tasks in blocks of at most
WINDOW_BLOCK, one pass over the postings for each block, so no broadcast grows with the
benchmark. Documents never span segments; a gap between documents keeps phrases apart.

near > 0 also gives proximity matches: items with a window for which some start in the
document has each of its terms within `near` places of where an exact match would have it.

Defined cases: null or empty texts have no words and no hits; an item without words is no
window, one of fewer than N words is one; items with equal windows all count; repeated
document rows are searched one by one; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, slices, stored, table

N = 8
NEAR = 2
SEGMENT_WORDS = 250_000
WINDOW_BLOCK = 200_000
POSTINGS = 8192  # terms written at once
GAP = 64  # places between documents, more than a window and its slack
_UPPER = bytes(range(65, 91))
_SPACES = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_UPPER + _SPACES, _UPPER.lower() + b" " * len(_SPACES))
INDEX = "segment string, term binary, cf long, postings binary"


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII characters that are not letters or digits."""
    return (text or "").encode().translate(_TABLE).split()


def build_index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the stored index."""

    @frugal
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        begins, sizes, terms, codes = [], [], {}, []
        at = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{task:06d}-{k:06d}"
            code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            place = np.concatenate([np.arange(b, b + n, dtype=np.uint32) for b, n in zip(begins, sizes, strict=True)])
            order = np.argsort(code, kind="stable")
            n = np.bincount(code, minlength=len(terms))
            ends = np.cumsum(n)
            place = place[order]
            raw = [place[e - c : e].tobytes() for c, e in zip(n, ends, strict=True)]
            info = np.array([(-1 if i is None else i, b, s) for i, b, s in zip(ids, begins, sizes, strict=True)], np.int64)
            null = np.array([i is None for i in ids], np.int8).tobytes()
            rows = len(terms)
            names = list(terms)
            for i in range(0, rows, POSTINGS):
                part = names[i : i + POSTINGS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part)), pa.array(part, pa.binary()), pa.array(n[i : i + POSTINGS]), pa.array(raw[i : i + POSTINGS], pa.binary())],
                    ["segment", "term", "cf", "postings"],
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([null + info.tobytes()], pa.binary())],
                ["segment", "term", "cf", "postings"],
            )

        for b in (x for whole in batches for x in slices(whole)):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                codes.append(np.fromiter((terms.setdefault(x, len(terms)) for x in w), np.int32, len(w)))
                ids.append(doc_id)
                begins.append(at)
                sizes.append(len(w))
                at += len(w) + GAP
                if at >= SEGMENT_WORDS:
                    yield from flush()
                    ids, begins, sizes, terms, codes, at, k = [], [], [], {}, [], 0, k + 1
        if ids:
            yield from flush()
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX), "index")


def windows_of(text: str | None, n: int = N) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


def search(index: DataFrame, block: list[tuple[tuple[bytes, ...], list[str]]], near: int = 0) -> DataFrame:
    """index, (window, its items) of one block -> doc_id, n_words, hit places and items, for all documents."""
    spark = index.sparkSession
    terms = sorted({t for w, _ in block for t in w})
    number = {t: i for i, t in enumerate(terms)}
    need = [[number[t] for t in w] for w, _ in block]
    items = [i for _, i in block]
    wanted = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.binary())}).to_pandas(), "term binary") if terms else None
    rows = index.where("term IS NULL")
    rows = rows.union(index.join(F.broadcast(wanted), "term", "left_semi").select(*index.columns)) if terms else rows
    sent = spark.sparkContext.broadcast((terms, need, items))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        terms, need, items = sent.value
        number = {t: i for i, t in enumerate(terms)}
        lists: dict[int, np.ndarray] = {}
        for term, raw in zip(pdf["term"], pdf["postings"], strict=True):
            if term is None:
                raw_docs = bytes(raw)
            else:
                lists[number[bytes(term)]] = np.frombuffer(raw, np.uint32).astype(np.int64)
        n = len(raw_docs) // 25
        null = np.frombuffer(raw_docs[:n], np.int8)
        doc = np.frombuffer(raw_docs[n:], np.int64).reshape(n, 3)
        starts, lengths, found, close = [], [], [[] for _ in range(n)], [set() for _ in range(n)]
        begins = doc[:, 1]
        has = np.zeros(len(terms), bool)
        has[list(lists)] = True
        for w, need_w in enumerate(need):
            if not has[need_w].all():
                continue
            order = sorted(range(len(need_w)), key=lambda j: len(lists[need_w[j]]))
            rarest = lists[need_w[order[0]]]
            at = rarest - order[0]
            # starts that the rarest term allows, and its place, which lies in the document
            wide = (at[:, None] + np.arange(-near, near + 1)).ravel() if near else at
            seat = np.repeat(rarest, 2 * near + 1)
            for j in order[1:]:
                p = lists[need_w[j]]
                if len(at):
                    i = np.minimum(np.searchsorted(p, at + j), len(p) - 1)
                    at = at[p[i] == at + j]
                if near and len(wide):
                    i = np.minimum(np.searchsorted(p, wide + j - near), len(p) - 1)
                    ok = (p[i] >= wide + j - near) & (p[i] <= wide + j + near)
                    wide, seat = wide[ok], seat[ok]
                if not len(at) and not (near and len(wide)):
                    break
            if len(at):
                starts.append(at)
                lengths.append(np.full(len(at), len(need_w)))
                for d in set((np.searchsorted(begins, at, side="right") - 1).tolist()):
                    found[d].append(w)
            if near and len(wide):
                for d in set((np.searchsorted(begins, seat, side="right") - 1).tolist()):
                    close[d].update(items[w])
        spans: list[list[dict]] = [[] for _ in range(n)]
        if starts:
            s = np.concatenate(starts)
            e = s + np.concatenate(lengths)
            o = np.argsort(s, kind="stable")
            s, e = s[o], e[o]
            # a new run begins where a window starts after the end of all before it
            top = np.maximum.accumulate(e)
            new = np.concatenate([[True], s[1:] > top[:-1]])
            first, last = s[new], top[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                d = int(np.searchsorted(begins, a, side="right")) - 1
                spans[d].append({"a": a - int(begins[d]), "b": b - int(begins[d])})
        got = [sorted({i for w in f for i in items[w]}) for f in found]
        ids = pd.array([None if x else int(i) for x, i in zip(null, doc[:, 0], strict=True)], dtype="Int64")
        return pd.DataFrame({"segment": pdf["segment"].iloc[0], "ord": np.arange(n, dtype=np.int32), "doc_id": ids, "n_words": doc[:, 2], "spans": spans, "items": got, "near": [sorted(c) for c in close]})

    return rows.groupBy("segment").applyInPandas(
        match, "segment string, ord int, doc_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>, near array<string>"
    )


def blocks(benchmark: DataFrame, n: int, size: int = WINDOW_BLOCK) -> Iterator[list[tuple[tuple[bytes, ...], list[str]]]]:
    """The benchmark's different windows with their items, `size` windows at a time. Equal
    windows of items in different blocks give their items block by block."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        for w in windows_of(r["text"], n):
            block.setdefault(w, set()).add(r["i"])
        if len(block) >= size:
            yield [(w, sorted(i)) for w, i in block.items()]
            block = {}
    if block:
        yield [(w, sorted(i)) for w, i in block.items()]


def covered(spans: Column) -> Column:
    """How many places an array of structs (a, b) covers."""
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0).cast("long"))).alias("n")
    )
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, near: int = 0) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> a row per document: doc_id, n_words,
    spans (structs a, b: from and to, in words), items, near (the items of proximity matches,
    which exact matches are too)."""
    index = build_index(docs)
    block, parts = [], []
    for nxt in blocks(benchmark, n):  # one block's windows are sent at a time
        if block:
            parts.append(stored(search(index, block, near), "found"))
        block = nxt
    out = search(index, block, near)
    if not parts:
        return out
    for p in parts:
        out = out.union(p)
    return out.groupBy("segment", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=NEAR)
    return out.select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
        F.size(F.array_except("near", "items")).cast("long").alias("n_near"),
    )


_WORDS = "string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, w[i : i + {N - 1}] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM b WHERE w <> ['']) ),
d AS (SELECT doc_id, CASE WHEN s = [''] THEN [] ELSE s END AS w FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS s FROM documents)),
sizes AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (
  SELECT doc_id, i, k, w[i : i + k - 1] AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw ON dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
-- proximity: documents with all of a window's terms, then starts with each within NEAR places
wt AS (SELECT win, unnest(win) AS term, unnest(range(len(win))) AS j, len(win) AS k FROM (SELECT DISTINCT win FROM bw)),
dt AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM d),
hold AS (
  SELECT doc_id, win FROM (SELECT DISTINCT doc_id, term FROM dt) JOIN (SELECT DISTINCT win, term FROM wt) USING (term)
  GROUP BY doc_id, win HAVING count(*) = len(list_distinct(win))),
np AS (
  SELECT doc_id, win FROM (
    SELECT DISTINCT doc_id, win, k, j, unnest(range(i - j - {NEAR}, i - j + {NEAR + 1})) AS s FROM hold JOIN wt USING (win) JOIN dt USING (doc_id, term))
  GROUP BY doc_id, win, s, k HAVING count(*) = k),
n AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item_id FROM np JOIN bw USING (win) EXCEPT SELECT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
