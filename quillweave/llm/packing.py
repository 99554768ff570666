"""Pattern packing by non-negative least squares.

Documents become token pieces of at most 2048; the histogram of piece lengths (2048 counts
at most) goes to the driver. There, patterns of up to three length classes of UNIT lengths
that fill a sequence are enumerated, and their repeat counts fitted to the histogram by NNLS
and rounded. Each repeat takes real lengths of its classes that fill a sequence without a
gap; where none are left, the pattern ends. What is left is packed by best fit decreasing
over counts. The plan's size depends on the number of different lengths, not of documents.
Each piece is then ranked within its length, and its rank names its sequence and offset.

Defined cases: a null or empty text is one piece of length 1 (the end id); repeated rows are
packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, ranked, slices, stored, table
from .token_counts import byte_symbols

LENGTH = 2048
END = 0
UNIT = 16
CACHED = 300_000  # different chunks of text that a task keeps the ids of


class WordPieces:
    """Ids of chunks of printable ASCII and Latin-1 letters under a lower-casing BPE of bytes with
    word ends, whose words are cut by SPLIT. A byte that no such chunk holds stands for the
    word end, so that byte pairs merge by the order of the vocabulary and tiktoken can do it."""

    SAFE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    #: Fixed values of the vocabulary file's format: its word splitting and its word end.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"
    STEPS = ["NFC", "Replace", "Lowercase"]
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff \x01]+|\x01")

    @classmethod
    def fits(cls, spec: dict) -> bool:
        model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        return (
            model.get("type") == "BPE" and model.get("end_of_word_suffix") == cls.WORD_END and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
            and [x.get("type") for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": cls.SPLIT}
            and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == cls.STEPS
        )

    def __init__(self, spec: dict):
        import tiktoken

        symbols, vocabulary = byte_symbols(), spec["model"]["vocab"]
        ranks: dict[bytes, int] = {}
        self.back = []
        joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"])
        letters = [c for c, b in symbols.items() if b > 1]
        for w in [None, None, *letters, *(c + self.WORD_END for c in letters), *joined]:
            raw = bytes([len(ranks)]) if w is None else bytes(symbols[c] for c in w.removesuffix(self.WORD_END)) + b"\0" * w.endswith(self.WORD_END)
            if raw not in ranks:
                ranks[raw] = len(ranks)
                self.back.append(0 if w is None else vocabulary[w])
        self.back = np.array(self.back, "<u4")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.encoding = tiktoken.Encoding("words", pat_str="[^\\x00\\x01]+\\x00|\\x01", mergeable_ranks=ranks, special_tokens={})

    def takes(self, chunk: str) -> bool:
        return bool(self.SAFE.fullmatch(chunk)) and not any(t in chunk for t in self.special)

    def __call__(self, chunks: list[str]) -> Iterator[bytes]:
        """The byte 1 ends a chunk, the byte 0 a word."""
        marked = self.WORDS.sub(lambda m: m[0] if m[0] == "\1" else m[0] + "\0", "\1".join([*chunks, ""]).lower())
        got = np.array(self.encoding.encode_ordinary(marked), np.int64)
        ids, at = self.back[got], 0
        for e in np.flatnonzero(got == 1).tolist():
            yield ids[at:e].tobytes()
            at = e + 1


class ChunkTokenizer:
    """Ids of whole texts, as little-endian 32-bit bytes, by way of their chunks between
    spaces. Valid for tokenizers that drop white space and never join across it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = WordPieces(spec) if WordPieces.fits(spec) else None

    def forget(self) -> None:
        """Lets go of the chunks."""
        self.known = {"": b""}

    def learn(self, chunks: list[str]) -> None:
        fast, slow = [], chunks
        if self.fast:
            fast = [c for c in chunks if self.fast.takes(c)]
            self.known.update(zip(fast, self.fast(fast), strict=True))
            slow = [c for c in chunks if c not in self.known] if len(fast) < len(chunks) else []
        if slow:
            got = self.tokenizer.encode_batch(slow, add_special_tokens=False)
            self.known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(slow, got, strict=True))

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            chunks = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            try:
                yield b"".join(map(known.__getitem__, chunks))
                continue
            except KeyError:
                pass
            if len(known) > CACHED:
                self.forget()
                known = self.known
            new = list(set(chunks).difference(known))
            self.learn(new)
            yield b"".join(map(known.__getitem__, chunks))
            for c in new:
                if len(c) > 64:
                    del known[c]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32."""
    tail = np.array([end], "<u4").tobytes()

    @frugal
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer(tokenizer)  # a task's own, as a worker would hold it in all that comes after
        for batch in (b for whole in batches for b in slices(whole)):
            out: list[list[int | None]] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tok.ids(batch.column(1).to_pylist()), strict=True):
                raw = memoryview(ids + tail)
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    for column, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del tok

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active-set method: x >= 0 that minimises |a x - b|. Each outer step lowers
    the error, so it ends; should rounding keep it from that, it raises."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(20 * n):
        w = target - gram @ x
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            return x
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[idx] = s
                break
            neg = s <= 0
            step = np.min(x[idx][neg] / np.maximum(x[idx][neg] - s[neg], 1e-300))
            x[idx] += step * (s - x[idx])
            off = idx[(x[idx] <= 1e-12) & neg]
            if not len(off):
                off = idx[neg][:1]
            active[off] = False
            x[off] = 0
            if not active.any():
                break
    raise RuntimeError("the fit of pattern counts did not converge")


def best_fit(counts: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(lens: tuple[int, ...], m: int) -> None:
        r = cap - sum(lens)
        if r not in room:
            room[r] = []
            insort(spaces, r)
        room[r].append((lens, m))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(spaces, size)
            if i < len(spaces):
                r = spaces[i]
                lens, m = room[r].pop()
                if not room[r]:
                    del room[r]
                    spaces.pop(i)
            else:
                lens, m = (), left
            t = (cap - sum(lens)) // size
            full = min(m, left // t)
            if full:
                put(lens + (size,) * t, full)
            left -= full * t
            m -= full
            if m and left and left < t:
                put(lens + (size,) * left, 1)
                left, m = 0, m - 1
            if m and lens:
                put(lens, m)
    return [x for r in spaces for x in room[r]]


def by_patterns(counts: dict[int, int], cap: int, unit: int = UNIT) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Full sequences by the fitted patterns, and the counts of what is left."""
    n = -(-cap // unit)
    pats = [(n,)] + [(i, n - i) for i in range(1, n // 2 + 1)] + [(i, j, n - i - j) for i in range(1, n // 3 + 1) for j in range(i, (n - i) // 2 + 1)]
    a, b = np.zeros((n, len(pats))), np.zeros(n)
    for k, p in enumerate(pats):
        for i in p:
            a[i - 1, k] += 1
    for size, c in counts.items():
        b[-(-size // unit) - 1] += c
    repeats = np.rint(nnls(a, b)).astype(int)
    left, made = dict(counts), []
    by_class: dict[int, list[int]] = {}
    for size in sorted(counts, reverse=True):
        by_class.setdefault(-(-size // unit), []).append(size)

    def filled(classes: tuple[int, ...], room: int) -> tuple[int, ...] | None:
        """Lengths that are left, one of each class but the last, with one that fills the room exactly."""
        if len(classes) == 1:
            return (room,) if left.get(room) else None
        for x in by_class.get(classes[0], ()):
            if x < room and left[x]:
                left[x] -= 1
                rest = filled(classes[1:], room - x)
                left[x] += 1
                if rest:
                    return (x, *rest)
        return None

    for k in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[k])
        while todo > 0 and (lens := filled(pats[k], cap)):
            need: dict[int, int] = {}
            for s in lens:
                need[s] = need.get(s, 0) + 1
            m = min([todo, *(left[s] // c for s, c in need.items())])
            for s, c in need.items():
                left[s] -= m * c
            made.append((lens, m))
            todo -= m
    return made, {s: c for s, c in left.items() if c}


def plan(counts: dict[int, int], cap: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): uses every counted piece once."""
    full = [((cap,), counts[cap])] if counts.get(cap) else []
    made, left = by_patterns({s: c for s, c in counts.items() if s < cap}, cap)
    return full + made + best_fit(left, cap)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> one row per piece with sequence_id and offset."""
    cut = stored(pieces(docs, tokenizer, length), "pieces")
    counts = {r["length"]: r["c"] for r in cut.groupBy("length").agg(F.count("*").alias("c")).collect()}  # at most `length` rows
    slots, used, base = [], {}, 0
    for lens, m in plan(counts, length):
        offset = 0
        for size in lens:
            slots.append((size, used.get(size, 0), base, offset))
            used[size] = used.get(size, 0) + m
            offset += size
        base += m
    assert used == counts
    slots.sort()
    size, first, seq, off = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 4
    keys = (size << 44) + first

    @frugal
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            rank = t["rank"].to_numpy()
            i = np.searchsorted(keys, (t["length"].to_numpy() << 44) + rank, side="right") - 1
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(seq[i] + rank - first[i])).append_column("offset", pa.array(off[i]))
            yield from t.to_batches()

    rows = ranked(cut, "length", ["doc_id", "piece"], ["ids_crc32", "doc_id", "piece"], "rank", sum(counts.values()))
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
