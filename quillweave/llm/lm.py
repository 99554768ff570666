"""Language-model scoring by online logistic context mixing.

The text is coded in its order. A token (word, or the end of the text) is a path of bits in
a Huffman tree of the FREQUENT commonest training tokens and an escape. Predictors look up
counts of zeros and ones by a hash of the tree's node and a context: none, the token before,
the two before, the one before that, and the last two of the COMMON commonest tokens, which
tell language and phrase. Their stretched probabilities are mixed by weights that a gate
(trust in the contexts' counts, depth) selects. The mix is refined twice: it is scaled and
shifted online as the text's own errors say, after each BLOCK of tokens, and a map of mixed
to seen probabilities, learned with the weights, is averaged in.

A token behind the escape is new with the Good-Turing probability, or one of the other
training tokens with its exact share, from the table of all token counts. A new one is
spelled byte by byte, bits mixed from hashed contexts of its bytes before. The log10
probability of a text is the sum, so total bits are -score / log10(2).

Texts are read once: their symbols are stored in 16 bits each, which all later passes take.

What is gathered: the exact counts of all training tokens, a table that grows with the
corpus and is joined; and counts of hashed contexts over all places of all training texts,
in tables of 2 ** SLOT_BITS slots a predictor, of a fixed size as each worker holds them
(contexts of large corpora collide there; trust gates and weights learn how far they help).
Weights and maps are learned over all places of all training texts (and the spellings of all
training tokens) too, each bit's own count taken out: a Newton step from even weights, whose
sums over all bits are added up by gate. Counts are whole numbers and weights are rounded
far above the sums' last digits, so scores don't depend on how rows are dealt. Nothing is
learned from a sample.

Defined cases: a null or empty text is its end alone; repeated rows are scored one by one; a
null id is never held out; without training texts every token is escaped and spelled with
even bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, id_fold, let_go, slices, stored, table

FREQUENT = 65_535
COMMON = 64
OWN_KIND = 2048  # commonest symbols that are a kind of their own as a context
KINDS = 2560  # with those of the other tokens, by their last two bytes
DEEP = 8  # depth in the tree from which the long contexts are cut short
SLOT_BITS = 20
SPELL_BITS = 18
SPELL_ORDERS = (1, 2, 3, 4, 0)  # bytes before in the token; 0: all of them
PRIOR = 0.4
BLOCK = 256
INERTIA = 100.0
START = 0.2  # weight of each predictor before the Newton step
RIDGE = 50.0
SEEN = 30.0  # bits that the map has seen beforehand in each bucket
DIGITS = 6  # of weights
CACHED = 200_000
FLUSH = 200_000
BATCH_TOKENS = 30_000
BUCKETS = 33
END = b"\n"
ESCAPE = 1  # symbol 0 is the end
CHUNKS = 32
TASKS = 64  # partial tables that are summed at once
FLOOR = 1e-5


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit hashes of 64-bit numbers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """context is overwritten."""
    context ^= node
    context *= np.uint32(0x9E3779B1)
    context >>= np.uint32(32 - bits)
    return context


def _kind(token: bytes) -> int:
    return OWN_KIND + xxhash.xxh32_intdigest(token[-2:]) % (KINDS - OWN_KIND)


class Bits:
    """Bits of texts: a slot for each predictor, bit, place (a small number that selects weights),
    and the item (token or text) and block that each belongs to. An item's bits are in order
    within each block, but need not stand together."""

    def __init__(self, slots: list[np.ndarray], bit: np.ndarray, place: np.ndarray, item: np.ndarray, block: np.ndarray):
        self.slots, self.bit, self.place, self.item, self.block = slots, bit, place, item, block


class Tree:
    """The Huffman code of symbols: nodes and bits of the path of symbol s are at
    start[s] : start[s] + size[s]."""

    def __init__(self, weights: list[int]):
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        at = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]], up[b[1]] = (at, 0), (at, 1)
            heapq.heappush(heap, (a[0] + b[0], at))
            at += 1
        paths = []
        for k in range(len(weights)):
            path = []
            while k in up:
                k, bit = up[k]
                path.append((k - len(weights), bit))
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.nodes = np.array([n for p in paths for n, _ in p], np.uint32)
        self.bits = np.array([b for p in paths for _, b in p], np.uint8)
        self.salts = _mix(self.nodes.astype(np.uint64) + np.uint64(1 << 40))


class TokenCoder:
    """Bits of texts, given as the symbols and kinds of their tokens."""

    predictors, bits, places, trusted = 5, SLOT_BITS, 2, (3, 4)

    def __init__(self, tree: Tree, names: list[bytes]):
        self.tree, self.symbol = tree, {t: k for k, t in enumerate(names) if k != ESCAPE}
        self.kinds = np.array([k if k < OWN_KIND else _kind(t) for k, t in enumerate(names)], np.int64)

    def __call__(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Bits:
        n = np.array([len(s) for s, _ in texts])
        return self.joined(n, *(np.concatenate([t[k] for t in texts]) for k in (0, 1)))

    def joined(self, n: np.ndarray, symbol: np.ndarray, kind: np.ndarray) -> Bits:
        """Of texts that stand one after another; n: their numbers of tokens."""
        text = np.repeat(np.arange(len(n), dtype=np.int32), n)
        first = np.repeat(np.cumsum(n) - n, n)
        at = np.arange(len(symbol))
        # the last common token before each place, the one before that, and the next
        common = np.concatenate([[-1], np.where(symbol < COMMON, at, -1)[:-1]])
        last = np.maximum.accumulate(common)
        one = np.where(last >= first, last, -1)
        two = np.where(one >= 0, one[one], -1)
        three = np.where(two >= 0, one[two], -1)
        c1, c2, c3 = (np.where(k >= 0, symbol[k], COMMON) for k in (one, two, three))
        k1, k2 = (np.where(at - first >= d, kind[np.maximum(at - d, 0)], KINDS) for d in (1, 2))
        pair = c1 * 128 + c2
        short = [_mix(k1), _mix(pair + (1 << 20))]
        long = [short[0], short[1], _mix(k1 * 8192 + k2 + (1 << 30)), _mix(pair * 128 + c3 + (1 << 60))]
        size = self.tree.size[symbol]
        top = np.minimum(size, DEEP)
        begin = self.tree.start[symbol]
        parts = []
        for count, start, contexts in ((top, begin, long), (size - top, begin + top, short)):
            path = np.arange(count.sum(), dtype=np.int32) + np.repeat((start - (np.cumsum(count) - count)).astype(np.int32), count)
            salt = self.tree.salts[path]
            slots = [_slot(np.repeat(c, count), salt, SLOT_BITS) for c in contexts]
            # contexts that are cut short have tables of their own
            slots = [self.tree.nodes[path], *slots, *slots[: 4 - len(slots)]]
            rest = np.repeat(text, count), np.repeat(((at - first) // BLOCK).astype(np.int32), count)
            parts.append((slots, self.tree.bits[path], *rest))
        slots = [np.concatenate(p) for p in zip(*(q[0] for q in parts), strict=True)]
        bit, item, block = (np.concatenate([q[k] for q in parts]) for k in (1, 2, 3))
        place = np.zeros(len(bit), np.uint8)
        place[len(parts[0][1]) :] = 1
        return Bits(slots, bit, place, item, block)


class SpellCoder:
    """Bits of tokens: their bytes, then a space."""

    predictors, bits, places, trusted = len(SPELL_ORDERS), SPELL_BITS, 8, (3, 4)

    def __call__(self, tokens: list[bytes]) -> Bits:
        coded = [t + b" " for t in tokens]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        start = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(data)) - start
        last, contexts = np.zeros(len(data), np.uint64), []
        for j in range(1, max(SPELL_ORDERS) + 1):
            before = np.zeros(len(data), np.uint64)
            before[j:] = data[:-j] if j < len(data) else 0
            before[place < j] = 0
            last = (last + before + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            last ^= last >> np.uint64(29)
            if j in SPELL_ORDERS:
                contexts.append(last.copy())
        power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place])])
        contexts.append((sums[:-1] - sums[start]) ^ (place.astype(np.uint64) + np.uint64(77)) * np.uint64(0x94D049BB133111EB))
        k = np.arange(7, -1, -1)
        bit = ((data[:, None] >> k) & 1).ravel()
        node = ((np.int64(1) << (7 - k)) | (data[:, None].astype(np.int64) >> (k + 1))).ravel()
        salt = _mix(np.arange(256))[node]
        slots = [_slot(np.repeat(_mix(c), 8), salt, SPELL_BITS) for c in contexts]
        item = np.repeat(np.repeat(np.arange(len(coded), dtype=np.int32), size), 8)
        return Bits(slots, bit, np.tile(np.arange(8, dtype=np.uint8), len(data)), item, np.zeros(len(bit), np.int32))


def _trust(n: np.ndarray) -> np.ndarray:
    return (n >= 3).astype(np.uint8) + (n >= 30) + (n >= 300)


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))).astype(np.float16)


class Gates:
    """Tables of stretched predictions (a row each) and of trust, where predictors have it."""

    def __init__(self, places: int, trusted: tuple[int, int], stretched: np.ndarray, trust: dict[int, np.ndarray]):
        self.places, self.trusted, self.stretched, self.trust = places, trusted, stretched.astype(np.float32), trust
        self.gates, self.width = 16 * places, len(stretched) + 1

    def __getstate__(self) -> dict:
        """Half of the bytes: the tables hold half precision."""
        return {**self.__dict__, "stretched": self.stretched.astype(np.float16)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = {**state, "stretched": state["stretched"].astype(np.float32)}

    def gate(self, b: Bits) -> np.ndarray:
        gate = b.place.copy()
        for k in self.trusted:
            gate += np.take(self.trust[k], b.slots[k], mode="clip") * np.uint8(self.places * (4 if k == self.trusted[0] else 1))
        return gate


class Lessons(Gates):
    """What a Newton step needs, summed over bits by gate. Predictions go by slot and bit, each
    without that bit's own count, and so does trust."""

    def __init__(self, tables: np.ndarray, places: int, trusted: tuple[int, int]):
        own = np.empty((len(tables), 2 * tables.shape[1]), np.float16)
        for t, out in zip(tables, own, strict=True):
            zeros, ones = t[:, 0], t[:, 1]
            out[0::2], out[1::2] = _stretched(np.maximum(zeros - 1, 0), ones), _stretched(zeros, np.maximum(ones - 1, 0))
        super().__init__(places, trusted, own, {k: _trust(tables[k].sum(1) - 1) for k in trusted})

    def none(self) -> list[np.ndarray]:
        """Sums over no bits: slopes, bends, and bits by bucket of the map."""
        return [np.zeros((self.gates, self.width)), np.zeros((self.gates, self.width, self.width)), np.zeros((self.gates, BUCKETS, 2))]

    def add(self, sums: list[np.ndarray], b: Bits) -> None:
        gate = self.gate(b)
        x = np.full((self.width, len(gate)), 0.3, np.float32)
        mixed = np.zeros(len(gate), np.float32)
        for k, s in enumerate(b.slots):
            np.take(self.stretched[k], s * np.uint32(2) + b.bit, out=x[k], mode="clip")
            mixed += x[k]
        mixed *= np.float32(START)
        seen = (gate * np.int32(BUCKETS) + _bucket(mixed)) * 2 + b.bit
        sums[2] += np.bincount(seen, minlength=sums[2].size).reshape(sums[2].shape)
        p = squash(mixed)
        order = np.argsort(gate, kind="stable")
        cuts = np.searchsorted(gate[order], np.arange(self.gates + 1))
        x, err, bend = np.take(x, order, axis=1), (b.bit - p)[order], (p * (1 - p))[order]
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            here = slice(cuts[g], cuts[g + 1])
            own = x[:, here].astype(np.float64)
            sums[0][g] += own @ err[here]
            sums[1][g] += (own * bend[here]) @ own.T


class Mixer(Gates):
    """Predictions from counts in tables (predictor, slot, bit), weights (gate, predictor and a
    constant) and the refining map (gate, bucket), learned by the sums of Lessons."""

    def __init__(self, tables: np.ndarray, places: int, trusted: tuple[int, int], sums: list[np.ndarray]):
        stretched = np.empty(tables.shape[:2], np.float16)
        for t, out in zip(tables, stretched, strict=True):
            out[:] = _stretched(t[:, 0], t[:, 1])
        super().__init__(places, trusted, stretched, {k: _trust(tables[k].sum(1)) for k in trusted})
        slopes, bends, seen = sums
        start = np.array([*[START] * len(tables), 0.0])
        step = np.linalg.solve(bends + RIDGE * np.eye(self.width), slopes[:, :, None])[:, :, 0]
        self.weights = np.round(start + np.clip(step, -1, 1), DIGITS)
        even = squash((np.arange(BUCKETS) - BUCKETS // 2) * 0.5)
        self.apm = (even * SEEN + seen[:, :, 1]) / (SEEN + seen.sum(2))
        self.by_input = np.ascontiguousarray(self.weights.T, np.float32)
        self.refining = self.apm.astype(np.float32).ravel()

    def inputs(self, b: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (a row each) with a constant, and gates."""
        x = np.full((self.width, len(b.bit)), 0.3, np.float32)
        for k, s in enumerate(b.slots):
            np.take(self.stretched[k], s, out=x[k], mode="clip")
        return x, self.gate(b)

    def log10(self, b: Bits, items: int) -> np.ndarray:
        """log10 probabilities of the items; the mix follows an item's errors from block to block."""
        x, gate = self.inputs(b)
        gate = gate.astype(np.intp)
        mixed, part = np.zeros(len(b.bit), np.float32), np.empty(len(b.bit), np.float32)
        for v, w in zip(x, self.by_input, strict=True):
            np.take(w, gate, out=part, mode="clip")
            part *= v
            mixed += part
        last = np.zeros(items, np.int32)
        np.maximum.at(last, b.item, b.block)
        if last.any():
            self._follow(b, mixed, last)
        np.clip(mixed, -12, 12, out=mixed)
        np.take(self.refining, gate * BUCKETS + _bucket(mixed), out=part, mode="clip")
        np.exp(np.negative(mixed, out=mixed), out=mixed)
        mixed += 1
        p = (np.reciprocal(mixed, out=mixed) + part) * np.float32(0.5)
        p = np.clip(np.where(b.bit, p, 1 - p), FLOOR, 1 - FLOOR)
        return np.bincount(b.item, weights=np.log10(p), minlength=items)

    def _follow(self, b: Bits, mixed: np.ndarray, last: np.ndarray) -> None:
        """Scales and shifts mixed, place by place, by what the errors of an item's blocks before say."""
        long = np.flatnonzero(last)
        number = np.full(len(last), -1, np.int32)
        number[long] = np.arange(len(long), dtype=np.int32) * self.places
        rows = np.flatnonzero(last[b.item])
        block = b.block[rows].astype(np.min_scalar_type(int(last.max())))  # few bytes are sorted faster
        order = np.argsort(block, kind="stable")
        rows, cuts = rows[order], np.searchsorted(block[order], np.arange(last.max() + 2))
        cells = len(long) * self.places
        slope, shift, by_slope, by_shift = (np.zeros(cells) for _ in range(4))
        for k in range(last.max() + 1):
            r = rows[cuts[k] : cuts[k + 1]]
            item, m = b.item[r], mixed[r]
            cell = number[item] + b.place[r]
            if k:
                m = m * (1 + slope / (by_slope + INERTIA)).astype(np.float32)[cell] + (shift / (by_shift + INERTIA)).astype(np.float32)[cell]
                mixed[r] = m
            go = last[item] > k  # an item's last block teaches nothing
            if not go.all():
                cell, m, r = cell[go], m[go], r[go]
            p = 1 / (1 + np.exp(-np.clip(m, -12, 12)))
            err, bend = b.bit[r] - p, p * (1 - p)
            slope += np.bincount(cell, weights=err * m, minlength=cells)
            shift += np.bincount(cell, weights=err, minlength=cells)
            by_slope += np.bincount(cell, weights=bend * m * m, minlength=cells)
            by_shift += np.bincount(cell, weights=bend, minlength=cells)


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(mixed, -8, 8) * np.float32(2)).astype(np.int32) + np.int32(BUCKETS // 2)


def token_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the stored exact counts (token, c); the end is the token of a newline."""

    @frugal
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

        for b in (s for whole in batches for s in slices(whole)):
            for text in b.column(0).to_pylist():
                seen.update(words(text))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return stored(docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")


def gathered(rows: DataFrame, coder: Callable, bits_of: Callable[[Iterable[pa.RecordBatch]], Iterator[Bits]]) -> np.ndarray:
    """Counts (predictor, slot, bit) over the Bits of all rows: partial tables of each task are
    summed part by part, and the sums, of a fixed size, go to the driver. Each core takes its rows
    in one task, so there are as many partial tables as cores, however many files the rows lie in."""
    shape = (coder.predictors, 1 << coder.bits, 2)
    chunk = shape[1] * 2 // CHUNKS

    @frugal
    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() // TASKS
        tables = np.zeros((shape[0], shape[1] * 2), np.uint32)
        some = False
        for b in bits_of(batches):
            some = True
            for k, s in enumerate(b.slots):
                np.add.at(tables[k], s * np.uint32(2) + b.bit, np.uint32(1))
        if some:
            for k in range(shape[0]):
                for i in range(CHUNKS):
                    blob = tables[k, i * chunk : (i + 1) * chunk].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k * CHUNKS + i], pa.int32()), pa.array([task], pa.int32()), pa.array([blob], pa.binary())], ["part", "task", "blob"])

    def total(read: type, write: type):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, part, task = np.zeros(chunk, np.float64), None, None
            for pdf in batches:
                for part, task, blob in zip(pdf["part"], pdf["task"], pdf["blob"], strict=True):
                    out += np.frombuffer(blob, read)
            yield pd.DataFrame({"part": [part], "task": [task], "blob": [out.astype(write).tobytes()]})

        run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
        return run

    schema = "part int, task int, blob binary"
    # whole numbers in double precision are exact in any order; runs of TASKS tasks are summed first
    rows = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, 1))
    sums = rows.mapInArrow(tally, schema).groupBy("part", "task").applyInPandas(total(np.uint32, np.float64), schema)
    sums = sums.groupBy("part").applyInPandas(total(np.float64, np.float32), schema)
    out = np.zeros((shape[0], shape[1] * 2), np.float32)
    for r in sums.toLocalIterator():
        k, i = divmod(r["part"], CHUNKS)
        out[k, i * chunk : (i + 1) * chunk] = np.frombuffer(r["blob"], np.float32)
    return out.reshape(shape)


class Reader:
    """Symbols and hashes of texts' tokens, by way of a bounded map of tokens."""

    def __init__(self, symbol: dict[bytes, int]):
        self.symbol, self.known, self.names = symbol, {}, []
        self.symbols, self.kinds = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The tokens' numbers, by which symbols, hashes and names go, until the next call."""
        tokens = [[*words(t), END] for t in texts]
        if len(self.known) > CACHED:
            self.__init__(self.symbol)
        new = list(set().union(*tokens).difference(self.known))
        self.known.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
        self.names += new
        self.symbols = np.concatenate([self.symbols, np.array([self.symbol.get(t, ESCAPE) for t in new], np.int64)])
        self.kinds = np.concatenate([self.kinds, np.where(self.symbols[len(self.kinds):] < OWN_KIND, self.symbols[len(self.kinds):], [_kind(t) for t in new])])
        return [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in tokens]


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about BATCH_TOKENS tokens, and where each begins."""
    texts: list[str | None] = []
    begin = size = done = 0
    for part in slices(batch, 256):
        for t in part.column(column).to_pylist():
            texts.append(t)
            size += len(t or "") // 6 + 1
            done += 1
            if size > BATCH_TOKENS:
                yield begin, texts
                texts, begin, size = [], done, 0
    if texts:
        yield begin, texts


class _Symbols(dict):
    def __missing__(self, token: bytes) -> int:
        return ESCAPE


def read(docs: DataFrame, coder: TokenCoder) -> DataFrame:
    """docs (doc_id, text, held_out) -> a stored table with a row for each text, numbered by rid, with
    its symbols but the end's, which is the last of each (so the others fit 16 bits); and a row for
    each of its different tokens behind the escape, with their count n."""
    sent = docs.sparkSession.sparkContext.broadcast(coder.symbol)  # FREQUENT tokens

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, symbol_of = TaskContext.get().partitionId() << 36, _Symbols(sent.value).__getitem__
        for b in batches:
            for begin, texts in _groups(b, 1):
                codes, size, rare = [], [], ([], [], [])
                for k, t in enumerate(texts):
                    raw = (t or "").encode()
                    tokens = raw.lower().split()
                    symbols = np.fromiter(map(symbol_of, tokens), np.int32, len(tokens))
                    codes.append((symbols - 1).astype("<u2").tobytes())
                    size.append(len(raw))
                    escaped = Counter(map(tokens.__getitem__, np.flatnonzero(symbols == ESCAPE).tolist()))
                    for column, v in zip(rare, ([rid + k] * len(escaped), escaped.keys(), escaped.values()), strict=True):
                        column.extend(v)
                part, none, e = b.slice(begin, len(texts)), len(texts), len(rare[0])
                own = [pa.array(np.arange(rid, rid + none)), part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64())], READ)
                if e:
                    nulls = [pa.nulls(e, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(rare[0], pa.int64()), *nulls, pa.array(rare[1], pa.binary()), pa.array(rare[2], pa.int64())], READ)
                rid += none
        let_go(sent)

    schema = "rid long, doc_id long, held_out boolean, n_bytes long, codes binary, token binary, n long"
    return stored(docs.select("doc_id", "text", "held_out").mapInArrow(run, schema), "read")


READ = ["rid", "doc_id", "held_out", "n_bytes", "codes", "token", "n"]


def _symbols(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about BATCH_TOKENS tokens: where each begins, and the texts' numbers of tokens
    and all their symbols, from their codes."""
    codes = batch.column(column).to_pylist()
    ends = np.cumsum([len(c) // 2 + 1 for c in codes])
    last = 0
    while last < len(codes):
        i, done = last, ends[last - 1] if last else 0
        last = int(np.searchsorted(ends, done + BATCH_TOKENS)) + 1
        n = np.diff(np.r_[done, ends[i:last]])
        symbol = np.zeros(n.sum(), np.int64)  # the end's is 0
        word = np.ones(len(symbol), bool)
        word[np.cumsum(n) - 1] = False
        symbol[word] = np.frombuffer(b"".join(codes[i:last]), "<u2").astype(np.int64) + 1
        yield i, n, symbol


def _runs(tokens: Iterable[bytes], size: int = 40_000) -> Iterator[list[bytes]]:
    """Runs of tokens of about size bytes."""
    run, n = [], 0
    for t in tokens:
        run.append(t)
        n += len(t) + 1
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def _trained(rows: DataFrame, coder: Callable, bits_of: Callable[[Iterable[pa.RecordBatch]], Iterator[Bits]]) -> Mixer:
    """The mixer of all rows: counts first, then the sums of a Newton step, a fixed number a task."""
    tables = gathered(rows, coder, bits_of)
    lessons = Lessons(tables, coder.places, coder.trusted)
    sums = lessons.none()
    sent = rows.sparkSession.sparkContext.broadcast(lessons)  # tables of a fixed size
    del lessons

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sent.value.none()
        for b in bits_of(batches):
            sent.value.add(sums, b)
        let_go(sent)
        every = np.concatenate([x.ravel() for x in sums])
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(every[some])], ["cell", "v"])

    got = rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    sent.destroy()
    every = np.zeros(sum(x.size for x in sums))
    every[got.column(0).to_numpy()] = got.column(1).to_numpy()
    parts = np.split(every, np.cumsum([x.size for x in sums])[:-1])
    return Mixer(tables, coder.places, coder.trusted, [p.reshape(x.shape) for p, x in zip(parts, sums, strict=True)])


class Model:
    """A tree and mixer of tokens, a mixer of spellings, and what the escape leads to."""

    def __init__(self, coder: TokenCoder, mixer: Mixer, speller: Mixer, frequent: np.ndarray, rare: int, single: int):
        self.coder, self.mixer, self.speller, self.frequent = coder, mixer, speller, frequent
        self.rare, self.new = rare, (single + 1) / (rare + 2)

    def behind_escape(self, token: bytes, count: int | None) -> float:
        if count:
            return float(np.log10(1 - self.new) + np.log10(count / self.rare))
        return float(np.log10(self.new) + self.speller.log10(SpellCoder()([token]), 1)[0])


def symbols_of(counts: DataFrame) -> tuple[TokenCoder, np.ndarray, int, int]:
    """The coder of the token counts, its symbols' counts, that of all other tokens, and how many of those occur once."""
    top = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(FREQUENT).collect()
    n, single = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if((F.col("c") == 1) & (F.col("token") != F.lit(END)))).first()
    ends = counts.where(F.col("token") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    rare = n - ends - sum(r["c"] for r in top)
    single -= sum(r["c"] == 1 for r in top)
    names = [END, b"", *(bytes(r["token"]) for r in top)]
    coder = TokenCoder(Tree([max(ends, 1), max(rare, 1), *(r["c"] for r in top)]), names)
    return coder, np.array([ends, 0, *(r["c"] for r in top)], np.int64), rare, single


def learned(texts: DataFrame, counts: DataFrame, coder: TokenCoder, frequent: np.ndarray, rare: int, single: int) -> Model:
    """texts: a table of read()."""
    sent = texts.sparkSession.sparkContext.broadcast(coder)

    def token_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[Bits]:
        for b in batches:
            for _, n, symbol in _symbols(b, 0):
                yield sent.value.joined(n, symbol, sent.value.kinds[symbol])
        let_go(sent)

    def spell_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[Bits]:
        for run in _runs(t for b in batches for t in b.column(0).to_pylist()):
            yield SpellCoder()(run)

    types = counts.where(F.col("token") != F.lit(END)).select("token")
    train = texts.where("codes IS NOT NULL AND NOT held_out").select("codes")
    mixer, speller = _trained(train, coder, token_bits), _trained(types, SpellCoder, spell_bits)
    return Model(coder, mixer, speller, frequent, rare, single)


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """docs (doc_id, text) of the training texts and their token counts."""
    found = symbols_of(counts)
    return learned(read(docs.withColumn("held_out", F.lit(False)), found[0]), counts, *found)


def score(docs: DataFrame, folds: int = 10, held_out: int = 0) -> DataFrame:
    """docs (doc_id, text): learns from those whose fold isn't held out, scores all."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(id_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"))
    counts = token_counts(docs.where("NOT held_out").select("doc_id", "text"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = n + 0.1 * (v + 1)
    found = symbols_of(counts)
    texts = read(docs, found[0])
    model = learned(texts, counts, *found)
    sent = spark.sparkContext.broadcast((model, np.log10((model.frequent + 0.1) / below), model.frequent > 0))  # FREQUENT tokens and tables of a fixed size

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base_of, known_of = sent.value
        for b in batches:
            for begin, n, symbol in _symbols(b, 4):
                lp = model.mixer.log10(model.coder.joined(n, symbol, model.coder.kinds[symbol]), len(n))
                text, own = np.repeat(np.arange(len(n)), n), symbol != ESCAPE
                sums = lambda x: np.bincount(text[own], weights=x[symbol[own]], minlength=len(n))  # noqa: B023, E731
                part = b.slice(begin, len(n))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(n, pa.int64()), pa.array(sums(known_of).astype(np.int64)), pa.array(sums(base_of)), pa.array(lp)], NAMES
                )
        del model
        let_go(sent)

    schema = "rid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double"
    out = stored(texts.where("codes IS NOT NULL").select(*READ[:5]).mapInArrow(run, schema), "scored")
    rare = texts.where("token IS NOT NULL").select("rid", "token", "n").join(counts, "token", "left")

    @frugal
    def escaped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spelled = sent.value[0], {}
        for b in batches:
            token, n, c = b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).fill_null(0).to_numpy()
            new = list({t for t, x in zip(token, c, strict=True) if not x}.difference(spelled))
            for run in _runs(new):
                spelled.update(zip(run, model.speller.log10(SpellCoder()(run), len(run)).tolist(), strict=True))
            seen = np.maximum(c, 1) / max(model.rare, 1)
            lp = np.where(c > 0, np.log10(1 - model.new) + np.log10(seen), np.log10(model.new) + np.array([spelled.get(t, 0.0) for t in token]))
            if len(spelled) > CACHED:
                spelled.clear()
            base = n * np.log10((c + 0.1) / below)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base), pa.array(n * (c > 0)), pa.array(n * lp)], ["rid", "base", "known", "lp"])
        del model, spelled
        let_go(sent)

    rare = rare.select("rid", "token", "n", "c").mapInArrow(escaped, "rid long, base double, known long, lp double")
    rare = rare.groupBy("rid").agg(F.sum("base").alias("rare_base"), F.sum("known").alias("rare_known"), F.sum("lp").alias("rare_lp"))
    both = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", both("n_known", "rare_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        both("base", "rare_base").alias("base_score"), both("score", "rare_lp").alias("score"), "n_bytes",
    )


NAMES = ["rid", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score"]


def bits_per_byte(scored: DataFrame) -> DataFrame:
    """Adds total_bits and bits_per_byte (null for no bytes) to rows with score and n_bytes."""
    bits = -F.col("score") * F.log2(F.lit(10.0))
    return scored.withColumn("total_bits", bits).withColumn("bits_per_byte", F.col("total_bits") / F.nullif("n_bytes", F.lit(0)))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits_per_byte(score(table(spark, sf_dir, "documents"))).drop("n_bytes")
