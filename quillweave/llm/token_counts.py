"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node v has a failure link and the number of pieces that
greedy longest match emits on the way there (Song et al., 2021, without the pieces): if v
is a piece, 1 and the root of continuations; otherwise those of its parent and of the nodes
whose links are followed until one can read v's last symbol. A word is read symbol by
symbol; where a node has no such child its pieces are counted and its link is followed. So
the count takes time linear in the word, and no piece is built.

Where the greedy pieces reach the last letter but can't read the word end, a word is counted
once more by longest match among the pieces that don't end on the last letter.

Counts depend on the word alone, so a worker keeps those of CACHED different words.

Defined cases: a null or empty text has no words and no tokens; a word that the vocabulary
can't spell is one unknown token; repeated rows are counted one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

CACHED = 500_000
LONGEST_CACHED = 200
WORD_END = 256
NONE = -1


class Automaton:
    """initial, following: pieces (sequences of symbols below 512) that may begin or continue a word."""

    def __init__(self, initial: Iterable[tuple[int, ...]], following: Iterable[tuple[int, ...]] | None = None):
        self.child: dict[int, int] = {}
        self.link, self.pops = [], []
        piece: list[bool] = []
        parent: list[tuple[int, int]] = []

        def node(p: int, c: int) -> int:
            piece.append(False)
            parent.append((p, c))
            return len(piece) - 1

        self.start = self.next = node(NONE, NONE)
        if following is not None:
            self.next = node(NONE, NONE)
        for root, pieces in ((self.start, initial), (self.next, following or ())):
            for symbols in pieces:
                at = root
                for c in symbols:
                    key = at << 9 | c
                    if key not in self.child:
                        self.child[key] = node(at, c)
                    at = self.child[key]
                if at != root:
                    piece[at] = True
        # parents first, and all nodes of a depth before the next: links lead to lower depths
        depth = [0] * len(piece)
        for v, (p, _) in enumerate(parent):
            depth[v] = depth[p] + 1 if p != NONE else 0
        self.link, self.pops = [NONE] * len(piece), [0] * len(piece)
        for v in sorted(range(len(piece)), key=depth.__getitem__):
            u, c = parent[v]
            if u == NONE:
                continue
            if piece[v]:
                self.link[v], self.pops[v] = self.next, 1
                continue
            z, n = self.link[u], self.pops[u]
            while z != NONE and (z << 9 | c) not in self.child:
                n += self.pops[z]
                z = self.link[z]
            if z != NONE:
                self.link[v], self.pops[v] = self.child[z << 9 | c], n

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of a word; 1 if it can't be spelled."""
        child, link, pops, at, n = self.child, self.link, self.pops, self.start, 0
        for c in symbols:
            while (to := child.get(at << 9 | c)) is None:
                n += pops[at]
                at = link[at]
                if at == NONE:
                    return 1
            at = to
        while at != self.next and at != self.start:
            n += pops[at]
            at = link[at]
            if at == NONE:
                return 1
        return n


class Placeable:
    """Longest match for words whose last letter the greedy pieces reach without a word end:
    no piece ends on the last letter, but with the word end."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.pieces = set(pieces)
        self.longest = max(map(len, self.pieces), default=0)

    def count(self, symbols: tuple[int, ...]) -> int:
        """Pieces of a word with its end; 1 if it can't be spelled."""
        at, n, last = 0, 0, len(symbols) - 1
        while at < len(symbols):
            for to in range(min(len(symbols), at + self.longest), at, -1):
                if to != last and symbols[at:to] in self.pieces:
                    break
            else:
                return 1
            at, n = to, n + 1
        return n


def byte_symbols() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends, as bytes and WORD_END."""
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    symbols, out = byte_symbols(), []
    for w in words:
        body = w.removesuffix("</w>")
        if all(c in symbols for c in body):
            out.append((*(symbols[c] for c in body), *((WORD_END,) if w != body else ())))
    return out


@functools.cache
def counters(path: str) -> tuple[Automaton, Placeable, dict[bytes, int]]:
    """One automaton for all tasks of a worker, and the counts of words that a task knows."""
    pieces = vocabulary(path)
    return Automaton(pieces), Placeable(pieces), {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_tokens, n_bytes. Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, placeable, known = counters(path)
        for b in (x for whole in batches for x in slices(whole)):
            n_words, n_tokens, n_bytes = [], [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                w = raw.lower().split()
                if len(known) > CACHED:
                    known.clear()
                long = 0
                for x in set(w).difference(known):
                    n = automaton.count((*x, WORD_END))
                    known[x] = n if n > 1 else placeable.count((*x, WORD_END))
                    long += len(x) > LONGEST_CACHED
                n_tokens.append(sum(map(known.__getitem__, w)))
                n_words.append(len(w))
                n_bytes.append(len(raw))
                if long:
                    for x in w:
                        if len(x) > LONGEST_CACHED:
                            known.pop(x, None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_bytes))], ["doc_id", "n_words", "n_tokens", "n_bytes"])
        known.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
