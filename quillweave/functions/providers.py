"""Seams to models: callables over rows, and the reading of their replies. Nothing here opens a connection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: names that name no model.
UNPINNED = ("", "latest", "default", "auto", "current")
REPLY = "text string, model string, input_tokens long, output_tokens long, stop_reason string"


def pinned(model: str) -> str:
    if model.strip().lower() in UNPINNED:
        raise ValueError("name a model whose version is fixed")
    return model


def with_retry(send: Callable[[], dict], transient: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), attempts: int = 4, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What send gives. Only a request that didn't complete is tried again, after 2, 4, 8 ... times wait / 2."""
    if attempts < 1:
        raise ValueError("at least one attempt")
    for k in range(attempts):
        try:
            return send()
        except transient:
            if k + 1 == attempts:
                raise
            sleep(wait * 2**k)
    raise AssertionError


def answers(prompts: DataFrame, provider: Callable[[str, str], dict], instructions: str = "", text: str = "prompt") -> DataFrame:
    """Adds what provider (prompt, instructions) -> dict of REPLY's fields says to each row, and latency_seconds."""
    names = [c.split(" ")[0] for c in REPLY.split(", ")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema), REPLY, "latency_seconds double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf[text]:
                began = time.perf_counter()
                reply = with_retry(lambda: provider(p, instructions))  # noqa: B023
                rows.append([*(reply.get(n) for n in names), time.perf_counter() - began])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "latency_seconds"])], axis=1)

    return prompts.mapInPandas(run, fields)


def embeddings(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """Adds vector: what provider says to a batch of texts."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), "vector array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(vector=[list(map(float, v)) for v in provider(pdf[text].tolist())])

    return texts.mapInPandas(run, fields)


def _joined(array: Column, kinds: tuple[str, ...], field: str) -> Column:
    return F.array_join(F.transform(F.filter(array, lambda b: b["type"].isin(*kinds) & b[field].isNotNull()), lambda b: b[field]), "")


def message_text(payload: Column, include_thinking: bool = False) -> Column:
    """Text blocks of a messages reply (JSON); with include_thinking, where there is none, its thinking blocks."""
    blocks = F.coalesce(F.from_json(payload, "content array<struct<type:string,text:string,thinking:string>>")["content"], F.array())
    text = _joined(blocks, ("text",), "text")
    return F.when(text == "", _joined(blocks, ("thinking",), "thinking")).otherwise(text) if include_thinking else text


def output_text(payload: Column) -> Column:
    """Text of a responses reply: output_text, or its parts of type output_text or text."""
    p = F.from_json(payload, "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>")
    parts = F.flatten(F.transform(F.coalesce(p["output"], F.array()), lambda o: F.coalesce(o["content"], F.array())))
    return F.coalesce(p["output_text"], _joined(parts, ("output_text", "text"), "text"))


def input_tokens(payload: Column) -> Column:
    """Uncached, cache-written and cache-read input together."""
    u = F.from_json(payload, "usage struct<input_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>")["usage"]
    return sum((F.coalesce(u[k], F.lit(0)) for k in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")), F.lit(0))


def renormalised(probabilities: Column) -> Column:
    """A map of probabilities over their sum."""
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(probabilities, lambda _, p: p / F.nullif(total, F.lit(0.0)))


def judge_prompt(query: Column, requirements: Column, a: Column, b: Column) -> Column:
    """All that a judge sees: no arm and no count of tokens."""
    rubric = F.when(F.size(requirements) == 0, "- (no rubric)").otherwise(F.array_join(F.transform(requirements, lambda r: F.concat(F.lit("- "), r)), "\n"))
    return F.concat(F.lit("[Question]\n"), query, F.lit("\n\n[Requirements]\n"), rubric, F.lit("\n\n[Answer A]\n"), a, F.lit("\n\n[Answer B]\n"), b, F.lit("\n"))


class Prompts:
    """Named instructions, each with its digest, so that a run can tell which it used."""

    def __init__(self, styles: dict[str, str]):
        self.styles = dict(styles)

    def __call__(self, style: str) -> str:
        if style not in self.styles:
            raise ValueError(f"unknown style {style!r}; known: {', '.join(sorted(self.styles))}")
        return self.styles[style]

    def digest(self, style: str) -> str:
        import hashlib

        return hashlib.sha256(self(style).encode()).hexdigest()
