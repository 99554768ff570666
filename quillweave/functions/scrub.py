"""Redaction of personal and machine-specific content, and gates for what must not be published."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Redactions in their order, forbidden patterns and secrets. (?U) gives \\w and \\b
# letters of all scripts.
REDACTIONS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "<private-key>"),
    (r"(?U)\bsk-[A-Za-z0-9_-]{16,}\b", "<secret>"),
    (r"(?U)\bAKIA[0-9A-Z]{16}\b", "<secret>"),
    (r"(?U)\bgh[pousr]_[A-Za-z0-9]{20,}\b", "<secret>"),
    (r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"),
    (r"(?U)(?<![0-9a-fA-F])1[3-9]\d{9}(?![0-9a-fA-F])", "<phone>"),
    (r"(?U)[A-Za-z]:\\Users\\[^\\\s\"']+", "<home>"),
    (r"(?U)[A-Za-z]:\\+Users\\+[^\\\s\"']+", "<home>"),
    (r"(?U)/(?:home|Users)/[^/\s\"']+", "<home>"),
    (r"(?<![A-Za-z0-9])[A-Za-z]--(?:Users|home)-[A-Za-z0-9._-]+", "<home>"),
    (r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]", "<abs>/"),
)
FORBIDDEN = (
    ("email", r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("phone", r"(?U)(?<![0-9a-fA-F])1[3-9]\d{9}(?![0-9a-fA-F])"),
    ("secret", r"(?U)\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("aws-key", r"(?U)\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"(?U)\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("drive-path", r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]"),
    ("unredacted-home", r"(?U)(?<![A-Za-z0-9])[\\/](?:Users|home)[\\/][^\\/\s\"'<>]+"),
)
SECRET = r"(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN .+ PRIVATE KEY-----)"
LEAST_TOKEN = 3


def identity_tokens(names: Iterable[str]) -> list[str]:
    """The names that are long enough to tell an identity."""
    return sorted({n for n in names if len(n) >= LEAST_TOKEN})


def scrub(text: Column, identities: Iterable[str] = ()) -> Column:
    """All redactions in their order, then the machine's own names as whole words."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    for name in identity_tokens(identities):
        text = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", "<user>")
    return text


def has_secret(text: Column) -> Column:
    return text.rlike(SECRET)


def masked(value: Column) -> Column:
    """Two characters and the length, so that a report is no leak."""
    return F.concat(F.left(value, F.lit(2)), F.lit("…("), F.length(value).cast("string"), F.lit(" chars)"))


def leaks(rows: DataFrame, text: str, identities: Iterable[str] = ()) -> DataFrame:
    """A row (label, masked) for each forbidden pattern or name that a text still holds."""
    found = [F.struct(F.lit(label).alias("label"), F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit("")).alias("value")) for label, pattern in FORBIDDEN]
    low = F.lower(F.col(text))
    found += [F.struct(F.lit("identity").alias("label"), F.when(F.contains(low, F.lit(n.lower())), F.lit(n)).alias("value")) for n in identity_tokens(identities)]
    hits = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
    taken = [c for c in rows.columns if c not in ("label", "masked", "_hit")]
    out = rows.withColumn("_hit", F.explode(hits)).withColumns({"label": F.col("_hit.label"), "masked": masked(F.col("_hit.value"))})
    return out.select(*taken, "label", "masked")


def refuse(found: DataFrame) -> None:
    """Raises if there is any leak; names at most the first, masked."""
    first = found.select("label", "masked").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['label']} survived scrubbing: {first[0]['masked']}")


def _walk(node: object, leaf: Callable[[str], str], out: list[str]) -> object:
    """The node with each string passed through leaf; out gets keys and strings."""
    if isinstance(node, str):
        out.append(node)
        return leaf(node)
    if isinstance(node, dict):
        out.extend(map(str, node))
        return {k: _walk(v, leaf, out) for k, v in node.items()}
    if isinstance(node, list):
        return [_walk(v, leaf, out) for v in node]
    return node


def artifact_leaves(text: Column | str) -> Column:
    """Keys and strings of a JSON text at any depth; of another text, the text itself."""

    def of(t: str | None) -> list[str] | None:
        if t is None:
            return None
        out: list[str] = []
        try:
            _walk(json.loads(t), lambda x: x, out)
        except ValueError:
            return [t]
        return out

    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(leaves, "array<string>")(text)


def scrub_payload(payload: Column | str) -> Column:
    """A JSON payload whose strings, at any depth, are scrubbed; keys and numbers stay."""
    rules = [(re.compile(p.removeprefix("(?U)")), mark) for p, mark in REDACTIONS]

    def clean(t: str) -> str:
        for pattern, mark in rules:
            t = pattern.sub(mark, t)
        return t

    def scrubbed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(_walk(json.loads(t), clean, []), ensure_ascii=False, sort_keys=True))

    return F.pandas_udf(scrubbed, "string")(payload)


def artifact_leaks(rows: DataFrame, text: str, identities: Iterable[str] = ()) -> DataFrame:
    """leaks() over what a reader of the artifact sees: parsed keys and values, not their encoding."""
    return leaks(rows.withColumn("_leaf", F.explode(artifact_leaves(text))), "_leaf", identities).drop("_leaf")
