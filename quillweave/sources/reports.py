"""Exports that may be published, reports, index artifacts and question packages."""

from __future__ import annotations

import ast
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub as S
from . import log

#: Names that a package's files give their values.
TRUTH, NOISE, QUESTIONS = "GROUND_TRUTH_HISTORY", "NOISE", "EVALUATION_QUERIES"


def sanitized_export(events: DataFrame, ids: list[DataFrame], path: str, identities: tuple[str, ...] = ()) -> int:
    """Writes the events that ids name, scrubbed, as JSON; refuses, before anything is written, if a forbidden pattern
    or a name is left. An existing target is an error. Returns how many were written."""
    clean = log.referenced(events, *ids).withColumn("content", S.scrub(F.col("content"), identities))
    S.refuse(S.leaks(clean, "content", identities))
    clean.write.mode("error").json(path)
    return clean.count()


def report_json(rows: DataFrame, key: str) -> str:
    """A small report (arms, strata) as JSON by its key."""
    return json.dumps({str(r[key]): {k: v for k, v in r.asDict(True).items() if k != key} for r in rows.orderBy(key).collect()}, ensure_ascii=False, indent=2, sort_keys=True)


def report_markdown(rows: DataFrame, digits: int = 3) -> str:
    """A small report as a table."""
    said = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [rows.columns, ["---"] * len(rows.columns), *([said(v) for v in r] for r in rows.collect())]
    return "\n".join(f"| {' | '.join(c)} |" for c in lines)


def save_index(vectors: DataFrame, path: str) -> str:
    """Writes (context_id, vector) and returns the version: 16 digits of a sha256 over the rows' own."""
    vectors.write.parquet(path)
    h = vectors.sparkSession.read.parquet(path).select("context_id", F.sha2(F.to_json(F.struct("context_id", "vector")).cast("binary"), 256).alias("h"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("context_id", "h"))), lambda x: x["h"])
    return h.agg(F.left(F.sha2(F.array_join(each, "").cast("binary"), 256), F.lit(16))).first()[0]


def load_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """truth and noise (dialogue_id, kind, number, place, text, role) and questions, from Python files that assign
    literals to the three names. Files are read as literals and never run."""
    found: dict[str, object] = {}
    for r in spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py").collect():  # a package is a few files
        for node in ast.parse(r[0]).body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id in (TRUTH, NOISE, QUESTIONS):
                found[node.targets[0].id] = ast.literal_eval(node.value)
    missing = {TRUTH, NOISE, QUESTIONS} - set(found)
    if missing:
        raise ValueError(f"the package lacks {', '.join(sorted(missing))}")
    schema = "dialogue_id string, kind string, number int, place int, text string, role string"
    rows = lambda name, kind: [(f"{kind}-{i}", kind, i, k, s.get("text"), s.get("role")) for i, d in enumerate(found[name]) for k, s in enumerate(d)]
    q = [(str(x["global_id"]), x["query"], list(x.get("expected_doc") or []), x.get("answer_key"), x.get("topic")) for x in found[QUESTIONS]]
    return {
        "truth": spark.createDataFrame(rows(TRUTH, "truth"), schema), "noise": spark.createDataFrame(rows(NOISE, "noise"), schema),
        "questions": spark.createDataFrame(q, "question_id string, query string, expected array<string>, answer_key string, topic string"),
    }
