"""Import of agent transcripts: JSON lines of nested messages as log events.

A file is one session and its order is the events' order, so a file is one row and is read through in
one task; files are dealt over tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, status string, session_id string, event_id string, sequence int, occurred_at timestamp, actor string, kind string, content string, parent_event_id string, payload string"


def text_of(value: object) -> str:
    """Text of a polymorphic content field: itself, its parts' texts by line, nothing, or sorted JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        texts = [p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in value]
        return "\n".join(t for t in texts if isinstance(t, str))
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def moment(value: object, otherwise: datetime) -> datetime:
    """An ISO time; without a zone in UTC; anything else is `otherwise`."""
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))  # type: ignore[union-attr]
    except (AttributeError, ValueError):
        return otherwise
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def blocks(record: dict) -> tuple[list[dict], int]:
    """The visible blocks of a record (actor, kind, content, payload, call, answers), and its thinking blocks."""
    message = record.get("message")
    if record.get("type") not in ("user", "assistant") or not isinstance(message, dict):
        return [], 0
    speaker, content = record["type"], message.get("content")
    if isinstance(content, str):
        return ([{"actor": speaker, "kind": "message", "content": content}] if content.strip() else []), 0
    out, thinking = [], 0
    for b in content if isinstance(content, list) else []:
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "thinking":
            thinking += 1
        elif kind == "text" and isinstance(b.get("text"), str):
            out.append({"actor": speaker, "kind": "message", "content": b["text"]})
        elif kind == "tool_use":
            name = str(b.get("name") or "unknown_tool")
            body = json.dumps(b.get("input") or {}, ensure_ascii=False, sort_keys=True)
            out.append({"actor": "assistant", "kind": "tool_call", "content": f"{name}\n{body}", "payload": {"tool_name": name}, "call": b.get("id")})
        elif kind == "tool_result":
            payload = {"is_error": bool(b.get("is_error", False))}
            out.append({"actor": "tool", "kind": "tool_result", "content": text_of(b.get("content")) or "[empty tool result]", "payload": payload, "answers": b.get("tool_use_id")})
        elif kind == "image":
            source = b.get("source") if isinstance(b.get("source"), dict) else {}
            payload = {"media_type": source.get("media_type"), "source_type": source.get("type"), "binary_omitted": True}
            out.append({"actor": speaker, "kind": "artifact", "content": "[image attachment]", "payload": payload})
    return out, thinking


def read_file(path: str, changed: datetime, body: str, source: str = "agent") -> list[tuple]:
    """Rows of SCHEMA: events, and rows without an event for what was skipped (status says why). source
    begins the ids of sessions."""
    stem, session, position = path.rsplit("/", 1)[-1].removesuffix(".jsonl"), None, 0
    calls: dict[str, str] = {}
    first: dict[str, str] = {}
    rows: list[tuple] = []
    note = lambda status: rows.append((path, status, session, *[None] * 8))
    for line in body.split("\n"):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError:
            record = None
        if not isinstance(record, dict):
            note("malformed")
            continue
        if session is None:
            session = f"{source}:{record.get('sessionId') or record.get('session_id') or stem}" + (f":subagent:{stem}" if "/subagents/" in path else "")
        found, thinking = blocks(record)
        for _ in range(thinking):
            note("thinking")
        if not found:
            note("meta")
            continue
        uid, lead = str(record.get("uuid") or f"line-{position}"), None
        for k, b in enumerate(found):
            position += 1
            event_id = f"{session}:{uid}:{k}:{b['kind']}"
            parent = calls.get(str(b["answers"])) if b.get("answers") else first.get(str(record.get("parentUuid") or ""))
            payload = {**b.get("payload", {}), "source_file": path, "uuid": uid, "cwd": record.get("cwd"), "git_branch": record.get("gitBranch"), "model": record["message"].get("model")}
            rows.append((path, "event", session, event_id, position, moment(record.get("timestamp"), changed), b["actor"], b["kind"], b["content"], parent, json.dumps(payload, sort_keys=True)))
            lead = lead or event_id
            if b.get("call"):
                calls[str(b["call"])] = event_id
        first[uid] = lead
    return rows


def discover(spark: SparkSession, root: str, include_subagents: bool = False) -> DataFrame:
    """(file, changed, size, body) of the transcripts below root, or below its folder `projects` if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/projects")
    root = f"{root}/projects" if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else root
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("body"))
    return files if include_subagents else files.where(~F.contains("file", F.lit("/subagents/")))


def parse(files: DataFrame, source: str = "agent") -> DataFrame:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                at = r.changed.to_pydatetime()
                out = pd.DataFrame(read_file(r.file, at if at.tzinfo else at.replace(tzinfo=UTC), r.body, source), columns=names)
                out["occurred_at"] = pd.to_datetime(out["occurred_at"], utc=True)
                yield out.astype({"sequence": "Int32"})

    return files.select("file", "changed", "body").mapInPandas(run, SCHEMA)


def new_events(parsed: DataFrame, log: DataFrame) -> DataFrame:
    """Events that the log doesn't hold yet, each once."""
    return parsed.where("status = 'event'").drop("status", "file").dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti")


def report(files: DataFrame, parsed: DataFrame, log: DataFrame) -> DataFrame:
    """The eight counters of an import, before it is written (so it is a dry run's too)."""
    known = log.select("event_id", F.lit(True).alias("known"))
    p = parsed.join(known, "event_id", "left").withColumn("new", (F.col("status") == "event") & F.col("known").isNull())
    n = lambda s: F.count_if(F.col("status") == s)
    counts = p.agg(
        F.count_distinct(F.when(F.col("new"), F.col("file"))).alias("imported_sessions"), F.count_if("new").alias("imported_events"), F.count_if((F.col("status") == "event") & F.col("known")).alias("existing_events"),
        n("thinking").alias("skipped_thinking"), n("meta").alias("skipped_meta_records"), n("malformed").alias("malformed_records"),
    )
    return files.agg(F.count("*").alias("discovered_sessions"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes")).join(counts)  # one row each
