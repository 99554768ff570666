"""The event log: as-of scans, appends, versions, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def conversation_events(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as log events."""
    return conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence"),
        F.col("role").alias("actor"), F.col("text").alias("content"),
    )


def as_of(events: DataFrame, sequence: Column | int) -> DataFrame:
    """What was known at a point of each session."""
    return events.where(F.col("sequence") <= sequence)


def future(events: DataFrame, sequence: Column | int) -> DataFrame:
    return events.where(F.col("sequence") > sequence)


class SequenceConflict(ValueError):
    pass


class DuplicateEvent(ValueError):
    pass


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of batch whose event is not in the log, each event once: a repeated import adds nothing."""
    return batch.dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti").select(*log.columns)


def append_strict(log: DataFrame, batch: DataFrame) -> DataFrame:
    """batch, if none of its events is in the log or twice in the batch, and none of its places in a session is
    taken; the first kind of fault is told before the second."""
    twice = batch.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id")
    known = batch.join(log.select("event_id"), "event_id", "left_semi").select("event_id").union(twice).limit(1).collect()
    if known:
        raise DuplicateEvent(known[0]["event_id"])
    taken = conflicts(log.select("session_id", "sequence", "event_id").union(batch.select("session_id", "sequence", "event_id"))).join(batch, ["session_id", "sequence"], "left_semi").limit(1).collect()
    if taken:
        raise SequenceConflict(f"{taken[0]['session_id']} {taken[0]['sequence']}")
    return batch


def lookup(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def list_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.orderBy("context_id")


def append_assignments(assignments: DataFrame, batch: DataFrame, events: DataFrame, contexts: DataFrame) -> DataFrame:
    """New rows by (event, context, source, version), if all of their events and contexts exist."""
    for other, key in ((events, "event_id"), (contexts, "context_id")):
        missing = batch.join(other.select(key), key, "left_anti").select(key).limit(1).collect()
        if missing:
            raise ValueError(f"no such {key}: {missing[0][key]}")
    keys = ["event_id", "context_id", "source", "version"]
    return batch.dropDuplicates(keys).join(assignments.select(*keys), keys, "left_anti").select(*assignments.columns)


def list_assignments(assignments: DataFrame, events: DataFrame, session_id: str | None = None, latest_only: bool = False) -> DataFrame:
    """Assignments with the session and place of their events, in order; latest_only keeps the greatest version of
    each (event, context, source)."""
    a = latest(assignments, ["event_id", "context_id", "source"], "version") if latest_only else assignments
    e = events.select("event_id", "session_id", "sequence")
    e = e.where(F.col("session_id") == session_id) if session_id is not None else e
    out = a.select(*(c for c in a.columns if c not in ("session_id", "sequence"))).join(e, "event_id")
    return out.orderBy("session_id", "sequence", "context_id", "source", "version")


def referenced(events: DataFrame, *ids: DataFrame) -> DataFrame:
    """Events that any of the id tables (queries', evidence's, members') names."""
    named = ids[0].toDF("event_id")
    for d in ids[1:]:
        named = named.union(d.toDF("event_id"))
    return events.join(named.distinct(), "event_id", "left_semi")


def conflicts(events: DataFrame) -> DataFrame:
    """Places of a session that several events claim."""
    return events.groupBy("session_id", "sequence").agg(F.count_distinct("event_id").alias("n")).where("n > 1")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the greatest version of each key, by a partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return out.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*rows.columns)


def upsert(current: DataFrame, update: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of update replace those of current unless their version is older."""
    both = current.withColumn("_new", F.lit(0)).union(update.select(*current.columns).withColumn("_new", F.lit(1)))
    both = both.withColumn("_at", F.struct(F.col(version), F.col("_new")))
    return latest(both, [key], "_at").select(*current.columns)


def recent(events: DataFrame, checkpoints: DataFrame, n: int, inclusive: bool = False) -> DataFrame:
    """Of each checkpoint (session_id, as_of) the last n events before it (or up to it), with place from 1.

    Events of a session are numbered once; a checkpoint's number says which n it needs, so each meets n rows
    and not all that came before."""
    by = Window.partitionBy("session_id").orderBy("sequence", F.desc("event_id"))
    numbered = events.withColumn("_n", F.row_number().over(by))
    marks = events.select("session_id", "sequence", F.lit(0).alias("_mark")).union(checkpoints.select("session_id", F.col("as_of").alias("sequence"), F.lit(1)))
    # events at a checkpoint's own place count for it only where they are included
    order = Window.partitionBy("session_id").orderBy("sequence", F.col("_mark") if inclusive else -F.col("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    last = marks.withColumn("_last", F.sum(1 - F.col("_mark")).over(order)).where("_mark = 1").select("session_id", F.col("sequence").alias("as_of"), "_last").distinct()
    wanted = last.select("session_id", "as_of", F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_p", "_k"), "_last").select("session_id", "as_of", (F.col("_last") - F.col("_k")).cast("int").alias("_n"), (F.col("_p") + 1).cast("long").alias("place"))
    return wanted.where("_n > 0").join(numbered, ["session_id", "_n"]).drop("_n").select(*events.columns, "as_of", "place")


KINDS = ("event", "context", "assignment")


def jsonl(rows: DataFrame, kind: str) -> DataFrame:
    """A line per row: its kind and its columns by name."""
    data = F.struct(*sorted(rows.columns)).alias("data")
    return rows.select(F.to_json(F.struct(data, F.lit(kind).alias("record_type")), {"ignoreNullFields": "false"}).alias("value"))


def export_jsonl(tables: dict[str, DataFrame], path: str) -> None:
    """Events, contexts and assignments, a folder of lines for each kind, in that order."""
    for k, kind in enumerate(KINDS):
        if kind in tables:
            jsonl(tables[kind], kind).write.text(f"{path}/{k}-{kind}")


def write_jsonl(rows: DataFrame, kind: str, path: str) -> None:
    jsonl(rows, kind).write.mode("append").text(path)


def _records(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.trim("value") != "")
    return lines.withColumn("kind", F.from_json("value", "record_type string")["record_type"])


def import_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """How many records of each kind there are; a line of another kind, or that is no JSON, is an error that names
    its file and text."""
    r = _records(spark, path)
    odd = r.where(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).limit(1).collect()
    if odd:
        raise ValueError(f"unknown record in {odd[0]['file']}: {odd[0]['value'][:80]}")
    n = r.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS)).first()
    return {k: n[k] for k in KINDS}


def read_jsonl(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Records of one kind. A line that is not such JSON, or of no known kind, fails the read."""
    known = F.col("kind").isNotNull() & F.col("kind").isin(*KINDS, kind)
    r = _records(spark, path).withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown record: "), F.left("value", F.lit(80))))))
    parsed = r.where(F.col("kind") == kind).select(F.from_json("value", f"data struct<{schema}>", {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.data.*")


def read_benchmark(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
