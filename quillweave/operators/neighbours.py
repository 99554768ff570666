"""Joins along a session: what came before, the reply that follows, neighbours and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_of(events: DataFrame, kind: str, keep: str, name: str) -> DataFrame:
    """Adds name: `keep` of the latest earlier event of this actor in the session, one
    window pass instead of a range join."""
    w = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(F.col("actor") == kind, F.col(keep)), ignorenulls=True).over(w))


def reply_after(events: DataFrame) -> DataFrame:
    """Of each user event the assistant's texts up to the next user event, in order, and their number."""
    w = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    turns = events.withColumn("asked", F.max(F.when(F.col("actor") == "user", F.col("sequence"))).over(w)).where("asked IS NOT NULL")
    said = F.array_sort(F.collect_list(F.when(F.col("actor") == "assistant", F.struct("sequence", "content"))))
    return turns.groupBy("session_id", "asked").agg(said.alias("said")).select(
        "session_id", F.col("asked").alias("sequence"), F.size("said").cast("long").alias("n_replies"), F.array_join(F.transform("said", lambda x: x["content"]), "\n").alias("reply")
    )


def adjacent(anchors: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, sequence) pairs with each neighbour at a distance of 1: an equi-join on
    the two possible places."""
    wanted = anchors.select("session_id", F.col("sequence").alias("anchor"), F.explode(F.array(F.col("sequence") - 1, F.col("sequence") + 1)).alias("sequence"))
    return wanted.join(events, ["session_id", "sequence"])


def children(parents: DataFrame, rows: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")
