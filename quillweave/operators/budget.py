"""Packing of blocks under a token budget: folds over ordered arrays, a group at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def admit(costs: Column, budget: Column | int) -> Column:
    """Places (from 0) of the costs taken in order while they fit; one that doesn't fit is
    skipped and later ones go on."""
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        fits = c <= s["left"]
        return F.struct(
            F.when(fits, s["left"] - c).otherwise(s["left"]).cast("long").alias("left"),
            F.when(fits, F.concat(s["taken"], F.array(s["i"]))).otherwise(s["taken"]).alias("taken"), (s["i"] + 1).alias("i"),
        )

    return F.aggregate(costs, zero, step, lambda s: s["taken"])


def pack(blocks: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """A row per group: blocks offered and admitted, tokens used, admitted orders joined."""
    rows = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("b"))
    rows = rows.withColumn("taken", admit(F.transform("b", lambda x: x["c"]), budget))
    own = F.transform("taken", lambda i: F.get(F.col("b"), i))
    rows = rows.withColumn("own", own)
    return rows.select(
        group, F.size("b").cast("long").alias("n_blocks"), F.size("own").cast("long").alias("n_admitted"),
        F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("tokens"),
        F.array_join(F.transform("own", lambda x: x["o"].cast("string")), ",").alias("admitted"),
    )


def spans(lengths: Column, separator: int = 2) -> Column:
    """[start, end) of blocks joined by a separator of that many characters."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        end = s["at"] + n
        return F.struct((end + separator).cast("long").alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.cast("long").alias("end")))).alias("out"))

    return F.aggregate(lengths, zero, step, lambda s: s["out"])
