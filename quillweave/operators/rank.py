"""From channel scores to calibrated probabilities and a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of the untrained ranker and the selection policy.
INTERCEPT = -2.7
WEIGHTS = {"rrf": 1.45, "dense": 1.10, "lexical": 1.05, "entity": 1.70, "agreement": 0.55, "primary": 0.35, "recent": 0.20, "recency": 0.15, "relation_match": 1.00}
POLICY = {"high": 0.72, "low": 0.35, "margin": 0.16, "margin_scale": 0.35, "abstain": 0.52, "new": 0.80, "new_confidence": 0.79}
CONFIDENCE = {"p1": 0.50, "margin": 0.20, "agreement": 0.15, "relation": 0.15, "unknown_relation": 0.35}


def probability(features: dict[str, Column] | None = None) -> Column:
    """The logistic score of the nine features; a missing one is 0."""
    z = F.lit(INTERCEPT)
    for name, w in WEIGHTS.items():
        z = z + w * F.coalesce((features or {}).get(name, F.col(name)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def platt(logit: Column, slope: float, constant: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(constant) + F.lit(slope) * logit)))


def recency(as_of: Column, last_active: Column) -> Column:
    return F.exp(-F.greatest(as_of - last_active, F.lit(0)) / 20.0)


def select(candidates: DataFrame, query: str, item: str, maximum: int = 3) -> DataFrame:
    """candidates (query, item, p, agreement, relation) -> a row per query: decision,
    selected (items) and confidence.

    The best `maximum` and the count that passes are all a decision needs, so a query's
    candidates meet as one array of at most what its channels returned."""
    one = F.struct((-F.col("p")).alias("n"), F.col(item).alias("item"), F.col("agreement").alias("agreement"))
    q = candidates.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("c"), F.first("relation").alias("relation"))
    p1, agreement = -F.col("c")[0]["n"], F.col("c")[0]["agreement"]
    p2 = F.when(F.size("c") > 1, -F.try_element_at("c", F.lit(2))["n"]).otherwise(0.0)
    q = q.withColumns({"p1": p1, "margin": p1 - p2, "agreement": agreement})
    known = F.when(F.col("relation") == "unknown", CONFIDENCE["unknown_relation"]).otherwise(1.0)
    confidence = (
        CONFIDENCE["p1"] * F.col("p1") + CONFIDENCE["margin"] * F.least(F.col("margin") / POLICY["margin_scale"], F.lit(1.0))
        + CONFIDENCE["agreement"] * F.col("agreement") + CONFIDENCE["relation"] * known
    )
    q = q.withColumn("confidence", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
    items = lambda c: F.transform(c, lambda x: x["item"])
    low = F.slice(F.filter("c", lambda x: -x["n"] >= POLICY["low"]), 1, maximum)
    single = (F.col("p1") >= POLICY["high"]) & (F.col("margin") >= POLICY["margin"]) & F.col("relation").isin("continue", "switch_or_return")
    chosen = F.when(single, F.slice("c", 1, 1)).when(F.col("relation") == "cross_context", F.slice(F.array_union(F.slice("c", 1, 2), low), 1, maximum)).otherwise(low)
    fresh = (F.col("relation") == "new_context") & (F.col("p1") < POLICY["new"])
    q = q.withColumn("chosen", items(chosen)).withColumn("safe", items(F.slice("c", 1, maximum)))
    unsure = (F.size("chosen") == 0) | (F.col("confidence") < POLICY["abstain"])
    return q.select(
        query, F.when(fresh, "new_context_candidate").when(unsure, "abstain").otherwise("route").alias("decision"),
        F.when(fresh, F.slice("safe", 1, 0)).when(unsure, F.col("safe")).otherwise(F.col("chosen")).alias("selected"),
        F.when(fresh, F.least("confidence", F.lit(POLICY["new_confidence"]))).otherwise(F.col("confidence")).alias("confidence"),
    )
