"""Evaluation aggregates over cases: sets, rankings, calibration and paired comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def set_counts(required: Column, chosen: Column) -> dict[str, Column]:
    return {
        "tp": F.size(F.array_intersect(required, chosen)).cast("long"), "fp": F.size(F.array_except(chosen, required)).cast("long"),
        "fn": F.size(F.array_except(required, chosen)).cast("long"),
    }


def micro(cases: DataFrame, required: str, chosen: str) -> DataFrame:
    c = cases.select(*(v.alias(k) for k, v in set_counts(F.col(required), F.col(chosen)).items()))
    c = c.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def reciprocal_rank(ranking: Column, required: Column) -> Column:
    hits = F.filter(F.transform(ranking, lambda x, i: F.when(F.array_contains(required, x), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1.0 / F.array_min(hits), F.lit(0.0))


def ndcg(ranking: Column, required: Column) -> Column:
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    got = gain(F.transform(ranking, lambda x, i: F.when(F.array_contains(required, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)))
    ideal = gain(F.transform(F.sequence(F.lit(1), F.greatest(F.size(required), F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)))
    return F.when(F.size(required) == 0, (F.size(ranking) == 0).cast("double")).otherwise(got / ideal)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


#: Lower edges of the bins of calibration and the thresholds of risk, as literals: 0.1 * 3 is not 0.3.
TENTHS = tuple(k / 10 for k in range(10))


def tenth(p: Column) -> Column:
    """How many of the edges 0.1 to 0.9 are at most p: its bin among ten, the last one closed."""
    out = F.lit(0)
    for edge in TENTHS[1:]:
        out = out + (p >= edge).cast("int")
    return out


def ece(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Expected calibration error over ten equal bins, the last one closed."""
    b = rows.groupBy(tenth(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"))
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def risk_coverage(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Coverage and risk at thresholds 0.1 to 0.9, in one pass: rows are counted by tenths first."""
    by = rows.groupBy(tenth(F.col(p)).alias("t")).agg(F.count("*").alias("n"), F.sum((F.col(y) == 0).cast("long")).alias("wrong"))
    at = by.select("n", "wrong", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("tenth"), "t").groupBy("tenth").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("t") >= F.col("tenth"), F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(F.col("t") >= F.col("tenth"), F.col("wrong")).otherwise(0)).alias("wrong"),
    )
    return at.select("tenth", ratio(F.col("kept"), F.col("all")).alias("coverage"), ratio(F.col("wrong"), F.col("kept")).alias("risk"))


def evidence_recall(sets: Column, included: Column) -> Column:
    """1 if any set is wholly included, or there is none."""
    return F.when(F.size(sets) == 0, 1.0).otherwise(F.exists(sets, lambda s: F.size(F.array_except(s, included)) == 0).cast("double"))


def mcnemar(wins: int, losses: int) -> float:
    """Exact two-sided p of two discordant counts."""
    n, k = wins + losses, min(wins, losses)
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def pareto(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points (arms or groups: few) that no other beats on both; ones that are equal stay. One sort
    by cost: a point stays if it has the best gain of its cost and more than all cheaper ones."""
    from pyspark.sql import Window

    best = points.groupBy(cost).agg(F.max(gain).alias("_g"))
    cheaper = best.withColumn("_before", F.max("_g").over(Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)))
    kept = points.join(cheaper, cost).where((F.col(gain) == F.col("_g")) & (F.col("_before").isNull() | (F.col(gain) > F.col("_before"))))
    return kept.select(*points.columns)


def route_report(cases: DataFrame) -> DataFrame:
    """cases (required, selected, ranking, confidence, expected, predicted) -> one row of measures."""
    n = set_counts(F.col("required"), F.col("selected"))
    size = {k: F.size(k) for k in ("required", "selected")}
    exact = ((n["fp"] == 0) & (n["fn"] == 0)).cast("double")
    c = cases.select(
        *(v.alias(k) for k, v in n.items()), exact.alias("exact"), "confidence", "required", "ranking",
        F.when(size["selected"] == 0, (size["required"] == 0).cast("double")).otherwise(n["tp"] / size["selected"]).alias("p"),
        F.when(size["required"] == 0, (size["selected"] == 0).cast("double")).otherwise(n["tp"] / size["required"]).alias("r"),
        reciprocal_rank(F.col("ranking"), F.col("required")).alias("rr"), ndcg(F.col("ranking"), F.col("required")).alias("ndcg"),
        (F.col("expected") == F.col("predicted")).cast("double").alias("same"),
    ).withColumn("bin", tenth(F.col("confidence")))
    bins = c.groupBy("bin").agg(
        F.count("*").alias("n"), *(F.sum(k).alias(k) for k in ("tp", "fp", "fn", "exact", "p", "r", "rr", "ndcg", "same", "confidence")),
        F.sum((F.col("confidence") - F.col("exact")) ** 2).alias("square"), F.sum(F.when(F.size("required") >= 2, F.col("r"))).alias("cross"),
        F.count_if(F.size("required") >= 2).alias("n_cross"), F.sum(F.when(F.col("confidence") >= 0.8, F.col("exact"))).alias("high"), F.count_if(F.col("confidence") >= 0.8).alias("n_high"),
    )
    off = F.sum(F.abs(F.col("confidence") - F.col("exact"))) / F.sum("n")
    a = bins.agg(*(F.sum(k).alias(k) for k in bins.columns if k not in ("bin",)), off.alias("ece"))
    mean = lambda k: F.col(k) / F.col("n")
    f1 = lambda p, r: ratio(2 * p * r, p + r)
    mp, mr = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select(
        F.col("n").alias("count"), mean("exact").alias("exact_set_accuracy"), mp.alias("micro_precision"), mr.alias("micro_recall"), f1(mp, mr).alias("micro_f1"),
        mean("p").alias("macro_precision"), mean("r").alias("macro_recall"), f1(mean("p"), mean("r")).alias("macro_f1"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"),
        ratio(F.col("cross"), F.col("n_cross")).alias("cross_context_recall"), mean("same").alias("relation_accuracy"), mean("square").alias("brier"), "ece",
        F.when(F.col("n_high") > 0, 1 - F.col("high") / F.col("n_high")).otherwise(0.0).alias("high_confidence_error"),
    )


def stages(cases: DataFrame) -> DataFrame:
    """The 17 counters of candidates and selection: in all, by query_type and by expected relation."""
    req, cand, sel = F.col("required"), F.array_distinct("ranking"), F.array_distinct("selected")
    both = lambda a, b: F.size(F.array_intersect(a, b)).cast("long")
    c = cases.select(
        "query_type", "expected", F.size(F.array_distinct(req)).cast("long").alias("req"), F.size(cand).cast("long").alias("cand"), F.size(sel).cast("long").alias("sel"),
        both(req, cand).alias("ch"), both(req, sel).alias("sh"), both(F.array_intersect(req, cand), sel).alias("shc"), F.size(F.array_except(sel, req)).cast("long").alias("extra"),
    )
    has = F.col("req") > 0
    of = lambda v: F.coalesce(F.sum(F.when(has, v)), F.lit(0)).cast("long")
    share = lambda a, b: F.try_divide(a, b)
    answerable, required, ch, sh = F.count_if(has), of(F.col("req")), of(F.col("ch")), of(F.col("sh"))
    return c.groupingSets([[], ["query_type"], ["expected"]], "query_type", "expected").agg(
        F.count("*").alias("cases"), answerable.alias("cases_with_required"), required.alias("required_contexts"), ch.alias("candidate_hits"), sh.alias("selection_hits"),
        of(F.col("req") - F.col("ch")).alias("candidate_miss"), of(F.col("ch") - F.col("shc")).alias("selection_loss"), F.sum("extra").alias("selection_extra"),
        F.count_if(F.col("extra") > 0).alias("over_selected"), (F.sum("cand") / F.count("*")).alias("mean_candidates"), (F.sum("sel") / F.count("*")).alias("mean_selected"),
        share(ch, required).alias("candidate_micro_recall"), share(sh, required).alias("selection_micro_recall"), share(sh, F.sum("sel")).alias("selection_micro_precision"),
        share(of(F.col("shc")), ch).alias("selection_given_candidate"), share(F.count_if(has & (F.col("ch") == F.col("req"))), answerable).alias("candidate_complete"),
        share(F.count_if(has & (F.col("sh") == F.col("req"))), answerable).alias("selection_complete"),
    )


def dense_index(rows: DataFrame, key: str, name: str = "i") -> DataFrame:
    """Adds a gapless index from 0 over distinct keys, by (first two digits of the key's md5, key): 256
    buckets are counted and summed up, so no task ranks more than one."""
    from pyspark.sql import Window

    r = rows.withColumn("_b", F.left(F.md5(F.col(key).cast("string").cast("binary")), F.lit(2)))
    below = r.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_below", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    return r.join(F.broadcast(below), "_b").withColumn(name, F.col("_below") + F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1).drop("_b", "_below")


def paired_bootstrap(baseline: DataFrame, candidate: DataFrame, session: str, value: str, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean over shared sessions of (candidate mean - baseline mean), with the 95 % interval of means of
    resampled sessions. Draws are md5 of seed, iteration and place, so they are alike on every engine;
    a draw is a row with one number, joined by the session's index."""
    of = lambda d, name: d.groupBy(session).agg(F.avg(value).alias(name))
    deltas = dense_index(of(baseline, "_a").join(of(candidate, "_b0"), session).select(session, (F.col("_b0") - F.col("_a")).alias("d")), session)
    n = deltas.count()
    if not n:
        raise ValueError("baseline and candidate have no shared sessions")
    spark = baseline.sparkSession
    draws = spark.range(iterations * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("k"))
    pick = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "k").cast("binary")), F.lit(8)), 16, 10).cast("long") % n
    means = draws.select("b", pick.alias("i")).join(deltas.select("i", "d"), "i").groupBy("b").agg(F.avg("d").alias("m"))
    low, high = math.floor(0.025 * (iterations - 1)), math.ceil(0.975 * (iterations - 1))
    order = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # `iterations` numbers
    return order.join(deltas.agg(F.avg("d").alias("mean_delta"))).select("mean_delta", F.col("m")[low].alias("ci_low"), F.col("m")[high].alias("ci_high"))


def established(low: Column, high: Column, p: Column) -> Column:
    """The interval excludes 0 and p is under 0.05."""
    return ((low > 0) | (high < 0)) & (p < 0.05)
