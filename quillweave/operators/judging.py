"""Answers and pairwise judging: records per arm, verdicts in both orders, tallies and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Why a provider stopped an answer short, and the categories of the strata.
CUT_OFF = ("max_tokens", "length", "incomplete")
CHECKPOINTS = ("answerable", "must_refuse")
RESPONSES = ("neither_refuses", "one_refuses", "both_refuse")


def answer_records(answers: DataFrame) -> DataFrame:
    """answers (answer, requirements, query_type, stop_reason, context) with scores: a refusal counts
    nothing for strict coverage only where declining was right, by the rule as it is coded."""
    covered, refused = T.coverage(F.col("requirements"), F.col("answer")), T.is_refusal(F.col("answer"))
    must = F.col("query_type") == "unanswerable"
    return answers.withColumns({
        "coverage": covered, "refused": refused, "expects_refusal": must, "truncated": F.coalesce(F.col("stop_reason").isin(*CUT_OFF), F.lit(False)),
        "context_sha256": F.left(F.sha2(F.col("context").cast("binary"), 256), F.lit(16)),
    }).withColumn("strict_coverage", F.when(F.col("expects_refusal") & F.col("refused"), 0.0).otherwise(F.col("coverage")))


def answer_summary(records: DataFrame) -> DataFrame:
    """One row per arm: means, and means over slices, which are 0 where a slice is empty."""
    must, refused = F.col("must_abstain"), F.col("refused")
    of = lambda cond, v: F.coalesce(F.avg(F.when(cond, v)), F.lit(0.0))
    share = lambda cond: F.avg(cond.cast("double"))
    return records.groupBy("arm").agg(
        F.count("*").alias("count"), F.avg("coverage").alias("mean_coverage"), F.avg("strict_coverage").alias("mean_strict_coverage"), share(refused).alias("refusal_rate"),
        of(~must & ~refused, F.col("coverage")).alias("mean_attempted_coverage"), of(~must, F.col("coverage")).alias("mean_answerable_coverage"),
        of(must, F.col("coverage")).alias("unanswerable_refusal_score"), *(F.avg(f"{k}_tokens").alias(f"mean_{k}_tokens") for k in ("memory", "input", "output", "total")),
        F.avg("latency_seconds").alias("mean_latency_seconds"), share(F.col("truncated")).alias("truncated_rate"), share(T.stripped(F.col("answer")) == "").alias("empty_answer_rate"),
    )


def coverage_verdict(requirements: Column, a: Column, b: Column) -> Column:
    """Which answer satisfies more requirements."""
    x, y = T.coverage(requirements, a), T.coverage(requirements, b)
    return F.when(x > y, "a").when(y > x, "b").otherwise("tie")


def flipped(verdict: Column) -> Column:
    return F.when(verdict == "a", "b").when(verdict == "b", "a").otherwise("tie")


def outcomes(pairs: DataFrame, calls: DataFrame, swap: bool = True) -> DataFrame:
    """pairs (sample_id, arm_a, arm_b, answer_a, answer_b), calls (sample_id, repeat, swapped, reply) ->
    winner, agreement, consistency, counts and source of each pair.

    Two refusals tie without a call. Else the verdicts, flipped back where the answers were, are counted
    by pair before they meet; a strict majority wins. A reply that can't be read is a tie. Agreement
    is null unless both orders were asked."""
    said = F.coalesce(T.verdict(F.col("reply")), F.lit("tie"))
    v = calls.select("sample_id", F.when(F.col("swapped"), flipped(said)).otherwise(said).alias("v"))
    n = v.groupBy("sample_id").agg(*(F.count_if(F.col("v") == k).alias(f"n_{k}") for k in ("a", "b", "tie")), F.count("*").alias("n"))
    gate = T.is_refusal(F.col("answer_a")) & T.is_refusal(F.col("answer_b"))
    out = pairs.withColumn("gate", gate).join(n, "sample_id", "left")
    most = F.greatest("n_a", "n_b", "n_tie")
    winner = F.when(2 * F.col("n_a") > F.col("n"), "a").when(2 * F.col("n_b") > F.col("n"), "b").otherwise("tie")
    judged = lambda c: F.when(~F.col("gate"), c)
    return out.select(
        *pairs.columns, F.when(F.col("gate"), "tie").otherwise(winner).alias("winner"), judged((most == F.col("n")) if swap else F.lit(None).cast("boolean")).alias("agreement"),
        judged(most / F.col("n")).alias("consistency"), F.when(F.col("gate"), "refusal_gate").otherwise("judge").alias("source"),
    )


def tally(done: DataFrame) -> DataFrame:
    """Wins, losses, ties, comparisons and win rate per arm; how often the two orders agreed, of all."""
    sides = done.select(F.inline(F.array(
        F.struct(F.col("arm_a").alias("arm"), (F.col("winner") == "a").alias("won"), (F.col("winner") == "b").alias("lost")),
        F.struct(F.col("arm_b").alias("arm"), (F.col("winner") == "b").alias("won"), (F.col("winner") == "a").alias("lost")),
    )))
    t = sides.groupBy("arm").agg(F.count_if("won").alias("wins"), F.count_if("lost").alias("losses"), F.count_if(~F.col("won") & ~F.col("lost")).alias("ties"), F.count("*").alias("comparisons"))
    return t.withColumn("win_rate", F.col("wins") / F.col("comparisons")).join(done.agg(F.avg(F.col("agreement").cast("double")).alias("order_agreement")))


def strata(done: DataFrame) -> DataFrame:
    """Outcomes by what was expected and by who declined; categories without a pair are there too."""
    spark = done.sparkSession
    kinds = spark.createDataFrame([("checkpoint", k) for k in CHECKPOINTS] + [("response", k) for k in RESPONSES], "stratum string, name string")
    n = T.is_refusal(F.col("answer_a")).cast("int") + T.is_refusal(F.col("answer_b")).cast("int")
    rows = done.select("winner", "agreement", F.inline(F.array(
        F.struct(F.lit("checkpoint").alias("stratum"), F.when(F.col("expects_refusal"), CHECKPOINTS[1]).otherwise(CHECKPOINTS[0]).alias("name")),
        F.struct(F.lit("response").alias("stratum"), F.get(F.array(*map(F.lit, RESPONSES)), n).alias("name")),
    )))
    known = F.col("agreement").isNotNull()
    s = rows.groupBy("stratum", "name").agg(
        F.count("*").alias("pairs"), F.count_if(known).alias("judged_pairs"), F.count_if("agreement").alias("agreed"), F.count_if(known & ~F.col("agreement")).alias("disagreed"),
        F.avg(F.col("agreement").cast("double")).alias("order_agreement"), F.count_if(F.col("winner") == "a").alias("arm_a_wins"), F.count_if(F.col("winner") == "b").alias("arm_b_wins"),
        F.count_if(F.col("winner") == "tie").alias("ties"),
    )
    counts = ("pairs", "judged_pairs", "agreed", "disagreed", "arm_a_wins", "arm_b_wins", "ties")
    return kinds.join(s, ["stratum", "name"], "left").fillna(0, list(counts))


def mean_consistency(done: DataFrame) -> DataFrame:
    return done.agg(F.round(F.avg("consistency"), 4).alias("mean_consistency"))


def ablation_prompts(materials: DataFrame, queries: DataFrame) -> DataFrame:
    """materials (sample_id, context_id, name, material), queries (sample_id, query, recent) -> for each
    context the prompt without it: the window, the others' material in order, the question.

    A sample's materials are a handful; they meet in one array, from which each context is left out."""
    one = F.struct("context_id", "name", "material")
    m = materials.groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("all")).join(queries, "sample_id")
    each = m.select("sample_id", "query", "recent", "all", F.explode("all").alias("own"))
    other = F.transform(F.filter("all", lambda x: x["context_id"] != F.col("own.context_id")), lambda x: F.concat(F.lit("[Context: "), x["name"], F.lit("]\n"), F.coalesce(F.nullif(x["material"], F.lit("")), F.lit("(no material retrieved)"))))
    head = F.concat(F.lit("[Recent conversation]\n"), F.coalesce(F.nullif("recent", F.lit("")), F.lit("(none)")))
    blocks = F.concat(F.array(head), other, F.array(F.concat(F.lit("[Question]\n"), F.col("query"))))
    return each.select("sample_id", F.col("own.context_id").alias("ablated"), F.array_join(blocks, "\n\n").alias("prompt"))


def ablation_verdicts(replies: DataFrame) -> DataFrame:
    """replies (sample_id, ablated, reply, is_control) -> per sample the contexts that were needed (not
    answerable without), the controls among them, and how many replies couldn't be read."""
    r = replies.withColumn("yes", T.yes_no(F.col("reply")))
    needed = lambda cond: F.array_sort(F.collect_list(F.when(cond & ~F.col("yes"), F.col("ablated"))))
    return r.groupBy("sample_id").agg(needed(F.lit(True)).alias("required"), needed(F.col("is_control")).alias("control_failures"), F.count_if(F.col("yes").isNull()).alias("unreadable"))
