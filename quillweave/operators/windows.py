"""Window benchmarks: streams of dialogues cut into windows, retrieval of windows, and what decides hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics

# The audit's limits.
SOLVED_LIMIT, LEAST_OPEN, LEAST_SHARE, LONG_SHARE = 0.75, 25, 0.20, 0.05


def arrange(dialogues: DataFrame, how: str = "blocks", seed: int = 0) -> DataFrame:
    """dialogues (dialogue_id, kind 'truth' or 'noise', number) with a place in the stream: truth then noise, each in
    its order (blocks); in turn (interleaved); or by a seeded hash (shuffled). Places are the same for every run.

    Shuffled dialogues are dealt into buckets by the hash's first two digits, which are counted and summed up,
    and the others by runs of numbers, so no task numbers all of them."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "kind", "number").cast("binary"))
    run = F.format_string("%012d", F.floor(F.col("number") / 4096).cast("long"))
    bucket = {"blocks": F.concat(F.when(F.col("kind") == "truth", "0").otherwise("1"), run), "interleaved": run, "shuffled": F.left(h, F.lit(2))}[how]
    order = {"blocks": ["number"], "interleaved": ["number", F.desc("kind")], "shuffled": ["_h", "kind", "number"]}[how]
    d = dialogues.withColumns({"_h": h, "_b": bucket})
    below = d.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_below", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.col("_below") + F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return d.join(below, "_b").withColumn("place", place).drop("_h", "_b", "_below")


def pack_sentences(costs: Column, size: int) -> Column:
    """The window that each sentence of a dialogue falls into: sentences are added while the window stays within
    size; one that is larger makes a window of its own."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("w"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        new = (s["w"] < 0) | (s["used"] + c > size)
        w = F.when(new, s["w"] + 1).otherwise(s["w"])
        return F.struct(F.when(new, c).otherwise(s["used"] + c).cast("long").alias("used"), w.alias("w"), F.concat(s["out"], F.array(w)).alias("out"))

    return F.aggregate(costs, zero, step, lambda s: s["out"])


def window_blocks(sentences: DataFrame, size: int) -> DataFrame:
    """sentences (dialogue_id, number, text) -> (dialogue_id, window, text, tokens, first): consecutive sentences of
    about size tokens, never over two dialogues."""
    s = sentences.withColumn("tokens", T.token_count(F.col("text")))
    d = s.groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("number", "text", "tokens"))).alias("s"))
    d = d.withColumn("w", pack_sentences(F.transform("s", lambda x: x["tokens"]), size))
    flat = d.select("dialogue_id", F.inline(F.arrays_zip("s", "w"))).select("dialogue_id", F.col("w").alias("window"), "s.*")
    one = F.array_sort(F.collect_list(F.struct("number", "text")))
    return flat.groupBy("dialogue_id", "window").agg(F.array_join(F.transform(one, lambda x: x["text"]), " ").alias("text"), F.sum("tokens").alias("tokens"), F.min("number").alias("first"))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def evidence_share(expected: Column, text: Column) -> Column:
    """Share of the expected strings that the text holds, white space and case aside; 0 without any."""
    body = squeezed(text)
    return metrics.ratio(F.size(F.filter(expected, lambda e: F.contains(body, squeezed(e)))), F.size(expected))


def retrieval(gold: Column, ranking: Column, k: int) -> dict[str, Column]:
    """any@k, all@k and coverage@k of a set of right units."""
    hit = F.size(F.array_intersect(gold, F.slice(ranking, 1, k)))
    return {"any": (hit > 0).cast("double"), "all": ((F.size(gold) > 0) & (hit == F.size(F.array_distinct(gold)))).cast("double"), "coverage": metrics.ratio(hit, F.size(F.array_distinct(gold)))}


def difficulty_strata(cases: DataFrame) -> DataFrame:
    """cases (solved: the first lexical window holds all evidence; recall) -> recall on solved, on open and on all; a
    stratum without cases has null; the strata weighted by their sizes give the pooled recall."""
    of = lambda c: F.avg(F.when(c, F.col("recall")))
    return cases.agg(F.count("*").alias("questions"), F.count_if("solved").alias("solved"), of(F.col("solved")).alias("recall_solved"), of(~F.col("solved")).alias("recall_open"), F.avg("recall").alias("recall_pooled"))


def miss_decomposition(cases: DataFrame) -> DataFrame:
    """cases (gold, candidates, selected) -> recovered + selection_loss + candidate_miss = questions with evidence, and
    those without a window that holds it."""
    has = F.size("gold") > 0
    in_c, in_s = (F.size(F.array_except("gold", c)) == 0 for c in ("candidates", "selected"))
    return cases.agg(
        F.count_if(has).alias("questions"), F.count_if(has & in_s).alias("recovered"), F.count_if(has & ~in_s & in_c).alias("selection_loss"), F.count_if(has & ~in_s & ~in_c).alias("candidate_miss"),
        F.count_if(~has).alias("no_evidence_window"),
    )


def selected_histogram(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.size("selected").alias("n_selected")).agg(F.count("*").alias("questions"))


def ordering_hits(candidates: DataFrame, orders: dict[str, bool]) -> DataFrame:
    """candidates (question_id, id, right, a column per order) -> (order, question_id, hit): whether the first by each
    order (True: greater first) is right; nulls come last. `oracle` is a hit where any candidate is right."""
    rows = None
    for name, greater in orders.items():
        by = F.desc_nulls_last(name) if greater else F.asc_nulls_last(name)
        first = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy(by, "id"))).where("_r = 1")
        part = first.select(F.lit(name).alias("order"), "question_id", F.col("right").cast("int").alias("hit"))
        rows = part if rows is None else rows.union(part)
    return rows.union(candidates.groupBy("question_id").agg(F.max(F.col("right").cast("int")).alias("hit")).select(F.lit("oracle").alias("order"), "question_id", "hit"))


def ordering_report(hits: DataFrame) -> DataFrame:
    return hits.groupBy("order").agg(F.count("*").alias("questions"), F.avg("hit").alias("recall"))


def paired_ordering(hits: DataFrame, base: str, other: str, iterations: int = 20_000, seed: int = 0) -> dict:
    """Wins, losses, exact McNemar p and the bootstrap's interval of other against base."""
    h = hits.where(F.col("order").isin(base, other)).groupBy("question_id").agg(F.max(F.when(F.col("order") == base, F.col("hit"))).alias("a"), F.max(F.when(F.col("order") == other, F.col("hit"))).alias("b"))
    n = h.agg(F.count_if(F.col("b") > F.col("a")).alias("w"), F.count_if(F.col("b") < F.col("a")).alias("l")).first()
    ci = metrics.paired_bootstrap(h.select("question_id", F.col("a").alias("v")), h.select("question_id", F.col("b").alias("v")), "question_id", "v", iterations, seed).first()
    p = metrics.mcnemar(n["w"], n["l"])
    return {"wins": n["w"], "losses": n["l"], "p": p, **ci.asDict(), "established": (ci["ci_low"] > 0 or ci["ci_high"] < 0) and p < 0.05}


def arrangement_reachability(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """blocks (place, tokens, kind) of a stream -> its tokens, those of truth, truth blocks, the median distance of
    truth from the end in tokens, and the share within each trailing size."""
    total = F.sum("tokens").over(Window.partitionBy())
    before = F.sum("tokens").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # one row per block
    b = blocks.withColumn("total", total).withColumn("distance", total - F.coalesce(before, F.lit(0)))
    truth = F.col("kind") == "truth"
    return b.agg(
        F.max("total").alias("stream_tokens"), F.sum(F.when(truth, F.col("tokens"))).alias("truth_tokens"), F.count_if(truth).alias("truth_blocks"), F.median(F.when(truth, F.col("distance"))).alias("median_distance"),
        *(metrics.ratio(F.count_if(truth & (F.col("distance") <= s)), F.count_if(truth)).alias(f"within_{s}") for s in sizes),
    )


def audit(cases: DataFrame) -> DataFrame:
    """cases (solved, recall, open_hits, long_question) -> five checks of whether a benchmark can tell arms apart."""
    n = F.count("*")
    a = cases.agg(n.alias("n"), F.avg(F.col("solved").cast("double")).alias("solved"), F.count_if(~F.col("solved")).alias("open"), F.avg(F.col("long_question").cast("double")).alias("long"), F.avg("recall").alias("recall"))
    grade = lambda ok, soft: F.when(ok, "pass").when(soft, "caveat").otherwise("fail")
    return a.select(
        "n", "solved", "open", grade(F.col("solved") <= SOLVED_LIMIT, F.col("solved") < 1).alias("ceiling"), grade(F.col("open") >= LEAST_OPEN, F.col("open") > 0).alias("enough_open"),
        grade(F.col("open") / F.col("n") >= LEAST_SHARE, F.col("open") > 0).alias("open_share"), grade(F.col("long") <= LONG_SHARE, F.col("long") < 0.5).alias("query_length"), grade((F.col("recall") > 0) & (F.col("recall") < 1), F.lit(False)).alias("spread"),
    )
