"""Comparison arms over checkpoints: what each would show, scored against the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import stored
from . import assembly, budget, metrics, routing, search

# The arms and their limits.
ARMS = ("query_recent_only", "full_history", "sliding_window", "summary_recent", "global_bm25", "global_dense", "global_hybrid", "hybrid_router", "indexed_router", "oracle_router")
SLIDING, LIMIT, REDUCTION = 8, 8, 0.30


def visible_contexts(checkpoints: DataFrame, contexts: DataFrame, events: DataFrame) -> DataFrame:
    """(sample_id, context ...): contexts whose creating event is in the session and causal; one whose event is
    unknown is not there."""
    made = contexts.join(events.select("session_id", F.col("event_id").alias("created_at_event"), F.col("sequence").alias("created")), ["session_id", "created_at_event"])
    return checkpoints.select("sample_id", "session_id", "as_of").join(made, "session_id").where("created <= as_of").drop("as_of")


def missing_queries(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Checkpoints whose query event isn't in the log: a case can't be built of them."""
    return checkpoints.join(events.select(F.col("event_id").alias("query_event_id")), "query_event_id", "left_anti")


def _fold(blocks: DataFrame, limit: int | None) -> DataFrame:
    """blocks (sample_id, rank, section, event_id, text) admitted in order while they fit; others are skipped."""
    b = blocks.withColumn("cost", T.token_count(F.col("text")))
    one = F.struct("rank", "section", "event_id", "text", "cost")
    rows = b.groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("b"))
    if limit is not None:
        taken = budget.admit(F.transform("b", lambda x: x["cost"]), limit)
        rows = rows.withColumn("taken", taken).withColumn("b", F.transform("taken", lambda i: F.get(F.col("b"), i)))
    return rows.select(
        "sample_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("rendered"), F.filter(F.transform("b", lambda x: x["event_id"]), lambda e: e.isNotNull()).alias("included"),
        F.array_distinct(F.transform("b", lambda x: x["section"])).alias("sections"), F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("memory_tokens"),
    )


def _event_blocks(rows: DataFrame, section: str, rank: Column) -> DataFrame:
    return rows.select("sample_id", rank.alias("rank"), F.lit(section).alias("section"), "event_id", assembly.event_text(F.lit(section), F.lit(None)).alias("text"))


def global_ranking(checkpoints: DataFrame, events: DataFrame, mode: str) -> DataFrame:
    """(sample_id, event_id, place): the LIMIT best of all causal events but the query's own, by one channel or
    by fusing both whole rankings."""
    pool = checkpoints.select("sample_id", "session_id", "as_of", "query_event_id").join(events.select("session_id", "event_id", "sequence", "content"), "session_id").where("sequence <= as_of AND event_id <> query_event_id")
    asked = checkpoints.select("sample_id", "query").withColumn("_q", F.lit(0))
    by = Window.partitionBy("sample_id")
    place = F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), "event_id"))

    def ranked(scored: DataFrame) -> DataFrame:
        return scored.where(F.round("score", 9) > 0).select("sample_id", "event_id", "score").withColumn("place", place)

    lexical = lambda: ranked(search.bm25(asked, pool, "_q", "event_id", "query", "content", corpus=["sample_id"]))
    cosine = lambda: ranked(search.dense(asked, pool, "_q", "event_id", "query", "content", corpus=["sample_id"]))
    if mode == "global_bm25":
        out = lexical()
    elif mode == "global_dense":
        out = cosine()
    else:
        out = ranked(search.rrf([(d.withColumnRenamed("place", "rank"), 1.0) for d in (lexical(), cosine())], "sample_id", "event_id"))
    return out.where(F.col("place") <= LIMIT).select("sample_id", "event_id", "place")


def expanded(checkpoints: DataFrame, events: DataFrame, ranking: DataFrame) -> DataFrame:
    """The ranking's events with their tool partners and neighbours, each event once, at its first group:
    (sample_id, event_id, group, sequence)."""
    own = checkpoints.select("sample_id", "session_id", "as_of")
    e = events.select("session_id", "event_id", "sequence", "kind", "parent_event_id")
    a = ranking.join(own, "sample_id").join(e, ["session_id", "event_id"])
    keys = ["sample_id", "session_id", "as_of", "place"]
    root = a.withColumn("root", F.when(F.col("kind") == "tool_call", F.col("event_id")).when(F.col("kind") == "tool_result", F.col("parent_event_id"))).where("root IS NOT NULL")
    call = root.select(*keys, "root").join(e.select("session_id", F.col("event_id").alias("root"), F.col("sequence").alias("root_at")), ["session_id", "root"]).where("root_at <= as_of")
    child = call.join(e.select("session_id", F.col("parent_event_id").alias("root"), "event_id", "sequence"), ["session_id", "root"]).where("sequence <= as_of")
    band = a.select(*keys, F.explode(F.array(F.col("sequence") - 1, F.col("sequence") + 1)).alias("sequence")).join(e.select("session_id", "sequence", "event_id"), ["session_id", "sequence"]).where("sequence <= as_of")
    rows = a.select("sample_id", "place", "event_id", "sequence").union(call.select("sample_id", "place", F.col("root"), F.col("root_at"))).union(child.select("sample_id", "place", "event_id", "sequence")).union(band.select("sample_id", "place", "event_id", "sequence"))
    return rows.groupBy("sample_id", "event_id", "sequence").agg(F.min("place").alias("group"))


def assemble_arm(name: str, checkpoints: DataFrame, events: DataFrame, contexts: DataFrame, assignments: DataFrame, limit: int = assembly.BUDGET) -> DataFrame:
    """(sample_id, rendered, included, sections, memory_tokens, selected, decision, confidence) of an arm."""
    plain = lambda d: d.withColumns({"selected": F.array().cast("array<string>"), "decision": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    if name == "query_recent_only":
        return plain(_fold(_event_blocks(assembly.last_events(checkpoints, events, assembly.RECENT_TURNS, False), "recent", F.col("sequence")), limit))
    if name == "sliding_window":
        return plain(_fold(_event_blocks(assembly.last_events(checkpoints, events, SLIDING, True), "recent", F.col("sequence")), limit))
    if name == "full_history":
        rows = checkpoints.select("sample_id", "session_id", "as_of").join(events, "session_id").where("sequence <= as_of")
        return plain(_fold(_event_blocks(rows, "evidence", F.col("sequence")), None))
    if name == "summary_recent":
        active = checkpoints.select("sample_id", F.array_distinct(F.filter(F.concat(F.array("primary_id"), "recent_ids"), lambda x: x.isNotNull())).alias("active"))
        seen = visible_contexts(checkpoints, contexts, events).join(active.select("sample_id", F.posexplode("active").alias("rank", "context_id")), ["sample_id", "context_id"])
        described = seen.select("sample_id", (F.col("rank") - 1000).alias("rank"), F.lit("context").alias("section"), F.lit(None).cast("string").alias("event_id"), assembly.descriptor_text().alias("text"))
        recent = _event_blocks(assembly.last_events(checkpoints, events, assembly.RECENT_TURNS, False), "recent", F.col("sequence"))
        chosen = seen.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context_id"))), lambda x: x["context_id"]).alias("selected"))
        out = plain(_fold(described.union(recent), limit)).drop("selected").join(chosen, "sample_id", "left")
        return out.withColumn("selected", F.coalesce("selected", F.array().cast("array<string>")))
    if name.startswith("global_"):
        rows = expanded(checkpoints, events, global_ranking(checkpoints, events, name)).join(checkpoints.select("sample_id", "session_id"), "sample_id").join(events.drop("sequence"), ["session_id", "event_id"])
        return plain(_fold(_event_blocks(rows, "evidence", F.struct("group", "sequence")), limit))
    if name not in ARMS:
        raise ValueError(f"unknown arm {name}")
    if name == "oracle_router":
        d = routing.oracle(checkpoints)
    else:
        d = decide(checkpoints, events, contexts)
    seen = visible_contexts(checkpoints, contexts, events).select("session_id", "context_id", "name", "goal", "summary").distinct()
    built = assembly.assemble(checkpoints, d, events, seen, assignments, limit, "index" if name == "indexed_router" else "prose")
    return built.select("sample_id", "rendered", "included", "sections", "memory_tokens").join(d.select(F.col("request_id").alias("sample_id"), "selected", "decision", "confidence"), "sample_id")


def decide(checkpoints: DataFrame, events: DataFrame, contexts: DataFrame) -> DataFrame:
    """Routes each checkpoint over the contexts that it can see."""
    seen = visible_contexts(checkpoints, contexts, events).withColumnRenamed("sample_id", "request_id")
    # decided once: assembly uses decisions several times
    return stored(routing.route(checkpoints.select(F.col("sample_id").alias("request_id"), "query", "primary_id", "recent_ids", "as_of"), seen), "decisions")


def score(name: str, built: DataFrame, checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """A row per checkpoint: tokens, evidence recall (1 without labels), reachability, leakage of the future."""
    c = checkpoints.select("sample_id", "session_id", "query", "query_type", "as_of", "required_ids", "evidence_sets", "requirements").join(built, "sample_id", "left")
    included = F.coalesce("included", F.array().cast("array<string>"))
    late = c.select("sample_id", "session_id", "as_of", F.explode("included").alias("event_id")).join(events.select("session_id", "event_id", "sequence"), ["session_id", "event_id"], "left")
    leaks = late.groupBy("sample_id").agg(F.count_if(F.col("sequence").isNull() | (F.col("sequence") > F.col("as_of"))).alias("future_leakage"))
    tokens = F.coalesce("memory_tokens", F.lit(0)).cast("long")
    return c.join(leaks, "sample_id", "left").select(
        F.lit(name).alias("arm"), "sample_id", "session_id", "query_type", "selected", "decision", tokens.alias("memory_tokens"), (tokens + T.token_count(F.col("query"))).alias("total_input_tokens"), F.size(included).alias("n_included"),
        metrics.evidence_recall(F.col("evidence_sets"), included).alias("evidence_recall"), T.reachability(F.col("requirements"), F.coalesce("rendered", F.lit(""))).alias("reachability"), F.coalesce("future_leakage", F.lit(0)).cast("long").alias("future_leakage"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row per arm; means skip what wasn't measured; the saving is against full history."""
    s = results.groupBy("arm").agg(
        F.count("*").alias("count"), F.avg("memory_tokens").alias("mean_memory_tokens"), F.median("memory_tokens").alias("median_memory_tokens"), F.max("memory_tokens").alias("max_memory_tokens"), F.avg("total_input_tokens").alias("mean_total_input_tokens"),
        F.avg("evidence_recall").alias("evidence_recall"), F.avg("reachability").alias("reachability"), F.sum("future_leakage").alias("future_leakage"), F.avg((F.coalesce("decision", F.lit("")) == "abstain").cast("double")).alias("abstention_rate"),
    )
    full = s.where("arm = 'full_history'").select(F.nullif("mean_memory_tokens", F.lit(0.0)).alias("_full"))
    return s.join(F.broadcast(full), how="left").withColumn("token_reduction", 1 - F.col("mean_memory_tokens") / F.col("_full")).drop("_full")  # one row


def recall_not_worse(candidate: Column, reference: Column) -> Column:
    return F.coalesce(candidate >= reference - 1e-9, F.lit(False))


def gate_one(summarised: DataFrame) -> DataFrame:
    """Whether labels' own contexts save enough tokens without losing evidence."""
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    g = summarised.agg(*(of(a, c).alias(f"{n}_{k}") for a, n in (("full_history", "full"), ("oracle_router", "oracle")) for c, k in (("mean_memory_tokens", "tokens"), ("evidence_recall", "recall"))))
    g = g.withColumn("oracle_token_reduction", F.coalesce(1 - F.col("oracle_tokens") / F.nullif("full_tokens", F.lit(0.0)), F.lit(0.0)))
    g = g.withColumn("token_gate_passed", F.col("oracle_token_reduction") >= REDUCTION).withColumn("recall_not_worse", recall_not_worse(F.col("oracle_recall"), F.col("full_recall")))
    return g.withColumn("verdict", F.when(F.col("token_gate_passed") & F.col("recall_not_worse"), "continue").otherwise("stop"))


def recency_reachability(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Per query type how many labelled checkpoints have evidence among the last three events; a type is
    definitional if all or none have."""
    last = assembly.last_events(checkpoints, events, assembly.RECENT_TURNS, False).groupBy("sample_id").agg(F.collect_list("event_id").alias("near"))
    c = checkpoints.join(last, "sample_id", "left")
    near = F.coalesce("near", F.array().cast("array<string>"))
    hit = F.exists("evidence_sets", lambda s: F.arrays_overlap(s, near))
    labelled = F.size("evidence_sets") > 0
    r = c.groupBy("query_type").agg(F.count("*").alias("checkpoints"), F.count_if(labelled).alias("labelled"), F.count_if(labelled & hit).alias("reachable"))
    return r.withColumn("share", metrics.ratio(F.col("reachable"), F.col("labelled"))).withColumn("definitional", (F.col("labelled") > 0) & ((F.col("reachable") == 0) | (F.col("reachable") == F.col("labelled"))))


def stratified_sample(cases: DataFrame, limit: int, kind: str = "query_type", order: str = "sample_id") -> DataFrame:
    """About limit cases, each type's spread evenly over its timeline and types in turn; the tail is filled in
    order. Types are few; places within a type come from a window."""
    by = Window.partitionBy(kind).orderBy(order)
    c = cases.withColumn("_i", F.row_number().over(by) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(kind)))
    kinds = c.groupBy(kind).agg(F.min(order).alias("_first"))
    take = F.least(F.greatest(F.floor(F.lit(limit) / kinds.count()), F.lit(1)) + 1, F.col("_n"))
    step = (F.col("_n") - 1) / F.greatest(F.col("_t") - 1, F.lit(1))
    # the pick whose even place rounds to this row, halves to even
    near = F.round(F.col("_i") / F.greatest(F.col("_step"), F.lit(1e-12))).cast("int")
    picks = F.filter(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < F.col("_t")) & (F.bround(k * F.col("_step"), 0) == F.col("_i")))
    c = c.withColumn("_t", take).withColumn("_step", step).withColumn("_depth", F.when(F.col("_t") <= 1, F.col("_i")).otherwise(F.array_min(picks))).join(F.broadcast(kinds), kind)
    return c.orderBy(F.col("_depth").isNull(), "_depth", F.when(F.col("_depth").isNotNull(), F.col("_first")), order).limit(limit).select(*cases.columns)
