"""Checks and audits of labels: rows that break a rule, coverage by annotators, agreement of label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scrub as S
from ..functions import text as T
from . import metrics

LEAST_DOUBLE = 0.2


def _faults(rows: DataFrame, rule: str, what: Column | str = "sample_id") -> DataFrame:
    return rows.select("sample_id", F.lit(rule).alias("rule"), (F.col(what) if isinstance(what, str) else what).cast("string").alias("what"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dataset_faults(checkpoints: DataFrame, events: DataFrame, contexts: DataFrame) -> DataFrame:
    """(sample_id, rule, what) of checkpoints (sample_id, session_id, query_event_id, as_of, required_ids,
    evidence_sets, forbidden_ids, must_abstain) that break a rule of generated data; a checkpoint without its
    query event is told that alone. Secrets are looked for in the events of the checkpoints' sessions."""
    e = events.select("event_id", F.col("session_id").alias("_session"), F.col("sequence").alias("_at"))
    c = checkpoints.join(e.withColumnRenamed("event_id", "query_event_id"), "query_event_id", "left")
    found = c.where("_at IS NOT NULL")
    by_id = e.drop("_session")
    needed = found.select("sample_id", F.explode("required_ids").alias("context_id")).join(contexts.select("context_id"), "context_id", "left_anti")
    evidence = found.select("sample_id", "as_of", F.explode(F.flatten("evidence_sets")).alias("event_id")).join(by_id, "event_id", "left").where("_at IS NULL OR _at > as_of")
    future = found.select("sample_id", "as_of", F.explode("forbidden_ids").alias("event_id")).join(by_id, "event_id", "left").where("_at IS NULL OR _at <= as_of")
    sessions = found.select("session_id", "sample_id")
    secret = events.where(S.has_secret(F.col("content"))).select("session_id", "event_id").join(sessions, "session_id")
    twice = checkpoints.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")
    return _all([
        _faults(twice, "duplicate sample"), _faults(c.where("_at IS NULL"), "missing query event", "query_event_id"), _faults(found.where("_session <> session_id"), "session mismatch"),
        _faults(found.where("_at <> as_of"), "place mismatch"), _faults(needed, "missing context", "context_id"), _faults(found.where((F.size("required_ids") > 0) == F.col("must_abstain")), "abstain conflict"),
        _faults(evidence, "evidence not causal", "event_id"), _faults(future, "future event not later", "event_id"), _faults(secret, "possible secret", "event_id"),
    ])


def replay_faults(checkpoints: DataFrame, events: DataFrame, contexts: DataFrame, members: DataFrame, enforce_double: bool = True) -> DataFrame:
    """The same for labels of a real conversation: checkpoints also have requirements, members are (context_id,
    event_id). With enforce_double, too few second annotators are a fault without a sample."""
    e = events.select("event_id", F.col("sequence").alias("_at"))
    c = checkpoints.join(e.withColumnRenamed("event_id", "query_event_id"), "query_event_id", "left")
    found = c.where("_at IS NOT NULL")
    wanted = found.select("sample_id", F.explode("requirements").alias("r")).where(F.size(T.requirement_terms(F.col("r"))) == 0)
    options = found.select("sample_id", "as_of", F.explode("evidence_sets").alias("option"))
    evidence = options.select("sample_id", "as_of", F.explode("option").alias("event_id")).join(e, "event_id", "left")
    m = members.withColumn("sample_id", F.lit(None).cast("string"))
    parts = [
        _faults(c.where("_at IS NULL"), "unknown query event", "query_event_id"), _faults(found.where("_at <> as_of"), "place mismatch"), _faults(wanted, "requirement has nothing to match on", "r"),
        _faults(options.where(F.size("option") == 0), "empty evidence option"), _faults(evidence.where("_at IS NULL"), "unknown evidence", "event_id"), _faults(evidence.where("_at > as_of"), "evidence not causal", "event_id"),
        _faults(m.join(contexts.select("context_id"), "context_id", "left_anti"), "members of an undeclared context", "context_id"), _faults(m.join(e, "event_id", "left_anti"), "unknown member", "event_id"),
    ]
    if enforce_double:
        short = annotation_coverage(checkpoints).where(F.col("double_rate") < LEAST_DOUBLE).withColumn("sample_id", F.lit(None).cast("string"))
        parts.append(_faults(short, "too few second annotators", "double_rate"))
    return _all(parts)


def annotation_coverage(checkpoints: DataFrame) -> DataFrame:
    """Second annotators and, apart from them, rechecks by the same one. Empty names count as none."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    again = has("recheck_annotator")
    agree = lambda c: metrics.ratio(F.count_if(again & F.coalesce(F.col(c), F.lit(False))), F.count_if(again))
    return checkpoints.agg(
        F.count("*").alias("checkpoints"), F.count_if(has("second_annotator")).alias("double_annotated"), F.count_if(has("adjudicated_by")).alias("adjudicated"), metrics.ratio(F.count_if(has("second_annotator")), F.count("*")).alias("double_rate"),
        F.count_if(again).alias("rechecked"), agree("recheck_contexts_agree").alias("recheck_context_agreement"), agree("recheck_type_agrees").alias("recheck_type_agreement"),
    )


def to_benchmark(checkpoints: DataFrame, events: DataFrame, ahead: int = 3) -> DataFrame:
    """Annotated checkpoints as benchmark rows: the first events that come later are forbidden, and no context is
    required, as none can be labelled."""
    later = checkpoints.select("sample_id", "session_id", "as_of").join(events.select("session_id", "event_id", "sequence"), "session_id").where("sequence > as_of")
    first = later.groupBy("sample_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("sequence", "event_id"))), 1, ahead).alias("_f"))
    out = checkpoints.drop("required_ids", "forbidden_ids").join(first, "sample_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"required_ids": none, "forbidden_ids": F.coalesce(F.transform("_f", lambda x: x["event_id"]), none)}).drop("_f")


def record_faults(records: DataFrame) -> DataFrame:
    """Second labels (blind_id, sample_id, status, requirements) that can't stand: none or too many requirements for
    their status, one that nothing can match, ids that repeat."""
    n, answerable = F.size("requirements"), F.col("status") == "answerable"
    vague = F.exists("requirements", lambda r: F.size(T.requirement_terms(r)) == 0)
    twice = lambda c: records.groupBy(c).agg(F.first("sample_id").alias("sample_id"), F.count("*").alias("n")).where("n > 1")
    same = records.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")
    return _all([
        _faults(records.where(answerable & (n == 0)), "answerable without requirement"), _faults(records.where(~answerable & (n > 0)), "requirement without answer"), _faults(records.where(n > 3), "more than three requirements"),
        _faults(records.where(vague), "requirement has nothing to match on"), _faults(same, "sample repeats"), _faults(twice("blind_id"), "blind id repeats"),
    ])


def label_audit(second: DataFrame, first: DataFrame, answers: DataFrame) -> DataFrame:
    """second (sample_id, status, requirements), first (sample_id, requirements), answers (sample_id, answer) -> per
    sample whether the status fits the answer, and counts of requirements that the answer, and the other set's
    wording, support. A sample that either other table lacks is an error."""
    j = second.join(first.select("sample_id", F.col("requirements").alias("_first"), F.lit(True).alias("_in")), "sample_id", "left").join(answers, "sample_id", "left")
    j = j.withColumn("answer", F.when(F.col("_in") & F.col("answer").isNotNull(), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("unknown sample "), F.col("sample_id").cast("string")))))
    there = T.stripped(F.col("answer")) != ""
    fits = ((F.col("status") == "answerable") & there) | ((F.col("status") == "no_substantive_answer") & ~there)
    met = lambda rs, text: F.size(F.filter(rs, lambda r: T.satisfied(r, text))).cast("long")
    joined = lambda rs: F.array_join(rs, " ")
    return j.select(
        "sample_id", fits.alias("status_matches"), F.size("requirements").cast("long").alias("n_requirements"), met("requirements", F.col("answer")).alias("n_supported"), F.size("_first").cast("long").alias("n_first"),
        met("_first", joined("requirements")).alias("n_first_recalled"), met("requirements", joined("_first")).alias("n_recalled_by_first"),
    )


def adjudication_audit(final: DataFrame, first: DataFrame, second: DataFrame, answers: DataFrame) -> DataFrame:
    """final (sample_id, decision, requirements) against both label sets: what the final text matches, whether the
    decision says so, whether it fits the answer. Decisions are kept as they are."""
    j = final.join(first.select("sample_id", F.col("requirements").alias("_a")), "sample_id").join(second.select("sample_id", F.col("requirements").alias("_b")), "sample_id").join(answers, "sample_id")
    a, b, some = F.col("requirements") == F.col("_a"), F.col("requirements") == F.col("_b"), F.size("requirements") > 0
    matches = F.when(~some, "no_answer").when(a & b, "both").when(a, "primary").when(b, "secondary").otherwise("neither")
    j = j.withColumn("final_matches", matches)
    m, d = F.col("final_matches"), F.col("decision")
    consistent = (
        F.when(d == "use_primary", m.isin("primary", "both")).when(d == "use_secondary", m.isin("secondary", "both")).when(d == "merge_rewrite", some).when(d == "equivalent", m == "both")
        .when(d == "confirm_no_substantive_answer", m == "no_answer")
    )
    return j.select("sample_id", "final_matches", consistent.alias("decision_consistent"), (some == (T.stripped(F.col("answer")) != "")).alias("status_matches"), (~m.isin("primary", "both", "no_answer")).alias("gold_changed"))


# Rules that label a checkpoint by what its reply drew on (kept for comparison; labels don't use them).

TASK_NOUN = r"\.py|\.vsdx|\.csv|\.xlsx|\.pdf|题|问|图|表|附录|代码|模型|算法|文件|材料|网格|方案"


def reply_contexts(scores: DataFrame) -> DataFrame:
    """scores (sample_id, context_id, score) -> ids of those within half of the best, if that is above 0."""
    best = scores.groupBy("sample_id").agg(F.max("score").alias("_best")).where("_best > 0")
    near = scores.join(best, "sample_id").where("score >= 0.5 * _best")
    return near.groupBy("sample_id").agg(F.array_sort(F.collect_list("context_id")).alias("reply_contexts"))


def decide_type(rows: DataFrame) -> DataFrame:
    """rows (query, reply, reply_contexts, previous_active, active_before) with query_type, required and must_abstain."""
    n, first = F.size("reply_contexts"), F.get("reply_contexts", F.lit(0))
    noun = F.col("query").rlike(TASK_NOUN)
    kind = (
        F.when((n == 0) & T.is_refusal(F.col("reply")), "unanswerable").when(n == 0, "new_context").when(n >= 2, "cross_context")
        .when((first == F.col("previous_active")) & ~noun, "short_coreference").when(first == F.col("previous_active"), "continue").when(F.array_contains("active_before", first), "return").otherwise("switch")
    )
    return rows.withColumns({"query_type": kind, "required": F.col("reply_contexts"), "must_abstain": n == 0})
