"""Queries of evaluation, judging and redaction, and their DuckDB SQL.

The tables have no routed cases, so cases are made of document ids by arithmetic that both
engines share: required, selected and ranked contexts, confidence, relations and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub as S
from ..functions import text as T
from ..operators import judging, metrics
from .catalog import _t, query

TYPES = ("continue", "switch", "return", "cross_context", "new_context", "ambiguous", "unanswerable", "follow_up")

_CASES = f"""x AS (SELECT doc_id, doc_id // 13 AS session, ((doc_id * 37) % 101) / 100.0::DOUBLE AS confidence,
    {list(TYPES)}[doc_id % 8 + 1] AS query_type, {list(T.RELATIONS)}[doc_id % 5 + 1] AS expected, {list(T.RELATIONS)}[(doc_id * 3 + doc_id // 7) % 5 + 1] AS predicted,
    CASE WHEN doc_id % 9 = 0 THEN [] ELSE [c FOR c IN range(8) IF (doc_id * 31 + c * 17) % 7 < 2] END AS required,
    [k % 8 FOR k IN list_sort([((doc_id + 3) * (c + 2) * 7) % 11 * 8 + c FOR c IN range(8) IF (doc_id * 13 + c * 5) % 6 <> 0])] AS ranking FROM documents),
cases AS (SELECT *, ranking[1 : doc_id % 4] AS selected FROM x),
n AS (SELECT *, len(list_intersect(required, selected)) AS tp, len(selected) - tp AS fp, len(required) - tp AS fn, (fp = 0 AND fn = 0)::INT::DOUBLE AS exact FROM cases)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, eight = F.col("doc_id"), F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    required = F.when(d % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.filter(eight, lambda c: (d * 31 + c * 17) % 7 < 2))
    order = F.array_sort(F.transform(F.filter(eight, lambda c: (d * 13 + c * 5) % 6 != 0), lambda c: ((d + 3) * (c + 2) * 7) % 11 * 8 + c))
    out = _t(spark, sf_dir, "documents").select(
        "doc_id", F.expr("doc_id div 13").alias("session"), (((d * 37) % 101) / 100.0).alias("confidence"), pick(TYPES, d % 8).alias("query_type"),
        pick(T.RELATIONS, d % 5).alias("expected"), pick(T.RELATIONS, (d * 3 + F.expr("doc_id div 7")) % 5).alias("predicted"), required.alias("required"),
        F.transform(order, lambda k: k % 8).alias("ranking"),
    )
    return out.withColumn("selected", F.slice("ranking", F.lit(1), (d % 4).cast("int")))


def _rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes))


_ROUND = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"""WITH {_CASES}, m AS (SELECT *, CASE WHEN len(selected) = 0 THEN (len(required) = 0)::INT ELSE tp / len(selected) END AS p,
  CASE WHEN len(required) = 0 THEN (len(selected) = 0)::INT ELSE tp / len(required) END AS r,
  coalesce(1 / list_min([i FOR i IN range(1, len(ranking) + 1) IF list_contains(required, ranking[i])]), 0) AS rr,
  CASE WHEN len(required) = 0 THEN (len(ranking) = 0)::INT ELSE coalesce(list_sum([1 / log2(i + 1) FOR i IN range(1, len(ranking) + 1) IF list_contains(required, ranking[i])]), 0)
    / list_sum([1 / log2(i + 1) FOR i IN range(1, len(required) + 1)]) END AS g,
  len([t FOR t IN [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[] IF confidence >= t]) AS bin FROM n),
e AS (SELECT sum(c * abs(ac - ae)) / sum(c) AS ece FROM (SELECT bin, count(*) AS c, avg(confidence) AS ac, avg(exact) AS ae FROM m GROUP BY bin)),
a AS (SELECT count(*) AS count, avg(exact) AS exact_set_accuracy, sum(tp) / sum(tp + fp) AS micro_precision, sum(tp) / sum(tp + fn) AS micro_recall, avg(p) AS macro_precision, avg(r) AS macro_recall,
  avg(rr) AS mrr, avg(g) AS ndcg, avg(r) FILTER (WHERE len(required) >= 2) AS cross_context_recall, avg((expected = predicted)::INT) AS relation_accuracy, avg((confidence - exact) ** 2) AS brier,
  1 - avg(exact) FILTER (WHERE confidence >= 0.8) AS high_confidence_error FROM m),
f AS (SELECT *, 2 * micro_precision * micro_recall / (micro_precision + micro_recall) AS micro_f1, 2 * macro_precision * macro_recall / (macro_precision + macro_recall) AS macro_f1 FROM a, e)
SELECT count, {_ROUND("exact_set_accuracy micro_precision micro_recall micro_f1 macro_precision macro_recall macro_f1 mrr ndcg cross_context_recall relation_accuracy brier ece high_confidence_error".split())} FROM f""")
def route_report(spark, sf_dir):
    return _rounded(metrics.route_report(_cases(spark, sf_dir)))


@query(f"""WITH {_CASES}, s AS (SELECT query_type, expected, len(required) AS req, len(ranking) AS cand, len(selected) AS sel, len(list_intersect(required, ranking)) AS ch, tp AS sh,
  len(list_intersect(list_intersect(required, ranking), selected)) AS shc, fp AS extra FROM n)
SELECT query_type, expected, count(*) AS cases, count_if(req > 0)::BIGINT AS cases_with_required, sum(req)::BIGINT AS required_contexts, sum(ch)::BIGINT AS candidate_hits, sum(sh)::BIGINT AS selection_hits,
  sum(req - ch)::BIGINT AS candidate_miss, sum(ch - shc)::BIGINT AS selection_loss, sum(extra)::BIGINT AS selection_extra, count_if(extra > 0)::BIGINT AS over_selected,
  round(avg(cand), 6) AS mean_candidates, round(avg(sel), 6) AS mean_selected, round(sum(ch) / nullif(sum(req), 0), 6) AS candidate_micro_recall, round(sum(sh) / nullif(sum(req), 0), 6) AS selection_micro_recall,
  round(sum(sh) / nullif(sum(sel), 0), 6) AS selection_micro_precision, round(sum(shc) / nullif(sum(ch), 0), 6) AS selection_given_candidate,
  round(count_if(req > 0 AND ch = req) / nullif(count_if(req > 0), 0), 6) AS candidate_complete, round(count_if(req > 0 AND sh = req) / nullif(count_if(req > 0), 0), 6) AS selection_complete
FROM s GROUP BY GROUPING SETS ((), (query_type), (expected))""")
def stage_counters(spark, sf_dir):
    return _rounded(metrics.stages(_cases(spark, sf_dir)))


@query(f"""WITH {_CASES}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold, unnest(range(1, 10))::INT AS tenth)
SELECT tenth, round(count_if(confidence >= threshold) / count(*), 6) AS coverage, round(coalesce(1 - avg(exact) FILTER (WHERE confidence >= threshold), 0), 6) AS risk FROM n, t GROUP BY tenth""")
def risk_by_threshold(spark, sf_dir):
    c = _cases(spark, sf_dir)
    n = metrics.set_counts(F.col("required"), F.col("selected"))
    return _rounded(metrics.risk_coverage(c.withColumn("y", ((n["fp"] == 0) & (n["fn"] == 0)).cast("int")), "confidence", "y"))


DRAWS = 200


@query(f"""WITH {_CASES}, v AS (SELECT session, avg(tp / greatest(len(required), 1)) - avg(exact) AS d FROM n GROUP BY session),
i AS (SELECT d, row_number() OVER (ORDER BY substr(md5(session::VARCHAR), 1, 2), session) - 1 AS i, count(*) OVER () AS n FROM v),
w AS (SELECT b, ('0x' || substr(md5('7:' || b || ':' || k), 1, 8))::BIGINT % n AS i FROM (SELECT unnest(range({DRAWS})) AS b), (SELECT i AS k, n FROM i)),
m AS (SELECT b, avg(d) AS m FROM w JOIN i USING (i) GROUP BY b), o AS (SELECT list_sort(list(m)) AS m FROM m)
SELECT round((SELECT avg(d) FROM v), 6) AS mean_delta, round(m[{int(0.025 * (DRAWS - 1)) + 1}], 6) AS ci_low, round(m[{-int(-0.975 * (DRAWS - 1) // 1) + 1}], 6) AS ci_high FROM o""")
def paired_bootstrap(spark, sf_dir):
    n = metrics.set_counts(F.col("required"), F.col("selected"))
    c = _cases(spark, sf_dir)
    exact = c.select("session", ((n["fp"] == 0) & (n["fn"] == 0)).cast("double").alias("v"))
    recall = c.select("session", (n["tp"] / F.greatest(F.size("required"), F.lit(1))).alias("v"))
    return _rounded(metrics.paired_bootstrap(exact, recall, "session", "v", DRAWS, 7))


# Answers and judging

_CUES = "(" + " OR ".join(f"contains(lower({{0}}), '{c}')" for c in T.REFUSAL_CUES) + ")"
#: Answers to documents: the text, with a refusal appended to some.
_ANSWERS = """ans AS (SELECT doc_id, ['hybrid_router', 'full_history', 'global_bm25'][doc_id % 3 + 1] AS arm, text || CASE WHEN doc_id % 5 = 1 THEN ' cannot determine' ELSE '' END AS answer,
  [['the', 'and 「of」'], ['le ouè', 'zz_zz'], ['说明上下文不足: declines'], []][doc_id % 4 + 1] AS requirements, """ + f"{list(TYPES)}" + """[doc_id % 8 + 1] AS query_type, doc_id % 6 = 0 AS must_abstain,
  CASE doc_id % 7 WHEN 0 THEN 'length' WHEN 1 THEN NULL ELSE 'end_turn' END AS stop_reason, doc_id % 100 AS memory_tokens, doc_id % 300 AS input_tokens, doc_id % 50 AS output_tokens,
  doc_id % 350 AS total_tokens, (doc_id % 40) / 8.0::DOUBLE AS latency_seconds FROM documents)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    lists = [["the", "and 「of」"], ["le ouè", "zz_zz"], ["说明上下文不足: declines"], []]
    requirements = F.get(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists)), (d % 4).cast("int"))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", pick(("hybrid_router", "full_history", "global_bm25"), d % 3).alias("arm"), F.concat("text", F.when(d % 5 == 1, " cannot determine").otherwise("")).alias("answer"),
        requirements.alias("requirements"), pick(TYPES, d % 8).alias("query_type"), (d % 6 == 0).alias("must_abstain"), F.when(d % 7 == 0, "length").when(d % 7 == 1, F.lit(None)).otherwise("end_turn").alias("stop_reason"),
        (d % 100).alias("memory_tokens"), (d % 300).alias("input_tokens"), (d % 50).alias("output_tokens"), (d % 350).alias("total_tokens"), ((d % 40) / 8.0).alias("latency_seconds"), F.lit("").alias("context"),
    )


_FORM = r"lower(regexp_replace({0}, '[*`\\\s\x{{A0}}\x{{3000}}]+', '', 'g'))"
_SCORED = f"""met AS (SELECT doc_id, r, CASE WHEN starts_with(r, '{T.REFUSAL_PREFIX}') THEN {_CUES.format('answer')} ELSE
    len(list_concat(list_filter(regexp_extract_all(r, '[A-Za-z_][A-Za-z0-9_.\\-]*'), lambda x: length(x) > 1), regexp_extract_all(r, '「([^」]+)」', 1))) > 0
    AND len(list_filter(list_concat(list_filter(regexp_extract_all(r, '[A-Za-z_][A-Za-z0-9_.\\-]*'), lambda x: length(x) > 1), regexp_extract_all(r, '「([^」]+)」', 1)),
      lambda x: NOT contains({_FORM.format('answer')}, {_FORM.format('x')}))) = 0 END AS ok
  FROM (SELECT *, unnest(requirements) AS r FROM ans)),
cov AS (SELECT doc_id, count_if(ok) / count(*) AS c FROM met GROUP BY doc_id),
rec AS (SELECT a.*, coalesce(c, 1)::DOUBLE AS coverage, {_CUES.format('answer')} AS refused, coalesce(stop_reason IN ('max_tokens', 'length', 'incomplete'), false) AS truncated,
  CASE WHEN query_type = 'unanswerable' AND {_CUES.format('answer')} THEN 0 ELSE coalesce(c, 1) END::DOUBLE AS strict_coverage FROM ans a LEFT JOIN cov USING (doc_id))"""


@query(f"WITH {_ANSWERS}, {_SCORED} SELECT doc_id, round(coverage, 6) AS coverage, round(strict_coverage, 6) AS strict_coverage, refused, truncated FROM rec")
def answer_records(spark, sf_dir):
    return _rounded(judging.answer_records(_answers(spark, sf_dir)).select("doc_id", "coverage", "strict_coverage", "refused", "truncated"))


_SUMMARY = f"""sm AS (SELECT arm, count(*) AS count, avg(coverage) AS mean_coverage, avg(strict_coverage) AS mean_strict_coverage, avg(refused::INT) AS refusal_rate,
  coalesce(avg(coverage) FILTER (WHERE NOT must_abstain AND NOT refused), 0) AS mean_attempted_coverage, coalesce(avg(coverage) FILTER (WHERE NOT must_abstain), 0) AS mean_answerable_coverage,
  coalesce(avg(coverage) FILTER (WHERE must_abstain), 0) AS unanswerable_refusal_score, avg(memory_tokens) AS mean_memory_tokens, avg(input_tokens) AS mean_input_tokens, avg(output_tokens) AS mean_output_tokens,
  avg(total_tokens) AS mean_total_tokens, avg(latency_seconds) AS mean_latency_seconds, avg(truncated::INT) AS truncated_rate, avg((trim(answer) = '')::INT) AS empty_answer_rate FROM rec GROUP BY arm)"""
_MEANS = "mean_coverage mean_strict_coverage refusal_rate mean_attempted_coverage mean_answerable_coverage unanswerable_refusal_score mean_memory_tokens mean_input_tokens mean_output_tokens mean_total_tokens mean_latency_seconds truncated_rate empty_answer_rate".split()


@query(f"WITH {_ANSWERS}, {_SCORED}, {_SUMMARY} SELECT arm, count, {_ROUND(_MEANS)} FROM sm")
def answer_summary(spark, sf_dir):
    return _rounded(judging.answer_summary(judging.answer_records(_answers(spark, sf_dir))))


@query(f"""WITH {_ANSWERS}, {_SCORED}, {_SUMMARY} SELECT arm, round(mean_coverage, 6) AS quality, round(mean_total_tokens, 6) AS tokens FROM sm a WHERE NOT EXISTS (
  SELECT 1 FROM sm b WHERE b.mean_total_tokens <= a.mean_total_tokens AND b.mean_coverage >= a.mean_coverage AND (b.mean_total_tokens < a.mean_total_tokens OR b.mean_coverage > a.mean_coverage))""")
def quality_token_frontier(spark, sf_dir):
    s = judging.answer_summary(judging.answer_records(_answers(spark, sf_dir))).select("arm", F.col("mean_coverage").alias("quality"), F.col("mean_total_tokens").alias("tokens"))
    return _rounded(metrics.pareto(s, "tokens", "quality"))


@query(f"""WITH {_ANSWERS}, s AS (SELECT doc_id, [x FOR x IN requirements IF NOT starts_with(x, '{T.REFUSAL_PREFIX}')] AS rs, answer FROM ans), {_SCORED}
SELECT s.doc_id, round(CASE WHEN len(rs) > 0 THEN coverage END, 6) AS reachable FROM s JOIN rec USING (doc_id)""")
def requirement_reachability(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.round(T.reachability(F.col("requirements"), F.col("answer")), 6).alias("reachable"))


# Pairs of answers to documents, judged four times: twice, in both orders
_CALLS = """pr AS (SELECT doc_id AS sample_id, ['bm25', 'dense', 'router'][doc_id % 3 + 1] AS arm_a, ['router', 'bm25', 'dense'][doc_id % 3 + 1] AS arm_b,
  CASE WHEN doc_id % 4 < 2 THEN 'it is unable to say' ELSE 'yes' END AS answer_a, CASE WHEN doc_id % 6 < 2 THEN 'no information' ELSE 'done' END AS answer_b, doc_id % 5 = 0 AS expects_refusal FROM documents),
cl AS (SELECT sample_id, k % 2 = 1 AS swapped, ['winner: a', 'so {"winner": "b"}', 'Verdict: TIE', 'unclear'][CASE WHEN k % 2 = 1 AND sample_id % 3 <> 0 THEN [1, 0, 2, 3][(sample_id + k // 2 * (sample_id % 2)) % 4 + 1] ELSE (sample_id + k // 2 * (sample_id % 2)) % 4 END + 1] AS reply FROM pr, (SELECT unnest(range(4)) AS k)),
vd AS (SELECT sample_id, CASE WHEN swapped THEN CASE v WHEN 'a' THEN 'b' WHEN 'b' THEN 'a' ELSE 'tie' END ELSE v END AS v
  FROM (SELECT *, CASE reply WHEN 'winner: a' THEN 'a' WHEN 'so {"winner": "b"}' THEN 'b' ELSE 'tie' END AS v FROM cl)),
ct AS (SELECT sample_id, count_if(v = 'a') AS na, count_if(v = 'b') AS nb, count_if(v = 'tie') AS nt, count(*) AS n FROM vd GROUP BY sample_id),
oc AS (SELECT pr.*, answer_a <> 'yes' AND answer_b <> 'done' AS gate, CASE WHEN gate THEN 'tie' WHEN 2 * na > n THEN 'a' WHEN 2 * nb > n THEN 'b' ELSE 'tie' END AS winner,
  CASE WHEN NOT gate THEN greatest(na, nb, nt) = n END AS agreement, CASE WHEN NOT gate THEN greatest(na, nb, nt) / n END AS consistency, CASE WHEN gate THEN 'refusal_gate' ELSE 'judge' END AS source
  FROM pr JOIN ct USING (sample_id))"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    pairs = _t(spark, sf_dir, "documents").select(
        d.alias("sample_id"), pick(("bm25", "dense", "router"), d % 3).alias("arm_a"), pick(("router", "bm25", "dense"), d % 3).alias("arm_b"),
        F.when(d % 4 < 2, "it is unable to say").otherwise("yes").alias("answer_a"), F.when(d % 6 < 2, "no information").otherwise("done").alias("answer_b"), (d % 5 == 0).alias("expects_refusal"),
    )
    k = F.col("k")
    s = F.col("sample_id")
    base = (s + F.floor(k / 2) * (s % 2)) % 4
    at = F.when((k % 2 == 1) & (s % 3 != 0), pick((1, 0, 2, 3), base)).otherwise(base)
    calls = pairs.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "sample_id", (k % 2 == 1).alias("swapped"), pick(("winner: a", 'so {"winner": "b"}', "Verdict: TIE", "unclear"), at).alias("reply")
    )
    return judging.outcomes(pairs, calls)


@query(f"WITH {_CALLS} SELECT sample_id, winner, agreement, round(consistency, 6) AS consistency, source FROM oc")
def pairwise_judging(spark, sf_dir):
    return _rounded(_outcomes(spark, sf_dir).select("sample_id", "winner", "agreement", "consistency", "source"))


@query(f"""WITH {_CALLS}, sd AS (SELECT arm_a AS arm, winner = 'a' AS won, winner = 'b' AS lost FROM oc UNION ALL SELECT arm_b, winner = 'b', winner = 'a' FROM oc)
SELECT arm, count_if(won)::BIGINT AS wins, count_if(lost)::BIGINT AS losses, count_if(NOT won AND NOT lost)::BIGINT AS ties, count(*) AS comparisons, round(count_if(won) / count(*), 6) AS win_rate,
  round((SELECT avg(agreement::INT) FROM oc), 6) AS order_agreement FROM sd GROUP BY arm""")
def win_tally(spark, sf_dir):
    return _rounded(judging.tally(_outcomes(spark, sf_dir)))


@query(f"""WITH {_CALLS}, kd AS (SELECT * FROM (VALUES ('checkpoint', 'answerable'), ('checkpoint', 'must_refuse'), ('response', 'neither_refuses'), ('response', 'one_refuses'), ('response', 'both_refuse')) v(stratum, name)),
st AS (SELECT 'checkpoint' AS stratum, CASE WHEN expects_refusal THEN 'must_refuse' ELSE 'answerable' END AS name, winner, agreement FROM oc UNION ALL
  SELECT 'response', ['neither_refuses', 'one_refuses', 'both_refuse'][(answer_a <> 'yes')::INT + (answer_b <> 'done')::INT + 1], winner, agreement FROM oc)
SELECT stratum, name, count(winner) AS pairs, count(agreement) AS judged_pairs, coalesce(count_if(agreement), 0)::BIGINT AS agreed, coalesce(count_if(NOT agreement), 0)::BIGINT AS disagreed, round(avg(agreement::INT), 6) AS order_agreement,
  count_if(winner = 'a')::BIGINT AS arm_a_wins, count_if(winner = 'b')::BIGINT AS arm_b_wins, count_if(winner = 'tie')::BIGINT AS ties FROM kd LEFT JOIN st USING (stratum, name) GROUP BY stratum, name""")
def judge_strata(spark, sf_dir):
    return _rounded(judging.strata(_outcomes(spark, sf_dir)))


@query(f"WITH {_CALLS} SELECT round(avg(consistency), 4) AS mean_consistency FROM oc")
def mean_consistency(spark, sf_dir):
    return judging.mean_consistency(_outcomes(spark, sf_dir))


#: Replies to judges with the verdict that is right, and replies to the ablation's question.
REPLIES = (
    ('{"winner": "a", "reason": "covers more"}', "a"), ('```json\n{"winner": "b", "reason": "x"}\n```', "b"), ('Here is my verdict: {"winner": "tie", "reason": "equivalent"}', "tie"), ("winner: a", "a"),
    ("Winner: B", "b"), ("  a  ", "a"), ("The better answer is B.", None), ("", None), ('{"winner": "a"} later verdict: b', "a"), ("winner: a then verdict: b", "a"), ("winner：a", "a"), ('"A".', "a"),
    ("winner = a", None), ("winner: a ... winner: b", "b"), ('{"winner": "none"} verdict: tie', "tie"), ('{"winner": "b", "reas', "b"), ("{'winner': 'a'}", "a"),
)
ANSWERABLE = (("YES", True), ("yes", True), ("NO", False), ("No.", False), ("NO, the file is missing", False), ("", None), ("maybe", None), ("\tYES", True), ("well\nno", False), ("x" * 50 + "\nNO", None))


def _values(rows: tuple, names: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join(f'({i}, {said(a)}, {said(b)})' for i, (a, b) in enumerate(rows))}) v({names})"


@query(f"SELECT i, want AS verdict FROM {_values(REPLIES, 'i, reply, want')}")
def verdict_vectors(spark, sf_dir):
    return spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string").select("i", T.verdict(F.col("reply")).alias("verdict"))


@query(f"SELECT i, want AS yes FROM {_values(ANSWERABLE, 'i, reply, want')}")
def yes_no_vectors(spark, sf_dir):
    return spark.createDataFrame([(i, r) for i, (r, _) in enumerate(ANSWERABLE)], "i int, reply string").select("i", T.yes_no(F.col("reply")).alias("yes"))


@query("""WITH m AS (SELECT conv_id AS sample_id, turn AS context_id, role || turn AS name, substr(text, 1, 40) AS material FROM conversations WHERE turn > 0),
q AS (SELECT conv_id AS sample_id, substr(text, 1, 40) AS query, '' AS recent FROM conversations WHERE turn = 0)
SELECT a.sample_id, a.context_id AS ablated, md5('[Recent conversation]' || chr(10) || '(none)' || coalesce(string_agg(chr(10) || chr(10) || '[Context: ' || b.name || ']' || chr(10) ||
  coalesce(nullif(b.material, ''), '(no material retrieved)'), '' ORDER BY b.context_id) FILTER (WHERE b.context_id <> a.context_id), '') || chr(10) || chr(10) || '[Question]' || chr(10) || any_value(query)) AS prompt_md5
FROM m a JOIN m b USING (sample_id) JOIN q USING (sample_id) GROUP BY a.sample_id, a.context_id""")
def ablation_prompts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("short", F.left("text", F.lit(40)))
    m = c.where("turn > 0").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("context_id"), F.concat("role", F.col("turn").cast("string")).alias("name"), F.col("short").alias("material"))
    q = c.where("turn = 0").select(F.col("conv_id").alias("sample_id"), F.col("short").alias("query"), F.lit("").alias("recent"))
    return judging.ablation_prompts(m, q).select("sample_id", "ablated", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("""WITH r AS (SELECT conv_id AS sample_id, turn AS ablated, ['YES', 'NO, it is not', 'hm'][(conv_id + turn * 2) % 3 + 1] AS reply, turn % 2 = 0 AS is_control FROM conversations)
SELECT sample_id, coalesce(string_agg(ablated::VARCHAR, ',' ORDER BY ablated) FILTER (WHERE reply LIKE 'NO%'), '') AS required,
  coalesce(string_agg(ablated::VARCHAR, ',' ORDER BY ablated) FILTER (WHERE reply LIKE 'NO%' AND is_control), '') AS control_failures, count_if(reply = 'hm')::BIGINT AS unreadable FROM r GROUP BY sample_id""")
def ablation_verdicts(spark, sf_dir):
    reply = F.get(F.array(*map(F.lit, ("YES", "NO, it is not", "hm"))), ((F.col("conv_id") + F.col("turn") * 2) % 3).cast("int"))
    r = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("ablated"), reply.alias("reply"), (F.col("turn") % 2 == 0).alias("is_control"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return judging.ablation_verdicts(r).select("sample_id", joined("required").alias("required"), joined("control_failures").alias("control_failures"), "unreadable")


# Redaction. RE2 has no look-behind: SQL takes the character before a match and puts it back.

_W = r"[\pL\pM\pN\p{Pc}.+-]"
_SQL_RULES = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "<private-key>"), (r"\bsk-[A-Za-z0-9_-]{16,}\b", "<secret>"), (r"\bAKIA[0-9A-Z]{16}\b", "<secret>"), (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "<secret>"),
    (_W + r"+@[\pL\pM\pN\p{Pc}-]+\." + r"[\pL\pM\pN\p{Pc}.-]+", "<email>"), (r"(^|[^0-9a-fA-F])1[3-9]\d{9}($|[^0-9a-fA-F])", r"\1<phone>\2"), (r"[A-Za-z]:\\Users\\[^\\\s\"'']+", "<home>"),
    (r"[A-Za-z]:\\+Users\\+[^\\\s\"'']+", "<home>"), (r"/(?:home|Users)/[^/\s\"'']+", "<home>"), (r"(^|[^A-Za-z0-9])[A-Za-z]--(?:Users|home)-[A-Za-z0-9._-]+", r"\1<home>"), (r"(^|[^A-Za-z0-9])[A-Za-z]:[\\/]", r"\1<abs>/"),
)


def _sql_scrub(text: str) -> str:
    for pattern, mark in _SQL_RULES:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


_TAIL = "' C:\\Users\\ann\\x.py /home/ann/y C--Users-ann-z 13912345678. d:/w https://a.b/c ' || 'sk-' || repeat('a1', 9)"


@query(f"SELECT doc_id, md5(s) AS clean_md5, s <> t AS changed FROM (SELECT doc_id, t, {_sql_scrub('t')} AS s FROM (SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN {_TAIL} ELSE '' END AS t FROM documents))")
def scrub_text(spark, sf_dir):
    tail = F.concat(F.lit(" C:\\Users\\ann\\x.py /home/ann/y C--Users-ann-z 13912345678. d:/w https://a.b/c "), F.lit("sk-" + "a1" * 9))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 10 == 0, tail).otherwise("")).alias("t"))
    clean = S.scrub(F.col("t"))
    return d.select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), (clean != F.col("t")).alias("changed"))


@query(f"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN {_TAIL} ELSE '' END AS t FROM documents),
f AS (SELECT doc_id, unnest(['email', 'phone', 'secret', 'aws-key', 'github-token', 'private-key', 'drive-path', 'unredacted-home']) AS label, unnest([
  regexp_extract(t, '{_W}+@[\\pL\\pM\\pN\\p{{Pc}}-]+\\.[\\pL\\pM\\pN\\p{{Pc}}.-]+'), regexp_extract(t, '(?:^|[^0-9a-fA-F])(1[3-9]\\d{{9}})(?:$|[^0-9a-fA-F])', 1), regexp_extract(t, '\\bsk-[A-Za-z0-9_-]{{16,}}\\b'),
  regexp_extract(t, '\\bAKIA[0-9A-Z]{{16}}\\b'), regexp_extract(t, '\\bgh[pousr]_[A-Za-z0-9]{{20,}}\\b'), regexp_extract(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
  regexp_extract(t, '(?:^|[^A-Za-z0-9])([A-Za-z]:[\\\\/])', 1), regexp_extract(t, '(?:^|[^A-Za-z0-9])([\\\\/](?:Users|home)[\\\\/][^\\\\/\\s"''<>]+)', 1)]) AS v FROM d)
SELECT doc_id, label, substr(v, 1, 2) || '…(' || length(v) || ' chars)' AS masked FROM f WHERE v <> ''""")
def leak_gate(spark, sf_dir):
    tail = F.concat(F.lit(" C:\\Users\\ann\\x.py /home/ann/y C--Users-ann-z 13912345678. d:/w https://a.b/c "), F.lit("sk-" + "a1" * 9))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 10 == 0, tail).otherwise("")).alias("t"))
    return S.leaks(d, "t").select("doc_id", "label", "masked")


@query("SELECT doc_id, regexp_matches(text, 'sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN .+ PRIVATE KEY-----') AS secret FROM documents")
def secret_detector(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", S.has_secret(F.col("text")).alias("secret"))
