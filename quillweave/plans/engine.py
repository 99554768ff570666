"""Queries of the log's rules, routing, assembly, arms and window benchmarks.

The tables have no tasks, so routing and assembly run over generated sessions, SESSIONS of
them; the SQL of routing has the same rows as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arms, assembly, material, rank, routing, search, windows
from ..sources import generator, log
from ..sources.durable import dealt, stored
from .catalog import _COUNT, _sql_tokens, _t, query

SESSIONS = 2


def _synthetic(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: stored(v, k) for k, v in generator.tables(spark, SESSIONS).items()}


def _sql(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return f"[{', '.join(map(_sql, v))}]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) v({columns}))"


def _relation_sql(text: str) -> str:
    ahead, absent = "(?!尚未|还没|没有|未曾|未讨论|未提到)", "(这个|那个)(尚未|还没|没有|未曾|未讨论|未提到)"
    of = lambda p: f"regexp_replace({text}, '{absent}', '', 'g')" if ahead in p else text
    return "CASE " + " ".join(f"WHEN regexp_matches({of(p)}, '(?i){p.replace(ahead, '')}') THEN '{name}'" for name, p, _ in T.RELATION_CUES) + " ELSE 'unknown' END"


_MADE = [generator.session(i) for i in range(SESSIONS)]
_HASH = lambda keys, source: f"SELECT {keys}, h % 256 AS place, sum(CASE WHEN (h // 256) % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM (SELECT {keys}, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM {source}) GROUP BY ALL HAVING v <> 0"
_CANDIDATES = f"""WITH {_values('rq', 'request_id, session_id, query, as_of, primary_id, recent_ids', [(c[0], c[1], c[3], c[5], c[12], c[13]) for m in _MADE for c in m['checkpoints']])},
{_values('cx', 'session_id, context_id, name, goal, summary, entities, terms, last_active', [(c[0], c[1], c[2], c[3], c[4], c[5], c[6], c[8]) for m in _MADE for c in m['contexts']])},
doc AS (SELECT rq.*, context_id, entities, last_active, concat_ws(chr(10), name, goal, summary, array_to_string(entities, ' '), array_to_string(terms, ' ')) AS text, {_sql_tokens('query')} AS qt
  FROM rq JOIN cx ON rq.session_id = cx.session_id AND last_active <= as_of),
p0 AS (SELECT request_id, context_id, {_sql_tokens('text')} AS t FROM doc), p AS (SELECT request_id, context_id, len(t) AS dl, unnest(t) AS term FROM p0),
st AS (SELECT request_id, count(*) AS n, greatest(avg(len(t)), 1) AS mean FROM p0 GROUP BY 1), df AS (SELECT request_id, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT DISTINCT request_id, unnest({_sql_tokens('query')}) AS term FROM rq),
s AS (SELECT request_id, context_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {search.K1 + 1} / (1 + {search.K1} * ({1 - search.B} + {search.B} * dl / mean))) AS lexical
  FROM q JOIN p USING (request_id, term) JOIN df USING (request_id, term) JOIN st USING (request_id) GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(lexical, 9) DESC, context_id) AS lexical_rank FROM s WHERE lexical > 0 QUALIFY lexical_rank <= {routing.PER_CHANNEL}),
hd AS ({_HASH('request_id, context_id', 'p')}), hq AS ({_HASH('request_id', 'q')}),
nd AS (SELECT request_id, context_id, sqrt(sum(v * v)) AS n FROM hd GROUP BY ALL), nq AS (SELECT request_id, sqrt(sum(v * v)) AS n FROM hq GROUP BY ALL),
cs AS (SELECT a.request_id, a.context_id, greatest(sum(a.v / nd.n * (b.v / nq.n)), 0) AS dense FROM hd a JOIN hq b USING (request_id, place) JOIN nd ON nd.request_id = a.request_id AND nd.context_id = a.context_id
  JOIN nq ON nq.request_id = a.request_id GROUP BY ALL),
et AS (SELECT request_id, context_id, sum(CASE WHEN contains(lower(query), lower(e)) THEN 1.0 WHEN len(et) > 0 AND len(list_filter(et, lambda x: NOT list_contains(qt, x))) = 0 THEN 0.7 ELSE 0 END)::DOUBLE / greatest(any_value(len(entities)), 1) AS entity
  FROM (SELECT *, {_sql_tokens('e')} AS et FROM (SELECT *, unnest(entities) AS e FROM doc)) GROUP BY ALL),
a0 AS (SELECT doc.*, coalesce(dense, 0) AS dense, lexical, lexical_rank, coalesce(entity, 0) AS entity, {_relation_sql('query')} AS relation,
  row_number() OVER (PARTITION BY request_id ORDER BY round(coalesce(dense, 0), 9) DESC, context_id) AS dr, row_number() OVER (PARTITION BY request_id ORDER BY round(coalesce(entity, 0), 9) DESC, context_id) AS er,
  coalesce(context_id = primary_id, false)::INT AS prim, list_contains(recent_ids, context_id)::INT AS rec FROM doc LEFT JOIN lx USING (request_id, context_id) LEFT JOIN cs USING (request_id, context_id) LEFT JOIN et USING (request_id, context_id)),
a1 AS (SELECT *, CASE WHEN dense > 0 AND dr <= {routing.PER_CHANNEL} THEN dr END AS dense_rank, CASE WHEN entity > 0 AND er <= {routing.PER_CHANNEL} THEN er END AS entity_rank FROM a0),
a2 AS (SELECT *, coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + lexical_rank), 0) + coalesce(1 / (60 + entity_rank), 0) AS rrf, ((dense_rank IS NOT NULL)::INT + (lexical_rank IS NOT NULL)::INT + (entity_rank IS NOT NULL)::INT) / 3 AS agreement,
  coalesce(dense / nullif(max(dense) OVER w, 0), 0) AS fd, coalesce(entity / nullif(max(entity) OVER w, 0), 0) AS fe, coalesce(lexical / max(lexical) OVER w, 0) AS fl FROM a1 WINDOW w AS (PARTITION BY request_id)),
a3 AS (SELECT *, coalesce(rrf / nullif(max(rrf) OVER (PARTITION BY request_id), 0), 0) AS fr, row_number() OVER (PARTITION BY request_id ORDER BY round(rrf, 9) DESC, context_id) AS place FROM a2 WHERE agreement > 0 OR prim > 0 OR rec > 0),
c AS (SELECT *, 1 / (1 + exp(-({rank.INTERCEPT} + 1.45 * fr + 1.10 * fd + 1.05 * fl + 1.70 * fe + 0.55 * agreement + 0.35 * prim + 0.20 * rec + 0.15 * exp(-greatest(as_of - last_active, 0) / 20.0)
  + CASE WHEN relation = 'continue' AND prim > 0 THEN 1.0 WHEN relation = 'cross_context' AND prim + rec > 0 THEN 0.6 ELSE 0 END))) AS p FROM a3 WHERE place <= {routing.MAX_CANDIDATES})"""


def _seen(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    seen = arms.visible_contexts(t["checkpoints"], t["contexts"], t["events"]).withColumnRenamed("sample_id", "request_id")
    return t["checkpoints"].select(F.col("sample_id").alias("request_id"), "query", "primary_id", "recent_ids", "as_of"), seen


@query(_CANDIDATES + """ SELECT request_id, context_id, relation, dense_rank, lexical_rank, entity_rank, round(rrf, 6) AS rrf, round(p, 6) AS p,
  array_to_string(list_filter([CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END, CASE WHEN entity_rank IS NOT NULL THEN 'entity' END,
    CASE WHEN prim > 0 THEN 'primary' END, CASE WHEN rec > 0 THEN 'recent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def route_candidates(spark, sf_dir):
    c = routing.candidates(*_seen(_synthetic(spark)))
    return c.select("request_id", "context_id", "relation", "dense_rank", "lexical_rank", "entity_rank", F.round("rrf_score", 6).alias("rrf"), F.round("p", 6).alias("p"), F.array_join("reasons", ",").alias("reasons"))


@query(_CANDIDATES + """, o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(p, 9) DESC, context_id) AS k FROM c),
g AS (SELECT request_id, any_value(relation) AS relation, max(round(p, 9)) AS p1, coalesce(max(round(p, 9)) FILTER (WHERE k = 2), 0) AS p2, max(agreement) FILTER (WHERE k = 1) AS ag,
  coalesce(list(context_id ORDER BY k) FILTER (WHERE round(p, 9) >= 0.35), []) AS low, list(context_id ORDER BY k) AS every FROM o GROUP BY request_id),
f AS (SELECT *, least(greatest(0.5 * p1 + 0.2 * least((p1 - p2) / 0.35, 1) + 0.15 * ag + 0.15 * CASE WHEN relation = 'unknown' THEN 0.35 ELSE 1 END, 0), 1) AS conf,
  CASE WHEN p1 >= 0.72 AND p1 - p2 >= 0.16 AND relation IN ('continue', 'switch_or_return') THEN every[1:1]
    WHEN relation = 'cross_context' THEN list_concat(every[1:2], list_filter(low[1:3], lambda x: NOT list_contains(every[1:2], x)))[1:3] ELSE low[1:3] END AS chosen FROM g)
SELECT request_id, relation, CASE WHEN relation = 'new_context' AND p1 < 0.8 THEN 'new_context_candidate' WHEN len(chosen) = 0 OR conf < 0.52 THEN 'abstain' ELSE 'route' END AS decision,
  array_to_string(CASE WHEN relation = 'new_context' AND p1 < 0.8 THEN [] WHEN len(chosen) = 0 OR conf < 0.52 THEN every[1:3] ELSE chosen END, ',') AS selected,
  round(CASE WHEN relation = 'new_context' AND p1 < 0.8 THEN least(conf, 0.79) ELSE conf END, 6) AS confidence FROM f""")
def route_decisions(spark, sf_dir):
    d = routing.route(*_seen(_synthetic(spark)))
    return d.select("request_id", "relation", "decision", F.array_join("selected", ",").alias("selected"), F.round("confidence", 6).alias("confidence"))


def _arm(name: str):
    def run(spark, sf_dir):
        t = _synthetic(spark)
        built = arms.assemble_arm(name, t["checkpoints"], t["events"], t["contexts"], t["assignments"])
        return arms.score(name, built, t["checkpoints"], t["events"]).select("arm", "sample_id", "query_type", "memory_tokens", "total_input_tokens", "n_included", "evidence_recall", "reachability", "future_leakage")

    run.__name__ = f"arm_{name}"
    return run


_LOG = f"""{_values('ev', 'session_id, sequence, event_id, actor, kind, content', [e[:6] for m in _MADE for e in m['events']])},
{_values('cp', 'sample_id, session_id, query, query_type, as_of, requirements', [(c[0], c[1], c[3], c[4], c[5], c[9]) for m in _MADE for c in m['checkpoints']])},
es AS (SELECT * FROM (VALUES {', '.join(f"('{c[0]}', {_sql(s)})" for m in _MADE for c in m['checkpoints'] for s in c[7])}) v(sample_id, option))"""


def _arm_sql(name: str, near: str, section: str, keep: str) -> str:
    """Arms that show a run of events; all of them fit."""
    count = lambda x: _COUNT.replace("coalesce(text, '')", f"({x})")
    block = f"'[' || '{section}' || '][' || event_id || '][' || actor || '/' || kind || '] ' || content"
    form = lambda x: rf"lower(regexp_replace({x}, '[*`\\\s]+', '', 'g'))"
    return f"""WITH {_LOG}, b AS (SELECT sample_id, event_id, sequence, {block} AS text FROM cp JOIN ev ON cp.session_id = ev.session_id AND sequence {near} as_of
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY sequence DESC) <= {keep}),
m AS (SELECT sample_id, sum({count('text')})::BIGINT AS memory_tokens, list(event_id) AS included, string_agg(text, chr(10) || chr(10) ORDER BY sequence) AS rendered FROM b GROUP BY sample_id),
rc AS (SELECT sample_id, max((len(list_filter(option, lambda x: NOT list_contains(included, x))) = 0)::INT)::DOUBLE AS hit FROM es JOIN m USING (sample_id) GROUP BY sample_id),
rq AS (SELECT sample_id, r, len(list_filter(list_concat(list_filter(regexp_extract_all(r, '[A-Za-z_][A-Za-z0-9_.\\-]*'), lambda x: length(x) > 1), regexp_extract_all(r, '「([^」]+)」', 1)), lambda x: NOT contains({form('rendered')}, {form('x')}))) = 0 AS ok
  FROM (SELECT sample_id, rendered, unnest(requirements) AS r FROM cp JOIN m USING (sample_id)) WHERE NOT starts_with(r, '{T.REFUSAL_PREFIX}')),
rs AS (SELECT sample_id, count_if(ok) / count(*) AS reach FROM rq GROUP BY sample_id)
SELECT '{name}' AS arm, cp.sample_id, query_type, memory_tokens, memory_tokens + {count('query')} AS total_input_tokens, len(included)::INT AS n_included, coalesce(hit, 1)::DOUBLE AS evidence_recall, reach AS reachability, 0::BIGINT AS future_leakage
FROM cp JOIN m USING (sample_id) LEFT JOIN rc USING (sample_id) LEFT JOIN rs USING (sample_id)"""


for _name in arms.ARMS:
    _sqls = {
        "query_recent_only": lambda: _arm_sql("query_recent_only", "<", "Recent", str(assembly.RECENT_TURNS)), "sliding_window": lambda: _arm_sql("sliding_window", "<=", "Recent", str(arms.SLIDING)),
        "full_history": lambda: _arm_sql("full_history", "<=", "Evidence:None", "1000000"),
    }
    query(_sqls[_name]() if _name in _sqls else None)(_arm(_name))


@query()
def gate_one(spark, sf_dir):
    t, results = _synthetic(spark), None
    for name in ("full_history", "oracle_router"):
        r = arms.score(name, arms.assemble_arm(name, t["checkpoints"], t["events"], t["contexts"], t["assignments"]), t["checkpoints"], t["events"])
        results = r if results is None else results.union(r)
    return arms.gate_one(arms.summary(results))


@query(f"""WITH {_LOG}, n AS (SELECT sample_id, list(event_id) AS near FROM (SELECT sample_id, event_id FROM cp JOIN ev ON cp.session_id = ev.session_id AND sequence < as_of
    QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY sequence DESC) <= 3) GROUP BY 1),
h AS (SELECT sample_id, max(list_has_any(option, near)::INT) AS hit FROM es JOIN n USING (sample_id) GROUP BY 1), r AS (SELECT query_type, count(*) AS checkpoints, count(hit) AS labelled, coalesce(sum(hit), 0)::BIGINT AS reachable FROM cp LEFT JOIN h USING (sample_id) GROUP BY 1)
SELECT *, coalesce(reachable / nullif(labelled, 0), 0)::DOUBLE AS share, labelled > 0 AND reachable IN (0, labelled) AS definitional FROM r""")
def recency_reachability(spark, sf_dir):
    t = _synthetic(spark)
    return arms.recency_reachability(t["checkpoints"], t["events"])


@query(f"WITH {_LOG} SELECT session_id, count(*) AS events, count(DISTINCT event_id) AS ids, max(sequence) AS last, (SELECT count(*) FROM cp WHERE cp.session_id = ev.session_id) AS checkpoints FROM ev GROUP BY session_id")
def generated_sessions(spark, sf_dir):
    t = _synthetic(spark)
    c = t["checkpoints"].groupBy("session_id").agg(F.count("*").alias("checkpoints"))
    return t["events"].groupBy("session_id").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.max("sequence").alias("last")).join(c, "session_id")


_OBSERVED = """ob AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cross_context' ELSE 'continue' END AS relation, [x FOR x IN range(4) IF (doc_id + x) % 3 = 0] AS required,
  list_reverse(list_sort([{'p': ((doc_id * 7 + x * 29) % 97) / 96.0::DOUBLE, 'n': -x, 'id': x} FOR x IN range(4)])) AS ranked FROM documents)"""
_GRID = ", ".join(f"(SELECT unnest({list(v)}{'::DOUBLE[]' if k != 'maximum' else ''}) AS {k})" for k, v in routing.GRID.items())


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, four = F.col("doc_id"), F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    one = lambda x: F.struct((-(((d * 7 + x * 29) % 97) / 96.0)).alias("n"), x.alias("id"))
    ranked = F.transform(F.array_sort(F.transform(four, one)), lambda s: F.struct(s["id"].alias("id"), (-s["n"]).alias("p")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(d % 5 == 0, "cross_context").otherwise("continue").alias("relation"), F.filter(four, lambda x: (d + x) % 3 == 0).alias("required"), ranked.alias("ranked"))


@query(f"""WITH {_OBSERVED}, gr AS (SELECT * FROM {_GRID} WHERE t_high >= t_low), b AS (SELECT gr.*, required, ranked[1].p AS first,
  CASE WHEN ranked[1].p >= t_high AND ranked[1].p - ranked[2].p >= margin AND relation <> 'cross_context' THEN [ranked[1].id] ELSE [r.id FOR r IN ranked IF r.p >= t_low][1 : maximum] END AS c0,
  CASE WHEN relation = 'cross_context' THEN [r.id FOR r IN ranked][1 : least(2, maximum)] ELSE [] END AS forced FROM ob, gr),
c AS (SELECT *, list_distinct(list_concat(c0, forced)) AS ch, len(list_intersect(required, list_distinct(list_concat(c0, forced)))) AS hit FROM b),
r AS (SELECT *, CASE WHEN len(required) = 0 THEN (len(ch) = 0)::INT ELSE hit / len(required) END AS rec FROM c)
SELECT t_low, t_high, margin, maximum, sure, round(avg(rec), 6) AS recall, round(coalesce(avg((hit < len(required))::INT) FILTER (WHERE first >= sure), 0), 6) AS error,
  round(coalesce(avg(rec) FILTER (WHERE len(required) >= 2), 1), 6) AS "cross", round(avg(len(ch)), 6) AS selected FROM r GROUP BY ALL""")
def policy_grid(spark, sf_dir):
    g = routing.policy_grid(_observations(spark, sf_dir))
    return g.select(*routing.GRID, *(F.round(c, 6).alias(c) for c in ("recall", "error", "cross", "selected")))


@query()
def policy_tune(spark, sf_dir):
    return routing.tune(_observations(spark, sf_dir))


# The log's rules


@query("""WITH a AS (SELECT event_id, event_type AS source, user_id AS context_id, event_id % 3 AS version FROM events)
SELECT event_id, context_id, source, version, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM a JOIN events USING (event_id) WHERE user_id = 16""")
def assignments_in_order(spark, sf_dir):
    """Assignments with their events' places, in order, of one session (a user)."""
    e = _t(spark, sf_dir, "events")
    a = e.select("event_id", F.col("user_id").alias("context_id"), F.col("event_type").alias("source"), (F.col("event_id") % 3).alias("version"))
    from pyspark.sql import Window

    out = log.list_assignments(a, e.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("sequence")), 16)
    return out.select("event_id", "context_id", "source", "version", F.col("sequence").alias("ts"), F.row_number().over(Window.orderBy("sequence", "event_id")).cast("long").alias("place"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations UNION SELECT vec_id FROM embeddings)")
def referenced_events(spark, sf_dir):
    """What any of three id tables names."""
    ids = [_t(spark, sf_dir, t).select(c) for t, c in (("labels", "doc_id"), ("conversations", "conv_id"), ("embeddings", "vec_id"))]
    return log.referenced(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "lang"), *ids).withColumnRenamed("event_id", "doc_id")


# Windows

_SIZE = 64


@query(f"""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {_COUNT} AS n FROM conversations),
f AS (SELECT conv_id, i, n AS used, 0 AS w, n FROM s WHERE i = 1 UNION ALL
  SELECT s.conv_id, s.i, CASE WHEN used + s.n > {_SIZE} THEN s.n ELSE used + s.n END, CASE WHEN used + s.n > {_SIZE} THEN w + 1 ELSE w END, s.n FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
SELECT conv_id, w::INT AS "window", sum(n)::BIGINT AS tokens, count(*) AS sentences FROM f GROUP BY conv_id, w""")
def window_blocks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("number"), "text")
    w = windows.window_blocks(c, _SIZE)
    n = c.join(w.select("dialogue_id", "window", "first"), "dialogue_id").where("number >= first").groupBy("dialogue_id", "number").agg(F.max("window").alias("window"))
    n = n.groupBy("dialogue_id", "window").agg(F.count("*").alias("sentences"))
    return w.join(n, ["dialogue_id", "window"]).select(F.col("dialogue_id").alias("conv_id"), "window", "tokens", "sentences")


_FOUND = "r AS (SELECT doc_id, [x FOR x IN range(6) IF (doc_id + x * 5) % 4 = 0] AS gold, [(x * 5 + doc_id) % 6 FOR x IN range(6)] AS ranking FROM documents)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, six = F.col("doc_id"), F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.filter(six, lambda x: (d + x * 5) % 4 == 0).alias("gold"), F.transform(six, lambda x: (x * 5 + d) % 6).alias("ranking"))


@query(f"""WITH {_FOUND}, h AS (SELECT *, len(list_intersect(gold, ranking[1:3])) AS hit FROM r)
SELECT doc_id, (hit > 0)::INT::DOUBLE AS "any", (len(gold) > 0 AND hit = len(gold))::INT::DOUBLE AS "all", round(coalesce(hit / nullif(len(gold), 0), 0), 6) AS coverage FROM h""")
def set_retrieval(spark, sf_dir):
    r = _found(spark, sf_dir)
    return r.select("doc_id", *(F.round(v, 6).alias(k) for k, v in windows.retrieval(F.col("gold"), F.col("ranking"), 3).items()))


@query(f"""WITH {_FOUND}, c AS (SELECT len(gold) > 0 AND list_contains(gold, ranking[1]) AS solved, coalesce(len(list_intersect(gold, ranking[1:3])) / nullif(len(gold), 0), 0) AS recall FROM r)
SELECT count(*) AS questions, count_if(solved)::BIGINT AS solved, round(avg(recall) FILTER (WHERE solved), 6) AS recall_solved, round(avg(recall) FILTER (WHERE NOT solved), 6) AS recall_open, round(avg(recall), 6) AS recall_pooled FROM c""")
def difficulty_strata(spark, sf_dir):
    r = _found(spark, sf_dir)
    c = r.select(((F.size("gold") > 0) & F.array_contains("gold", F.col("ranking")[0])).alias("solved"), windows.retrieval(F.col("gold"), F.col("ranking"), 3)["coverage"].alias("recall"))
    return windows.difficulty_strata(c).select("questions", "solved", *(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in ("solved", "open", "pooled")))


@query(f"""WITH {_FOUND}, c AS (SELECT gold, ranking[1:4] AS candidates, ranking[1:2] AS selected FROM r), m AS (SELECT len(gold) > 0 AS has, len(list_intersect(gold, candidates)) = len(gold) AS ic, len(list_intersect(gold, selected)) = len(gold) AS sel FROM c)
SELECT count_if(has)::BIGINT AS questions, count_if(has AND sel)::BIGINT AS recovered, count_if(has AND NOT sel AND ic)::BIGINT AS selection_loss, count_if(has AND NOT sel AND NOT ic)::BIGINT AS candidate_miss, count_if(NOT has)::BIGINT AS no_evidence_window FROM m""")
def miss_decomposition(spark, sf_dir):
    return windows.miss_decomposition(_found(spark, sf_dir).select("gold", F.slice("ranking", 1, 4).alias("candidates"), F.slice("ranking", 1, 2).alias("selected")))


@query("""WITH s AS (SELECT o_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT 'price' AS "order", o_orderkey AS question_id, arg_max(l_discount > 0.04, (l_extendedprice, -l_linenumber))::INT AS hit FROM s GROUP BY 2 UNION ALL
  SELECT 'quantity', o_orderkey, arg_max(l_discount > 0.04, (l_quantity, -l_linenumber))::INT FROM s GROUP BY 2 UNION ALL SELECT 'oracle', o_orderkey, max((l_discount > 0.04)::INT) FROM s GROUP BY 2)
SELECT "order", count(*) AS questions, round(avg(hit), 6) AS recall FROM h GROUP BY 1""")
def ordering_report(spark, sf_dir):
    """An order's lines as candidates, those with a discount over 4 % being right, ordered by price and by quantity."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_quantity")
    lines, orders = dealt("l_orderkey", lines, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")))
    c = lines.join(orders, "l_orderkey")
    c = c.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("id"), (F.col("l_discount") > 0.04).alias("right"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return windows.ordering_report(windows.ordering_hits(c, {"price": True, "quantity": True})).select("order", "questions", F.round("recall", 6).alias("recall"))


@query("""WITH d AS (SELECT doc_id AS number, CASE WHEN doc_id % 3 = 0 THEN 'truth' ELSE 'noise' END AS kind, n_chars AS tokens, row_number() OVER (ORDER BY md5('5:' || CASE WHEN doc_id % 3 = 0 THEN 'truth' ELSE 'noise' END || ':' || doc_id), kind, doc_id) - 1 AS place FROM documents),
e AS (SELECT *, sum(tokens) OVER () AS total, sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS distance FROM d)
SELECT max(total)::BIGINT AS stream_tokens, (sum(tokens) FILTER (WHERE kind = 'truth'))::BIGINT AS truth_tokens, count_if(kind = 'truth')::BIGINT AS truth_blocks, median(distance) FILTER (WHERE kind = 'truth')::DOUBLE AS median_distance,
  round(count_if(kind = 'truth' AND distance <= 100000) / count_if(kind = 'truth'), 6) AS within_100000 FROM e""")
def arrangement_reachability(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 3 == 0, "truth").otherwise("noise").alias("kind"), F.col("n_chars").alias("tokens"))
    r = windows.arrangement_reachability(windows.arrange(d, "shuffled", 5), [100_000])
    return r.withColumn("within_100000", F.round("within_100000", 6))


@query()
def stratified_sample(spark, sf_dir):
    """Twenty documents, spread over languages and, within each, over ids."""
    return arms.stratified_sample(_t(spark, sf_dir, "documents").select("doc_id", "lang"), 20, "lang", "doc_id")


# Material of contexts


def _material_sql(scope: str) -> str:
    return f"""WITH e AS (SELECT conv_id AS sample_id, role AS context_id, turn AS sequence, conv_id || ':' || turn AS event_id, text AS content FROM conversations),
q AS (SELECT sample_id, unnest({_sql_tokens('content')}) AS term FROM e WHERE sequence = 0), dt AS (SELECT *, {_sql_tokens('content')} AS t FROM e),
st AS (SELECT {scope}, count(*) AS n, greatest(avg(len(t)), 1) AS mean FROM dt GROUP BY ALL), p AS (SELECT sample_id, context_id, event_id, len(t) AS dl, unnest(t) AS term FROM dt),
df AS (SELECT {scope}, term, count(*) AS df FROM p GROUP BY ALL),
sc AS (SELECT sample_id, context_id, event_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {search.K1 + 1} / (1 + {search.K1} * ({1 - search.B} + {search.B} * dl / mean))) AS score
  FROM p JOIN q USING (sample_id, term) JOIN df USING ({scope}, term) JOIN st USING ({scope}) GROUP BY ALL),
a AS (SELECT e.*, coalesce(score, 0) AS score FROM e LEFT JOIN sc USING (sample_id, context_id, event_id))"""


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("role").alias("context_id"), F.col("turn").alias("sequence"), F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("text").alias("content"))
    return e.where("sequence = 0").select("sample_id", F.col("content").alias("query")), e


@query(_material_sql("sample_id, context_id") + f""", r AS (SELECT *, max(score) OVER w > 0 AS found, row_number() OVER (PARTITION BY sample_id, context_id ORDER BY round(score, 9) DESC, event_id) AS best,
  row_number() OVER (PARTITION BY sample_id, context_id ORDER BY sequence DESC) AS last FROM a WINDOW w AS (PARTITION BY sample_id, context_id))
SELECT sample_id, context_id, md5(string_agg(substr(content, 1, 400), chr(10) ORDER BY sequence)) AS material_md5 FROM r WHERE CASE WHEN found THEN best <= {material.MATERIAL} AND score > 0 ELSE last <= {material.MATERIAL} END GROUP BY ALL""")
def context_material(spark, sf_dir):
    m = material.context_material(*_spoken(spark, sf_dir))
    return m.select("sample_id", "context_id", F.md5(F.col("material").cast("binary")).alias("material_md5"))


@query(_material_sql("sample_id") + """, b AS (SELECT sample_id, context_id, max(score) AS plausibility FROM a GROUP BY ALL)
SELECT sample_id, context_id, round(plausibility, 6) AS plausibility, plausibility = 0 OR row_number() OVER (PARTITION BY sample_id ORDER BY round(plausibility, 9), context_id) = 1 AS is_control FROM b""")
def weakest_control(spark, sf_dir):
    return material.plausibility(*_spoken(spark, sf_dir)).withColumn("plausibility", F.round("plausibility", 6))


@query("""WITH q AS (SELECT doc_id, ((doc_id * 7) % 5)::INT AS right_id FROM documents), u AS (SELECT doc_id AS question_id, x AS id, x = right_id AS gold FROM q, (SELECT unnest(range(5)) AS x))
SELECT question_id, id, gold FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY gold DESC, md5('3:' || question_id || ':' || id), id) AS p FROM u) WHERE p <= 2 OR gold""")
def corpus_sample(spark, sf_dir):
    u = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("id"))
    return material.corpus_sample(u.withColumn("gold", F.col("id") == (F.col("question_id") * 7) % 5), 2, 3)
