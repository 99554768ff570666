"""Queries over the driver's tables, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, metrics, neighbours, rank, search
from ..sources import log
from ..sources.durable import spread

DEPTH = 5
AS_OF = 3
BUDGET = 200

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.conversation_events(_t(spark, sf_dir, "conversations"))


EVENTS = "e AS (SELECT conv_id || ':' || turn AS event_id, conv_id AS session_id, turn AS sequence, role AS actor, text AS content FROM conversations)"


# The log


@query(f"WITH {EVENTS} SELECT session_id, sequence, event_id, actor, md5(content) AS content_md5 FROM e WHERE sequence <= {AS_OF}")
def asof_scan(spark, sf_dir):
    return log.as_of(_events(spark, sf_dir), AS_OF).select("session_id", "sequence", "event_id", "actor", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"WITH {EVENTS} SELECT session_id, count(*) AS n_future, min(sequence) AS first_future FROM e WHERE sequence > {AS_OF} GROUP BY session_id")
def future_complement(spark, sf_dir):
    return log.future(_events(spark, sf_dir), AS_OF).groupBy("session_id").agg(F.count("*").alias("n_future"), F.min("sequence").alias("first_future"))


def _checkpoints(events: DataFrame) -> DataFrame:
    return events.where("actor = 'user'").select("session_id", F.col("sequence").alias("as_of"))


CHECKPOINTS = "c AS (SELECT session_id, sequence AS as_of FROM e WHERE actor = 'user')"


def _window_sql(n: int, op: str) -> str:
    return f"""WITH {EVENTS}, {CHECKPOINTS}
SELECT session_id, as_of, event_id, place FROM (
  SELECT e.session_id, as_of, event_id, row_number() OVER (PARTITION BY e.session_id, as_of ORDER BY sequence DESC, event_id) AS place
  FROM e JOIN c ON e.session_id = c.session_id AND e.sequence {op} c.as_of) WHERE place <= {n}"""


@query(_window_sql(6, "<"))
def recent_window(spark, sf_dir):
    e = _events(spark, sf_dir)
    return log.recent(e, _checkpoints(e), 6).select("session_id", "as_of", "event_id", "place")


@query(_window_sql(8, "<="))
def trailing_window(spark, sf_dir):
    e = _events(spark, sf_dir)
    return log.recent(e, _checkpoints(e), 8, inclusive=True).select("session_id", "as_of", "event_id", "place")


@query("SELECT user_id AS session_id, epoch_us(date_trunc('hour', ts)) // 3600000000 AS sequence, count(DISTINCT event_id) AS n FROM events GROUP BY ALL HAVING n > 1")
def duplicate_conflicts(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.expr("unix_micros(date_trunc('HOUR', ts)) div 3600000000").alias("sequence"))
    return log.conflicts(e)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'error') AND event_type <> 'click'")
def append_anti_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return log.append(e.where("event_type = 'click'"), e.where("event_type IN ('click', 'error')"))


@query("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_version(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    return log.latest(e.select("user_id", "event_type", "event_id", "value", "version"), ["user_id", "event_type"], "version").drop("version")


@query("""WITH c AS (SELECT user_id, max(event_id) AS version FROM events WHERE event_id % 2 = 0 GROUP BY 1),
u AS (SELECT user_id, max(event_id) AS version FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(c.user_id, u.user_id) AS user_id, CASE WHEN c.version IS NULL OR u.version >= c.version THEN u.version ELSE c.version END AS version,
       CASE WHEN c.version IS NULL OR u.version >= c.version THEN 'update' ELSE 'current' END AS origin
FROM c FULL JOIN u ON c.user_id = u.user_id""")
def context_upsert(spark, sf_dir):
    """Two versions of a table of users: the last even event against the last odd one."""
    e = _t(spark, sf_dir, "events")
    side = lambda k, name: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("event_id").alias("version")).withColumn("origin", F.lit(name))
    return log.upsert(side(0, "current"), side(1, "update"), "user_id", "version")


@query(f"""WITH {EVENTS} SELECT event_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) AS r FROM e) WHERE r > 3""")
def evidence_anti(spark, sf_dir):
    """What may be evidence: a session's events but the last three."""
    e = _events(spark, sf_dir)
    last = e.groupBy("session_id").agg(F.max("sequence").alias("as_of"))
    return e.join(log.recent(e, last, 3, inclusive=True).select("event_id"), "event_id", "left_anti").select("event_id", "session_id")


@query(f"""WITH {EVENTS} SELECT event_id, last_value(CASE WHEN actor = 'assistant' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e""")
def previous_active_asof(spark, sf_dir):
    return neighbours.previous_of(_events(spark, sf_dir), "assistant", "event_id", "previous").select("event_id", "previous")


@query(f"""WITH {EVENTS}, q AS (SELECT session_id, sequence, lead(sequence) OVER (PARTITION BY session_id ORDER BY sequence) AS until FROM e WHERE actor = 'user')
SELECT q.session_id, q.sequence, count(e.event_id) AS n_replies, md5(coalesce(string_agg(e.content, chr(10) ORDER BY e.sequence), '')) AS reply_md5
FROM q LEFT JOIN e ON e.session_id = q.session_id AND e.actor = 'assistant' AND e.sequence > q.sequence AND (q.until IS NULL OR e.sequence < q.until)
GROUP BY q.session_id, q.sequence""")
def next_reply_interval(spark, sf_dir):
    return neighbours.reply_after(_events(spark, sf_dir)).select("session_id", "sequence", "n_replies", F.md5(F.col("reply").cast("binary")).alias("reply_md5"))


@query(f"WITH {EVENTS} SELECT a.session_id, a.sequence AS anchor, b.sequence, b.event_id FROM e a JOIN e b ON a.session_id = b.session_id AND abs(a.sequence - b.sequence) = 1 WHERE a.actor = 'user'")
def neighbour_band(spark, sf_dir):
    e = _events(spark, sf_dir)
    return neighbours.adjacent(e.where("actor = 'user'"), e).select("session_id", "anchor", "sequence", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def parent_child_closure(spark, sf_dir):
    parents = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return neighbours.children(parents, _t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey").select("l_orderkey", "l_linenumber")


# Text

_ID = r"[A-Za-z_][A-Za-z0-9_./\\:-]*"
_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
_NUM = r"\d+(?:\.\d+)*"
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _sql_tokens(text: str) -> str:
    """Distinct tokens, in any order."""
    inner = r"list_filter(string_split_regex(lower(regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\s_./:\\-]+'), lambda x: x <> '')"
    pairs = "CASE WHEN length(p) > 1 THEN [substr(p, i, 2) FOR i IN range(1, length(p))] ELSE [p] END"
    parts = f"regexp_extract_all(coalesce({text}, ''), '{_ID}|[{_HAN}]+|{_NUM}')"
    return f"list_distinct(flatten([list_concat([lower(p)], CASE WHEN regexp_matches(p, '^[{_HAN}]') THEN {pairs} ELSE {inner} END) FOR p IN {parts}]))"


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents)")
def tokens(spark, sf_dir):
    d = spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[{_HAN}]|{_ID}|{_NUM}|[^{_SPACE}]')) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS head, length(text) AS n FROM documents")
def head_truncate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.head(F.col("text"), 80).alias("head"), F.length("text").cast("long").alias("n"))


@query(r"""SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (
  SELECT doc_id, list_concat(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.\-]*'), lambda x: length(x) > 1), regexp_extract_all(text, '「([^」]+)」', 1)) AS t FROM documents)""")
def requirement_terms(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", T.requirement_terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms_md5"))


@query(rf"SELECT doc_id, md5(lower(regexp_replace(text, '[*`\\{_SPACE}]+', '', 'g'))) AS form_md5 FROM documents")
def normalize_match(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.match_form(F.col("text")).cast("binary")).alias("form_md5"))


@query("SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{c}')" for c in T.REFUSAL_CUES) + " AS refusal FROM conversations")
def refusal_flags(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


def _sql_relation() -> str:
    ahead = "(?!尚未|还没|没有|未曾|未讨论|未提到)"
    cases = []
    for name, pattern, p in T.RELATION_CUES:
        cases.append((name, pattern.replace(ahead, ""), p, ahead in pattern))
    absent = "(这个|那个)(尚未|还没|没有|未曾|未讨论|未提到)"
    test = lambda pattern, cut: f"regexp_matches({f"regexp_replace(text, '{absent}', '', 'g')" if cut else 'text'}, '(?i){pattern}')"
    when = lambda k: " ".join(f"WHEN {test(c[1], c[3])} THEN {c[k]!r}" for c in cases)
    return f"SELECT conv_id, turn, CASE {when(0)} ELSE 'unknown' END AS relation, (CASE {when(2)} ELSE {T.UNKNOWN_CONFIDENCE} END)::DOUBLE AS confidence FROM conversations"


@query(_sql_relation())
def relation_classify(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.relation(F.col("text")).alias("relation"), T.relation_confidence(F.col("text")).alias("confidence"))


@query("""SELECT conv_id, turn, CASE WHEN upper(trim(text)) LIKE 'NO%' OR contains(substr(upper(trim(text)), 1, 40), chr(10) || 'NO') THEN false
  WHEN upper(trim(text)) LIKE 'YES%' OR contains(substr(upper(trim(text)), 1, 40), chr(10) || 'YES') THEN true END AS said_yes FROM conversations""")
def yes_no_parse(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.yes_no(F.col("text")).alias("said_yes"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("sha"))


@query("SELECT event_id, (list_sum([strpos('123456789abcdef', c) FOR c IN string_split(sha256(event_id::VARCHAR), '')]) % 5)::INT AS fold FROM events")
def hash_bucket_mod5(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", T.fold5(F.col("event_id")).alias("fold"))


# Search

_BM25 = f"""dt AS (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, greatest(sum(len(t)) / count(*), 1) AS avgdl FROM dt),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, unnest({_sql_tokens('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {search.K1 + 1} / (1 + {search.K1} * ({1 - search.B} + {search.B} * dl / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts against whole documents."""
    return search.bm25(_t(spark, sf_dir, "benchmark").select("item_id", "text"), _t(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


def _lexical(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.bm25_top(_t(spark, sf_dir, "benchmark").select("item_id", "text"), _t(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id", k)


@query(f"WITH {_BM25} SELECT item_id, count(*) AS n_docs, round(max(score), 6) AS best FROM s GROUP BY item_id")
def bm25_score(spark, sf_dir):
    return _bm25(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max("score"), 6).alias("best"))


@query(f"WITH {_BM25} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM lex WHERE rank <= {DEPTH}")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, DEPTH).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """The stated queries (vec_id divisible by 100) against all vectors."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lexical ranking, and one by length of the same documents (shortest first)."""
    lexical = _lexical(spark, sf_dir)
    sizes = lexical.join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    short = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")).cast("long"))
    return lexical, short


_SHORT = "short AS (SELECT item_id, lex.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, lex.doc_id) AS rank FROM lex JOIN documents d ON lex.doc_id = d.doc_id)"


def _sql_rrf(w: tuple[float, float]) -> str:
    return f"""WITH {_BM25}, {_SHORT}, u AS (SELECT item_id, doc_id, {w[0]} / (60 + rank) AS part FROM lex UNION ALL SELECT item_id, doc_id, {w[1]} / (60 + rank) FROM short)
SELECT item_id, doc_id, round(sum(part), 6) AS score FROM u GROUP BY item_id, doc_id"""


@query(_sql_rrf((1.0, 1.0)))
def rrf_two_channel(spark, sf_dir):
    a, b = _channels(spark, sf_dir)
    return search.rrf([(a, 1.0), (b, 1.0)], "item_id", "doc_id").withColumn("score", F.round("score", 6))


@query(_sql_rrf((1.0, 0.5)))
def rrf_weighted(spark, sf_dir):
    a, b = _channels(spark, sf_dir)
    return search.rrf([(a, 1.0), (b, 0.5)], "item_id", "doc_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 6) AS share FROM lex")
def max_normalise(spark, sf_dir):
    return _lexical(spark, sf_dir).select("item_id", "doc_id", F.round(search.share_of_best(F.col("score"), "item_id"), 6).alias("share"))


_PROB = """f AS (SELECT lex.item_id, lex.doc_id, score / max(score) OVER (PARTITION BY lex.item_id) AS lexical, lex.rank, short.rank AS srank
  FROM lex JOIN short ON lex.item_id = short.item_id AND lex.doc_id = short.doc_id),
r AS (SELECT *, 1 / (1 + exp(-(-2.7 + 1.45 * (1 / (60 + rank)) + 1.05 * lexical + 0.55 / 3 + 0.15 * exp(-(srank - 1) / 20)))) AS p FROM f)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, short = _channels(spark, sf_dir)
    d = lexical.withColumn("lexical", search.share_of_best(F.col("score"), "item_id")).join(short.select("item_id", "doc_id", F.col("rank").alias("srank")), ["item_id", "doc_id"])
    zero = F.lit(0.0)
    features = {
        "rrf": 1.0 / (search.RRF + F.col("rank")), "dense": zero, "lexical": F.col("lexical"), "entity": zero, "agreement": F.lit(1 / 3), "primary": zero, "recent": zero,
        "recency": rank.recency(F.col("srank"), F.lit(1)), "relation_match": zero,
    }
    return d.select("item_id", "doc_id", rank.probability(features).alias("p"))


@query(f"WITH {_BM25}, {_SHORT}, {_PROB} SELECT item_id, doc_id, round(p, 6) AS p FROM r")
def heuristic_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).withColumn("p", F.round("p", 6))


@query(f"""WITH {_BM25}, {_SHORT}, {_PROB},
o AS (SELECT item_id, doc_id, p, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, doc_id) AS k FROM (SELECT item_id, doc_id, round(p, 9) AS p FROM r)),
g AS (SELECT item_id, max(p) AS p1, coalesce(max(p) FILTER (WHERE k = 2), 0) AS p2,
  coalesce(list(doc_id ORDER BY k) FILTER (WHERE k <= 3 AND p >= 0.35), []) AS low, list(doc_id ORDER BY k) FILTER (WHERE k <= 3) AS safe FROM o GROUP BY item_id),
c AS (SELECT *, least(greatest(0.5 * p1 + 0.2 * least((p1 - p2) / 0.35, 1) + 0.15 / 3 + 0.15 * 0.35, 0), 1) AS confidence FROM g)
SELECT item_id, CASE WHEN len(low) = 0 OR confidence < 0.52 THEN 'abstain' ELSE 'route' END AS decision,
       array_to_string(CASE WHEN len(low) = 0 OR confidence < 0.52 THEN safe ELSE low END, ',') AS selected, round(confidence, 6) AS confidence FROM c""")
def soft_select(spark, sf_dir):
    c = _ranked(spark, sf_dir).select("item_id", "doc_id", F.round("p", 9).alias("p"), F.lit(1 / 3).alias("agreement"), F.lit("unknown").alias("relation"))
    return rank.select(c, "item_id", "doc_id").select("item_id", "decision", F.array_join(F.transform("selected", lambda x: x.cast("string")), ",").alias("selected"), F.round("confidence", 6).alias("confidence"))


# Packing


def _greedy(rows: str, group: str, order: str, cost: str, limit: int) -> str:
    return f"""WITH RECURSIVE b AS (SELECT {group}, {order} AS o, ({cost})::BIGINT AS c, row_number() OVER (PARTITION BY {group} ORDER BY {order}, {cost}) AS i FROM {rows}),
f AS (SELECT DISTINCT {group}, 0::BIGINT AS i, {limit}::BIGINT AS rest, ''::VARCHAR AS admitted, 0::BIGINT AS n FROM b UNION ALL
  SELECT f.{group}, b.i, CASE WHEN b.c <= rest THEN rest - b.c ELSE rest END,
         CASE WHEN b.c <= rest THEN CASE WHEN admitted = '' THEN b.o::VARCHAR ELSE admitted || ',' || b.o END ELSE admitted END, n + (b.c <= rest)::BIGINT
  FROM f JOIN b ON f.{group} = b.{group} AND b.i = f.i + 1)
SELECT {group}, i AS n_blocks, n AS n_admitted, {limit} - rest AS tokens, admitted FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY i DESC) AS last FROM f) WHERE last = 1"""


_COUNT = f"len(regexp_extract_all(coalesce(text, ''), '[{_HAN}]|{_ID}|{_NUM}|[^{_SPACE}]'))"


@query(_greedy("conversations", "conv_id", "turn", _COUNT, BUDGET))
def greedy_pack(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_count(F.col("text")).alias("cost"))
    return budget.pack(c, "conv_id", "turn", "cost", BUDGET)


@query(_greedy("lineitem", "l_orderkey", "l_linenumber", "l_quantity", 60))
def greedy_pack_orders(spark, sf_dir):
    return budget.pack(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 60)


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY k, first, turn) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations)""")
def round_robin_interleave(spark, sf_dir):
    own = Window.partitionBy("conv_id", "role")
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(own.orderBy("turn")).alias("k"), F.min("turn").over(own).alias("first"))
    return c.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("k", "first", "turn")).cast("long").alias("place"))


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM lex) WHERE score >= 0.5 * best")
def sufficiency_floor(spark, sf_dir):
    best = F.max("score").over(Window.partitionBy("item_id"))
    return _lexical(spark, sf_dir).withColumn("best", best).where("score >= 0.5 * best").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, turn, (sum(length(text) + 2) OVER w - length(text) - 2)::BIGINT AS start, (sum(length(text) + 2) OVER w - 2)::BIGINT AS "end"
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def render_spans(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("b"))
    s = c.withColumn("s", budget.spans(F.transform("b", lambda x: x["n"])))
    return s.select("conv_id", F.inline(F.arrays_zip("b", "s"))).select("conv_id", F.col("b.turn").alias("turn"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


# Evaluation

#: A document's required set is its label's flags; the chosen set its own by a simple rule.
_CASES = """k AS (SELECT d.doc_id, list_concat(CASE WHEN quality = 1 THEN ['quality'] ELSE [] END, CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS required,
  list_concat(CASE WHEN n_chars >= 500 THEN ['quality'] ELSE [] END, CASE WHEN n_chars < 100 THEN ['toxic'] ELSE [] END) AS chosen,
  least(n_chars, 2000) / 2000.0::DOUBLE AS p, coalesce(quality, 0) AS y, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    flags = lambda **k: F.filter(F.array(*(F.when(v, F.lit(n)) for n, v in k.items())), lambda x: x.isNotNull())
    return d.select(
        "doc_id", "lang", flags(quality=F.col("quality") == 1, toxic=F.col("toxic") == 1).alias("required"), flags(quality=F.col("n_chars") >= 500, toxic=F.col("n_chars") < 100).alias("chosen"),
        (F.least("n_chars", F.lit(2000)) / 2000.0).alias("p"), F.coalesce("quality", F.lit(0)).alias("y"),
    )


@query(f"""WITH {_CASES}, c AS (SELECT sum(len(list_intersect(required, chosen)))::BIGINT AS tp, sum(len(chosen) - len(list_intersect(required, chosen)))::BIGINT AS fp,
  sum(len(required) - len(list_intersect(required, chosen)))::BIGINT AS fn FROM k)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def route_prf(spark, sf_dir):
    out = metrics.micro(_cases(spark, sf_dir), "required", "chosen")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_CASES}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS ap, avg(y) AS ay FROM k GROUP BY 1)
SELECT round((SELECT avg((p - y) * (p - y)) FROM k), 6) AS brier, round(sum(n * abs(ap - ay)) / sum(n), 6) AS ece FROM b""")
def brier_ece(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.agg(F.round(metrics.brier(F.col("p"), F.col("y")), 6).alias("brier")).join(metrics.ece(c, "p", "y").select(F.round("ece", 6).alias("ece")))


@query(f"""WITH {_CASES}, t AS (SELECT unnest(range(1, 10))::INT AS tenth)
SELECT tenth, round(count_if(floor(p * 10) >= tenth) / count(*), 6) AS coverage, round(coalesce(count_if(floor(p * 10) >= tenth AND y = 0) / nullif(count_if(floor(p * 10) >= tenth), 0), 0), 6) AS risk
FROM k, t GROUP BY tenth""")
def risk_coverage(spark, sf_dir):
    return metrics.risk_coverage(_cases(spark, sf_dir), "p", "y").select("tenth", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(f"""WITH {_CASES} SELECT lang, y::INT AS y, count(*) AS cases, sum((list_sort(required) = list_sort(chosen))::INT)::BIGINT AS exact,
  sum(len(required) - len(list_intersect(required, chosen)))::BIGINT AS missed FROM k GROUP BY GROUPING SETS ((), (lang), (y))""")
def stage_diagnostics(spark, sf_dir):
    n = metrics.set_counts(F.col("required"), F.col("chosen"))
    c = _cases(spark, sf_dir).select("lang", "y", n["fn"].alias("fn"), ((n["fn"] == 0) & (n["fp"] == 0)).cast("long").alias("exact"))
    return c.groupingSets([[], ["lang"], ["y"]], "lang", "y").agg(F.count("*").alias("cases"), F.sum("exact").alias("exact"), F.sum("fn").alias("missed"))


@query(f"""WITH {_BM25}, g AS (SELECT item_id, min(rank) AS r FROM lex JOIN documents d ON lex.doc_id = d.doc_id JOIN benchmark b USING (item_id) WHERE contains(d.text, b.text) GROUP BY item_id)
SELECT b.item_id, round(coalesce(1 / r, 0), 6) AS rr, coalesce(r <= 1, false) AS hit1, coalesce(r <= {DEPTH}, false) AS hit5 FROM benchmark b LEFT JOIN g ON b.item_id = g.item_id""")
def reciprocal_ranks(spark, sf_dir):
    """Whether the ranking finds a document that holds the whole benchmark text."""
    b = _t(spark, sf_dir, "benchmark")
    found = _lexical(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").join(b, "item_id")
    best = found.where(F.contains("body", "text")).groupBy("item_id").agg(F.min("rank").alias("r"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return b.join(best, "item_id", "left").select("item_id", F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 6).alias("rr"), no(F.col("r") <= 1).alias("hit1"), no(F.col("r") <= DEPTH).alias("hit5"))


@query("""WITH p AS (SELECT s_nationkey AS arm, count(*) AS cost, round(max(s_acctbal), 2) AS gain FROM supplier GROUP BY 1)
SELECT arm, cost, gain FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain))""")
def pareto_frontier(spark, sf_dir):
    p = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("arm")).agg(F.count("*").alias("cost"), F.round(F.max("s_acctbal"), 2).alias("gain"))
    return metrics.pareto(p, "cost", "gain")


@query("""WITH a AS (SELECT role AS arm, len(string_split(text, ' ')) AS n FROM conversations)
SELECT arm, count(*) AS cases, round(avg(n), 6) AS mean_tokens, median(n)::DOUBLE AS median_tokens, max(n) AS max_tokens FROM a GROUP BY arm""")
def arm_summary(spark, sf_dir):
    a = _t(spark, sf_dir, "conversations").select(F.col("role").alias("arm"), F.size(F.split("text", " ")).cast("long").alias("n"))
    return a.groupBy("arm").agg(F.count("*").alias("cases"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.median("n").alias("median_tokens"), F.max("n").alias("max_tokens"))
