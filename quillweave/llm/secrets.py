"""Secret scans: named patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame operations only. Texts without a match of a pattern cost one scan; in the others
each pattern cuts the text into (gap, match) pieces, whose running lengths give offsets in
code points. The entropy of a window of WINDOW characters is kept by incremental counts: a
step adds the character that enters, drops the one that leaves and corrects the sum of
c * log2(c), in whole millionths, so results are exact and alike on every engine.

A candidate is a maximal run of 20 or more base64 characters. A run of hexadecimal digits
alone, of either case, belongs to the hex class, any other to the base64 class; each class
has its threshold. A span reaches from the start of its first to the end of its last window
above the threshold. The allow list suppresses UUIDs, runs without a digit or without a
letter, and runs that hold a listed well-known string.

Defined cases: a null or empty text has no spans, and the digest of no bytes; repeated rows
are scanned one by one; an empty table gives no rows. redact() keeps all other columns;
scan() too, but for columns named as those that it adds (ADDED), which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # maximal runs, so the same as a run of 18 or more
HEX = r"[0-9a-f]{16,}"
HEX_RUN = "^[0-9A-Fa-f]+$"
ADDED = ("base", "added", "n_assign", "n_access", "n_hex")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
XLOG = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 2)]
#: Entropy in bits a character; windows at or above it count.
THRESHOLD = {"hex": 3.0, "base64": 3.8}
ALLOWED = ("0123456789", "abcdefghij", "ABCDEFGHIJ", "EXAMPLE", "example")
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
BLOCK = 256


def most(kind: str) -> int:
    """The largest sum of c * log2(c), in millionths, of a window that counts."""
    return math.floor((math.log2(WINDOW) - THRESHOLD[kind]) * WINDOW * 1e6)


def _pieces(text: Column, pattern: str, want: int | None = None) -> Column:
    """Arrays gap, match and (if wanted) group of the leftmost matches, and of the tail."""
    cut = rf"(?s)(.*?)(?:({pattern})|\z)"
    parts = [F.regexp_extract_all(text, F.lit(cut), F.lit(1)), F.regexp_extract_all(text, F.lit(cut), F.lit(2))]
    parts.append(F.regexp_extract_all(text, F.lit(cut), F.lit(2 + want)) if want else parts[1])
    return F.arrays_zip(*(p.alias(a) for p, a in zip(parts, ("gap", "match", "inner"), strict=True)))


def _with_pieces(df: DataFrame, text: str, name: str, pattern: str, want: int | None = None) -> DataFrame:
    hit = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    kind = "array<struct<gap:string,match:string,inner:string>>"
    return df.withColumn(name, F.when(hit, _pieces(F.col(text), pattern, want).cast(kind)).otherwise(F.array().cast(kind)))


def _spans(pieces: str, kind: str, order: int, least: int) -> Column:
    """Structs (start, kind's order, kind, end, match) of the matches whose group has least characters.

    Offsets are sums over blocks of BLOCK pieces and then within one, so a text with k
    matches takes about k * (BLOCK + k / BLOCK) steps.
    """
    size = lambda x: F.length(x["gap"]) + F.length(x["match"])
    add = lambda a, x: a + size(x)
    p = F.col(pieces)
    n_blocks = F.greatest(F.ceil(F.size(p) / BLOCK), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.aggregate(F.slice(p, b * BLOCK + 1, BLOCK), F.lit(0), add))

    def place(x: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        below = F.aggregate(F.slice(blocks_col, F.lit(1), b), F.lit(0), lambda a, y: a + y)
        start = below + F.aggregate(F.slice(p, b * BLOCK + 1, i - b * BLOCK), F.lit(0), add) + F.length(x["gap"])
        return F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"), F.length(x["inner"]).alias("inner"))

    blocks_col = blocks
    return F.filter(F.transform(p, place), lambda s: (F.length(s["match"]) > 0) & (s["inner"] >= least))


def _entropy_window(run: Column) -> Column:
    """Struct (first, last): where the first and the last window above the threshold start
    in the run, or -1."""
    is_hex = run.rlike(HEX_RUN)
    limit = F.when(is_hex, F.lit(most("hex"))).otherwise(F.lit(most("base64")))
    xlog = F.array(*map(F.lit, XLOG))
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(run, i + 1, F.lit(1)))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(a: Column, i: Column) -> Column:
        come, go = at(i), F.when(i >= WINDOW, at(i - WINDOW)).otherwise(F.lit(0))
        c_in = F.element_at(a["counts"], come)
        c_out = F.when(go > 0, F.element_at(a["counts"], F.greatest(go, F.lit(1)))).otherwise(F.lit(0))
        log = lambda c: F.element_at(xlog, c + 1)
        s = F.when(come == go, a["s"]).otherwise(
            a["s"] + log(c_in + 1) - log(c_in) + F.when(go > 0, log(F.greatest(c_out - 1, F.lit(0))) - log(c_out)).otherwise(F.lit(0))
        )
        counts = F.transform(a["counts"], lambda c, j: c + (j + 1 == come).cast("int") - (j + 1 == go).cast("int"))
        high = (i >= WINDOW - 1) & (s <= limit)
        start = i - (WINDOW - 1)
        return F.struct(
            counts.alias("counts"), s.alias("s"), F.when(high & (a["first"] < 0), start).otherwise(a["first"]).alias("first"),
            F.when(high, start).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), zero, step, lambda a: F.struct(a["first"], a["last"]))


def _suspect(run: Column) -> Column:
    """Not on the allow list."""
    out = run.rlike("[0-9]") & run.rlike("[A-Za-z]") & ~run.rlike(UUID)
    for x in ALLOWED:
        out = out & ~F.contains(run, F.lit(x))
    return out


def _free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and added, arrays of structs (start, ord, kind, end), and counts of the base kinds."""
    df = docs.drop(*ADDED)
    assign, access, hexa, run = (_free(df, f"_{k}") for k in ("assign", "access", "hex", "run"))
    for name, pattern, want in ((assign, ASSIGN, 2), (access, ACCESS, None), (hexa, HEX, None), (run, RUN, None)):
        df = _with_pieces(df, text, name, pattern, want)
    df = df.withColumn(assign, _spans(assign, "assign", 0, 12)).withColumn(access, _spans(access, "access", 1, 18)).withColumn(hexa, _spans(hexa, "hex", 2, 16))
    df = df.withColumn(run, F.filter(_spans(run, "entropy", 3, WINDOW), lambda s: _suspect(s["match"])))
    df = df.withColumn(run, F.transform(run, lambda s: F.struct(s["start"].alias("start"), _entropy_window(s["match"]).alias("w"))))
    keep = lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.concat(assign, access, hexa), keep))
    added = F.transform(
        F.filter(run, lambda r: r["w"]["first"] >= 0),
        lambda r: F.struct(
            (r["start"] + r["w"]["first"]).alias("start"), F.lit(3).alias("ord"), F.lit("entropy").alias("kind"),
            (r["start"] + r["w"]["last"] + WINDOW).alias("end"),
        ),
    )
    n = [F.size(k).cast("long") for k in (assign, access, hexa)]
    return df.withColumns(dict(zip(ADDED, (base, added, *n), strict=True))).drop(assign, access, hexa, run)


def _marker(pattern: str, least: int, mark: str) -> Callable[[Column], Column]:
    def piece(x: Column) -> Column:
        bad = F.length(x["inner"]) >= least
        if pattern == RUN:
            bad = bad & _suspect(x["match"]) & (_entropy_window(x["match"])["first"] >= 0)
        return F.concat(x["gap"], F.when(bad, F.lit(mark)).otherwise(x["match"]))

    return piece


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces the secrets of scan() in the text, kind by kind; other texts stay as they are."""
    df, p = docs, _free(docs, "_p")
    for pattern, want, least in ((ASSIGN, 2, 12), (ACCESS, None, 18), (HEX, None, 16), (RUN, None, WINDOW)):
        df = _with_pieces(df, text, p, pattern, want)
        joined = F.array_join(F.transform(p, _marker(pattern, least, mark)), "")
        df = df.withColumn(text, F.when(F.size(p) > 0, joined).otherwise(F.col(text))).drop(p)
    return df


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _said(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )


def _sql_pieces(name: str, pattern: str, kind: str, order: int, least: int, want: int = 2) -> str:
    cut = rf"(?s)(.*?)(?:({pattern})|\z)".replace("'", "''")
    return f"""
{name} AS (
  SELECT doc_id, start, {order} AS ord, '{kind}' AS kind, start + length(m) AS "end", m FROM (
    SELECT doc_id, m, inn, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS start FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '{cut}', 1)) AS g, unnest(regexp_extract_all(text, '{cut}', 2)) AS m,
             unnest(regexp_extract_all(text, '{cut}', {want})) AS inn, generate_subscripts(regexp_extract_all(text, '{cut}', 1), 1) AS i
      FROM documents))
  WHERE length(m) > 0 AND length(inn) >= {least})"""


ORACLE = (
    "WITH " + ",".join([
        _sql_pieces("a", ASSIGN, "assign", 0, 12, 4), _sql_pieces("k", ACCESS, "access", 1, 18), _sql_pieces("h", HEX, "hex", 2, 16),
        _sql_pieces("r", RUN, "entropy", 3, WINDOW),
    ])
    + f""",
c AS (
  SELECT * FROM r WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{UUID}')
    AND NOT ({' OR '.join(f"contains(m, '{x}')" for x in ALLOWED)})),
w AS (
  SELECT doc_id, start, CASE WHEN regexp_matches(m, '{HEX_RUN}') THEN {most('hex')} ELSE {most('base64')} END AS top,
         unnest(range(length(m) - {WINDOW} + 1)) AS i, m FROM c),
v AS (
  SELECT *, list_sum([({XLOG})[length(x) - length(replace(x, ch, '')) + 1]
                      FOR ch IN list_distinct(string_split(x, ''))]) AS s
  FROM (SELECT *, substr(m, i + 1, {WINDOW}) AS x FROM w)),
e AS (
  SELECT doc_id, start + min(i) AS start, 3 AS ord, 'entropy' AS kind, start + max(i) + {WINDOW} AS "end"
  FROM v WHERE s <= top GROUP BY doc_id, start),
u AS (
  SELECT doc_id, start, ord, kind, "end" FROM a UNION ALL SELECT doc_id, start, ord, kind, "end" FROM k
  UNION ALL SELECT doc_id, start, ord, kind, "end" FROM h UNION ALL SELECT * FROM e),
g AS (
  SELECT doc_id, count_if(ord = 0) AS na, count_if(ord = 1) AS nk, count_if(ord = 2) AS nh, count_if(ord = 3) AS ne,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS spans
  FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nk, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ne, 0)::BIGINT AS n_entropy
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""
)
