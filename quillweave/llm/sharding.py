"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are ranked in a seeded shuffle within their source, sorted by fractional rank
(2 * rank - 1) / (2 * rows of the source), and cut into equal counts, so every prefix and
every shard holds each source in its share.

Both global ranks come from counts: rows are dealt to many small buckets by the shuffle
key (or the fractional rank), buckets are counted and summed up, and row_number runs
within a bucket. A source with a third of all rows spreads over all of its buckets, and
texts are read once, for their size and checksum, and never shuffled.

Defined cases: a null text has size 8 and the checksum of no bytes; a null source is a
stratum of its own; rows that repeat an id get consecutive places in any order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 24
SEED = "quillweave-1"
ROWS_PER_BUCKET = 500


def interleave(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, stratum: str = "source") -> DataFrame:
    """docs (doc_id, text, stratum) -> doc_id, stratum, size, text_crc32, shard, slot."""
    rows = stored(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("h"),
        ),
        "shardrows",
    )
    n = rows.count()
    digits = min(max(math.ceil(math.log(max(n / ROWS_PER_BUCKET, 2), 16)), 1), 4)
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))

    by_stratum = Window.partitionBy("stratum")
    before = (
        rows.groupBy("stratum", "bucket").agg(F.count("*").alias("c"))
        .withColumn("below", F.sum("c").over(by_stratum.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
        .withColumn("n_stratum", F.sum("c").over(by_stratum))
        .drop("c")
    )
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    rank = F.col("below") + F.row_number().over(within)
    parts = min(max(n // ROWS_PER_BUCKET, 1), 65_536)
    ranked = stored(
        rows.join(before, ["stratum", "bucket"])
        .withColumn("frac", ((2 * rank - 1).cast("double") / (2 * F.col("n_stratum")).cast("double")))
        .withColumn("part", F.floor(F.col("frac") * parts))
        .drop("bucket", "below", "n_stratum"),
        "shardrank",
    )
    # as many rows as there are parts (65,536 at most): one task sums them up
    starts = ranked.groupBy("part").agg(F.count("*").alias("c")).withColumn(
        "start", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ).drop("c")
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("frac", "stratum", "h", "doc_id", "text_crc32", "size")) - 1
    shard = F.expr(f"place * {n_shards} div {max(n, 1)}")
    return (
        ranked.join(starts, "part").withColumn("place", place).withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "stratum", "size", "text_crc32", "shard", "slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


# DuckDB has no crc32: the text's bytes are folded over the usual table.
ORACLE = f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS tab),
d AS (
  SELECT doc_id, coalesce('s' || source, '') AS stratum, coalesce(strlen(text), 0) + 8 AS size,
         md5('{SEED}:' || doc_id) AS h,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
           lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, t),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, stratum, h) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * {SHARDS} // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
       (place - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM s"""
