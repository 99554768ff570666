"""Reading of tables, durable intermediate tables and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where
    that is unset, a local master (as in tests) gets a new local folder; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored_at(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillweave/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, kind: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives the loss of
    executors, and gives the planner a true size to choose join strategies by."""
    return stored_at(df, kind)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Hands the memory that was freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(f):
    """f over Arrow batches, which at its end hands the memory it freed back to the system, so
    that idle workers of earlier stages don't add up."""

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        trim()

    return run


def let_go(sent: Broadcast) -> None:
    """At a task's end, drops the worker's copy of what was sent, which an idle worker would hold
    on to; the next task loads it again."""
    sent.__dict__.pop("_value", None)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that its texts become Python strings a few at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


#: Bits of the filter that keeps rows out of a shuffle; a full one only lets more rows pass.
FILTER_BITS = 1 << 26
_BITMAP_BITS = 32_768  # of one bitmap of bitmap_construct_agg


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key (a column of both) isn't in wanted: a semi-join by
    a bitmap of FILTER_BITS at most, so the exact join that follows shuffles less."""
    bits = wanted.select((slot(F.col(key)) + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b"))
    full = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # FILTER_BITS / 32,768 rows at most
        at = (r["k"] - 1) * (_BITMAP_BITS // 8)
        full[at : at + _BITMAP_BITS // 8] = np.frombuffer(r["b"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(full)

    @frugal
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.num_columns - 1).to_numpy()
            yield b.select(range(b.num_columns - 1)).filter(pa.array((sent.value[s >> 3] >> (s & 7)) & 1 == 1))

    return rows.withColumn("_slot", slot(F.col(key))).mapInArrow(keep, rows.schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b): long node ids -> (node, component): the smallest id reachable.

    Large-star and small-star in turn (Kiveris et al., 2014): each round is a partial
    aggregation and one equi-join, so a hub's edges are pre-aggregated and its join can be
    split; the number of rounds grows with the logarithm of a component's size. Edges stay
    in tables; the driver sees one count of changed edges a round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = stored_at(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u joins u's smallest neighbour (or u itself)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours join the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt, written = stored_at(small.where("u <> v").distinct(), "edges")
        after = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e.sparkSession, path)
        e, path = nxt, written
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def ranked(df: DataFrame, group: str, key: list[str], order: list[str], name: str, n: int, per_bucket: int = 500) -> DataFrame:
    """Adds name: the row's place from 0 among those of its group, ordered by (hash bucket of
    key, order). df should be stored, as it is read twice; n: about how many rows it has.

    A group of any size is dealt over up to 65,536 buckets, which are counted and summed up,
    so no task ranks more than a bucket.
    """
    from pyspark.sql import Window

    buckets = min(max(n // per_bucket, 1), 65_536)
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    below = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_c")).withColumn(
        "_below", F.sum("_c").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    ).drop("_c")
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    return rows.join(below, [group, "_bucket"]).withColumn(name, F.col("_below") + F.row_number().over(within) - 1).drop("_below", "_bucket")
