"""Tables that outlive executors, and the spreading of small files over cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes df to the folder that spark.checkpoint.dir names and reads it again, so that what is used
    several times is made once. Where that is unset, a local master (as in tests) gets a new local
    folder; a cluster is refused."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillweave-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/quillweave/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than there are; larger inputs stay as
    they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(key: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables by a key they share, over four partitions for each that the largest is read in and as many as shuffles
    have at least, so that what one task sorts keeps its size as inputs grow."""
    n = max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * max(t.rdd.getNumPartitions() for t in tables))
    return [t.repartition(n, key) for t in tables]
