"""Idempotent streaming ingest of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events of a folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def ingest(events: DataFrame, target: str, checkpoint: str, key: str = "event_id") -> None:
    """Appends what is there now and ends. An event that the target holds, however old, is not added again and a
    late one is not lost: each batch is joined with the ids of the target. A batch that is tried again after a
    fault finds its own rows there."""

    def append(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        new.write.mode("append").parquet(target)

    events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
