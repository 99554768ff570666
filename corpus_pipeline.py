"""From documents to packed training sequences.

STAGES run in order; each gets all that the one before kept, as `docs`, and returns the
columns of documents, but the last, which returns the packed pieces. sf_dir names the
folder of the tables labels and benchmark.

1. toxicity: documents scored 0.5 or more go.
2. near-duplicates: of each group the document with the smallest id stays.
3. decontamination: documents that hold windows of two or more benchmark items go.
4. secrets: secrets are replaced by a mark in the text, and n_chars follows; no document goes.
5. packing: the texts become token pieces, placed in sequences of 2048.

Documents without an id are kept by stages 1 to 4, as no decision about them can be told
from another's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillweave.llm import decontamination, minhash, packing, secrets, toxicity
from quillweave.llm.common import shared_dir, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose id is in ids, a stored table that the planner knows the size of."""
    return docs.join(stored(ids.select("doc_id").distinct(), "out"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = ("_toxicity", "_toxicity_evidence", "_toxicity_similarity")  # docs may have a column score
    return toxicity.score(docs, table(spark, sf_dir, "labels"), names).where(f"{names[0]} < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat the id that stays are copies of it: one of them stays."""
    groups = minhash.near_duplicates(docs)
    kept = _without(docs, groups.where("component_id <> doc_id"))
    twice = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL"), "twice")
    if twice.isEmpty():
        return kept
    first = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return _without(kept, twice).union(first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.where("size(items) >= 2 AND doc_id IS NOT NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Toxicity scores and token ids are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/quillweave/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
