"""Every query of the catalogue against DuckDB, and hand-made cases of the operators."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from quillweave.functions import text as T
from quillweave.operators import budget, metrics, rank, search
from quillweave.plans import catalog
from quillweave.sources import log
from quillweave.streaming import ingest


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if catalog.QUERIES[n].__module__ == catalog.__name__))
def test_query_matches_duckdb(name, spark, sf, matches):
    matches(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_keep_order_and_split(spark):
    assert _one(spark, T.tokens(F.lit("getUserName foo/bar_baz 3.14 foo/bar_baz"))) == ["getusername", "get", "user", "name", "foo/bar_baz", "foo", "bar", "baz", "3.14", "3", "14"]
    assert _one(spark, T.tokens(F.lit("部署密钥 字"))) == ["部署密钥", "部署", "署密", "密钥", "字"]
    assert _one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_token_count(spark):
    assert _one(spark, T.token_count(F.lit("a_b, 中文 1.5!"))) == 6
    assert _one(spark, T.token_count(F.lit(""))) == 0


@pytest.mark.parametrize(("query", "want"), [
    ("switch to the billing task", "switch_or_return"), ("go back", "switch_or_return"), ("start a new thing", "new_context"), ("continue", "continue"),
    ("那个尚未讨论的", "unknown"), ("reuse this and continue", "cross_context"), ("hello", "unknown"),
])
def test_relation(spark, query, want):
    assert _one(spark, T.relation(F.lit(query))) == want
    assert abs(sum(_one(spark, T.relation_probabilities(F.lit(query))).values()) - 1) < 1e-9


def test_requirement_satisfied(spark):
    assert _one(spark, T.satisfied(F.lit("uses spark_sql and 「merge join」"), F.lit("It USES  spark_sql `and` Mergejoin")))
    assert not _one(spark, T.satisfied(F.lit("。"), F.lit("anything")))


def test_append_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "event_id string, v int")
    more = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "event_id string, v int")
    assert [tuple(r) for r in log.append(rows, more).collect()] == [("c", 3)]
    old = spark.createDataFrame([("x", 2, "old"), ("y", 5, "old")], "k string, version int, t string")
    new = spark.createDataFrame([("x", 2, "new"), ("y", 4, "new"), ("z", 1, "new")], "k string, version int, t string")
    assert sorted(tuple(r) for r in log.upsert(old, new, "k", "version").collect()) == [("x", 2, "new"), ("y", 5, "old"), ("z", 1, "new")]


def test_jsonl_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, "x\n y"), ("b", 2, None)], "event_id string, sequence long, content string")
    log.write_jsonl(e, "event", f"{tmp_path}/log")
    log.write_jsonl(spark.range(2), "context", f"{tmp_path}/log")
    assert sorted(log.read_jsonl(spark, f"{tmp_path}/log", "event", "event_id string, sequence long, content string").collect()) == sorted(e.collect())


def test_greedy_skips_and_goes_on(spark):
    cases = [list(c) for c in itertools.product([1, 3, 5], repeat=4)]
    got = spark.createDataFrame([(c,) for c in cases], "c array<int>").select("c", budget.admit(F.col("c"), 6).alias("t")).collect()
    for r in got:
        left, want = 6, []
        for i, c in enumerate(r["c"]):
            if c <= left:
                left -= c
                want.append(i)
        assert r["t"] == want


def test_selection_branches(spark):
    rows = [
        ("single", 1, 0.9, 1.0, "continue"), ("single", 2, 0.5, 1.0, "continue"), ("cross", 1, 0.8, 1.0, "cross_context"), ("cross", 2, 0.2, 1.0, "cross_context"),
        ("new", 1, 0.6, 1.0, "new_context"), ("none", 1, 0.1, 0.3, "unknown"), ("none", 2, 0.1, 0.3, "unknown"),
    ]
    got = {r["q"]: r for r in rank.select(spark.createDataFrame(rows, "q string, item int, p double, agreement double, relation string"), "q", "item").collect()}
    assert (got["single"]["decision"], got["single"]["selected"]) == ("route", [1])
    assert (got["cross"]["decision"], got["cross"]["selected"]) == ("route", [1, 2])
    assert (got["new"]["decision"], got["new"]["selected"]) == ("new_context_candidate", [])
    assert (got["none"]["decision"], got["none"]["selected"]) == ("abstain", [1, 2])


def test_ranking_metrics(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert _one(spark, metrics.reciprocal_rank(a("x", "y", "z"), a("y"))) == 0.5
    assert _one(spark, metrics.ndcg(a("x", "y"), a("x", "y"))) == pytest.approx(1.0)
    sets = F.array(a("p", "q"), a("r"))
    assert _one(spark, metrics.evidence_recall(sets, a("r"))) == 1.0
    assert _one(spark, metrics.evidence_recall(sets, a("p"))) == 0.0


def test_mcnemar():
    assert metrics.mcnemar(0, 0) == 1.0
    assert metrics.mcnemar(5, 5) == 1.0
    assert metrics.mcnemar(10, 0) == pytest.approx(2 / 1024)


def test_entity_score(spark):
    got = _one(spark, search.entity_score(F.lit("deploy the Billing API key"), F.array(F.lit("billing api"), F.lit("key deploy"), F.lit("unseen"))))
    assert got == pytest.approx((1 + 0.7 + 0) / 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.bm25(items, docs, "item_id", "doc_id").count() == 0
    assert metrics.micro(spark.createDataFrame([], "r array<string>, c array<string>"), "r", "c").first()["f1"] == 0.0


def test_stream_ingest_is_idempotent(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.union(e.limit(50)).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest(ingest.stream(spark, f"{tmp_path}/in", e.schema), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == e.count()


def test_whole_queries_read_past_the_head(spark, tmp_path):
    """A term after the first 60 characters finds its document."""
    filler = "common words " * 6
    spark.createDataFrame([(1, f"{filler} zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "common words", 12), (2, "zebra", 5), (3, "other", 5)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda name: {r["doc_id"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert found("bm25_topk") == {1, 2}
