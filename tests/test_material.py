"""Material, sweeps, latent vectors, exports, reports and packages."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillweave.operators import arms, material, routing
from quillweave.sources import generator, reports
from quillweave.sources.durable import stored


def test_pair_features(spark):
    pairs = spark.createDataFrame([(1, 1, "fix foo_bar in cache", "we fix foo_bar and fix it"), (1, 2, "fix foo_bar in cache", "other words")], "query_id int, id int, query string, text string")
    df = spark.createDataFrame([("fix", 5), ("in", 50), ("foo_bar", 1), ("cache", 9)], "term string, df long")
    r = {x["id"]: x for x in material.pair_features(pairs, df, 100).collect()}
    assert r[1]["bigram_hit"] and r[1]["max_query_tf"] == 2 and r[1]["rare_hits"] >= 2 and r[1]["identifier_overlap"] == 1 and r[1]["max_idf_present"] > 3
    assert (r[2]["query_coverage"], r[2]["idf_coverage"], r[2]["bigram_hit"], r[2]["max_query_tf"], r[2]["candidate_tokens"]) == (0.0, 0.0, False, 0, 2)


def test_retrieval_modes(spark):
    units = spark.createDataFrame([("u1", "red apple pie"), ("u2", "green pear"), ("u3", "red car")], "id string, text string")
    q = spark.createDataFrame([("q", "red apple")], "question_id string, query string")
    for mode in ("lexical", "dense", "hybrid"):
        assert [r["id"] for r in material.retrieve(q, units, mode, 2).orderBy("place").collect()][0] == "u1"
    d = spark.createDataFrame([("q", ["u3"], [("u1",), ("u3",), ("u2",)])], "request_id string, selected array<string>, candidates array<struct<context_id:string>>")
    assert [(r["id"], r["place"]) for r in material.retrieve(q, units, "router", 2, d).orderBy("place").collect()] == [("u3", 1), ("u1", 2)]


def test_latent_vectors(spark):
    texts = spark.createDataFrame([(1, "apple pear fruit"), (2, "pear apple fruit"), (3, "engine wheel road"), (4, "wheel engine")], "id int, text string")
    v = {r["id"]: np.array(r["vector"]) for r in material.lsa(texts, "id", "text", 2).collect()}
    assert v[1] @ v[2] > 0.99 and v[3] @ v[4] > 0.9 and abs(v[1] @ v[3]) < 0.1 and all(np.linalg.norm(x) == pytest.approx(1) for x in v.values())
    with pytest.raises(ValueError):
        material.lsa(texts.limit(0), "id", "text")


def test_sweeps_and_pairs(spark):
    t = {k: stored(v, k) for k, v in generator.tables(spark, 1).items()}
    s = material.sweep(t["checkpoints"], t["events"], t["contexts"], t["assignments"], (60, 400), ("query_recent_only", "sliding_window")).collect()
    by = {(r["arm"], r["budget"], r["query_type"]): r["mean_memory_tokens"] for r in s}
    assert all(by[a, 60, q] <= by[a, 400, q] for a, b, q in by if b == 400) and max(v for (_, b, _), v in by.items() if b == 60) <= 60
    r = arms.score("a", arms.assemble_arm("sliding_window", t["checkpoints"], t["events"], t["contexts"], t["assignments"]), t["checkpoints"], t["events"])
    assert material.paired(r.union(r.withColumn("arm", F.lit("b"))), "a", "b", "memory_tokens").where("a = b").count() == 13
    assert "ranker=h" in material.router_profile({"t": 1}, "h") and arms.missing_queries(t["checkpoints"], t["events"].where("sequence > 20")).count() > 0
    assert routing.oracle(t["checkpoints"]).where("trace_id LIKE 'oracle:%'").count() == 13
    b = material.overlap_buckets(spark.createDataFrame([("a b", "a b", 1), ("a b", "c", 0)], "q string, g string, h int"), "q", "g", "h").collect()
    assert {(r["bucket"], r["recall"]) for r in b} == {(3, 1.0), (0, 0.0)}


def test_exports_and_reports(spark, tmp_path):
    e = spark.createDataFrame([("e1", "mail a@b.org"), ("e2", "ok"), ("e3", "not named")], "event_id string, content string")
    ids = [spark.createDataFrame([("e1",)], "x string"), spark.createDataFrame([("e2",)], "y string")]
    path = f"file://{tmp_path}/out"
    assert reports.sanitized_export(e, ids, path) == 2 and {r["content"] for r in spark.read.json(path).collect()} == {"mail <email>", "ok"}
    with pytest.raises(Exception, match="exist"):
        reports.sanitized_export(e, ids, path)
    with pytest.raises(ValueError, match="identity"):
        reports.sanitized_export(e.withColumn("content", F.lit("xannx")), ids, f"{path}2", ("ann",))
    rows = spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 3)], "arm string, share double, n int")
    assert json.loads(reports.report_json(rows, "arm"))["b"] == {"n": None, "share": 0.5} and reports.report_markdown(rows).splitlines()[2] == "| b | 0.500 | - |"
    v = spark.createDataFrame([("c", [1.0, 0.0])], "context_id string, vector array<double>")
    assert reports.save_index(v, f"{path}3") == reports.save_index(v, f"{path}4") != reports.save_index(v.withColumn("context_id", F.lit("d")), f"{path}5")


def test_packages_are_read_as_literals(spark, tmp_path):
    (tmp_path / "a.py").write_text("GROUND_TRUTH_HISTORY = [[{'text': 'hi', 'role': 'user'}, {'text': 'yo', 'role': 'assistant'}]]\nNOISE = [[{'text': 'n', 'role': 'user'}]]\n")
    (tmp_path / "b.py").write_text("EVALUATION_QUERIES = [{'global_id': 7, 'query': 'q', 'expected_doc': ['hi'], 'answer_key': 'k', 'topic': 't'}]\n")
    p = reports.load_package(spark, f"file://{tmp_path}")
    assert p["truth"].count() == 2 and p["noise"].count() == 1 and p["questions"].first()["expected"] == ["hi"]
    (tmp_path / "b.py").write_text("EVALUATION_QUERIES = open('x')\n")
    with pytest.raises(ValueError):
        reports.load_package(spark, f"file://{tmp_path}")
