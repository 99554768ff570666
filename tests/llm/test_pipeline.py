"""The pipeline's stages against brute force: decisions take effect, clean documents stay, odd inputs have results."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillweave.llm import decontamination, packing

from test_operators import VOCABULARY, brute_components

SF = "/root/testdata/sf0.001"
STAGE = dict(P.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_one_of_each_group_stays(spark, docs):
    """Pairs of 80 % or more, counted on whole shingle sets."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low = brute_components(rows, 80)
    assert sorted(r["doc_id"] for r in STAGE["near-duplicates"](spark, docs, SF).collect()) == sorted(d for d, m in low.items() if d == m)
    assert any(d != m for d, m in low.items())


def test_contaminated_documents_go(spark, docs):
    """Documents with passages of two items, planted among the others, by the SQL of the operator."""
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    first = docs.first()["text"]
    planted = [(9001, f"{first} {items[0]} and {items[1]}"), (9002, f"{first} {items[2]}"), (9003, " ".join(items[3].split()[:9] + ["x"] + items[4].split()[-9:]))]
    more = spark.createDataFrame(planted, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")})
    every = docs.union(more.select(docs.columns))
    con = duckdb.connect()
    con.register("documents", every.select("doc_id", "text").toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    bad = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontamination.ORACLE}) WHERE contaminated").fetchall()}
    kept = {r["doc_id"] for r in STAGE["decontamination"](spark, every, SF).collect()}
    assert {9001, 9003} <= bad and 9002 not in bad and kept == {r["doc_id"] for r in every.select("doc_id").collect()} - bad


def test_toxic_documents_go(spark, tmp_path):
    """Labelled texts of two wordings: unlabelled documents of the toxic one go, all others stay."""
    rng = random.Random(2)
    plain, bad = [f"calm{i}" for i in range(200)], [f"vile{i}" for i in range(12)]
    text = lambda toxic: " ".join([*rng.choices(plain, k=40), *(rng.choices(bad, k=8) if toxic else [])])
    rows = [(i, text(i % 10 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(700)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in STAGE["toxicity"](spark, df, str(tmp_path)).collect()}
    assert kept == {i for i in range(900) if i % 10}


def test_secrets_are_replaced(spark, docs):
    out = {r["doc_id"]: r for r in STAGE["secrets"](spark, docs, SF).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(out) == set(before) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.values())
    rule = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}""")
    assert any(rule.search(t or "") for t in before.values()) and not any(rule.search(r["text"] or "") for r in out.values())
    assert all(out[d]["text"] == t for d, t in before.items() if not re.search(r"[A-Za-z0-9+/_=-]{12}", t or ""))


def test_everything_is_packed(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    got = STAGE["packing"](spark, docs, SF).collect()
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    size: dict = {}
    for r in got:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    assert size == want and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and max(r["offset"] + r["length"] for r in got) <= packing.LENGTH


@pytest.mark.parametrize("name", list(STAGE))
def test_odd_documents(spark, odd_docs, no_docs, name):
    """Nulls, empty and long texts, ties, repeats and clashing columns; and no documents at all."""
    out = STAGE[name](spark, odd_docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()} and STAGE[name](spark, no_docs, SF).count() == 0
        return
    assert out.columns == odd_docs.columns and {r["score"] for r in rows} == {"x"}
    kept = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows)
    assert kept == ([-1, 1, 3, 4, 5, 6, 8, 10, 11] if name == "near-duplicates" else sorted([-1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]))
    assert STAGE[name](spark, no_docs, SF).count() == 0


def test_run(spark):
    got = P.run(spark, SF).collect()
    assert got and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
