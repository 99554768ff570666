"""Invariants of generated sessions, routing, assembly and arms; the log's rules; import, redaction, labels, seams."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillweave import plans
from quillweave.functions import providers as P
from quillweave.functions import scrub as S
from quillweave.functions import text as T
from quillweave.operators import arms, assembly, labels, metrics, rank, routing, search, windows
from quillweave.sources import generator, log, transcripts
from quillweave.sources.durable import dealt, spread, stored
from quillweave.streaming import ingest


@pytest.fixture(scope="module")
def made(spark):
    return {k: stored(v, k) for k, v in generator.tables(spark, 2).items()}


def test_sessions_have_their_shape():
    for i in (0, 1, 7):
        s = generator.session(i)
        events = {e[2]: e for e in s["events"]}
        assert len(s["events"]) == len(events) == 142 and len(s["checkpoints"]) == generator.queries_per_session() == 13 and len(s["contexts"]) == 6
        assert [e[1] for e in s["events"]] == list(range(1, 143))
        for c in s["checkpoints"]:
            sets, as_of = c[7], c[5]
            assert (not c[6]) == c[10] and bool(sets) == bool(c[6]) and all(events[e][1] <= as_of for o in sets for e in o) and all(events[e][1] > as_of for e in c[8])
        assert {e[6] for e in s["events"] if e[4] == "tool_result"} <= set(events)
        assert {c[4] for c in s["checkpoints"]} == set(generator.CYCLE)
    assert generator.session(3) == generator.session(3) and generator.session(3)["events"][0] != generator.session(4)["events"][0]


def test_assembly_keeps_its_promises(spark, made):
    cp, ev = made["checkpoints"], made["events"]
    seq = {r["event_id"]: (r["sequence"], r["kind"], r["parent_event_id"]) for r in ev.collect()}
    at = {r["sample_id"]: r["as_of"] for r in cp.collect()}
    d = routing.oracle(cp)
    cx = made["contexts"].select("session_id", "context_id", "name", "goal", "summary")
    for budget in (120, 400, 2048):
        prose = {r["sample_id"]: r for r in assembly.assemble(cp, d, ev, cx, made["assignments"], budget).collect()}
        index = {r["sample_id"]: r for r in assembly.assemble(cp, d, ev, cx, made["assignments"], budget, "index").collect()}
        counted = {r["s"]: r["n"] for r in spark.createDataFrame([(k, r["rendered"]) for k, r in prose.items()], "s string, t string").select("s", T.token_count(F.col("t")).alias("n")).collect()}
        for k, r in prose.items():
            assert r["memory_tokens"] == counted[k] <= budget and index[k]["memory_tokens"] <= r["memory_tokens"]
            assert r["included"] == index[k]["included"] and len(set(r["included"])) == len(r["included"])
            assert all(seq[e][0] <= at[k] for e in r["included"])
            for b in r["blocks"]:
                assert r["rendered"][b["start"] : b["end"]] == b["text"]
            shown = {b["event_id"] for b in r["blocks"] if b["section"] == "evidence"}
            for e in shown:  # a result never comes without its call
                if seq[e][1] == "tool_result":
                    assert seq[e][2] in r["included"]
            assert {x["reason"] for x in r["dropped"] or []} <= {"token_budget", "recent_budget", "minimal_sufficiency_floor"}


def test_index_rows_are_shorter_for_long_events(spark):
    rows = spark.createDataFrame([("e1", 7, "user", "message", "word " * 200, "c1"), ("e2", 8, "user", "message", "ok", "c1")], "event_id string, sequence int, actor string, kind string, content string, context_id string")
    rows = rows.withColumn("prose", assembly.event_text(F.lit("evidence"), F.col("context_id")))
    got = [r[0] for r in rows.select(assembly.index_row(F.lit(3), F.lit("evidence"), F.col("prose"))).collect()]
    assert got[0].startswith("[3] evidence ctx=c1 seq=7 user/message: word word") and got[0].endswith("…") and got[1] == "[Evidence:c1][e2][user/message] ok"


def test_selection_walks_groups_in_order(spark):
    """Descriptors, then the newest recent events within their share, then groups in turn over contexts."""
    blocks = [("s", "context", 0, "a", None, 10), ("s", "recent", 1, None, "r1", 30), ("s", "recent", 2, None, "r2", 10), ("s", "recent", 3, None, "r3", 4)]
    groups = [("s", "a", "x1", 9, "x1", 0.9, 1), ("s", "a", "x2", 9, "x1", 0.9, 2), ("s", "a", "x2", 9, "x2", 0.8, 2), ("s", "a", "x3", 50, "x3", 0.7, 3), ("s", "a", "x4", 1, "x4", 0.2, 4), ("s", "b", "y1", 5, "y1", 0.3, 5), ("s", "b", "x1", 9, "y2", 0.29, 1)]
    b = spark.createDataFrame(blocks, "sample_id string, section string, rank int, context_id string, event_id string, cost long")
    g = spark.createDataFrame(groups, "sample_id string, context_id string, event_id string, cost long, anchor string, score double, sequence int")
    rows = assembly.select_blocks(b, g, 100).collect()
    assert [(r["section"], r["event_id"]) for r in sorted((r for r in rows if r["place"] is not None), key=lambda r: r["place"])] == [("context", None), ("recent", "r2"), ("recent", "r3"), ("evidence", "x1"), ("evidence", "x2"), ("evidence", "y1"), ("evidence", "x3")]
    assert {(r["event_id"], r["reason"]) for r in rows if r["place"] is None} == {("r1", "recent_budget"), ("x4", "minimal_sufficiency_floor")}
    deep = assembly.select_blocks(b, g, 100, depth=1).collect()
    assert ("x3", "minimal_sufficiency_depth") in {(r["event_id"], r["reason"]) for r in deep}


def test_arms_compare_as_expected(made):
    cp, ev = made["checkpoints"], made["events"]
    results = None
    for name in arms.ARMS:
        r = stored(arms.score(name, arms.assemble_arm(name, cp, ev, made["contexts"], made["assignments"]), cp, ev))
        results = r if results is None else results.union(r)
    s = {r["arm"]: r for r in arms.summary(results).collect()}
    assert set(s) == set(arms.ARMS) and all(r["future_leakage"] == 0 and r["count"] == 26 for r in s.values())
    assert s["full_history"]["evidence_recall"] == s["oracle_router"]["evidence_recall"] == 1.0 and s["full_history"]["token_reduction"] == 0
    assert s["query_recent_only"]["evidence_recall"] < s["global_bm25"]["evidence_recall"] and s["oracle_router"]["reachability"] == 1.0
    assert arms.gate_one(arms.summary(results)).first()["verdict"] == "continue"
    assert arms.gate_one(arms.summary(results.where("arm <> 'oracle_router'"))).first()["verdict"] == "stop"
    with pytest.raises(ValueError):
        arms.assemble_arm("none", cp, ev, made["contexts"], made["assignments"])


def test_requests_without_contexts(made, spark):
    q = made["checkpoints"].limit(1).select(F.lit("r").alias("request_id"), F.lit("please start a new project").alias("query"), "primary_id", "recent_ids", "as_of")
    none = arms.visible_contexts(made["checkpoints"], made["contexts"], made["events"]).withColumnRenamed("sample_id", "request_id").limit(0)
    r = routing.route(q.union(q.withColumn("request_id", F.lit("s")).withColumn("query", F.lit("hm"))), none).collect()
    assert {(x["request_id"], x["decision"], x["index_version"], len(x["selected"])) for x in r} == {("r", "new_context_candidate", "empty", 0), ("s", "abstain", "empty", 0)}
    assert len(routing.index_versions(made["contexts"], "session_id").first()["index_version"]) == 16


def test_ranker_fit_save_and_load(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        f = {k: rng.random() for k in rank.WEIGHTS}
        rows.append((f"s{i % 40}", *f.values(), int(3 * f["lexical"] + 2 * f["dense"] + rng.gauss(0, 0.3) > 2.5)))
    df = spark.createDataFrame(rows, "session_id string, " + ", ".join(f"{k} double" for k in rank.WEIGHTS) + ", relevant int")
    train, held = routing.training_split(df)
    assert train.count() + held.count() == 600 and held.count()
    r = routing.fit_platt(train, held)
    again = routing.load_ranker(routing.save_ranker(r))
    got = held.select("relevant", routing.platt_score(again).alias("p")).collect()
    good, bad = [x["p"] for x in got if x["relevant"]], [x["p"] for x in got if not x["relevant"]]
    assert sum((a > b) for a in good for b in bad) > 0.9 * len(good) * len(bad)
    with pytest.raises(ValueError):
        routing.load_ranker(json.dumps({**json.loads(routing.save_ranker(r)), "semantics": 0}))
    with pytest.raises(ValueError):
        routing.load_ranker(routing.save_ranker(r), ["rrf"])
    with pytest.raises(ValueError):
        routing.fit_platt(train.where("relevant = 1"), held)


def test_the_log_refuses_conflicts(spark):
    e = lambda rows: spark.createDataFrame(rows, "event_id string, session_id string, sequence int")
    known = e([("a", "s", 1), ("b", "s", 2)])
    assert log.append_strict(known, e([("c", "s", 3), ("d", "t", 1)])).count() == 2
    with pytest.raises(log.DuplicateEvent):
        log.append_strict(known, e([("a", "s", 9)]))
    with pytest.raises(log.DuplicateEvent):
        log.append_strict(known, e([("c", "s", 9), ("c", "s", 10)]))
    with pytest.raises(log.SequenceConflict):
        log.append_strict(known, e([("c", "s", 2)]))
    assert log.lookup(known, "b").count() == 1 and log.append(known, e([("a", "s", 1), ("z", "s", 4)])).count() == 1
    a = spark.createDataFrame([("b", "c1", "router", 1, 0.5), ("a", "c1", "router", 1, 0.1), ("a", "c1", "router", 2, 0.9)], "event_id string, context_id string, source string, version int, relevance double")
    contexts = spark.createDataFrame([("c1",)], "context_id string")
    assert [(r["event_id"], r["version"]) for r in log.list_assignments(a, known, "s").collect()] == [("a", 1), ("a", 2), ("b", 1)]
    assert [r["relevance"] for r in log.list_assignments(a, known, "s", latest_only=True).collect()] == [0.9, 0.5]
    assert log.append_assignments(a, a, known, contexts).count() == 0
    with pytest.raises(ValueError):
        log.append_assignments(a, a.withColumn("event_id", F.lit("q")), known, contexts)
    first = spark.createDataFrame([("e", "c", "x", 1, 7, 0.5), ("e", "c", "x", 1, 3, 0.25)], "event_id string, context_id string, source string, version int, written int, relevance double")
    assert assembly.latest_assignments(first).first()["relevance"] == 0.25


def test_json_lines_round_trip_and_unknown_records(spark, made, tmp_path):
    path = f"file://{tmp_path}/log"
    log.export_jsonl({"event": made["events"], "context": made["contexts"], "assignment": made["assignments"]}, path)
    assert log.import_counts(spark, path) == {"event": 284, "context": 12, "assignment": made["assignments"].count()}
    back = log.read_jsonl(spark, path, "event", generator.EVENTS.replace(" string", ": string").replace(" int", ": int"))
    assert sorted(map(tuple, back.select(made["events"].columns).collect()), key=repr) == sorted(map(tuple, made["events"].collect()), key=repr)
    spark.createDataFrame([('{"record_type": "odd", "data": {}}',)], "value string").write.text(f"{path}/9-odd")
    with pytest.raises(ValueError, match="odd"):
        log.import_counts(spark, path)
    with pytest.raises(Exception, match="unknown record"):
        log.read_jsonl(spark, path, "event", "event_id: string").count()


def test_late_events_are_not_lost(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    put = lambda rows, n: spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "cast(ts as timestamp) ts").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    read = lambda: ingest.ingest(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    put([(1, "2024-03-01"), (2, "2024-03-09")], 1)
    read()
    put([(2, "2024-03-09"), (3, "2020-01-01"), (1, "2030-01-01")], 2)
    read()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_transcripts_become_events(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "u1", "sessionId": "S", "timestamp": "2024-01-02T03:04:05Z", "message": {"content": "hello"}},
        {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "message": {"model": "m-1", "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"b": 1, "a": 2}}]}},
        {"type": "user", "uuid": "u3", "parentUuid": "u2", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "one"}, "two"]}, {"type": "image", "source": {"media_type": "image/png", "type": "base64"}}]}},
        {"type": "summary"}, {"type": "user", "message": {"content": "  "}}, [1],
    ]
    for folder, extra in (("projects/p", "not json"), ("projects/p/subagents", "")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.jsonl").write_text("\n".join([*map(json.dumps, lines), extra, ""]))
    files = transcripts.discover(spark, f"file://{tmp_path}")
    assert files.count() == 1 and transcripts.discover(spark, f"file://{tmp_path}", True).count() == 2
    parsed = stored(transcripts.parse(files))
    none = spark.createDataFrame([], "event_id string")
    got = {r["sequence"]: r for r in transcripts.new_events(parsed, none).collect()}
    assert [got[k]["event_id"] for k in sorted(got)] == ["agent:S:u1:0:message", "agent:S:u2:0:message", "agent:S:u2:1:tool_call", "agent:S:u3:0:tool_result", "agent:S:u3:1:artifact"]
    assert got[3]["content"] == 'read\n{"a": 2, "b": 1}' and got[4]["content"] == "one\ntwo" and got[4]["parent_event_id"] == got[3]["event_id"] and got[2]["parent_event_id"] == got[1]["event_id"] == "agent:S:u1:0:message"
    assert got[5]["actor"] == "user" and json.loads(got[5]["payload"])["binary_omitted"] and got[1]["occurred_at"].hour == 3
    r = transcripts.report(files, parsed, none).first().asDict()
    assert (r["imported_events"], r["skipped_thinking"], r["skipped_meta_records"], r["malformed_records"], r["existing_events"], r["imported_sessions"], r["discovered_sessions"]) == (5, 1, 2, 2, 0, 1, 1)
    known = transcripts.new_events(parsed, none)
    assert transcripts.new_events(parsed, known).count() == 0 and transcripts.report(files, parsed, known).first()["existing_events"] == 5
    sub = transcripts.parse(transcripts.discover(spark, f"file://{tmp_path}", True)).where("session_id LIKE '%subagent:f'").count()
    assert sub and transcripts.text_of({"b": 1, "a": "é"}) == '{"a": "é", "b": 1}' and transcripts.text_of(None) == ""


def test_redaction_and_gates(spark):
    rows = [
        ("mail ann.b@example.org now", "mail <email> now"), (r"see C:\Users\ann\x.py", r"see <home>\x.py"), (r'{"p": "C:\\Users\\ann\\x"}', r'{"p": "<home>\\x"}'), ("/home/ann/y", "<home>/y"), ("C--Users-ann-proj", "<home>"),
        ("d:/data", "<abs>/data"), ("https://a.b/c", "https://a.b/c"), ("call 13912345678.", "call <phone>."), ("id 0f13912345678ab", "id 0f13912345678ab"), ("sk-" + "a" * 20, "<secret>"), ("AKIA" + "A" * 16, "<secret>"),
        ("-----BEGIN RSA PRIVATE KEY-----", "<private-key>"), ("owner ann  staff annex", "owner <user>  staff annex"),
    ]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", S.scrub(F.col("t"), ["ann", "x"]))
    assert [(r["t"], r["got"]) for r in df.collect() if r["got"] != r["want"]] == []
    assert S.leaks(df, "got", ["ann", "x"]).where("label <> 'identity'").count() == 0
    assert {(r["label"], r["masked"]) for r in S.leaks(df.where("t LIKE 'call%'"), "t").collect()} == {("phone", "13…(11 chars)")}
    with pytest.raises(ValueError, match="phone"):
        S.refuse(S.leaks(df.where("t LIKE 'call%'"), "t"))
    art = spark.createDataFrame([(json.dumps({"A": "arm a:\nb", "k": [{"x@y.org": 1}]}),), ("plain a@b.org",)], "t string")
    assert sorted(r["label"] for r in S.artifact_leaks(art, "t").collect()) == ["email", "email"]
    assert json.loads(art.select(S.scrub_payload("t")).first()[0]) == {"A": "arm a:\nb", "k": [{"x@y.org": 1}]}
    clean = spark.createDataFrame([('{"k": ["a@b.org", 3, null]}',)], "t string").select(S.scrub_payload("t")).first()[0]
    assert json.loads(clean) == {"k": ["<email>", 3, None]}


def test_cues_both_ways(spark):
    rows = [("I cannot answer that", True, "unknown"), ("上下文不足", True, "unknown"), ("fine", False, "unknown"), ("continue it", False, "continue"), ("switch to b", False, "switch_or_return"), ("go back to b", False, "switch_or_return"), ("reuse it in b", False, "cross_context"), ("a new project", False, "new_context"), ("那个尚未讨论的密钥", True, "unknown"), ("那个参数", False, "continue")]
    df = spark.createDataFrame(rows, "t string, no boolean, rel string")
    for r in df.select("no", "rel", T.is_refusal(F.col("t")).alias("a"), T.relation(F.col("t")).alias("b"), T.relation_probabilities(F.col("t")).alias("p")).collect():
        assert (r["no"], r["rel"]) == (r["a"], r["b"]) and sum(r["p"].values()) == pytest.approx(1.0)
    cjk = spark.createDataFrame([("路由器 fooBar_baz 3.14",)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert cjk == ["路由器", "路由", "由器", "foobar_baz", "foo", "bar", "baz", "3.14", "3", "14"] or set(cjk) >= {"路由器", "路由", "由器", "foobar_baz", "foo", "bar", "baz", "3.14"}
    assert spark.createDataFrame([(" a \t\n b ",)], "t string").select(T.squeeze(F.col("t"))).first()[0] == "a b"
    sat = spark.createDataFrame([("覆盖 x.py 的「深 度」", "X.PY **深度**"), ("没有词", "没有词"), ("说明上下文不足", "cannot determine")], "r string, a string")
    assert [r[0] for r in sat.select(T.satisfied(F.col("r"), F.col("a"))).collect()] == [True, False, True]


def test_label_checks(spark, made):
    assert labels.dataset_faults(made["checkpoints"], made["events"], made["contexts"]).count() == 0
    c = made["checkpoints"].limit(3)
    bad = c.withColumn("query_event_id", F.lit("gone")).limit(1).union(c.where("size(required_ids) > 0").limit(1).withColumn("as_of", F.lit(1)).withColumn("required_ids", F.array(F.lit("nope"))))
    rules = {r["rule"] for r in labels.dataset_faults(bad, made["events"].withColumn("content", F.lit("AKIA" + "A" * 16)), made["contexts"]).collect()}
    assert {"missing query event", "place mismatch", "missing context", "evidence not causal", "possible secret"} <= rules
    marks = c.withColumns({"second_annotator": F.lit("").cast("string"), "adjudicated_by": F.lit(None).cast("string"), "recheck_annotator": F.lit("a"), "recheck_contexts_agree": F.lit(True), "recheck_type_agrees": F.lit(False)})
    cov = labels.annotation_coverage(marks).first()
    assert (cov["double_rate"], cov["rechecked"], cov["recheck_context_agreement"], cov["recheck_type_agreement"]) == (0.0, 3, 1.0, 0.0)
    members = spark.createDataFrame([("syn-000-billing", "syn-000-evt-1"), ("zz", "gone")], "context_id string, event_id string")
    found = {r["rule"] for r in labels.replay_faults(marks.withColumn("requirements", F.array(F.lit("无"))), made["events"], made["contexts"], members).collect()}
    assert {"requirement has nothing to match on", "members of an undeclared context", "unknown member", "too few second annotators"} <= found
    b = labels.to_benchmark(made["checkpoints"], made["events"]).first()
    assert b["required_ids"] == [] and len(b["forbidden_ids"]) == 3
    second = spark.createDataFrame([("b1", "s1", "answerable", ["foo.py 「x」"]), ("b2", "s2", "no_substantive_answer", [])], "blind_id string, sample_id string, status string, requirements array<string>")
    first = spark.createDataFrame([("s1", ["foo.py"]), ("s2", ["bar.py"])], "sample_id string, requirements array<string>")
    answers = spark.createDataFrame([("s1", "in foo.py x"), ("s2", " ")], "sample_id string, answer string")
    assert labels.record_faults(second).count() == 0
    assert {r["rule"] for r in labels.record_faults(second.withColumn("sample_id", F.lit("s")).withColumn("status", F.lit("answerable"))).collect()} == {"answerable without requirement", "sample repeats"}
    a = {r["sample_id"]: r for r in labels.label_audit(second, first, answers).collect()}
    assert (a["s1"]["status_matches"], a["s1"]["n_supported"], a["s1"]["n_first_recalled"], a["s1"]["n_recalled_by_first"], a["s2"]["status_matches"]) == (True, 1, 1, 0, True)
    with pytest.raises(Exception, match="unknown sample"):
        labels.label_audit(second, first.limit(1), answers).collect()
    final = spark.createDataFrame([("s1", "use_primary", ["foo.py"]), ("s2", "use_secondary", ["new.py"])], "sample_id string, decision string, requirements array<string>")
    d = {r["sample_id"]: r for r in labels.adjudication_audit(final, first, second, answers).collect()}
    assert (d["s1"]["final_matches"], d["s1"]["decision_consistent"], d["s1"]["gold_changed"]) == ("primary", True, False) and (d["s2"]["final_matches"], d["s2"]["decision_consistent"], d["s2"]["gold_changed"], d["s2"]["status_matches"]) == ("neither", False, True, False)
    scores = spark.createDataFrame([("s", "a", 4.0), ("s", "b", 2.0), ("s", "c", 1.9), ("t", "a", 0.0)], "sample_id string, context_id string, score double")
    assert [r["reply_contexts"] for r in labels.reply_contexts(scores).collect()] == [["a", "b"]]
    kinds = [("q", "no information", [], None, []), ("q", "ok", [], None, []), ("q", "ok", ["a", "b"], None, []), ("that?", "ok", ["a"], "a", ["a"]), ("x.py?", "ok", ["a"], "a", ["a"]), ("q", "ok", ["a"], "b", ["a"]), ("q", "ok", ["a"], "b", ["b"])]
    df = spark.createDataFrame(kinds, "query string, reply string, reply_contexts array<string>, previous_active string, active_before array<string>")
    assert [r["query_type"] for r in labels.decide_type(df).collect()] == ["unanswerable", "new_context", "cross_context", "short_coreference", "continue", "return", "switch"]


def test_seams(spark):
    for name in ("latest", " Auto ", ""):
        with pytest.raises(ValueError):
            P.pinned(name)
    waits, tries = [], iter((ConnectionError(), TimeoutError(), None))

    def send():
        if e := next(tries):
            raise e
        return {"ok": 1}

    assert P.with_retry(send, sleep=waits.append) == {"ok": 1} and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        P.with_retry(lambda: {}["x"], sleep=waits.append)
    df = spark.createDataFrame([(1, "a b")], "id int, prompt string")
    r = P.answers(df, lambda p, i: {"text": p + i, "model": "m-1", "input_tokens": 3, "output_tokens": 1, "stop_reason": None}, "!").first()
    assert r["text"] == "a b!" and r["latency_seconds"] >= 0 and P.embeddings(df.withColumnRenamed("prompt", "text"), lambda t: [[1, 2]] * len(t)).first()["vector"] == [1.0, 2.0]
    reply = json.dumps({"content": [{"type": "thinking", "thinking": "hm"}], "usage": {"input_tokens": 1, "cache_read_input_tokens": 5}})
    got = spark.createDataFrame([(reply, json.dumps({"output": [{"content": [{"type": "output_text", "text": "yo"}]}]}))], "m string, o string")
    assert tuple(got.select(P.message_text(F.col("m")), P.message_text(F.col("m"), True), P.input_tokens(F.col("m")), P.output_text(F.col("o"))).first()) == ("", "hm", 6, "yo")
    prompt = spark.range(1).select(P.judge_prompt(F.lit("q"), F.array().cast("array<string>"), F.lit("x"), F.lit("y"))).first()[0]
    assert prompt == "[Question]\nq\n\n[Requirements]\n- (no rubric)\n\n[Answer A]\nx\n\n[Answer B]\ny\n"
    styles = P.Prompts({"short": "be brief"})
    assert len(styles.digest("short")) == 64
    with pytest.raises(ValueError, match="known: short"):
        styles("long")
    assert spark.range(1).select(P.renormalised(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0)))).first()[0] == {"a": 0.25, "b": 0.75}


def test_windows_and_orders(spark):
    s = spark.createDataFrame([("d", 1, "a b c"), ("d", 2, "d e"), ("d", 3, "f " * 9), ("e", 1, "g")], "dialogue_id string, number int, text string")
    assert [(r["dialogue_id"], r["window"], r["tokens"]) for r in windows.window_blocks(s, 5).orderBy("dialogue_id", "window").collect()] == [("d", 0, 5), ("d", 1, 9), ("e", 0, 1)]
    d = spark.createDataFrame([("truth", i) for i in range(4)] + [("noise", i) for i in range(4)], "kind string, number int")
    order = lambda how, seed=0: [(r["kind"], r["number"]) for r in windows.arrange(d, how, seed).orderBy("place").collect()]
    assert order("blocks")[:4] == [("truth", i) for i in range(4)] and order("interleaved")[:2] == [("truth", 0), ("noise", 0)] and order("shuffled", 1) == order("shuffled", 1) != order("shuffled", 2)
    c = spark.createDataFrame([(q, i, i == q % 3, float(i), float(-i)) for q in range(60) for i in range(3)], "question_id int, id int, right boolean, up double, down double")
    hits = windows.ordering_hits(c, {"up": True, "down": True})
    assert {r["order"]: r["recall"] for r in windows.ordering_report(hits).collect()} == {"up": pytest.approx(1 / 3), "down": pytest.approx(1 / 3), "oracle": 1.0}
    same, best = windows.paired_ordering(hits, "up", "up", 50), windows.paired_ordering(hits, "up", "oracle", 50)
    assert same["p"] == 1.0 and not same["established"] and best["wins"] == 40 and best["established"] and best["p"] == pytest.approx(2 * 0.5**40)
    assert spark.createDataFrame([(["Foo bar", "zz"], "x FOO\n bar y")], "e array<string>, t string").select(windows.evidence_share(F.col("e"), F.col("t"))).first()[0] == 0.5
    audit = windows.audit(spark.createDataFrame([(i < 50, i % 2 / 1.0, False) for i in range(100)], "solved boolean, recall double, long_question boolean")).first()
    assert [audit[k] for k in ("ceiling", "enough_open", "open_share", "query_length", "spread")] == ["pass"] * 5


def test_metrics_by_hand(spark):
    rows = [(["a", "b"], ["a"], ["a", "c", "b"], 0.9, "x", "x"), ([], [], [], 0.8999999999999999, "x", "y"), (["c"], ["d"], ["d", "c"], 0.3, "z", "z")]
    df = spark.createDataFrame(rows, "required array<string>, selected array<string>, ranking array<string>, confidence double, expected string, predicted string")
    r = metrics.route_report(df).first()
    assert (r["count"], r["exact_set_accuracy"], r["micro_precision"], r["micro_recall"]) == (3, pytest.approx(1 / 3), 0.5, pytest.approx(1 / 3))
    assert (r["macro_precision"], r["macro_recall"], r["mrr"]) == (pytest.approx(2 / 3), pytest.approx(0.5), pytest.approx(0.5))
    assert r["ndcg"] == pytest.approx(((1 + 1 / 2) / (1 + 1 / math.log2(3)) + 1 + 1 / math.log2(3)) / 3) and r["cross_context_recall"] == 0.5 and r["high_confidence_error"] == 0.5
    assert [x[0] for x in df.select(metrics.tenth(F.col("confidence"))).collect()] == [9, 8, 3]
    assert r["ece"] == pytest.approx((0.9 + (1 - 0.8999999999999999) + 0.3) / 3)
    pts = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 2.0), (3, 5.0), (3, 5.0)], "c int, g double")
    assert sorted(map(tuple, metrics.pareto(pts, "c", "g").collect())) == [(1, 2.0), (3, 5.0), (3, 5.0)]
    with pytest.raises(ValueError):
        metrics.paired_bootstrap(spark.createDataFrame([(1, 1.0)], "s int, v double"), spark.createDataFrame([(2, 1.0)], "s int, v double"), "s", "v", 10)


def test_policy_choice(spark):
    one = lambda required, relation, ps: (required, relation, [(chr(97 + i), p) for i, p in enumerate(ps)])
    df = spark.createDataFrame([one(["a"], "continue", [0.95, 0.1]), one(["a", "b"], "cross_context", [0.9, 0.85]), one([], "unknown", [0.1, 0.05])] * 4, "required array<string>, relation string, ranked array<struct<id:string,p:double>>")
    best = routing.tune(df).first()
    assert best["feasible"] and best["recall"] == 1.0 and best["selected"] == 1.0 and best["error"] == 0.0
    assert not routing.tune(df.withColumn("required", F.array(F.lit("z")))).first()["feasible"]


def test_sample_is_spread(spark):
    df = spark.createDataFrame([(f"{k}{i:02d}", k) for k, n in (("x", 20), ("y", 3), ("z", 1)) for i in range(n)], "sample_id string, query_type string")
    got = [r["sample_id"] for r in arms.stratified_sample(df, 6).collect()]
    assert sorted(got) == sorted({"x00", "y00", "z00", "x10", "y01", "x19"}) or len(set(got)) == 6 and {"x00", "y00", "z00"} <= set(got)
    assert arms.stratified_sample(df, 100).count() == 24


def test_small_files_are_spread(spark, sf):
    assert spread(spark.read.parquet(f"{sf}/documents.parquet")).rdd.getNumPartitions() == 8 and spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if plans.QUERIES[n].__module__.endswith((".engine", ".evaluation")) and n in plans.ORACLES))
def test_query_matches_duckdb(name, spark, sf, matches):
    matches(plans.QUERIES[name](spark, sf), plans.ORACLES[name], sf)


def _nearest_by_hand(rows, asked, k):
    product = lambda a, b: None if a is None or b is None or len(a) != len(b) or None in (*a, *b) else sum(x * y for x, y in zip(a, b, strict=True))
    out = set()
    for q, v in asked:
        scored = [(-round(s, 9), i) for i, w in rows if i != q and (s := product(v, w)) is not None and s > 0]
        out |= {(q, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_nearest_in_blocks_and_ties(spark):
    """Queries of several blocks, many equal vectors, odd ones, ids of texts: as by hand, and only each task's best are shuffled."""
    r = random.Random(1)
    rows = [(f"v{i:04d}", [1.0, 0.0, 0.5] if i % 3 else [r.choice((-1.0, 0.25, 1.0, 2.0)) for _ in range(3)]) for i in range(400)]
    rows += [("odd1", None), ("odd2", [1.0, None, 1.0]), ("odd3", [1.0, 1.0]), ("odd4", []), ("odd5", [2.0, 3.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    asked = df.where("id LIKE '%7' OR id LIKE 'odd%'")
    want = _nearest_by_hand(rows, [x for x in rows if x[0].endswith("7") or x[0].startswith("odd")], 4)
    for block in (8192, 9):
        got = search.nearest(asked, df, "id", "v", 4, block)
        assert {(x["query_id"], x["id"], x["rank"]) for x in got.collect()} == want
    plan = search.nearest(asked, df, "id", "v", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def _policy_by_hand(rows, low, high, margin, maximum, sure):
    recalls, errors, crosses, sizes = [], [], [], []
    for required, relation, ranked in rows:
        p = [x[1] for x in ranked] + [0.0, 0.0]
        if ranked and p[0] >= high and p[0] - p[1] >= margin and relation != "cross_context":
            chosen = [ranked[0][0]]
        else:
            chosen = [i for i, q in ranked if q >= low][:maximum]
        if relation == "cross_context":
            chosen = list(dict.fromkeys(chosen + [i for i, _ in ranked[: min(2, maximum)]]))
        hit = len(set(required) & set(chosen))
        recall = hit / len(required) if required else float(not chosen)
        recalls.append(recall)
        sizes.append(len(chosen))
        errors += [hit < len(required)] if p[0] >= sure else []
        crosses += [recall] if len(required) >= 2 else []
    mean = lambda v, default: sum(v) / len(v) if v else default
    return tuple(round(x, 6) for x in (mean(recalls, None), mean(errors, 0.0), mean(crosses, 1.0), mean(sizes, None)))


def test_policy_grid_counts_kinds(spark):
    """The grid by hand on random observations, and kinds, not observations, meet its rows."""
    r = random.Random(2)
    rows = []
    for _ in range(60):
        ranked = sorted(((c, r.choice((r.random(), 0.9, 0.5, 0.2))) for c in "abcd"[: r.randrange(5)]), key=lambda x: -x[1])
        rows.append((r.sample("abcd", r.randrange(4)), r.choice(("cross_context", "continue")), ranked))
    df = spark.createDataFrame(rows, "required array<string>, relation string, ranked array<struct<id:string,p:double>>")
    grid = routing.policy_grid(df)
    got = grid.collect()
    assert len(got) == sum(h >= low for h in routing.GRID["t_high"] for low in routing.GRID["t_low"]) * 75
    for x in got:
        assert tuple(round(x[k], 6) for k in ("recall", "error", "cross", "selected")) == pytest.approx(_policy_by_hand(rows, *(x[k] for k in routing.GRID)), abs=2e-6)
    plan = grid._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan[plan.index("NestedLoopJoin"):]
    odd = spark.createDataFrame([(None, None, None), (["a"], "continue", None), (["a"], None, [("a", 0.95)])], df.schema)
    assert {x["recall"] for x in routing.policy_grid(odd).collect()} == {1.0}


def test_token_sets_are_the_tokens(spark, sf):
    """Tokens of Python tasks are those of the column expression, on documents and on odd texts."""
    odd = ["", " ", None, "a.b-C:d\\e/f_g", "camelCaseX9Y z9Z", "__ _a -- ..", "1.2.3. 4..5 ٣٤ 12a", "汉 汉字串a汉字b", "é Éa ñandú straße K ſ", "A B c\x0bd\x1ce", "x" * 5000 + "." * 5000, "㐀䶿一鿿\U00020000", "\0a\0b"]
    df = spark.createDataFrame([(x,) for x in odd], "text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    sets = T.TokenSets(5)
    for text, want in df.select("text", T.tokens(F.col("text"))).collect():
        assert sets(text) == set(want)


def _scored_by_hand(items, docs):
    sets = T.TokenSets()
    held = [(i, sets(t)) for i, t in docs]
    mean, out = max(sum(len(s) for _, s in held) / len(held), 1), {}
    df = {t: sum(t in s for _, s in held) for _, x in items for t in sets(x)}
    for q, x in items:
        for i, s in held:
            for t in sets(x) & s:
                out[q, i] = out.get((q, i), 0) + math.log1p((len(held) - df[t] + 0.5) / (df[t] + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(s) / mean))
    return out


def test_bm25_stays_with_the_documents(spark, monkeypatch):
    """One corpus with ties, odd texts, keys that occur twice and keys of texts: as by hand, and pairs are not shuffled."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"d{i:03d}", " ".join(r.sample(words, r.randrange(8)))) for i in range(300)] + [("same", "w1 w2 w3")] * 3 + [(f"t{i}", "w1 w2") for i in range(40)] + [("none", None), ("odd", "汉字 x_y")]
    items = [(i, " ".join(r.sample(words, 3))) for i in range(20)] + [(7, "w1"), (30, ""), (31, "汉字"), (32, "nowhere")]
    a, b = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id string, text string").repartition(6)
    want = _scored_by_hand(items, docs)
    got = {(x["item_id"], x["doc_id"]): x["score"] for x in search.bm25(a, b, "item_id", "doc_id").collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    best = search.bm25_top(a, b, "item_id", "doc_id", 5)
    order = {q: sorted((-round(s, 9), i) for (p, i), s in want.items() if p == q)[:5] for q in {p for p, _ in want}}
    assert {(x["item_id"], x["doc_id"], x["rank"]) for x in best.collect()} == {(q, i, n) for q, rows in order.items() for n, (_, i) in enumerate(rows, 1)}
    # blocks of few queries give the same, and no exchange is under the scores of documents whose keys are unique
    scores = search._scores
    monkeypatch.setattr(search, "_scores", lambda *x: scores(*x, block=3))
    few = {(x["item_id"], x["doc_id"]): x["score"] for x in search.bm25(a, b, "item_id", "doc_id").collect()}
    assert few == pytest.approx(got)
    plan = search.bm25(a, b.dropDuplicates(["doc_id"]), "item_id", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert search.bm25(a.where("item_id < 0"), b, "item_id", "doc_id").count() == 0 and search.bm25_top(a, b.where("doc_id = 'none'"), "item_id", "doc_id", 2).count() == 0


def test_orders_are_dealt_by_their_size(spark, sf, tmp_path, matches):
    """More input partitions make more and not larger sorts, and the report is the SQL's."""
    a, b = dealt("id", spark.range(0, 100, 1, 50), spark.range(0, 10, 1, 2))
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 200
    few, _ = dealt("id", spark.range(0, 10, 1, 1), spark.range(0, 10, 1, 1))
    assert few.rdd.getNumPartitions() == 8
    report = plans.QUERIES["ordering_report"](spark, sf)
    assert "REPARTITION_BY_NUM" in report._jdf.queryExecution().executedPlan().toString()
    matches(report, plans.ORACLES["ordering_report"], sf)
