"""Synthetic sessions of interleaved tasks with labelled checkpoints, a session at a time.

Each session interleaves six tasks over nine rounds, in an order that turns with the session.
Every third round answers through a tool. After each four episodes comes a labelled query;
its type goes round CYCLE, and those that reach back aim at the tasks left alone longest.
142 events and 13 checkpoints a session; a session depends on its number alone, so ranges of
numbers are disjoint sets that any number of executors can make."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The shape of a session, the order of query types and what they imply.
ROUNDS, QUERY_EVERY, TRAILING, FORBIDDEN = 9, 4, 3, 3
CYCLE = ("return", "continue", "cross_context", "switch", "short_coreference", "return", "new_context", "unanswerable")
RELATION = {"continue": "continue", "return": "switch_or_return", "switch": "switch_or_return", "short_coreference": "continue", "cross_context": "cross_context", "new_context": "new_context", "unanswerable": "unknown"}
TASKS = (
    ("billing", "Billing export", "move invoices to the ledger", "invoices go out nightly", ("ledger.py", "InvoiceRow", "fx_rate"), "rounding currency totals retries schema tax refunds batching audit".split()),
    ("search", "Search ranking", "rank the help pages", "scores come from clicks", ("ranker.py", "ClickModel", "bm_weight"), "synonyms stemming boosts filters logging caching typos weights snippets".split()),
    ("mobile", "Mobile login", "let users sign in with a key", "the old form stays for a while", ("login.kt", "KeyStore", "pin_hash"), "biometrics fallback lockout tokens sessions layout consent errors metrics".split()),
    ("sensor", "Sensor firmware", "read the pumps each second", "a gateway collects the frames", ("pump.c", "FrameBuf", "crc_seed"), "timing framing sleep watchdog calibration drift bootloader wiring flash".split()),
    ("report", "Quarterly report", "write the summary for the board", "figures come from finance", ("report.md", "RevenueTable", "growth_q"), "outline charts footnotes sources wording dates headcount outlook appendix".split()),
    ("garden", "Garden planner", "draw beds for the allotment", "rows follow the sun", ("beds.svg", "PlotGrid", "row_gap"), "spacing rotation compost shade watering seeds fences paths harvest".split()),
)
EVENTS = "session_id string, sequence int, event_id string, actor string, kind string, content string, parent_event_id string"
CONTEXTS = "session_id string, context_id string, name string, goal string, summary string, entities array<string>, terms array<string>, created_at_event string, last_active int, version int"
ASSIGNMENTS = "session_id string, event_id string, context_id string, source string, relevance double, version int"
CHECKPOINTS = (
    "sample_id string, session_id string, query_event_id string, query string, query_type string, as_of int, required_ids array<string>, evidence_sets array<array<string>>, forbidden_ids array<string>, "
    "requirements array<string>, must_abstain boolean, relation_label string, primary_id string, recent_ids array<string>"
)
TABLES = {"events": EVENTS, "contexts": CONTEXTS, "assignments": ASSIGNMENTS, "checkpoints": CHECKPOINTS}


def queries_per_session(tasks: int = len(TASKS), rounds: int = ROUNDS) -> int:
    return tasks * rounds // QUERY_EVERY


def _query(kind: str, targets: list[tuple], topic: dict[str, str]) -> str:
    if kind == "new_context":
        return "Please start a new project on tide tables, first the data sources."
    if kind == "unanswerable":
        return "What was the door code of the old office?"
    name, what = targets[0][1], topic[targets[0][0]]
    if kind == "cross_context":
        return f"Can we reuse the {what} idea of {name} for the {topic[targets[1][0]]} of {targets[1][1]}?"
    return {
        "return": f"Go back to {name}: what did we settle about {what}?", "switch": f"Switch to {name} now, first the {what}.",
        "short_coreference": f"Continue that one, where does {targets[0][4][2]} belong?", "continue": f"Continue on {name}: {what} still needs a decision.",
    }[kind]


def session(index: int) -> dict[str, list[tuple]]:
    """The rows of one session."""
    sid = f"syn-{index:03d}"
    events: list[tuple] = []
    assigned: list[tuple] = []
    pending: list[list] = []
    first: dict[str, tuple] = {}
    episode: dict[str, list[str]] = {}
    topic: dict[str, str] = {}
    touched: dict[str, int] = {}

    def emit(actor: str, kind: str, content: str, task: str | None = None, relevance: float = 1.0, parent: str | None = None) -> str:
        n = len(events) + 1
        events.append((sid, n, f"{sid}-evt-{n}", actor, kind, content, parent))
        if task:
            assigned.append((sid, events[-1][2], f"{sid}-{task}", "oracle", relevance, 1))
        return events[-1][2]

    by_key = {t[0]: t for t in TASKS}
    order = [TASKS[(k + index) % len(TASKS)] for k in range(len(TASKS))]
    for number in range(ROUNDS * len(TASKS)):
        turn, task = number // len(TASKS), order[number % len(TASKS)]
        key, name, _, _, (file, symbol, field), topics = task
        what = topics[turn % len(topics)]
        ids = [emit("user", "message", f"On {file}: how do we handle the {what} step of {name}? {symbol} is still shaky, so tell me what breaks before we touch any code.", key)]
        first.setdefault(key, (ids[0], len(events)))
        if turn % 3 == 2:
            ids.append(emit("assistant", "tool_call", f"read {file} log {what} last three changes, find {symbol}", key))
            ids.append(emit("tool", "tool_result", f"{what}: two records of {symbol}; settle {field} before deciding on a rollback.", key, parent=ids[-1]))
        else:
            ids.append(emit("assistant", "decision", f"Check {what} in {file} against {field} first; while {symbol} is shaky, roll back to the last good version rather than patching.", key))
        episode[key], topic[key], touched[key] = ids, what, number
        if (number + 1) % QUERY_EVERY:
            continue
        kind = CYCLE[(number // QUERY_EVERY) % len(CYCLE)]
        cold = [by_key[k] for k in sorted((k for k in touched if k != key), key=lambda k: (touched[k], k))]
        targets = {"continue": [task], "short_coreference": [task], "cross_context": cold[:2], "return": cold[:1], "switch": cold[1:2] or cold[:1]}.get(kind, [])
        text = _query(kind, targets, topic)
        qid = emit("user", "message", text)
        evidence = [e for t in targets for e in episode[t[0]]]
        wanted = [f"→ {t[4][0]}「{topic[t[0]]}」" for t in targets] or ["说明上下文不足, instead of a guess"]
        pending.append([qid, len(events), kind, text, [f"{sid}-{t[0]}" for t in targets], evidence, wanted])
    for k in range(TRAILING):
        t = TASKS[k % len(TASKS)]
        emit("assistant", "decision", f"{t[4][0]}: the {t[5][k]} change is merged and passed; watch {t[4][1]} for a while.", t[0], 0.6)

    checkpoints, primary, recent = [], None, []
    for n, (qid, at, kind, text, required, evidence, wanted) in enumerate(pending, 1):
        sets = [evidence, evidence[-1:]] if evidence else []
        future = [e[2] for e in events if e[1] > at][:FORBIDDEN]
        checkpoints.append((f"{sid}-q-{n:02d}", sid, qid, text, kind, at, required, sets, future, wanted, not required, RELATION[kind], primary, list(recent)))
        if required:
            primary, recent = required[0], list(dict.fromkeys(required + recent))[:3]
    contexts = [(sid, f"{sid}-{t[0]}", t[1], t[2], t[3], list(t[4]), [t[1], t[2]], *first[t[0]], 1) for t in TASKS]
    return {"events": events, "contexts": contexts, "assignments": assigned, "checkpoints": checkpoints}


def tables(spark: SparkSession, sessions: int, start: int = 0) -> dict[str, DataFrame]:
    """events, contexts, assignments and checkpoints of the sessions start to start + sessions - 1."""
    if sessions < 1 or start < 0:
        raise ValueError("at least one session, from number 0 on")

    def of(name: str, schema: str) -> DataFrame:
        columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([r for i in pdf["id"] for r in session(int(i))[name]], columns=columns)

        return spark.range(start, start + sessions).mapInPandas(make, schema)

    return {name: of(name, schema) for name, schema in TABLES.items()}
