"""Working contexts under a token budget, for many checkpoints at once.

A checkpoint's blocks are few (its selected contexts' own events), but their order decides who
fits: groups cover what earlier ones left, and admission is a fold. So scores, neighbours and
costs are joins and aggregates over all checkpoints, and only each checkpoint's candidates
meet in one task, for the walk over its groups and the fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import stored
from . import search

# Fixed values of the profile.
WEIGHTS = {"lexical": 0.45, "dense": 0.40, "relevance": 0.15}
FLOOR = 0.5
RECENT_SHARE = 0.15
RECENT_TURNS = 3
HEAD = 160
BUDGET = 2048


def latest_assignments(assignments: DataFrame) -> DataFrame:
    """The greatest version of each (event, context, source); of equal versions the first that was written,
    where a column `written` tells their order."""
    first = -F.col("written") if "written" in assignments.columns else F.lit(0)
    rest = [c for c in assignments.columns if c not in ("event_id", "context_id", "source")]
    out = assignments.groupBy("event_id", "context_id", "source").agg(F.max_by(F.struct(*rest), F.struct("version", first)).alias("_r"))
    return out.select("event_id", "context_id", "source", *(F.col("_r")[c].alias(c) for c in rest))


def event_text(section: Column | str, context_id: Column) -> Column:
    prefix = F.when(section == "recent", "Recent").otherwise(F.concat(F.lit("Evidence:"), F.coalesce(context_id, F.lit("None"))))
    return F.concat(F.lit("["), prefix, F.lit("]["), F.col("event_id"), F.lit("]["), F.col("actor"), F.lit("/"), F.col("kind"), F.lit("] "), F.col("content"))


def descriptor_text() -> Column:
    return F.concat(F.lit("[Context: "), "context_id", F.lit(" | "), "name", F.lit("]\nGoal: "), "goal", F.lit("\nSummary cue: "), "summary")


def index_row(place: Column, section: Column, text: Column) -> Column:
    """One compact row of a block: identity kept, body cut to its head; the block itself where that costs no
    more tokens."""
    line = F.split(text, "\n")
    part = lambda i, head: F.regexp_replace(F.coalesce(F.get(line, F.lit(i)), F.lit("")), f"^{head}", "")
    own = F.concat(F.lit("["), place.cast("string"), F.lit("] context "), F.regexp_replace(part(0, r"\[Context: "), r"\]$", ""), F.lit(" | goal: "), part(1, "Goal: "), F.lit(" | cue: "), part(2, "Summary cue: "))
    event = F.concat(
        F.lit("["), place.cast("string"), F.lit("] "), section, F.lit(" ctx="), F.coalesce("context_id", F.lit("None")), F.lit(" seq="), F.col("sequence").cast("string"), F.lit(" "), F.col("actor"), F.lit("/"), F.col("kind"),
        F.lit(": "), T.head(T.squeeze(F.col("content")), HEAD),
    )
    row = F.when(section == "context", own).otherwise(event)
    return F.when(T.token_count(row) > T.token_count(text), text).otherwise(row)


def evidence_scores(checkpoints: DataFrame, selected: DataFrame, events: DataFrame, assignments: DataFrame, excluded: DataFrame) -> DataFrame:
    """checkpoints (sample_id, session_id, query, as_of), selected (sample_id, context_id), excluded (sample_id,
    event_id) -> (sample_id, context_id, event_id, sequence, score): causal events of the selected contexts,
    scored within each."""
    of = latest_assignments(assignments).groupBy("event_id", "context_id").agg(F.max_by("relevance", F.struct("source", "version")).alias("relevance"))
    pool = checkpoints.select("sample_id", "session_id", "as_of").join(selected, "sample_id").join(of, "context_id").join(events.select("session_id", "event_id", "sequence", "content"), ["session_id", "event_id"])
    pool = pool.where("sequence <= as_of").join(excluded.select("sample_id", "event_id"), ["sample_id", "event_id"], "left_anti")
    scope = ["sample_id", "context_id"]
    asked = checkpoints.select("sample_id", "query").join(selected, "sample_id").withColumn("_q", F.lit(0))
    lexical = search.bm25(asked, pool, "_q", "event_id", "query", "content", corpus=scope).select(*scope, "event_id", F.col("score").alias("lexical"))
    cos = search.dense(asked, pool, "_q", "event_id", "query", "content", corpus=scope).select(*scope, "event_id", F.greatest("score", F.lit(0.0)).alias("dense"))
    s = pool.join(lexical, [*scope, "event_id"], "left").join(cos, [*scope, "event_id"], "left").fillna(0.0, ["lexical", "dense"])
    w = Window.partitionBy(*scope)
    share = lambda c: F.col(c) / F.when(F.max(c).over(w) > 0, F.max(c).over(w)).otherwise(1.0)
    score = WEIGHTS["lexical"] * share("lexical") + WEIGHTS["dense"] * share("dense") + WEIGHTS["relevance"] * F.coalesce("relevance", F.lit(0.0))
    return s.select("sample_id", "session_id", "as_of", "context_id", "event_id", "sequence", F.round(score, 9).alias("score"))


def members(scored: DataFrame, events: DataFrame, assignments: DataFrame) -> DataFrame:
    """Of each scored (sample, context, anchor) the events of its group: itself; a call's results, or a result's
    call and that one's results; causal neighbours at a distance of one in the same context."""
    e = events.select("session_id", "event_id", "sequence", "kind", "parent_event_id")
    anchor = scored.select("sample_id", "session_id", "as_of", "context_id", F.col("event_id").alias("anchor"), "score").join(
        e.select("session_id", F.col("event_id").alias("anchor"), F.col("sequence").alias("at"), F.col("kind").alias("anchor_kind"), F.col("parent_event_id").alias("anchor_parent")), ["session_id", "anchor"]
    )
    keys = ["sample_id", "session_id", "as_of", "context_id", "anchor", "score", "at"]
    own = anchor.select(*keys, F.col("anchor").alias("event_id"), F.col("at").alias("sequence"))
    root = anchor.where("anchor_kind IN ('tool_call', 'tool_result')").withColumn("root", F.when(F.col("anchor_kind") == "tool_call", F.col("anchor")).otherwise(F.col("anchor_parent")))
    # a result whose call is not causal stands alone, so the call is looked up first
    call = e.select("session_id", F.col("event_id").alias("root"), F.col("sequence").alias("root_at"))
    root = root.join(call, ["session_id", "root"]).where("root_at <= as_of")
    parent = root.select(*keys, F.col("root").alias("event_id"), F.col("root_at").alias("sequence"))
    child = root.select(*keys, "root").join(e.select("session_id", F.col("parent_event_id").alias("root"), "event_id", "sequence"), ["session_id", "root"]).where("sequence <= as_of").select(*keys, "event_id", "sequence")
    band = anchor.select(*keys, F.explode(F.array(F.col("at") - 1, F.col("at") + 1)).alias("sequence")).join(e.select("session_id", "event_id", "sequence"), ["session_id", "sequence"]).where("sequence <= as_of")
    band = band.join(assignments.select("event_id", "context_id").distinct(), ["event_id", "context_id"]).select(*keys, "event_id", "sequence")
    return own.union(parent).union(child).union(band).distinct()


def select_blocks(blocks: DataFrame, groups: DataFrame, budget: int = BUDGET, recent_share: float = RECENT_SHARE, floor: float = FLOOR, depth: int | None = None) -> DataFrame:
    """blocks (sample_id, section 'context' or 'recent', rank, context_id, event_id, cost); groups: members with
    costs -> (sample_id, place, section, context_id, event_id, cost), and what was dropped with its reason and
    no place.

    In this order: descriptors while they fit; recent events, newest first, under their share and what is left,
    shown in time order; groups by falling score that are not yet covered, round-robin over contexts, but those
    under the floor of their context's best (or beyond depth), each whole or not at all."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        sample, left, out, gone = pdf["sample_id"].iloc[0], budget, [], []
        rows = pdf.where(pdf["score"].isna()).dropna(subset=["section"])
        for r in rows[rows["section"] == "context"].sort_values("rank").itertuples():
            if r.cost <= left:
                out.append(("context", r.context_id, None, r.cost))
                left -= r.cost
            else:
                gone.append(("context", r.context_id, None, "token_budget"))
        used, chosen, share = 0, [], max(int(budget * recent_share), 1)
        for r in rows[rows["section"] == "recent"].sort_values("rank", ascending=False).itertuples():
            if used + r.cost <= share and r.cost <= left:
                chosen.append(("recent", None, r.event_id, r.cost))
                used, left = used + r.cost, left - r.cost
            else:
                gone.append(("recent", None, r.event_id, "recent_budget"))
        out += chosen[::-1]
        shown = {b[2] for b in chosen}
        # groups in the order of their anchors; an anchor that an earlier group of its context holds makes none
        queues: dict[str, list[tuple[float, list]]] = {}
        seen: set[tuple[str, str]] = set()
        g = pdf[pdf["score"].notna()]
        anchors = [((-k[1], k[2], k[0]), m) for k, m in g.groupby(["context_id", "score", "anchor"], sort=False)]
        for (negative, anchor, context), m in sorted(anchors, key=lambda a: a[0]):
            if (anchor, context) in seen:
                continue
            m = m.sort_values("sequence")
            seen.update((e, context) for e in m["event_id"])
            queues.setdefault(context, []).append((-negative, list(zip(m["event_id"], m["cost"], strict=True))))
        best, admitted = {c: q[0][0] for c, q in queues.items()}, dict.fromkeys(queues, 0)
        for k in range(max(map(len, queues.values()), default=0)):
            for context, q in queues.items():
                if k >= len(q):
                    continue
                score, events = q[k]
                new = [(e, c) for e, c in events if e not in shown]
                cost = sum(c for _, c in new)
                if depth is not None and admitted[context] >= depth:
                    reason = "minimal_sufficiency_depth"
                elif score < floor * best[context]:
                    reason = "minimal_sufficiency_floor"
                elif not new or cost > left:
                    reason = "token_budget"
                else:
                    out += [("evidence", context, e, c) for e, c in new]
                    shown.update(e for e, _ in new)
                    left, admitted[context] = left - cost, admitted[context] + 1
                    continue
                gone += [("evidence", context, e, reason) for e, _ in new]
        kept = [(sample, i, s, c, e, n, None) for i, (s, c, e, n) in enumerate(out)]
        return pd.DataFrame(kept + [(sample, None, s, c, e, 0, why) for s, c, e, why in gone], columns=["sample_id", "place", "section", "context_id", "event_id", "cost", "reason"]).astype({"place": "Int32"})

    names = ["sample_id", "section", "rank", "context_id", "event_id", "cost", "anchor", "score", "sequence"]
    none = lambda kind: F.lit(None).cast(kind)
    b = blocks.select("sample_id", "section", F.col("rank").cast("int"), "context_id", "event_id", F.col("cost").cast("long"), none("string").alias("anchor"), none("double").alias("score"), none("int").alias("sequence"))
    g = groups.select("sample_id", F.lit("evidence").alias("section"), none("int").alias("rank"), "context_id", "event_id", F.col("cost").cast("long"), "anchor", "score", F.col("sequence").cast("int"))
    return b.union(g).select(*names).groupBy("sample_id").applyInPandas(fold, "sample_id string, place int, section string, context_id string, event_id string, cost long, reason string")


def assemble(checkpoints: DataFrame, decisions: DataFrame, events: DataFrame, contexts: DataFrame, assignments: DataFrame, budget: int = BUDGET, mode: str = "prose", exclude_recent: bool = True) -> DataFrame:
    """decisions (request_id = sample_id, selected) -> a row per checkpoint: blocks in order with texts and spans,
    rendered, included and dropped events, sections, memory and input tokens.

    The token counter never joins across white space, so a text's count is the sum of its blocks': separators
    cost nothing and what fits block by block fits whole, in either mode."""
    picked = decisions.select(F.col("request_id").alias("sample_id"), F.posexplode(F.array_distinct("selected")).alias("rank", "context_id"))
    shown = checkpoints.select("sample_id", "session_id", "as_of").join(picked, "sample_id").join(contexts, ["session_id", "context_id"])
    described = shown.select("sample_id", F.lit("context").alias("section"), "rank", "context_id", F.lit(None).cast("string").alias("event_id"), descriptor_text().alias("text"))
    last = last_events(checkpoints, events, RECENT_TURNS, inclusive=False)
    recent = last.select("sample_id", F.lit("recent").alias("section"), F.col("sequence").alias("rank"), F.lit(None).cast("string").alias("context_id"), "event_id", event_text(F.lit("recent"), F.lit(None)).alias("text"))
    blocks = described.union(recent).withColumn("cost", T.token_count(F.col("text")))
    of = shown.select("sample_id", "context_id")
    excluded = last if exclude_recent else last.limit(0)
    scored = stored(evidence_scores(checkpoints, of, events, assignments, excluded), "scores")
    full = events.select("session_id", "event_id", "actor", "kind", "content")
    grouped = members(scored, events, assignments).join(full, ["session_id", "event_id"]).withColumn("cost", T.token_count(event_text(F.lit("evidence"), F.col("context_id"))))
    done = stored(select_blocks(blocks, grouped, budget), "blocks")
    kept = done.where("place IS NOT NULL").join(checkpoints.select("sample_id", "session_id"), "sample_id")
    facts = events.select("session_id", "event_id", "sequence", "actor", "kind", "content")
    kept = kept.join(facts, ["session_id", "event_id"], "left").join(contexts.select("session_id", "context_id", "name", "goal", "summary"), ["session_id", "context_id"], "left")
    prose = F.when(F.col("section") == "context", descriptor_text()).otherwise(event_text(F.col("section"), F.col("context_id")))
    kept = kept.withColumn("prose", prose).withColumn("text", F.col("prose") if mode == "prose" else index_row(F.col("place"), F.col("section"), F.col("prose")))
    separator = "\n\n" if mode == "prose" else "\n"
    w = Window.partitionBy("sample_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + len(separator)).over(w) - len(separator)
    kept = kept.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))
    one = F.struct("place", "section", "context_id", "event_id", "text", "start", "end")
    rows = kept.groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"), F.sum(T.token_count(F.col("text"))).alias("memory_tokens"))
    dropped = done.where("place IS NULL").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("reason", "event_id", "context_id"))).alias("dropped"))
    field = lambda name: F.transform("blocks", lambda b: b[name])
    none = F.array().cast("array<struct<place:int,section:string,context_id:string,event_id:string,text:string,start:bigint,end:bigint>>")
    out = checkpoints.select("sample_id", "query").join(rows, "sample_id", "left").join(dropped, "sample_id", "left")
    out = out.withColumn("blocks", F.coalesce("blocks", none)).withColumn("memory_tokens", F.coalesce("memory_tokens", F.lit(0)).cast("long"))
    return out.select(
        "sample_id", "blocks", F.array_join(field("text"), separator).alias("rendered"), F.filter(field("event_id"), lambda e: e.isNotNull()).alias("included"), F.array_distinct(field("section")).alias("sections"),
        "dropped", "memory_tokens", (F.col("memory_tokens") + T.token_count(F.col("query"))).alias("total_input_tokens"),
    )


def last_events(checkpoints: DataFrame, events: DataFrame, n: int, inclusive: bool) -> DataFrame:
    """Of each checkpoint its last n events in the session, before it or up to it, with a place from the latest."""
    own = checkpoints.select("sample_id", "session_id", "as_of")
    near = own.join(events, "session_id").where(F.col("sequence") <= F.col("as_of") if inclusive else F.col("sequence") < F.col("as_of"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("sequence")))
    return near.withColumn("place", place).where(F.col("place") <= n)
