"""Routing of requests to contexts: three channels, their union, nine features, probability, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rank, search

# Fixed values of the policy.
PER_CHANNEL = 10
MAX_CANDIDATES = 20
CHANNELS = ("dense", "lexical", "entity")


def searchable(c: DataFrame) -> Column:
    """Name, goal, summary, entities and terms of a context, a line each."""
    return F.concat_ws("\n", "name", "goal", "summary", F.array_join("entities", " "), F.array_join("terms", " "))


def candidates(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """requests (request_id, query, primary_id, recent_ids, as_of), contexts (request_id, context_id, name,
    goal, summary, entities, terms, last_active): those visible to each request -> a row per candidate
    with ranks, rrf, features, p, reasons.

    A channel gives its PER_CHANNEL best; the primary and recent contexts are candidates without a
    channel too; MAX_CANDIDATES by fused rank stay. Normalisers: rrf over all candidates, dense and
    entity over all contexts, lexical over its best only."""
    docs = contexts.withColumn("text", searchable(contexts)).select("request_id", "context_id", "text", "entities", "last_active")
    asked = requests.select("request_id", F.col("request_id").alias("_q"), F.col("query").alias("text"))
    scope = ["request_id"]
    lexical = search.top(search.bm25(asked, docs, "_q", "context_id", corpus=scope), "_q", "context_id", PER_CHANNEL).select("request_id", "context_id", F.col("score").alias("lexical"), F.col("rank").alias("lexical_rank"))
    cos = search.dense(asked, docs, "_q", "context_id", corpus=scope).select("request_id", "context_id", F.greatest("score", F.lit(0.0)).alias("dense"))
    by = Window.partitionBy("request_id")
    order = lambda c: F.row_number().over(by.orderBy(F.desc(F.round(c, 9)), "context_id")).cast("long")
    ranked = lambda c: F.when((F.col(c) > 0) & (F.col(f"_{c}") <= PER_CHANNEL), F.col(f"_{c}"))
    facts = requests.select("request_id", F.col("query").alias("_query"), "primary_id", "recent_ids", "as_of")
    a = docs.select("request_id", "context_id", "entities", "last_active").join(facts, "request_id").join(cos, ["request_id", "context_id"], "left").join(lexical, ["request_id", "context_id"], "left")
    a = a.withColumn("entity", search.entity_score(F.col("_query"), F.col("entities"))).fillna(0.0, ["dense"])
    a = a.withColumns({"_dense": order("dense"), "_entity": order("entity")}).withColumns({"dense_rank": ranked("dense"), "entity_rank": ranked("entity")})
    n = sum((F.col(f"{c}_rank").isNotNull().cast("int") for c in CHANNELS), F.lit(0))
    rrf = sum((F.coalesce(1.0 / (search.RRF + F.col(f"{c}_rank")), F.lit(0.0)) for c in CHANNELS), F.lit(0.0))
    share = search.share_of_best
    a = a.withColumns({
        "rrf_score": rrf, "agreement": n / 3.0, "primary": F.coalesce(F.col("context_id") == F.col("primary_id"), F.lit(False)).cast("double"),
        "recent": F.coalesce(F.array_contains("recent_ids", F.col("context_id")), F.lit(False)).cast("double"),
        "f_dense": share(F.col("dense"), "request_id"), "f_entity": share(F.col("entity"), "request_id"), "f_lexical": F.coalesce(share(F.col("lexical"), "request_id"), F.lit(0.0)),
    }).where((F.col("agreement") > 0) | (F.col("primary") > 0) | (F.col("recent") > 0))
    a = a.withColumn("f_rrf", share(F.col("rrf_score"), "request_id"))
    a = a.withColumn("_place", F.row_number().over(by.orderBy(F.desc(F.round("rrf_score", 9)), "context_id"))).where(F.col("_place") <= MAX_CANDIDATES)
    relation = T.relation(F.col("_query"))
    match = F.when((relation == "continue") & (F.col("primary") > 0), 1.0).when((relation == "cross_context") & (F.col("primary") + F.col("recent") > 0), 0.6).otherwise(0.0)
    features = {"rrf": F.col("f_rrf"), "dense": F.col("f_dense"), "lexical": F.col("f_lexical"), "entity": F.col("f_entity"), "agreement": F.col("agreement"), "primary": F.col("primary"), "recent": F.col("recent"), "recency": rank.recency(F.col("as_of"), F.col("last_active")), "relation_match": match}
    reasons = F.filter(F.array(*(F.when(F.col(f"{c}_rank").isNotNull(), c) for c in CHANNELS), F.when(F.col("primary") > 0, "primary"), F.when(F.col("recent") > 0, "recent")), lambda r: r.isNotNull())
    return a.select(
        "request_id", "context_id", relation.alias("relation"), *(f"{c}_rank" for c in CHANNELS), "rrf_score", reasons.alias("reasons"),
        F.struct(*(v.alias(k) for k, v in features.items())).alias("features"), rank.probability(features).alias("p"),
    )


def route(requests: DataFrame, contexts: DataFrame, maximum: int = 3) -> DataFrame:
    """A row per request: decision, relation, selected, confidence, candidates (context, p, reasons) in their
    order, fallback_level, trace. A request that sees no context starts a new one or abstains."""
    c = candidates(requests, contexts)
    # ties of p are ties after nine digits, so that sums in another order rank alike
    flat = c.select("request_id", "context_id", F.round("p", 9).alias("p"), F.col("features.agreement").alias("agreement"), "relation")
    done = rank.select(flat, "request_id", "context_id", maximum)
    one = F.struct(-F.round("p", 9), F.col("context_id"), F.col("reasons"), F.col("rrf_score"))
    lists = c.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["context_id"].alias("context_id"), (-x["col1"]).alias("p"), x["reasons"].alias("reasons"))).alias("candidates"))
    relation = T.relation(F.col("query"))
    out = requests.select("request_id", "query").join(done, "request_id", "left").join(lists, "request_id", "left").withColumn("relation", relation)
    empty = F.when(F.col("relation") == "new_context", "new_context_candidate").otherwise("abstain")
    return out.select(
        "request_id", F.coalesce("decision", empty).alias("decision"), "relation", T.relation_probabilities(F.col("query")).alias("relation_probabilities"),
        F.coalesce("selected", F.array().cast("array<string>")).alias("selected"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("candidates", F.array()).alias("candidates"), F.when(F.col("decision") == "route", 0).otherwise(1).alias("fallback_level"),
        F.concat(F.lit("route:"), F.col("request_id").cast("string")).alias("trace_id"), F.when(F.col("decision").isNull(), "empty").otherwise("bm25+hash").alias("index_version"),
    )


def oracle(checkpoints: DataFrame) -> DataFrame:
    """The decision that the labels imply."""
    return checkpoints.select(
        F.col("sample_id").alias("request_id"), F.lit("route").alias("decision"), F.col("relation_label").alias("relation"), F.col("required_ids").alias("selected"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("oracle:"), "sample_id").alias("trace_id"),
    )


def index_versions(contexts: DataFrame, group: str) -> DataFrame:
    """Per group the first 16 digits of a sha256 over its contexts' own, in order: a row a context is
    hashed where it is, and only digests meet."""
    own = contexts.select(group, "context_id", F.sha2(F.to_json(F.struct(*sorted(contexts.columns))).cast("binary"), 256).alias("_h"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("context_id", "_h"))), lambda x: x["_h"])
    return own.groupBy(group).agg(F.left(F.sha2(F.array_join(each, "").cast("binary"), 256), F.lit(16)).alias("index_version"))


# The tuner's grid and its constraints.
GRID = {"t_low": (0.20, 0.30, 0.40, 0.50, 0.60), "t_high": (0.50, 0.60, 0.70, 0.80, 0.90), "margin": (0.05, 0.10, 0.20, 0.30, 0.40), "maximum": (1, 2, 3), "sure": (0.50, 0.60, 0.70, 0.80, 0.90)}
LEAST = {"recall": 0.95, "error": 0.02, "cross": 0.90}


def policy_grid(observations: DataFrame) -> DataFrame:
    """observations (required, relation, ranked: structs id, p by falling p) -> the measures of each policy of the grid.

    Of an observation a policy sees only how many of the grid's thresholds its probabilities reach, and what each
    low threshold and maximum would select. Observations that are alike in that are counted, and each
    kind meets the grid's 1,875 rows, which are broadcast, once; the kinds are as many as outcomes, not rows."""
    spark = observations.sparkSession
    grid = spark.range(1).drop("id")
    for name, values in GRID.items():
        grid = grid.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name))
    names = list(GRID)
    grid = grid.where("t_high >= t_low")
    r, cross = F.col("ranked"), F.col("relation") == "cross_context"
    p1, p2 = F.coalesce(F.get(r, F.lit(0))["p"], F.lit(0.0)), F.coalesce(F.get(r, F.lit(1))["p"], F.lit(0.0))
    ids = lambda a: F.transform(a, lambda x: x["id"])
    reached = lambda p, name: sum((F.when(p >= v, 1).otherwise(0) for v in GRID[name]), F.lit(0))
    outcome = lambda c: F.struct(F.size(F.array_intersect("required", c)).alias("hit"), F.size(c).alias("n"))

    def many(low: float, maximum: int) -> Column:
        some = ids(F.slice(F.filter(r, lambda x: x["p"] >= low), 1, maximum))
        return outcome(F.when(cross, F.array_union(some, ids(F.slice(r, 1, min(2, maximum))))).otherwise(some))

    kinds = observations.select(
        F.size("required").alias("need"), (F.coalesce(~cross, F.lit(False)) & (F.size(r) > 0)).alias("may_be_one"),
        reached(p1, "t_high").alias("high"), reached(p1 - p2, "margin").alias("apart"), reached(p1, "sure").alias("certain"),
        outcome(ids(F.slice(r, 1, 1))).alias("one"), F.array(*(many(low, m) for low in GRID["t_low"] for m in GRID["maximum"])).alias("many"),
    )
    kinds = kinds.groupBy(*kinds.columns).agg(F.count("*").alias("_n"))
    both = kinds.join(F.broadcast(grid))
    one = F.col("may_be_one") & (F.col("high") > F.col("_t_high")) & (F.col("apart") > F.col("_margin"))
    chosen = F.when(one, F.col("one")).otherwise(F.get("many", F.col("_t_low") * len(GRID["maximum"]) + F.col("_maximum")))
    both = both.withColumn("chosen", chosen)
    hit, need, size = F.col("chosen.hit"), F.col("need"), F.col("chosen.n")
    recall = F.when(need == 0, (size == 0).cast("double")).otherwise(hit / need)
    sure = F.col("certain") > F.col("_sure")
    mean = lambda v: F.sum(v * F.col("_n")) / F.nullif(F.sum(F.when(v.isNotNull(), F.col("_n"))), F.lit(0))
    # whole numbers and few digits, so sums in any order rank policies alike
    return both.groupBy(*names).agg(
        F.round(mean(recall), 9).alias("recall"), F.round(F.coalesce(mean(F.when(sure, (hit < need).cast("double"))), F.lit(0.0)), 9).alias("error"),
        F.round(F.coalesce(mean(F.when(need >= 2, recall)), F.lit(1.0)), 9).alias("cross"), F.round(mean(size), 9).alias("selected"),
    )


def tune(observations: DataFrame) -> DataFrame:
    """The policy that selects least among those within the constraints, or else the best; ties by the grid's order."""
    g = policy_grid(observations).withColumn("feasible", (F.col("recall") >= LEAST["recall"]) & (F.col("error") <= LEAST["error"]) & (F.col("cross") >= LEAST["cross"]))
    fit = F.col("feasible")
    keys = [F.when(fit, F.col("selected")).otherwise(-F.col("recall")), F.when(fit, -F.col("recall")).otherwise(-F.col("cross")), F.col("error"), F.col("selected")]
    return g.orderBy(F.desc("feasible"), *keys, *GRID).limit(1)


def standardised(rows: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean over their population deviation (1 where that is 0), and both."""
    s = rows.agg(*(f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scale = {c: (s[f"m_{c}"], s[f"s_{c}"] or 1.0) for c in features}
    return rows.withColumns({c: (F.col(c) - m) / d for c, (m, d) in scale.items()}), scale


def _logistic(rows: DataFrame, features: list[str], label: str) -> tuple[dict[str, float], float]:
    """Weights and intercept of a class-balanced logistic regression with an L2 penalty of 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        raise ValueError("rows of both labels are needed")
    total = n[0] + n[1]
    w = rows.withColumn("_w", F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])))
    v = VectorAssembler(inputCols=features, outputCol="_x").transform(w.select(label, "_w", *features))
    m = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(v)
    return dict(zip(features, map(float, m.coefficients.toArray()), strict=True)), float(m.intercept)


def fit_platt(train: DataFrame, held_out: DataFrame, features: list[str] | None = None, label: str = "relevant") -> dict:
    """The ranker: standardised features weighted on train, then slope and constant on held-out logits."""
    features = list(features or rank.WEIGHTS)
    x, scale = standardised(train, features)
    weights, intercept = _logistic(x, features, label)
    slope, constant = _logistic(held_out.withColumn("_z", _logit(scale, weights, intercept)), ["_z"], label)
    return {"features": features, "scale": scale, "weights": weights, "intercept": intercept, "slope": slope["_z"], "constant": constant, "semantics": SEMANTICS}


SEMANTICS = 1


def _logit(scale: dict[str, tuple[float, float]], weights: dict[str, float], intercept: float) -> Column:
    return sum((w * (F.col(c) - scale[c][0]) / scale[c][1] for c, w in weights.items()), F.lit(intercept))


def platt_score(ranker: dict) -> Column:
    return rank.platt(_logit(ranker["scale"], ranker["weights"], ranker["intercept"]), ranker["slope"], ranker["constant"])


def save_ranker(ranker: dict) -> str:
    import json

    return json.dumps(ranker, sort_keys=True)


def load_ranker(text: str, features: list[str] | None = None) -> dict:
    """Refuses a ranker of other features or another semantics version."""
    import json

    r = json.loads(text)
    if r.get("features") != list(features or rank.WEIGHTS):
        raise ValueError("the ranker has other features")
    if r.get("semantics") != SEMANTICS:
        raise ValueError("the ranker's features have another meaning")
    r["scale"] = {k: tuple(v) for k, v in r["scale"].items()}
    return r


def training_split(rows: DataFrame, session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(train, held out): sessions whose hash bucket of five is 0 are held out."""
    fold = T.fold5(F.col(session))
    return rows.where(fold != 0), rows.where(fold == 0)
