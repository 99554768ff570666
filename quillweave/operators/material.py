"""Evidence material per context, controls, pair features, sweeps and vectors by latent semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import stored
from . import arms, search

MATERIAL = 4
RARE = 5  # documents that a rare term is in at most


def context_material(queries: DataFrame, events: DataFrame, limit: int = MATERIAL, cut: int = 400) -> DataFrame:
    """queries (sample_id, query), events (sample_id, context_id, event_id, sequence, content): those of each
    context that a sample may see -> (sample_id, context_id, material): the limit best by BM25 within the
    context, in their order, each cut short; where none shares a word, the context's last ones."""
    scope = ["sample_id", "context_id"]
    asked = queries.join(events.select(*scope).distinct(), "sample_id").withColumn("_q", F.lit(0))
    scored = events.join(search.bm25(asked, events, "_q", "event_id", "query", "content", corpus=scope).select(*scope, "event_id", "score"), [*scope, "event_id"], "left").fillna(0.0, ["score"])
    w = Window.partitionBy(*scope)
    best = F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "event_id"))
    last = F.row_number().over(w.orderBy(F.desc("sequence")))
    s = scored.withColumns({"_any": F.max("score").over(w) > 0, "_best": best, "_last": last})
    s = s.where(F.when(F.col("_any"), (F.col("_best") <= limit) & (F.col("score") > 0)).otherwise(F.col("_last") <= limit))
    one = F.array_sort(F.collect_list(F.struct("sequence", T.excerpt(F.col("content"), cut).alias("t"))))
    return s.groupBy(*scope).agg(F.array_join(F.transform(one, lambda x: x["t"]), "\n").alias("material"))


def plausibility(queries: DataFrame, events: DataFrame) -> DataFrame:
    """(sample_id, context_id, plausibility, is_control): a context's best BM25 score among all of the sample's events;
    those without any, and the least plausible one, are controls."""
    asked = queries.withColumn("_q", F.lit(0))
    one = events.dropDuplicates(["sample_id", "event_id"])
    score = search.bm25(asked, one, "_q", "event_id", "query", "content", corpus=["sample_id"]).select("sample_id", "event_id", "score")
    p = events.join(score, ["sample_id", "event_id"], "left").groupBy("sample_id", "context_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("plausibility"))
    least = p.groupBy("sample_id").agg(F.min_by("context_id", F.struct(F.round("plausibility", 9), "context_id")).alias("_least"))
    return p.join(least, "sample_id").withColumn("is_control", (F.col("plausibility") == 0) | (F.col("context_id") == F.col("_least"))).drop("_least")


def material_tokens(materials: DataFrame) -> DataFrame:
    return materials.groupBy("sample_id").agg(F.sum(T.token_count(F.col("material"))).alias("material_tokens"))


def pair_features(pairs: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """pairs (query_id, id, query, text), df (term, df) over n texts -> eight features of each pair: the share of the
    query's terms, and of their idf, that the text holds; rare terms and the greatest idf among them; whether two
    words stand together in both; shared identifiers; the text's tokens; how often its commonest query term occurs."""
    terms = pairs.select("query_id", "id", F.explode(T.tokens(F.col("query"))).alias("term"), T.tokens(F.col("text")).alias("own")).join(df, "term", "left")
    idf = F.log1p((n - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5))
    held = F.array_contains("own", F.col("term"))
    by = terms.withColumns({"_idf": idf, "_in": held}).groupBy("query_id", "id").agg(
        F.avg(F.col("_in").cast("double")).alias("query_coverage"), F.try_divide(F.sum(F.when(F.col("_in"), F.col("_idf"))), F.sum("_idf")).alias("idf_coverage"),
        F.count_if(F.col("_in") & (F.coalesce("df", F.lit(0)) <= RARE)).alias("rare_hits"), F.coalesce(F.max(F.when(F.col("_in"), F.col("_idf"))), F.lit(0.0)).alias("max_idf_present"),
        F.count_if(F.col("_in") & F.col("term").rlike("[_./:]|[0-9]")).alias("identifier_overlap"),
    )
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    two = lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    q, t = words("query"), words("text")
    often = F.array_max(F.transform(q, lambda x: F.size(F.filter(t, lambda y: y == x))))
    shape = pairs.select("query_id", "id", F.arrays_overlap(two(q), two(t)).alias("bigram_hit"), T.token_count(F.col("text")).alias("candidate_tokens"), F.coalesce(often, F.lit(0)).alias("max_query_tf"))
    return by.fillna(0.0, ["idf_coverage"]).join(shape, ["query_id", "id"])


def paired(results: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(sample_id, session_id, a, b): both arms' value on the checkpoints that both have."""
    of = lambda arm, name: results.where(F.col("arm") == arm).select("sample_id", "session_id", F.col(value).alias(name))
    return of(a, "a").join(of(b, "b"), ["sample_id", "session_id"])


def sweep(checkpoints: DataFrame, events: DataFrame, contexts: DataFrame, assignments: DataFrame, budgets: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """Means per arm, budget and query type."""
    out = None
    for budget in budgets:
        for name in names:
            r = arms.score(name, arms.assemble_arm(name, checkpoints, events, contexts, assignments, budget), checkpoints, events)
            s = r.groupBy("arm", "query_type").agg(F.avg("memory_tokens").alias("mean_memory_tokens"), F.avg("evidence_recall").alias("evidence_recall"), F.avg("reachability").alias("reachability")).withColumn("budget", F.lit(budget))
            out = s if out is None else out.union(s)
    return out


def corpus_sample(units: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """units (question_id, id, gold) cut to size a question: all that are right stay, and of the others those whose
    seeded hash is least."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("question_id").cast("string"), F.col("id").cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("gold"), order, "id"))
    return units.withColumn("_p", place).where((F.col("_p") <= size) | F.col("gold")).drop("_p")


def overlap_buckets(cases: DataFrame, query: str, gold: str, hit: str, buckets: int = 4) -> DataFrame:
    """Recall by the share of the query's words that the right text has."""
    q = T.tokens(F.col(query))
    share = F.size(F.array_intersect(q, T.tokens(F.col(gold)))) / F.greatest(F.size(q), F.lit(1))
    return cases.groupBy(F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("cases"), F.avg(F.col(hit).cast("double")).alias("recall"))


def retrieve(questions: DataFrame, units: DataFrame, mode: str = "lexical", k: int = 5, decisions: DataFrame | None = None) -> DataFrame:
    """questions (question_id, query), units (id, text) -> (question_id, id, place): the k best windows by one channel
    or both fused; `router` gives a decision's selected ones first, then its candidates in their order."""
    if mode == "router":
        d = decisions.select(F.col("request_id").alias("question_id"), F.posexplode(F.array_distinct(F.concat("selected", F.transform("candidates", lambda c: c["context_id"])))).alias("place", "id"))
        return d.where(F.col("place") < k).select("question_id", "id", (F.col("place") + 1).cast("long").alias("place"))
    lexical = lambda: search.top(search.bm25(questions.withColumnRenamed("query", "text"), units, "question_id", "id"), "question_id", "id", 1 << 30 if mode == "hybrid" else k)
    cosine = lambda: search.top(search.dense(questions.withColumnRenamed("query", "text"), units, "question_id", "id"), "question_id", "id", 1 << 30 if mode == "hybrid" else k)
    if mode == "hybrid":
        return search.top(search.rrf([(lexical(), 1.0), (cosine(), 1.0)], "question_id", "id"), "question_id", "id", k).select("question_id", "id", F.col("rank").alias("place"))
    return (lexical() if mode == "lexical" else cosine()).select("question_id", "id", F.col("rank").alias("place"))


def router_profile(policy: dict, ranker: str, embedding: str = "md5-256") -> str:
    return "|".join([f"ranker={ranker}", f"embedding={embedding}", *(f"{k}={policy[k]}" for k in sorted(policy))])


def lsa(texts: DataFrame, key: str, text: str, width: int = 64, seed: int = 0) -> DataFrame:
    """(key, vector, version): TF-IDF of tokens, its leading singular directions (as many as there are), length 1.

    The vocabulary and the Gram matrix of its terms are held by the driver, so this is for catalogs and not for
    corpora; an empty table is an error. Directions are fixed up to their signs."""
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    t = stored(texts.select(key, T.tokens(F.col(text)).alias("_t")), "lsa")
    if t.isEmpty():
        raise ValueError("no texts")
    counted = CountVectorizer(inputCol="_t", outputCol="_c", minDF=1).fit(t)
    weighted = IDF(inputCol="_c", outputCol="_w").fit(c := counted.transform(t)).transform(c)
    wide = max(min(width, len(counted.vocabulary) - 1, t.count()), 1)
    rows = weighted.select(key, "_w").rdd.map(lambda r: (r[0], Vectors.fromML(r[1])))  # computeSVD exists for rows of RDDs only
    v = RowMatrix(rows.values()).computeSVD(wide, False).V.toArray()

    def project(w: Column) -> Column:
        import numpy as np

        def run(batch):
            import pandas as pd

            out = []
            for x in batch:
                y = np.asarray(x) @ v
                n = np.linalg.norm(y)
                out.append((y / n if n else y).tolist())
            return pd.Series(out)

        return F.pandas_udf(run, "array<double>")(w)

    from pyspark.ml.functions import vector_to_array

    return weighted.select(key, project(vector_to_array("_w")).alias("vector"), F.lit(f"lsa-{v.shape[1]}").alias("version"))
