"""Ranking by cosine and measures of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.text import trim_ws
from evispark.staging import broadcast_if_small, stage

#: Queries are sent to all vectors in blocks of at most so many.
MAX_QUERIES = 10_000
DEEPEST = 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector or vectors of unlike length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _scored(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q_id, vec_id, score, relevant): every vector but itself against each query of a stated set, which goes to the vectors block by block."""
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    parts = [F.broadcast(queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i) if blocks > 1 else queries) for i in range(blocks)]
    score = F.round(cosine(F.col("q_vec"), F.col("embedding")), 9)
    return reduce(DataFrame.unionByName, [vectors.join(q, F.col("vec_id") != F.col("q_id")).select("q_id", "vec_id", score.alias("score"), (F.col("label") == F.col("q_label")).alias("relevant")) for q in parts])


def rank_by_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q_id, vec_id, score, rank, relevant): the ``k`` nearest of ``vectors`` (vec_id, embedding, label) for a stated set of ``queries`` (q_id, q_label, q_vec).

    A query doesn't find itself. Scores are rounded to 9 places before ranking and ties go by id, so the order is the same on every machine. Each task keeps
    k a query before anything is shuffled.
    """
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    return _scored(queries, vectors).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked_with_first_hit(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """:func:`rank_by_cosine` to the deepest rank that is measured, and for queries without a hit so far one row more: their first hit, with its rank.

    That rank is one more than the number of vectors before the best relevant one, a count, so no query's vectors are ever ranked in one task.
    """
    top = stage(rank_by_cosine(queries, vectors, DEEPEST), "top")
    late = stage(queries.join(top.filter("relevant").select("q_id").distinct(), "q_id", "left_anti"), "late")
    if late.limit(1).count() == 0:
        return top
    scored = _scored(late, vectors)
    before = lambda c: F.struct(F.coalesce(c("score"), F.lit(-2.0)).alias("s"), (-c("vec_id")).alias("v"))
    best = scored.filter("relevant").groupBy("q_id").agg(F.max(before(F.col)).alias("best"))
    rows = scored.join(broadcast_if_small(best), "q_id").filter(before(F.col) > F.col("best")).groupBy("q_id").agg(F.count("*").alias("n"))
    hits = best.join(rows, "q_id", "left").select("q_id", (-F.col("best.v")).alias("vec_id"), F.col("best.s").alias("score"), F.lit(True).alias("relevant"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"))
    return top.unionByName(hits)


def numbered_queries(vectors: DataFrame, every: int = 100) -> DataFrame:
    """(q_id, q_label, q_vec): the vectors whose id is divisible by ``every``, as queries."""
    return vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"), F.col("embedding").alias("q_vec"))


def similar_entities(topics: DataFrame, entities: DataFrame, embeddings: DataFrame, kind: str, k: int, model: str | None = None) -> DataFrame:
    """(topic_id, entity_id, distance, rank): for each topic (topic_id, topic, vector) the ``k`` nearest of ``entities`` (entity_id) that have an embedding.

    ``embeddings`` is (entity_type, entity_id, model, embedding); without ``model`` an entity that has several stands once for each. A blank topic, or
    one without a vector, finds nothing.
    """
    asked = topics.filter((trim_ws("topic") != "") & F.col("vector").isNotNull())
    known = embeddings.filter(F.col("entity_type") == kind)
    known = known if model is None else known.filter(F.col("model") == model)
    rows = entities.select("entity_id").distinct().join(known.select("entity_id", "embedding"), "entity_id")
    pairs = rows.join(broadcast_if_small(asked.select("topic_id", "vector"), MAX_QUERIES), F.lit(True))
    scored = pairs.select("topic_id", "entity_id", F.round(1 - cosine(F.col("vector"), F.col("embedding")), 9).alias("distance"))
    w = Window.partitionBy("topic_id").orderBy(F.col("distance").asc_nulls_last(), "entity_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Measures per query at the fixed depths 5, 10 and 20; ``relevant`` is (q_id, n_relevant).

    Denominators stay 5 and 10 even if fewer come back; a query with nothing relevant has nulls only.
    """
    hit = F.col("relevant")
    within = lambda n: F.sum(F.when((F.col("rank") <= n) & hit, 1).otherwise(0))
    sums = ranked.groupBy("q_id").agg(
        within(5).alias("h5"), within(10).alias("h10"), within(20).alias("h20"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when((F.col("rank") <= 10) & hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    rows = relevant.join(sums, "q_id", "left")
    n = F.col("n_relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(10)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = lambda c: F.when(n > 0, F.round(F.coalesce(c, F.lit(0.0)), 3))
    return rows.select(
        "q_id", "n_relevant", some(F.col("h5") / 5).alias("precision_5"), some(F.col("h10") / 10).alias("precision_10"), some(F.col("h10") / n).alias("recall_10"), some(F.col("h20") / n).alias("recall_20"), some(1 / F.col("first")).alias("mrr"), some(F.col("dcg") / ideal).alias("ndcg_10")
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means over the queries that have something relevant, rounded to 3 places."""
    cols = [c for c in per_query.columns if c not in ("q_id", "n_relevant")]
    return per_query.filter("n_relevant > 0").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 3).alias(c) for c in cols])
