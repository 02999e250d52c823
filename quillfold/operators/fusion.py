"""Reciprocal rank fusion of ranked lists, hybrid and multi-query retrieval."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
PATH_WEIGHTS = {"dense": 0.2, "sparse": 1.0}
ORIGINAL_WEIGHT, VARIANT_WEIGHT = 1.0, 0.7


def rrf(ranked: DataFrame, top: int, weights: Mapping[str, float] = PATH_WEIGHTS, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank, representative, dense_rank, sparse_rank) from (query_id, path, id, rank).

    Paths of weight 0 or less, or without a weight, are skipped. The lists are one long table, so
    any number of paths is one aggregation. The representative is the first path by name.
    """
    used = {p: w for p, w in weights.items() if w > 0}
    if k <= 0:
        raise ValueError("k must be positive")
    weight = F.create_map(*[x for p, w in used.items() for x in (F.lit(p), F.lit(float(w)))])
    part = weight[F.col("path")] / (F.lit(float(k)) + F.col("rank"))
    fused = ranked.where(F.col("path").isin(list(used))).groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.min("path").alias("representative"), F.min(F.when(F.col("path") == "dense", F.col("rank"))).alias("dense_rank"), F.min(F.when(F.col("path") == "sparse", F.col("rank"))).alias("sparse_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hybrid(dense: DataFrame, sparse: DataFrame, top: int, weights: Mapping[str, float] = PATH_WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Fuses two results of (query_id, id, rank)."""
    parts = [d.select("query_id", F.lit(p).alias("path"), "id", "rank") for p, d in (("dense", dense), ("sparse", sparse))]
    return rrf(parts[0].unionByName(parts[1]), top, weights, k)


def variants(questions: DataFrame, rewrites: DataFrame, limit: int) -> DataFrame:
    """(query_id, variant_no from 0, text): the question first, then its distinct rewrites.

    ``questions`` has (query_id, question), ``rewrites`` (question_key, pos, rewrite), joined by the
    normalized question. The limit is looked at after a variant was taken, so a limit of 1
    still gives one rewrite. Blank questions and rewrites are left out.
    """
    from quillfold.functions.text import normalize_question, strip

    if limit < 1:
        raise ValueError("limit must be 1 or more")
    q = questions.where(strip(F.col("question")) != "").select("query_id", strip(F.col("question")).alias("text"), normalize_question(F.col("question")).alias("key"))
    more = q.select("query_id", F.col("key").alias("question_key")).join(rewrites, "question_key").where(strip(F.col("rewrite")) != "").select("query_id", (F.col("pos") + 1).alias("pos"), strip(F.col("rewrite")).alias("text"), normalize_question(F.col("rewrite")).alias("key"))
    every = q.select("query_id", F.lit(0).alias("pos"), "text", "key").unionByName(more)
    first = Window.partitionBy("query_id", "key").orderBy("pos", "text")
    order = Window.partitionBy("query_id").orderBy("pos", "text")
    return every.withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("variant_no", F.row_number().over(order) - 1).where(F.col("variant_no") < max(limit, 2)).select("query_id", "variant_no", "text")


def multi_query(ranked: DataFrame, top: int, k: int = RRF_K, original: float = ORIGINAL_WEIGHT, variant: float = VARIANT_WEIGHT) -> DataFrame:
    """Fuses (query_id, variant_no, id, rank): the original weighs 1 by default, a rewrite 0.7; of weight 0 it is skipped."""
    weight = F.when(F.col("variant_no") == 0, float(original)).otherwise(float(variant))
    part = weight / (float(k) + F.col("rank"))
    ranked = ranked.where(weight > 0)
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
