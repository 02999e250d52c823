"""Retrieval metrics, summaries of scores, gates and comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.text import miss_reason, normalize_source
from quillfold.functions.vectors import cosine


def labels(golden: DataFrame) -> DataFrame:
    """(qid, source, chunk_index) distinct; ``golden`` has (qid, relevant array<struct<source, chunk_index>>)."""
    return golden.select("qid", F.explode("relevant").alias("r")).select("qid", normalize_source(F.col("r.source")).alias("source"), F.col("r.chunk_index").alias("chunk_index")).distinct()


def cases(golden: DataFrame, run: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per (qid, k): hit, rr, recall, n_relevant, n_retrieved, first_rank, reason, capability, and what was retrieved in order.

    ``run`` has (qid, rank, source, chunk_index), retrieved once to the largest k. A label without
    a chunk is met by any chunk of its source. Repeated rows of ``golden`` count once.
    """
    g = golden.groupBy("qid").agg(F.min("capability").alias("capability"), F.min_by("relevant", F.to_json("relevant")).alias("relevant"))
    lab = labels(g)
    r = run.select("qid", "rank", normalize_source(F.col("source")).alias("source"), F.col("chunk_index").alias("found"))
    met = lab.join(r, ["qid", "source"]).where(F.col("chunk_index").isNull() | (F.col("chunk_index") == F.col("found"))).groupBy("qid", "source", "chunk_index").agg(F.min("rank").alias("rank"))
    by_label = met.groupBy("qid").agg(F.collect_list("rank").alias("ranks"))
    sizes = lab.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    got = r.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "source", F.col("found").alias("chunk_index")))).alias("got"))
    base = g.select("qid", "capability").join(sizes, "qid", "left").join(by_label, "qid", "left").join(got, "qid", "left").select("qid", "capability", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), F.coalesce("got", F.array().cast("array<struct<rank:int,source:string,chunk_index:int>>")).alias("got"))
    at = base.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    at = at.withColumn("n_matched", F.size(F.filter("ranks", lambda x: x <= F.col("k")))).withColumn("retrieved", F.filter("got", lambda x: x["rank"] <= F.col("k"))).withColumn("n_retrieved", F.size("retrieved"))
    first = F.array_min(F.filter("ranks", lambda x: x <= F.col("k")))
    positive = F.col("n_relevant") > 0
    return at.withColumn("first_rank", first).select("qid", "capability", "k", "n_relevant", "n_retrieved", "n_matched", "first_rank", F.when(positive, (F.col("n_matched") > 0).cast("int")).alias("hit"), F.when(positive, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("rr"), F.when(positive, F.col("n_matched") / F.col("n_relevant")).alias("recall"), miss_reason(F.col("n_matched"), F.col("n_relevant")).alias("reason"), "retrieved")


def summary(case: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Means per k, and per (k, capability), in one pass with grouping sets; ``capability`` is 'all' in the whole.

    ``extra`` columns (a mode, a run) are added to the keys. Hits, reciprocal ranks and recall are over
    questions with labels; the other two over those without.
    """
    case = case.withColumn("positive", F.col("n_relevant") > 0).withColumn("empty", (F.col("n_retrieved") == 0).cast("int"))
    keys = [F.col(c) for c in (*extra, "k")]
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    return case.groupingSets([keys, [*keys, F.col("capability")]], *keys, F.col("capability")).agg(F.when(F.grouping("capability") == 1, "all").otherwise(F.coalesce(F.col("capability"), F.lit("unknown"))).alias("slice"), F.count("*").alias("n"), mean("hit").alias("hit_rate"), mean("rr").alias("mrr"), mean("recall").alias("recall"), mean(F.when(~F.col("positive"), F.col("empty"))).alias("negative_empty_rate"), mean(F.when(~F.col("positive"), 1 - F.col("empty"))).alias("negative_false_recall_rate"), mean(F.when(F.col("positive"), F.col("empty"))).alias("positive_false_abstention_rate")).drop("capability")


def low_recall(case: DataFrame) -> DataFrame:
    """Questions with labels that aren't all found, and questions without labels that got anything."""
    return case.where(((F.col("n_relevant") > 0) & (F.col("recall") < 1)) | ((F.col("n_relevant") == 0) & (F.col("n_retrieved") > 0)))


def summarize(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, median, population deviation, median absolute deviation, min, max and n; nulls are left out."""
    v = values.where(F.col(value).isNotNull())
    first = v.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    # The second pass needs the medians: a small table of one row per key.
    medians = first.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("median").alias("__m"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    mad = v.join(medians, on).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("mad")).select(*[F.col(k).alias(f"__{k}") for k in keys], "mad")
    out = first.join(mad, on)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select(*keys, r("mean"), r("median"), r("stddev"), r("mad"), r("min"), r("max"), "n")


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """delta of the means of two summaries and whether it is larger than the larger deviation of the two."""
    b = before.select(key, F.col("mean").alias("before"), F.col("stddev").alias("sb"))
    a = after.select(key, F.col("mean").alias("after"), F.col("stddev").alias("sa"))
    return b.join(a, key).select(key, "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"), F.greatest("sb", "sa").alias("noise_band"), (F.abs(F.col("after") - F.col("before")) > F.greatest("sb", "sa")).alias("resolved"))


def verdict_gate(verdicts: DataFrame, thresholds: dict[str, float], margins: dict[str, float], sigma: float = 3.0) -> DataFrame:
    """Per metric of (qid, metric, value): mean, lowest median, largest deviation, failures, passed.

    A case fails if its median is under the threshold, a metric if its largest median absolute
    deviation times sigma is over the margin. Metrics without a threshold are reported and pass.
    """
    per_case = summarize(verdicts, ["qid", "metric"], "value")
    limit = F.create_map(*[x for m, t in thresholds.items() for x in (F.lit(m), F.lit(float(t)))])
    margin = F.create_map(*[x for m, t in margins.items() for x in (F.lit(m), F.lit(float(t)))])
    t, g = F.try_element_at(limit, F.col("metric")), F.try_element_at(margin, F.col("metric"))
    out = per_case.groupBy("metric").agg(F.round(F.avg("mean"), 6).alias("mean"), F.min("median").alias("lowest_median"), F.max("mad").alias("largest_mad"), F.sum(F.when(F.col("median") < t, 1).otherwise(0)).alias("failures"))
    return out.withColumn("passed", F.coalesce((F.col("failures") == 0) & (F.col("largest_mad") * sigma <= F.coalesce(g, F.lit(float("inf")))), F.lit(True)))


def replay(verdicts: DataFrame, thresholds: dict[str, float], margins: dict[str, float], sigma: float = 3.0, abstention: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(metrics, failures) of recorded verdicts (qid, capability, run_index, metric, value).

    Metrics are those of ``verdict_gate`` and, of negative questions, the rates ``abstained`` and ``fabricated``, of which the first
    must reach ``abstention`` and the second be 0. Failures are (kind, metric, qid, value, bound): a case under its
    threshold, the case that varies most beyond its margin, and negatives that were answered.
    """
    scores = verdicts.where(~F.col("metric").isin("abstained", "fabricated"))
    per_case = summarize(scores, ["qid", "metric"], "value")
    gated = verdict_gate(scores, thresholds, margins, sigma).select("metric", "mean", "lowest_median", "largest_mad", "failures", "passed")
    negative = verdicts.where(F.col("metric").isin("abstained", "fabricated"))
    wrong = F.when(F.col("metric") == "abstained", F.col("value") < 1).otherwise(F.col("value") > 0)
    rates = negative.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lowest_median"), F.lit(0.0).alias("largest_mad"), F.count_distinct(F.when(wrong, F.col("qid"))).alias("failures"))
    rates = rates.withColumn("passed", F.when(F.col("metric") == "abstained", F.col("mean") >= abstention).otherwise(F.col("mean") <= 0))
    limit = F.create_map(*[x for m, t in thresholds.items() for x in (F.lit(m), F.lit(float(t)))])
    margin = F.create_map(*[x for m, t in margins.items() for x in (F.lit(m), F.lit(float(t)))])
    t, g = F.try_element_at(limit, F.col("metric")), F.try_element_at(margin, F.col("metric"))
    low = per_case.where(F.col("median") < t).select(F.lit("median").alias("kind"), "metric", "qid", F.col("median").alias("value"), t.alias("bound"))
    wide = per_case.groupBy("metric").agg(F.max_by(F.struct("qid", "mad"), F.struct("mad", "qid")).alias("r")).where(F.col("r.mad") * sigma > g).select(F.lit("margin").alias("kind"), "metric", F.col("r.qid").alias("qid"), (F.col("r.mad") * sigma).alias("value"), g.alias("bound"))
    answered = negative.where(wrong).groupBy("metric", "qid").agg(F.avg("value").alias("value")).select(F.lit("negative").alias("kind"), "metric", "qid", "value", F.when(F.col("metric") == "abstained", F.lit(float(abstention))).otherwise(0.0).alias("bound"))
    return gated.unionByName(rates), low.unionByName(wide).unionByName(answered)


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the two has: missing or extra."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("extra")))


def judged_relevance(traces: DataFrame) -> DataFrame:
    """(qid, value): mean cosine of the reverse questions, 0 if all are noncommittal; (qid, cosine, noncommittal)."""
    return traces.groupBy("qid").agg(F.round(F.avg("cosine") * (1 - F.min(F.col("noncommittal").cast("int"))), 6).alias("value"))


def in_requested_order(rows: DataFrame, qids: Sequence[str]) -> DataFrame:
    """The rows of the asked questions with their place, in which they are to be shown; a question without rows is an error."""
    asked = rows.sparkSession.createDataFrame([(k, q) for k, q in enumerate(qids)], "place int, qid string")
    found = rows.withColumn("__here", F.lit(True))
    joined = F.broadcast(asked).join(found, "qid", "left")
    wrong = F.raise_error(F.concat(F.lit("no rows of the question "), "qid")).cast("string")
    return joined.withColumn("qid", F.when(F.col("__here").isNotNull(), F.col("qid")).otherwise(wrong)).drop("__here")


def semantic_baselines(variants: DataFrame) -> DataFrame:
    """(qid, variant_no, role, cosine): each variant's cosine to the original (variant 0), from (qid, variant_no, embedding)."""
    first = variants.where("variant_no = 0").select("qid", F.col("embedding").alias("__e"))
    role = F.when(F.col("variant_no") == 0, "original").otherwise(F.concat(F.lit("variant_"), F.col("variant_no").cast("string")))
    return variants.join(first, "qid").select("qid", "variant_no", role.alias("role"), F.round(cosine(F.col("embedding"), F.col("__e")), 6).alias("cosine"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
