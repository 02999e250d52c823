"""Metrics and audit records of a request log."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the histograms of durations (ms) and of retrieval scores.
BOUNDS_MS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)
BOUNDS_SCORE = (-1.0, -0.5, 0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def one_delivery(log: DataFrame) -> DataFrame:
    """One row per request: the one that was received last."""
    value = F.struct(*[F.col(c) for c in log.columns if c != "request_id"])
    order = F.struct("received_at", F.col("latency_ms"), "ts")
    return log.where("request_id is not null").groupBy("request_id").agg(F.max_by(value, order).alias("r")).select("request_id", "r.*")


def latency_summary(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, min, mean, nearest-rank p50 and p95, p99 from 1,000 samples on, max; in ms, 3 places."""
    v = log.where("latency_ms is not null")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by latency_ms)")
    r = lambda c, name: F.round(c, 3).alias(name)
    return v.groupBy(*keys).agg(F.count("*").alias("n"), r(F.min("latency_ms"), "min_ms"), r(F.avg("latency_ms"), "mean_ms"), r(p(0.5), "p50_ms"), r(p(0.95), "p95_ms"), r(F.when(F.count("*") >= 1000, p(0.99)), "p99_ms"), r(F.max("latency_ms"), "max_ms"))


def histogram(log: DataFrame, keys: Sequence[str], bounds: Sequence[float] = BOUNDS_MS, value: str = "latency_ms", places: int = 3) -> DataFrame:
    """Cumulative counts per bound, +Inf, count and sum, one row per (keys, bound); null values are left out."""
    v = log.where(F.col(value).isNotNull())
    wide = v.groupBy(*keys).agg(*[F.sum((F.col(value) <= b).cast("bigint")).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias("n"), F.round(F.sum(value), places).alias("total"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("cumulative")) for k, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cumulative"))]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c"), "n", "total").select(*keys, "c.le", "c.cumulative", "n", "total")


def counters(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts over the whole grid of label values, 0 where a pair never occurs."""
    got = log.groupBy(*keys).agg(F.count("*").alias("n"))
    grid = log.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(log.select(k).distinct())
    on = None
    named = got.select(*[F.col(k).alias(f"__{k}") for k in keys], "n")
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return grid.join(named, on, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def scenario_summary(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests, errors, requests a second over the span of time, and a histogram of statuses."""
    by_status = log.groupBy(*keys, "status_code").agg(F.count("*").alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    out = by_status.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("status_code") >= 400, F.col("c")).otherwise(0)).alias("errors"), F.min("a").alias("a"), F.max("b").alias("b"), F.array_join(F.array_sort(F.collect_list(F.format_string("%d:%d", "status_code", "c"))), ",").alias("statuses"))
    span = F.unix_micros("b") - F.unix_micros("a")
    return out.select(*keys, "n", "errors", F.when(span > 0, F.round(F.col("n") / (span / 1e6), 6)).alias("qps"), "statuses")


def delta(before: DataFrame, after: DataFrame, key: str, value: str = "n") -> DataFrame:
    """after minus before by key; what is missing on a side counts as 0."""
    b, a = before.select(key, F.col(value).alias("b")), after.select(key, F.col(value).alias("a"))
    return b.join(a, key, "full_outer").select(key, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


def usage_delta(usage: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """What each reading of a cumulative counter adds to the one before, never below 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return usage.withColumn("claimed", F.greatest(F.lit(0), F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))))


def _labels(labels: Sequence[str]) -> Column:
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])


def exposition(metrics: DataFrame, name: str, labels: Sequence[str], value: str, help_text: str = "", kind: str = "counter") -> DataFrame:
    """(place, line): the HELP and TYPE lines, then ``name{label="value",...} number`` in the order of the labels.

    ``place`` orders the lines; a sort of few rows is left to the writer.
    """
    spark = metrics.sparkSession
    head = spark.createDataFrame([(f"0{k}", x) for k, x in enumerate((f"# HELP {name} {help_text}", f"# TYPE {name} {kind}"))], "place string, line string")
    shown = F.regexp_replace(F.col(value).cast("string"), r"\.0$", "")
    rows = metrics.select(F.concat(F.lit("1"), _labels(labels)).alias("place"), F.concat(F.lit(name + "{"), _labels(labels), F.lit("} "), shown).alias("line"))
    return head.unionByName(rows)


def histogram_exposition(hist: DataFrame, name: str, labels: Sequence[str], help_text: str = "") -> DataFrame:
    """(place, line) of what ``histogram`` gives: the buckets in order, +Inf, sum and count of each set of labels."""
    spark = hist.sparkSession
    head = spark.createDataFrame([(f"0{k}", x) for k, x in enumerate((f"# HELP {name} {help_text}", f"# TYPE {name} histogram"))], "place string, line string")
    own = _labels(labels)
    le = F.when(F.col("le") == "+Inf", F.col("le")).otherwise(F.regexp_replace("le", r"\.0$", ""))
    order = F.when(F.col("le") == "+Inf", "2").otherwise(F.concat(F.lit("1"), F.lpad(F.format_string("%.3f", F.col("le").cast("double") + 1e6), 14, "0")))
    bucket = hist.select(F.concat(F.lit("1"), own, F.lit("\u0001"), order).alias("place"), F.concat(F.lit(f"{name}_bucket{{"), own, F.lit(',le="'), le, F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))
    last = hist.where("le = '+Inf'")
    total = last.select(F.concat(F.lit("1"), own, F.lit("\u00013")).alias("place"), F.concat(F.lit(f"{name}_sum{{"), own, F.lit("} "), F.format_string("%.3f", "total")).alias("line"))
    count = last.select(F.concat(F.lit("1"), own, F.lit("\u00014")).alias("place"), F.concat(F.lit(f"{name}_count{{"), own, F.lit("} "), F.col("n").cast("string")).alias("line"))
    return head.unionByName(bucket).unionByName(total).unionByName(count)


@F.pandas_udf(T.StringType())
def _hmac(domain: pd.Series, value: pd.Series, salt: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else hmac.new(s.encode(), f"{d}\0{v}".encode(), hashlib.sha256).hexdigest() for d, v, s in zip(domain, value, salt)])


def audit_records(log: DataFrame, salt: str, text_chars: int = 0) -> DataFrame:
    """What may be kept of a request: digests in place of principal and question, source ids, timing.

    A blank or null principal is 'anonymous'; a source id of other characters than letters, digits and ``._:-``
    is replaced by a digest.
    """
    blank = F.coalesce(F.trim("principal_id"), F.lit("")) == ""
    odd = F.transform(F.coalesce("source_ids", F.array().cast("array<string>")), lambda s: F.when(s.rlike(r"^[A-Za-z0-9._:-]{1,128}$"), s).otherwise(F.concat(F.lit("s_"), F.sha2(F.concat(F.lit(salt), s), 256))))
    out = log.select("request_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), "route", F.when(blank, "anonymous").otherwise(F.concat(F.lit("p_"), _hmac(F.lit("principal"), F.trim("principal_id"), F.lit(salt)))).alias("principal_id"), F.concat(F.lit("q_"), _hmac(F.lit("query"), F.col("question"), F.lit(salt))).alias("query_hash"), "top_k", "retrieval_mode", F.size(odd).alias("n_sources"), odd.alias("source_ids"), F.round(F.greatest(F.lit(0.0), "latency_ms"), 3).alias("latency_ms"), "cache_outcome", "status_code", "outcome", *([F.left("question", F.lit(text_chars)).alias("query_text")] if text_chars else []))
    return out


def write_audit(records: DataFrame, path: str) -> None:
    """Appends audit records as JSON lines; a stream of them goes there by ``audit_stream``."""
    records.write.mode("append").json(path)


def audit_stream(log: DataFrame, salt: str, path: str, checkpoint: str):
    """Starts a query that writes the audit records of a stream of requests as JSON lines, each once, and ends when all that is there is written."""
    return audit_records(log, salt).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completion(log: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """The alert of each request: error, empty, slow or none."""
    alert = F.when(F.col("status_code") >= 500, "error").when(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, "empty").when(F.col("latency_ms") > slow_ms, "slow").otherwise("none")
    return log.select("request_id", "outcome", "cache_outcome", alert.alias("alert"))


def cache_misses(questions: DataFrame, cached: DataFrame) -> DataFrame:
    """(query_hash, question): distinct normalized questions that aren't cached yet."""
    from quillfold.functions.text import normalize_question

    q = questions.where("question is not null").select(normalize_question(F.col("question")).alias("question")).distinct().withColumn("query_hash", F.sha2("question", 256))
    return q.join(cached.select("query_hash").distinct(), "query_hash", "left_anti")
