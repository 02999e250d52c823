"""Metrics of a request stream. An extension: the batch metrics on event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id string, ts timestamp, received_at timestamp, route string, principal_id string, question string, top_k int, retrieval_mode string, latency_ms double, cache_outcome string, status_code int, outcome string, source_ids array<string>"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REQUEST).parquet(folder)


def windowed_metrics(requests: DataFrame, width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Per window and route: requests, errors, summed latency. Repeated deliveries count once; rows later than ``late`` are dropped."""
    once = requests.where("request_id is not null and ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "route").agg(F.count("*").alias("n"), F.sum((F.col("status_code") >= 400).cast("int")).alias("errors"), F.round(F.sum("latency_ms"), 3).alias("total_ms")).select(F.col("w.start").alias("window_start"), "route", "n", "errors", "total_ms")
