"""Results kept by key: of query embeddings, of retrieval and of answers.

A key is a digest of what a result depends on, the corpus with its version among it, so that a new
version of the index leaves old entries unread instead of wrong. A cache is a table (cache_key,
payload, stored_at); a batch of requests reads what is there and computes what isn't, once for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.text import normalize_question

KEY_VERSION = "cache-v1"
LAYERS = ("embedding", "retrieval", "answer")


def _json(c: Column, kind: str) -> Column:
    """A value as JSON, null included."""
    if kind in ("int", "bigint", "boolean", "smallint", "tinyint"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    # Spark writes one field; what stands around it is cut.
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))


def stable_json(df: DataFrame, parts: Mapping[str, Column]) -> Column:
    """``{"a":1,"b":"x"}``: keys in order, no spaces, letters as they are."""
    kinds = dict(df.select(*[c.alias(k) for k, c in parts.items()]).dtypes)
    cells = [x for k in sorted(parts) for x in (F.lit(f'"{k}":'), F.when(parts[k].isNull(), "null").otherwise(_json(parts[k], kinds[k])), F.lit(","))][:-1]
    return F.concat(F.lit("{"), *cells, F.lit("}"))


def with_key(df: DataFrame, layer: str, parts: Mapping[str, Column], namespace: str = "rag") -> DataFrame:
    """Adds ``cache_key``: ``namespace:cache-v1:layer:digest`` of the parts."""
    if layer not in LAYERS:
        raise ValueError("the layer must be embedding, retrieval or answer")
    return df.withColumn("cache_key", F.concat(F.lit(f"{namespace}:{KEY_VERSION}:{layer}:"), F.sha2(stable_json(df, parts), 256)))


def retrieval_parts(question: Column, corpus: str, version: int, top_k: Column, filter_json: Column, config: str) -> dict[str, Column]:
    """What a retrieval depends on; an answer depends on the prompt's digest and the model besides."""
    return {"question": normalize_question(question), "corpus": F.lit(corpus), "version": F.lit(version), "top_k": top_k, "filter": filter_json, "config": F.lit(config)}


def served(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(the requests with payload and cache_outcome, the new entries): ``requests`` has cache_key, ``compute`` makes
    (cache_key, payload) from one request of each missing key. Entries older than the time they live count as missing."""
    live = cache.where(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))).groupBy("cache_key").agg(F.max_by("payload", "stored_at").alias("payload"))
    missing = requests.join(live.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    fresh = compute(missing).select("cache_key", "payload").withColumn("stored_at", now)
    known = live.withColumn("cache_outcome", F.lit("hit")).unionByName(fresh.select("cache_key", "payload").withColumn("cache_outcome", F.lit("miss")))
    return requests.join(known, "cache_key", "left"), fresh


def decoded_sources(payload: Column) -> Column:
    """``array<struct<index,content,score,metadata>>`` of a stored retrieval: a list as it once was, or an envelope with ``sources``."""
    kind = "array<struct<index:int,content:string,score:double,metadata:map<string,string>>>"
    return F.when(F.trim(payload).startswith("["), F.from_json(payload, kind)).otherwise(F.from_json(payload, f"struct<sources:{kind}>")["sources"])


def encoded_sources(sources: Column) -> Column:
    return F.to_json(F.struct(sources.alias("sources")))
