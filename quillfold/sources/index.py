"""The index as a table: upserts, deletes, listings and snapshots by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(index: DataFrame, new: DataFrame, key: str = "id", order: str = "ingest_sequence") -> DataFrame:
    """One row per key: the one with the greatest ``order``; of equals the new one. A null key is an error.

    An aggregation with ``max_by``, not a window, so that repeated deliveries shrink before the shuffle.
    """
    both = index.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    named = both.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"{key} is missing")).cast("string")))
    return latest(named, key, [order, "__new"]).drop("__new")


def with_dimension(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The rows, where a vector of another length, or none, is an error when they are read."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector isn't of {dimension} numbers: "), F.coalesce(F.size(column).cast("string"), F.lit("null"))))
    return df.withColumn(column, F.when(F.size(column) == dimension, F.col(column)).otherwise(wrong.cast(df.schema[column].dataType.simpleString())))


def add_records(index: DataFrame | None, new: DataFrame, dimension: int | None = None, key: str = "id", order: str = "ingest_sequence") -> DataFrame:
    """Upsert with the guard on vectors: ``dimension``, or that of the first vector of the index, or of the new rows."""
    if dimension is None:
        first = (new if index is None else index).where("embedding is not null").select(F.size("embedding").alias("n")).first()
        dimension = first.n if first else None
    guarded = new if dimension is None else with_dimension(new, dimension)
    return upsert(guarded.limit(0) if index is None else index, guarded, key, order)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, F.struct(*[F.col(c) for c in order])).alias("r")).select(key, "r.*").select(*df.columns)


def delete(index: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def get(index: DataFrame, value: str, key: str = "id") -> DataFrame:
    return index.where(F.col(key) == value)


def add_parents(parents: DataFrame | None, new: DataFrame) -> DataFrame:
    """The store of parents (parent_id, content) with the new ones; a later one replaces. A missing parent_id is an error."""
    now = new.withColumn("__t", F.lit(1))
    return upsert((parents if parents is not None else new.limit(0)).withColumn("__t", F.lit(0)), now, "parent_id", "__t").drop("__t")


def with_parent_payload(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with their parent's text, so that a store of parents can be rebuilt from an index of children."""
    return children.join(parents.select("parent_id", F.col("content").alias("parent_content")), "parent_id", "left")


def parents_of(records: DataFrame) -> DataFrame:
    """(parent_id, content): the text that the first record of a parent carries, by ingest_sequence and id. One without text is an error."""
    text = F.when(F.col("parent_content").isNotNull(), F.col("parent_content")).otherwise(F.raise_error(F.concat(F.lit("no text of the parent "), "parent_id")).cast("string"))
    first = records.where("parent_id is not null").groupBy("parent_id").agg(F.min_by(F.struct("parent_content"), F.struct("ingest_sequence", "id")).alias("r")).select("parent_id", "r.parent_content")
    return first.select("parent_id", text.alias("content"))


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the snapshots under a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}/_SUCCESS")))


def write_snapshot(index: DataFrame, root: str, version: int | None = None) -> int:
    """Writes the next version (or the one named) beside the older ones, so that readers of those aren't disturbed, and gives its
    number. A version that is there already is an error, so that two writers can't bump to the same one."""
    number = version if version is not None else max([0, *versions(index.sparkSession, root)]) + 1
    index.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={number}")
    return number


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The named version, or the last one whose writing was finished."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/version={known[-1] if version is None else version}")


def corpus_identity(index: DataFrame, key: str = "id") -> DataFrame:
    """One row (n, identity): a digest of the distinct sorted ids, as digests of buckets of ids and a digest of those."""
    ids = index.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k")).distinct()
    part = ids.groupBy(F.substring(F.sha2("k", 256), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("k")), "\u0000"), 256).alias("d"), F.count("*").alias("n"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\u0000"), 256).alias("identity"))
