"""Parquet tables of a data folder, and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        at = os.path.join(tempfile.mkdtemp(prefix="quillfold-code-"), "quillfold.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; columns are pruned by the plan that uses it."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where the session names none, a local master (tests on one machine) gets a temporary folder;
    on a cluster that is an error, as no folder of one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillfold-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes the rows to the shared folder and reads them from there.

    This cuts the lineage with files that outlive any executor. Use it where two or more
    later plans read the same costly rows. ``release`` deletes what was written.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(kept: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once all that reads it was written in its turn."""
    spark = kept.sparkSession
    _WRITTEN.get(spark.sparkContext.applicationId, []).remove(kept.stored_at)
    _delete(spark, kept.stored_at)


def release(spark: SparkSession) -> int:
    """Deletes all tables that ``stored`` wrote in this application and gives their number; results that
    still read them must have been written or collected before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


@atexit.register
def _release_all() -> None:
    """At the end of the program, as far as its session still runs."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            release(spark)
    except Exception:  # the JVM may be gone already
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file lies; the folder is a parameter."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)
