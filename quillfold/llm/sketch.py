"""Counts of hashed keys over a whole table in an array of fixed size.

The array's size is a parameter and doesn't grow with the data, so it may be sent to every
executor. Every partition counts into one of its own and sends the parts that aren't empty;
these are added in a tree, so that no task gets more than ``FAN`` copies of a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.sources.tables import ship_package, shuffle_partitions

PARTS = 64
FAN = 16


def hashed_counts(df: DataFrame, places: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """uint32 counts of length ``size``; ``places`` gives, of a batch, the index to count, as often as it occurs,
    or an array of two rows, indexes and their counts."""
    ship_package(df.sparkSession)
    step = -(-size // PARTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(step * PARTS, dtype=np.uint32)
        for pdf in batches:
            at = places(pdf)
            if at.ndim == 2:
                np.add.at(total, at[0], at[1].astype(np.uint32))
            elif 8 * len(at) < size:
                np.add.at(total, at, np.uint32(1))
            else:
                total += np.bincount(at, minlength=len(total)).astype(np.uint32)
        grp = TaskContext.get().partitionId() // FAN
        out = [(k, grp, zlib.compress(total[k * step : (k + 1) * step].tobytes(), 1)) for k in range(PARTS) if total[k * step : (k + 1) * step].any()]
        yield pd.DataFrame(out, columns=["part", "grp", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, dtype=np.uint64)
        for raw in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "grp": [pdf["grp"].iloc[0] // FAN], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "part int, grp int, counts binary"
    # How many partitions there are isn't known before a plan runs; the guess only sets the height of the tree.
    groups = -(-max(shuffle_partitions(df.sparkSession), len(df.inputFiles())) // FAN)
    sums = df.mapInPandas(run, kind).groupBy("part", "grp").applyInPandas(add, kind)
    while groups > 1:
        groups = -(-groups // FAN)
        sums = sums.groupBy("part", "grp").applyInPandas(add, kind)
    out = np.zeros(step * PARTS, dtype=np.uint64)
    for r in sums.select("part", "counts").collect():
        out[r.part * step : (r.part + 1) * step] += np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
    return np.minimum(out[:size], 0xFFFFFFFF).astype(np.uint32)


def least_hashed(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The rows of ``df`` whose hashed key is among the ``n`` least distinct hashes.

    Only hashes go to the driver to find the bound, no rows.
    """
    hashed = df.withColumn("__h", F.xxhash64(*key))
    last = hashed.select("__h").distinct().orderBy("__h").limit(n).agg(F.max("__h").alias("b")).first().b
    return hashed.where(F.col("__h") <= F.lit(last if last is not None else 0)).drop("__h")
