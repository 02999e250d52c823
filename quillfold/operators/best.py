"""The ``k`` best rows of each query: of those that a task has seen, and of all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAITING = 1_000_000  # candidates that wait for a cut, besides those that the last one kept
QUERIES_A_BATCH = 4000


class Best:
    """The best of what was added, by score and then the lesser key.

    ``bound`` has for each query the score of its k-th best so far: what is below it can't be among the
    best of all, what equals it still can, by its key.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.bound, self.waiting = k, np.full(queries, -np.inf), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, q: np.ndarray, score: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.parts.append((q.astype(np.int32), score, ids, *([] if key is ids else [key])))
            self.waiting += len(q)
            if self.waiting > WAITING:
                self.cut()

    def cut(self) -> None:
        """Drops what is below the bounds, which rise; only a query with more than 2k left has its ties put in order and cut to k."""
        if not self.waiting:
            return
        q, score, ids, *key = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        whole = np.rint(score * 1e6)
        if (np.abs(whole) < 1 << 38).all() and len(self.bound) < 1 << 23:  # scores have six places, so one number sorts both
            order = np.argsort((q.astype(np.int64) << 40) - whole.astype(np.int64))
        else:
            order = np.lexsort((-score, q))
        sq, ss = q[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], sq[1:] != sq[:-1]]))
        size = np.diff(np.append(first, len(sq)))
        full = first[size >= self.k]
        self.bound[sq[full]] = ss[full + self.k - 1]
        keep = ss >= self.bound[sq]
        left = np.add.reduceat(keep.astype(np.int64), first)
        for a, n in zip(first[left > 2 * self.k], left[left > 2 * self.k]):
            rows = np.arange(a, a + n)
            rows = rows[np.argsort((key[0] if key else ids)[order[rows]], kind="stable")]
            keep[rows[np.argsort(-ss[rows], kind="stable")][self.k :]] = False
        order = order[keep]
        self.parts, self.waiting = [(q[order], score[order], ids[order], *(x[order] for x in key))], 0

    def batches(self, names: pa.Array, schema: pa.Schema, tied: bool) -> Iterator[pa.RecordBatch]:
        """(query_id, best): a row for each query that found something."""
        self.cut()
        if not self.parts:
            return
        q, score, ids, *key = self.parts[0]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        ends = np.append(first, len(q))
        kind = schema.field("best").type
        for at in range(0, len(first), QUERIES_A_BATCH):
            own = ends[at : at + QUERIES_A_BATCH + 1]
            a, b = own[0], own[-1]
            fields = [pa.array(0.0 - score[a:b]), pa.array(key[0][a:b], pa.string()) if tied else pa.nulls(b - a, pa.string()), pa.array(ids[a:b], kind.value_type.field("id").type)]
            rows = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q[own[:-1]])), pa.ListArray.from_arrays(pa.array((own - a).astype(np.int32)), rows, type=kind)], schema=schema)


def schemas(query_kind: str, id_kind: str) -> tuple[str, pa.Schema]:
    """What ``Best.batches`` gives, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = f"query_id {query_kind}, best array<struct<worse:double,tie:string,id:{id_kind}>>"
    return text, to_arrow_schema(_parse_datatype_string(text))


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best over all tasks; each task sends a row for a query."""
    whole = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return whole.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", "b.id", (F.lit(0.0) - F.col("b.worse")).alias("score"), (F.col("pos") + 1).alias("rank"))
