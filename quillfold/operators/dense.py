"""Exact vector search of a batch of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.operators.best import Best, merged, schemas
from quillfold.sources.tables import ship_package

BLOCK_BYTES = 64 << 20  # of queries sent to the executors at once
TILE = 1024  # queries and rows that are multiplied at once


def _score(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    if metric == "euclid":
        # Subtract per query: differences of squares lose digits.
        return -np.sqrt(np.stack([((x - v) ** 2).sum(1) for v in q]))
    return s


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    if pc.any(pc.not_equal(pc.list_value_length(vectors), width)).as_py():
        raise ValueError(f"the queries' vectors have {width} numbers, and one of the index hasn't")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def _scorer(sent, k: int, metric: str, skip_self: bool, tied: bool, schema: pa.Schema):
    """The ``k`` best rows of a task for each query.

    Cosines are looked through in single precision; whatever comes within its error of a query's bound is
    computed again in double precision, and only that score counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qs = sent.value
        own, best = ids.to_numpy(zero_copy_only=False), Best(len(qs), k)
        length = np.linalg.norm(qs, axis=1)
        asked = np.arange(len(qs))
        slack, q32 = 0.0, None
        if metric == "cosine":
            slack = 1e-6 + (qs.shape[1] + 16) * 1.2e-7
            asked = np.flatnonzero(length > 0)
            q32 = (qs[asked] / length[asked, None]).astype(np.float32)
        blank = np.setdiff1d(np.arange(len(qs)), asked)  # of cosine 0 with every row
        done = due = 0
        for whole in batches:
            every = _matrix(whole.column("embedding"), qs.shape[1])
            ident, tie = whole.column("id").to_numpy(zero_copy_only=False), whole.column("tie").to_numpy(zero_copy_only=False)
            for low in range(0, len(every), TILE):
                x, names = every[low : low + TILE], ident[low : low + TILE]
                keys, size = tie[low : low + TILE] if tied else names, np.linalg.norm(x, axis=1)
                if q32 is not None:
                    x32 = np.ascontiguousarray(np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0).astype(np.float32).T)
                for at in range(0, len(asked), TILE):
                    mine = asked[at : at + TILE]
                    s = q32[at : at + TILE] @ x32 if q32 is not None else np.round(_score(qs[mine], x, metric), 6) + 0.0
                    if skip_self:
                        s[own[mine, None] == names[None, :]] = -np.inf
                    bound = best.bound[mine]
                    new = np.flatnonzero(bound == -np.inf)
                    if len(new) and s.shape[1] > k:
                        known = np.where(np.isnan(s[new]), -np.inf, s[new])
                        bound[new] = np.partition(known, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack
                    i, j = np.divmod(np.flatnonzero(s >= (bound - slack).astype(s.dtype)[:, None]), s.shape[1])
                    if q32 is None:
                        score = s[i, j]
                    else:
                        i, j = (v[s[i, j] > -np.inf] for v in (i, j))
                        n = length[mine[i]] * size[j]
                        score = np.round(np.divide(np.einsum("ij,ij->i", qs[mine[i]], x[j]), n, out=np.zeros(len(i)), where=n > 0), 6) + 0.0
                    good = np.isfinite(score) & (score >= best.bound[mine[i]])
                    i, j = i[good], j[good]
                    got = names[j]
                    best.add(mine[i], score[good], keys[j] if tied else got, got)
                if len(blank):
                    least = np.argsort(keys, kind="stable")
                    for q in blank:
                        j = (least[names[least] != own[q]] if skip_self else least)[:k]
                        got = names[j]
                        best.add(np.full(len(j), q), np.zeros(len(j)), keys[j] if tied else got, got)
                done += len(x)
                if done >= due:
                    best.cut()
                    due = 2 * done
        yield from best.batches(ids, schema, tied)

    return run


def record_ties() -> list[Column]:
    """What orders records of equal scores, as one string each: source (lower case first, slashes forward), chunk, start and end, id."""
    source = F.replace(F.coalesce(F.col("source"), F.lit("")), F.lit("\\"), F.lit("/"))
    far = F.lit((1 << 63) - 1)
    return [F.lower(source), source, *[F.lpad(F.coalesce(F.col(c).cast("bigint"), far).cast("string"), 19, "0") for c in ("chunk_index", "start_char", "end_char")], F.col("id").cast("string")]


def dense_topk(queries: DataFrame, index: DataFrame, k: int, metric: str = "cosine", *, skip_self: bool = False, ties: Sequence[Column] = ()) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best rows of ``index`` (id, embedding) for each of ``queries`` (query_id, embedding).

    metric is cosine, dot or euclid (the negated distance). Scores are rounded to 6 places and
    ties go to the lesser id, or to the lesser of the strings ``ties`` of the index (``record_ties``). Null ids and vectors take no part; a zero vector has cosine 0;
    vectors of another length than the queries' raise an error. The index is read once per block of queries, a block
    being bounded in bytes, and each task sends on its ``k`` best per query only.
    """
    if k <= 0 or metric not in ("cosine", "dot", "euclid"):
        raise ValueError("k must be positive and the metric cosine, dot or euclid")
    spark = index.sparkSession
    q = queries.where("query_id is not null and embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    tie = F.concat_ws("\u0000", *ties) if ties else F.lit(None).cast("string")
    x = index.where("id is not null and embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"), tie.alias("tie"))
    ship_package(spark)
    id_type, q_type = index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema, arrow = schemas(q_type, id_type)
    width = q.select(F.max(F.size("embedding")).alias("w")).first().w
    if not width:
        return spark.createDataFrame([], f"query_id {q_type}, id {id_type}, score double, rank int")
    per = max(1, BLOCK_BYTES // (8 * width))
    blocks = -(-q.count() // per)
    found = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        names = part.column("query_id").combine_chunks()
        sent = spark.sparkContext.broadcast((names, _matrix(part.column("embedding").combine_chunks(), width)))
        here = x.mapInArrow(_scorer(sent, k, metric, skip_self, bool(ties), arrow), schema)
        found = here if found is None else found.unionByName(here)
    return merged(found, k)
