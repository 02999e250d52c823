"""An inverted index as tables, BM25 over a batch of queries, and lexical reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.text import tokens
from quillfold.operators.best import Best, merged, schemas
from quillfold.sources.tables import ship_package, stored


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.k1 <= 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be positive and b in 0..1")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf, dl). Null texts and ids have no postings; a repeated id counts as often as it occurs."""
    t = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts")).select("id", "ts", F.size("ts").alias("dl"))
    return t.select("id", "dl", F.explode("ts").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (n, avgdl) over all documents, those without tokens included."""
    return docs.where(F.col(id_col).isNotNull()).select(F.coalesce(F.size(tokens(F.col(text_col))), F.lit(0)).alias("dl")).agg(F.count("*").alias("n"), F.avg(F.greatest("dl", F.lit(0))).alias("avgdl"))


QUERY_BYTES, QUERIES = 16 << 20, 50_000  # of questions that are scored in one pass over the index
DOCS_FIRST, DOCS_AT_ONCE = 2048, 32_768  # the first documents of a task give the bounds for its others


def write_index(docs: DataFrame, id_col: str = "id", text_col: str = "text", acl_col: str | None = None) -> DataFrame:
    """The written index (id, ts, dl[, acl]): one row per document with its tokens, made once and read by any number of batches.

    A null id is left out; a null text has no tokens and counts in the statistics.
    """
    t = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("ts"), *([F.col(acl_col).alias("acl")] if acl_col else []))
    return stored(t.withColumn("dl", F.size("ts")), "index")


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``DOCS_FIRST`` and then four times as many each time, up to ``DOCS_AT_ONCE``."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, DOCS_FIRST
    for batch in batches:
        while rows + batch.num_rows >= most:
            held.append(batch.slice(0, most - rows))
            yield pa.concat_batches(held)
            batch = batch.slice(most - rows)
            held, rows, most = [], 0, min(4 * most, DOCS_AT_ONCE)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.concat_batches(held)


def _added(doc: np.ndarray, part: np.ndarray, runs: list[tuple[int, int]], n: int) -> np.ndarray:
    return np.bincount(np.concatenate([doc[a:b] for a, b in runs]), np.concatenate([part[a:b] for a, b in runs]), n)


def _scorer(sent, option: Bm25, k: int, guarded: bool, schema: pa.Schema):
    """The ``k`` best documents of a task for each query, in numpy.

    Terms whose greatest weights together stay below a query's bound (its k-th best score so far) can't bring a
    document among the best without another one (MaxScore). Where most postings are theirs, the others are added
    up first, and theirs only if some document can still reach the bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, vocab, idf, avgdl, subjects, readers = sent.value
        words = pa.array(vocab, pa.string())
        terms, ends = asked[:, 0], np.searchsorted(asked[:, 1], np.arange(len(ids) + 1)).tolist()
        sets, of_set = np.unique(readers, axis=0, return_inverse=True) if guarded else (None, np.zeros(len(ids), dtype=np.int64))
        turn = np.argsort(of_set.reshape(-1), kind="stable").tolist()
        best = Best(len(ids), k)
        for batch in _slabs(batches):
            n, lists = batch.num_rows, batch.column("ts")
            token = pc.index_in(lists.flatten(), value_set=words)
            doc = pc.list_parent_indices(lists)
            used = token.is_valid()
            key, tf = np.unique(token.filter(used).to_numpy().astype(np.int64) * n + doc.filter(used).to_numpy(), return_counts=True)
            token, doc = key // n, key % n
            dl = batch.column("dl").to_numpy()[doc]
            part = idf[token] * tf * (option.k1 + 1) / (tf + option.k1 * (1 - option.b + option.b * dl / avgdl))
            begin = np.searchsorted(token, np.arange(len(vocab) + 1))
            most = np.zeros(len(vocab))
            held_by = np.flatnonzero(np.diff(begin))
            most[held_by] = np.maximum.reduceat(part, begin[held_by]) if len(held_by) else 0
            del key, token, tf, dl
            if guarded:
                own = pc.index_in(batch.column("acl").flatten(), value_set=subjects)
                of = pc.list_parent_indices(batch.column("acl"))
                held = np.zeros((len(subjects), n), dtype=np.float32)
                held[own.drop_null().to_numpy(), of.filter(own.is_valid()).to_numpy()] = 1
            seen, hidden, least = -1, None, (best.bound - 1e-6).tolist()
            who, where, scores = [], [], []
            names = batch.column("id").to_numpy(zero_copy_only=False)

            def hand_on(who=who, where=where, scores=scores, names=names) -> None:
                if who:
                    score = np.round(np.concatenate(scores), 6)
                    good = score > 0
                    got = names[np.concatenate(where)[good]]
                    best.add(np.repeat(who, [len(x) for x in where])[good], score[good], got, got)
                    for x in (who, where, scores):
                        x.clear()

            for q in turn:
                t = terms[ends[q] : ends[q + 1]]
                runs = [(a, b) for a, b in zip(begin[t].tolist(), begin[t + 1].tolist()) if a < b]
                if not runs:
                    continue
                weak, rest = [], 0.0
                if least[q] > 0 and len(runs) > 1:
                    top = most[t[begin[t] < begin[t + 1]]]
                    turned = np.argsort(top)
                    cut = int(top[turned].cumsum().searchsorted(least[q]))
                    if cut == len(runs):
                        continue
                    hits = [runs[x][1] - runs[x][0] for x in turned.tolist()]
                    if sum(hits[cut:]) < 0.4 * sum(hits):
                        rest, weak = float(top[turned[:cut]].sum()), [runs[x] for x in turned[:cut].tolist()]
                        runs = [runs[x] for x in sorted(turned[cut:].tolist())]
                score = _added(doc, part, runs, n)
                if weak:
                    near = np.count_nonzero(score >= least[q] - rest)
                    if not near:
                        continue
                    score += _added(doc, part, weak, n)
                if guarded:
                    if of_set[q] != seen:
                        seen = of_set[q]
                        hidden = (sets[seen] @ held) == 0
                    score[hidden] = 0
                found = np.flatnonzero(score >= max(least[q], 5e-7))  # a score that rounds to 0 is none
                own = score[found]
                if least[q] == -np.inf and len(found) > k:
                    best_of = own >= np.partition(own, len(own) - k)[len(own) - k] - 1e-6
                    found, own = found[best_of], own[best_of]
                if len(found):
                    who.append(q)
                    where.append(found)
                    scores.append(own)
                    if len(who) == 2000:
                        hand_on()
            hand_on()
            best.cut()
        yield from best.batches(ids, schema, tied=False)

    return run


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, *, id_col: str = "id", text_col: str = "text", allowed: DataFrame | None = None, option: Bm25 = Bm25(), index: DataFrame | None = None, acl_col: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best documents of each query.

    ``queries`` has (query_id, question). Scores are rounded to 6 places and ties go to the
    lesser id; scores of 0 are left out. The statistics cover the whole corpus; ``allowed``
    (query_id, id) restricts what a query may see before ranking, and so do ``queries.subjects`` where
    ``acl_col`` names the documents' subjects: one in common is needed. ``index`` is what ``write_index`` gave, else it is made.

    The queries are sent to the documents, in blocks bounded in bytes, with the idf of their tokens; no
    posting is shuffled, so a term that a third of all documents have costs what its hits cost.
    Each task sends on its ``k`` best per query. With ``allowed`` postings are joined instead.
    """
    if allowed is not None:
        return _joined_topk(queries, docs, k, id_col, text_col, allowed, option)
    spark = docs.sparkSession
    ship_package(spark)
    index = write_index(docs, id_col, text_col, acl_col) if index is None else index
    asked = queries.where("query_id is not null").select("query_id", F.array_distinct(F.coalesce(tokens(F.col("question")), F.array().cast("array<string>"))).alias("ts"), *(["subjects"] if acl_col else []))
    asked = stored(asked, "asked")
    size = asked.agg(F.sum(F.aggregate("ts", F.lit(16), lambda n, t: n + F.length(t) + 16)).alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size.b or 0) // QUERY_BYTES), -(-size.n // QUERIES))
    terms = asked.select(F.explode("ts").alias("token")).distinct()
    facts = index.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = stored(document_frequency(index.select(F.explode(F.array_distinct("ts")).alias("token"))).join(terms, "token", "left_semi"), "df")
    kind, q_kind = index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema, arrow = schemas(q_kind, kind)
    found = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = mine.toArrow()
        own = df if blocks == 1 else df.join(mine.select(F.explode("ts").alias("token")).distinct(), "token", "left_semi")
        count = own.toPandas().sort_values("token", ignore_index=True)
        vocab = count["token"].tolist()
        idf = np.log(1.0 + (facts.n - count["df"].to_numpy(dtype=float) + 0.5) / (count["df"].to_numpy(dtype=float) + 0.5))
        lists = rows.column("ts").combine_chunks()
        token = pc.index_in(lists.flatten(), value_set=pa.array(vocab, pa.string()))
        pair = np.stack([token.drop_null().to_numpy().astype(np.int64), pc.list_parent_indices(lists).filter(token.is_valid()).to_numpy().astype(np.int64)], axis=1).reshape(-1, 2)
        pair = pair[np.lexsort((pair[:, 0], pair[:, 1]))]
        subjects, readers = pa.array([], pa.string()), None
        if acl_col:
            of = rows.column("subjects").combine_chunks()
            subjects = pc.unique(of.flatten().drop_null())
            readers = np.zeros((len(rows), len(subjects)), dtype=np.float32)
            at = pc.index_in(of.flatten(), value_set=subjects)
            readers[pc.list_parent_indices(of).filter(at.is_valid()).to_numpy(), at.drop_null().to_numpy()] = 1
        sent = spark.sparkContext.broadcast((rows.column("query_id").combine_chunks(), pair, vocab, idf, facts.avgdl or 1.0, subjects, readers))
        here = index.mapInArrow(_scorer(sent, option, k, acl_col is not None, arrow), schema)
        found = here if found is None else found.unionByName(here)
    return merged(found, k)


def _joined_topk(queries: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str, allowed: DataFrame, option: Bm25) -> DataFrame:
    post = stored(postings(docs, id_col, text_col), "postings")
    terms = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("token"))
    size = docs.where(F.col(id_col).isNotNull()).agg(F.count("*").alias("n"))
    stats = size.crossJoin(F.broadcast(post.agg(F.sum("tf").alias("t")))).select("n", (F.coalesce("t", F.lit(0)) / F.col("n")).alias("avgdl"))
    idf = document_frequency(post).join(terms.select("token").distinct(), "token", "left_semi").crossJoin(F.broadcast(stats)).select("token", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))
    part = F.col("idf") * F.col("tf") * (option.k1 + 1) / (F.col("tf") + option.k1 * (1 - option.b + option.b * F.col("dl") / F.col("avgdl")))
    # Only what a query may see meets its terms.
    seen = allowed.select("query_id", "id").distinct().join(post, "id").join(terms, ["query_id", "token"])
    scored = seen.join(idf, "token").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_rerank(candidates: DataFrame, top_n: int) -> DataFrame:
    """(query_id, id, score, rank) from candidates (query_id, question, id, content, dense_rank).

    The inverse frequency is local to a query's candidates. A candidate's score adds the weights
    of the terms it shares, twice the share of the query's terms, a quarter per shared pair of
    neighbouring terms, and a trace of its dense rank; one without terms has 0. A query without
    terms keeps the dense order. Null contents count as empty.
    """
    c = candidates.select("query_id", "id", "dense_rank", tokens(F.col("question")).alias("q"), F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("t"))
    c = stored(c.withColumn("qd", F.array_distinct("q")), "rerank")  # five branches read the tokens
    n = c.groupBy("query_id").agg(F.count("*").alias("n"))
    has = c.select("query_id", "id", F.explode(F.array_intersect("qd", F.array_distinct("t"))).alias("token"))
    local = has.groupBy("query_id", "token").agg(F.count("*").alias("f")).join(n, "query_id").select("query_id", "token", (F.log((F.col("n") + 1) / (F.col("f") + 1)) + 1).alias("idf"))
    counts = c.select("query_id", "id", F.explode(F.filter("t", lambda x: F.array_contains("qd", x))).alias("token")).groupBy("query_id", "id", "token").agg(F.count("*").alias("tf"))
    wanted = c.select("query_id", "q").dropDuplicates(["query_id"]).select("query_id", F.explode("q").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weight = counts.join(local, ["query_id", "token"]).join(wanted, ["query_id", "token"]).groupBy("query_id", "id").agg(F.sum(F.col("qtf") * (1 + F.log("tf")) * F.col("idf")).alias("w"))

    def pairs(a: str):
        return F.when(F.size(a) > 1, F.array_distinct(F.zip_with(F.slice(F.col(a), 1, F.size(a) - 1), F.slice(F.col(a), 2, F.size(a) - 1), lambda x, y: F.concat(x, F.lit(" "), y)))).otherwise(F.array().cast("array<string>"))

    both = c.withColumn("qp", pairs("qd")).withColumn("tp", pairs("t"))
    score = F.when(F.size("q") == 0, F.lit(0.0)).when(F.size("t") == 0, F.lit(0.0)).otherwise(F.coalesce("w", F.lit(0.0)) + 2.0 * F.size(F.array_intersect("qd", F.array_distinct("t"))) / F.greatest(F.size("qd"), F.lit(1)) + 0.25 * F.size(F.array_intersect("qp", "tp")) + 1 / (1000.0 + F.col("dense_rank")))
    scored = both.join(weight, ["query_id", "id"], "left").select("query_id", "id", "dense_rank", F.round(score, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "dense_rank", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("query_id", "id", "score", "rank")
