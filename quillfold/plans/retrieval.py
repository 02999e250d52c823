"""Retrieval of a batch of questions as one plan, by options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.operators import context, dense, embedding, fusion, lexical
from quillfold.operators.providers import LexicalReranker, Reranker
from quillfold.sources.tables import stored


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"  # dense, bm25 or hybrid
    top_k: int = 5
    fetch_k: int = 30
    dimension: int = 64
    rrf_k: int = 60
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.PATH_WEIGHTS))
    multi_query: bool = False
    num_queries: int = 3
    original_weight: float = fusion.ORIGINAL_WEIGHT
    variant_weight: float = fusion.VARIANT_WEIGHT
    rerank: bool = False
    hierarchical: bool = False  # what is searched are children of parents
    expand: bool = False  # children give way to their parents
    gate: context.Gate | None = None
    pack: context.Packing | None = None
    budget: int = 2000
    budget_unit: str = "tokens"
    bm25: lexical.Bm25 = field(default_factory=lexical.Bm25)

    def __post_init__(self) -> None:
        if self.mode not in ("dense", "bm25", "hybrid"):
            raise ValueError("mode must be dense, bm25 or hybrid")
        if min(self.top_k, self.fetch_k, self.dimension, self.rrf_k, self.num_queries, self.budget) <= 0:
            raise ValueError("top_k, fetch_k, dimension, rrf_k, num_queries and budget must be positive")
        if self.budget_unit not in ("tokens", "chars"):
            raise ValueError("budget_unit must be tokens or chars")
        if not self.original_weight >= self.variant_weight >= 0:
            raise ValueError("the original must weigh as much as a variant or more, and neither be negative")
        if self.mode == "hybrid" and not any(w > 0 for w in self.weights.values()):
            raise ValueError("one path must have a positive weight")

    @property
    def candidates(self) -> int:
        return max(self.fetch_k if self.rerank or self.mode == "hybrid" else self.top_k, self.top_k)


PROFILES = {
    "baseline": Options(mode="dense"),
    "rerank": Options(mode="dense", rerank=True),
    "hybrid": Options(),
    "bm25": Options(mode="bm25"),
    "parent_child": Options(mode="dense", hierarchical=True),
    "context_packing": Options(mode="dense", pack=context.Packing(exact=True)),
    "multi_query": Options(mode="dense", multi_query=True),
}


def _single(questions: DataFrame, chunks: DataFrame, option: Options, n: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id, score, rank, dense_score, retrieval_mode) of the ``n`` best of each question."""
    paths = {}
    if option.mode in ("dense", "hybrid"):
        index = chunks if "embedding" in chunks.columns else embedding.embed_documents(chunks, "content", option.dimension)
        asked = embedding.embed_documents(questions, "question", option.dimension)
        if allowed is None:
            placed = {"source", "chunk_index", "start_char", "end_char"} <= set(index.columns)
            paths["dense"] = dense.dense_topk(asked.select("query_id", "embedding"), index, n, ties=dense.record_ties() if placed else ())
        else:
            from pyspark.sql import Window

            from quillfold.functions.vectors import cosine

            seen = allowed.join(index.select("id", F.col("embedding").alias("x")), "id").join(asked.select("query_id", F.col("embedding").alias("q")), "query_id")
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
            paths["dense"] = seen.select("query_id", "id", F.round(cosine(F.col("q"), F.col("x")), 6).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    if option.mode in ("bm25", "hybrid"):
        paths["sparse"] = lexical.bm25_topk(questions, chunks.select("id", "content"), n, text_col="content", allowed=allowed, option=option.bm25)
    if len(paths) == 2:
        paths["dense"] = stored(paths["dense"])
        found = fusion.hybrid(paths["dense"], paths["sparse"], n, option.weights, option.rrf_k).select("query_id", "id", "score", "rank")
        found = found.join(paths["dense"].select("query_id", "id", F.col("score").alias("dense_score")), ["query_id", "id"], "left")
        return found.withColumn("retrieval_mode", F.lit("hybrid_rrf"))
    found = next(iter(paths.values())).select("query_id", "id", "score", "rank")
    return found.withColumn("dense_score", F.col("score") if option.mode == "dense" else F.lit(None).cast("double")).withColumn("retrieval_mode", F.lit(option.mode))


def _variants(questions: DataFrame, rewrites: DataFrame, chunks: DataFrame, option: Options, allowed: DataFrame | None) -> DataFrame:
    """Like ``_single`` with every variant of a question as a query of its own, fused per question.

    A question without a rewrite keeps its single path. The dense score is the original's.
    """
    v = fusion.variants(questions, rewrites, option.num_queries).withColumn("variant", F.concat_ws("\u0001", "query_id", "variant_no"))
    v = stored(v.join(v.groupBy("query_id").agg(F.count("*").alias("variants")), "query_id"))
    n = max(option.candidates, option.top_k * max(option.num_queries, 2)) if option.rerank else option.candidates
    may = None if allowed is None else allowed.join(v.select("query_id", "variant"), "query_id").select(F.col("variant").alias("query_id"), "id")
    each = _single(v.select(F.col("variant").alias("query_id"), F.col("text").alias("question")), chunks, option, n, may).withColumnRenamed("query_id", "variant")
    each = stored(each.join(v.select("variant", "query_id", "variant_no", "variants"), "variant"))
    alone = each.where("variants = 1").select("query_id", "id", "score", "rank", "dense_score", "retrieval_mode")
    fused = fusion.multi_query(each.where("variants > 1"), n if option.rerank else option.top_k, option.rrf_k, option.original_weight, option.variant_weight)
    first = each.where("variants > 1 and variant_no = 0").select("query_id", "id", "dense_score")
    fused = fused.join(first, ["query_id", "id"], "left").withColumn("retrieval_mode", F.lit("hybrid_rrf"))
    return alone.unionByName(fused.select(*alone.columns))


def _ranked(questions: DataFrame, chunks: DataFrame, option: Options, allowed: DataFrame | None, reranker: Reranker | None, rewrites: DataFrame | None, parents: DataFrame | None) -> DataFrame:
    """All stages before the gate: (query_id, id, score, rank, dense_score, dense_rank, retrieval_mode, rerank_provider[, content, expanded, child_ids]).

    A reranker that gave no score leaves the score and order of before.
    """
    if option.multi_query and rewrites is None:
        raise ValueError("multi_query needs the rewrites")
    if option.expand and (parents is None or "parent_id" not in chunks.columns):
        raise ValueError("expand needs the parents and a parent_id of the chunks")
    found = _variants(questions, rewrites, chunks, option, allowed) if option.multi_query else _single(questions, chunks, option, option.candidates, allowed)
    provider = None
    if option.rerank:
        found, by = stored(found), reranker or LexicalReranker()
        provider = getattr(by, "provider", "unknown")
        c = found.join(questions, "query_id").join(chunks.select("id", "content"), "id").select("query_id", "question", "id", "content", F.col("rank").alias("dense_rank"))
        before = found.select("query_id", "id", "dense_score", "retrieval_mode", F.col("rank").alias("dense_rank"), F.col("score").alias("__score"))
        found = by.rerank(c, option.top_k).select("query_id", "id", "score", "rank").join(before, ["query_id", "id"]).withColumn("score", F.coalesce("score", "__score")).drop("__score")
    else:
        found = found.withColumn("dense_rank", F.col("rank"))
    found = found.where(F.col("rank") <= option.top_k).withColumn("rerank_provider", F.lit(provider).cast("string"))
    if not option.expand:
        return found
    found = stored(found.join(chunks.select("id", "content", "parent_id"), "id"))
    p = parents.select("parent_id", F.col("content").alias("parent_content"))
    here = found.join(p, "parent_id", "left").withColumn("parent_id", F.when(F.col("parent_content").isNotNull(), F.col("parent_id")))  # a child without its parent stands for itself
    first = context.collapse_siblings(here.select("query_id", "id", "parent_id", "rank")).select("query_id", "id", "child_ids")
    out = here.join(first, ["query_id", "id"]).withColumn("expanded", F.col("parent_content").isNotNull()).withColumn("content", F.coalesce("parent_content", "content"))
    return out.drop("parent_id", "parent_content")


def _decisions(questions: DataFrame, found: DataFrame, option: context.Gate) -> DataFrame:
    parts = ["retrieval_mode", "score", "dense_score", "rerank_provider"]
    first = found.groupBy("query_id").agg(F.min_by(F.struct(*parts), "rank").alias("f")).select("query_id", "f.*")
    return context.gate(questions.select("query_id").distinct().join(first, "query_id", "left"), option)


def retrieve(questions: DataFrame, chunks: DataFrame, option: Options = Options(), *, allowed: DataFrame | None = None, reranker: Reranker | None = None, rewrites: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, dense_score, dense_rank, retrieval_mode) for ``questions`` (query_id, question) over ``chunks`` (id, content[, embedding, parent_id]).

    ``allowed`` (query_id, id) is applied before ranking. Chunks without an embedding column get hash
    embeddings. The reranker sees the original question. With ``option.multi_query`` the ``rewrites``
    (question_key, pos, rewrite) are searched too and fused. With ``option.expand`` the best child of each of the
    ``parents`` (parent_id, content) keeps its rank and brings content, expanded and child_ids, and with
    ``option.gate`` action and reason are added. Packing makes one row per question: ``contexts``.
    """
    found = _ranked(questions, chunks, option, allowed, reranker, rewrites, parents)
    columns = ["query_id", "id", "score", "rank", "dense_score", "dense_rank", "retrieval_mode", *(["content", "expanded", "child_ids"] if option.expand else [])]
    if option.gate is not None:
        found = stored(found)
        found = found.join(_decisions(questions, found, option.gate).select("query_id", "action", "reason"), "query_id")
        columns += ["action", "reason"]
    return found.select(*columns)


def retrieve_variants(questions: DataFrame, rewrites: DataFrame, chunks: DataFrame, option: Options = Options(), **more) -> DataFrame:
    """``retrieve`` with every variant of a question as a query of its own, fused per question."""
    return retrieve(questions, chunks, replace(option, multi_query=True), rewrites=rewrites, **more)


def contexts(questions: DataFrame, chunks: DataFrame, option: Options = Options(), **more) -> DataFrame:
    """One row per question: query_id, action and reason of the gate (null without one), used_ids, context.

    ``more`` is what ``retrieve`` takes. Rejected questions and those without a source have no context. With
    ``option.pack`` the sources are packed into the budget, else all stand in their order.
    """
    every = {"allowed": None, "reranker": None, "rewrites": None, "parents": None, **more}
    found = _ranked(questions, chunks, option, **every)
    found = stored(found if option.expand else found.join(chunks.select("id", "content"), "id"))
    asked = questions.select("query_id").distinct()
    none = F.lit(None).cast("string")
    decided = _decisions(questions, found, option.gate) if option.gate is not None else asked.withColumns({"action": none, "reason": none})
    decided = decided.select("query_id", "action", "reason")
    open_ = found.join(decided.where("action in ('rejected', 'no_candidates')"), "query_id", "left_anti")
    if option.pack is not None:
        more = [c for c in ("source", "chunk_index", "start_char", "end_char") if c in chunks.columns]
        open_ = open_.join(chunks.select("id", *more), "id") if more and not option.expand else open_
        s = open_.select(F.col("query_id").alias("request_id"), F.col("rank").alias("source_index"), F.col("id").cast("string").alias("record_id"), "content", "score", *(more if not option.expand else []))
        budgets = asked.select(F.col("query_id").alias("request_id"), F.lit(option.budget).alias("budget_limit"), F.lit(option.budget_unit).alias("budget_unit"))
        made = context.pack_contexts(s, budgets, option.pack).select(F.col("request_id").alias("query_id"), "used_ids", "context")
    else:
        rows = F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), F.coalesce("content", F.lit("")).alias("content"))))
        made = open_.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.transform("r", lambda x: x["id"]).alias("used_ids"), F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x["content"])), "\n\n").alias("context"))
    return decided.join(made, "query_id", "left")
