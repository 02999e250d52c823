"""From ranked sources to a prompt: expansion, gate, deduplication, packing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.functions.text import question_shape, source_identifier, source_label
from quillfold.sources.tables import ship_package


def collapse_siblings(ranked: DataFrame) -> DataFrame:
    """(query_id, parent_id, id, rank, n_children, child_ids) from (query_id, id, parent_id, rank).

    The first child of a parent keeps its place; a child without a parent stands for itself.
    """
    parent = F.coalesce(F.col("parent_id"), F.col("id").cast("string"))
    return ranked.withColumn("parent_id", parent).groupBy("query_id", "parent_id").agg(F.min_by("id", F.struct("rank", "id")).alias("id"), F.min("rank").alias("rank"), F.count("*").alias("n_children"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("child_ids"))


def expand_parents(collapsed: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``parent_content`` and ``expanded``; where the parent is missing the child stays."""
    p = parents.select("parent_id", F.col("content").alias("parent_content"))
    return collapsed.join(p, "parent_id", "left").withColumn("expanded", F.col("parent_content").isNotNull())


@dataclass(frozen=True)
class Gate:
    dense_threshold: float | None = 0.63
    rerank_threshold: float | None = None
    dense_space: str = "dense_cosine"
    hybrid_enabled: bool = False


def gate(first: DataFrame, option: Gate = Gate()) -> DataFrame:
    """The decision on each query from its first source.

    ``first`` has one row per query: query_id, retrieval_mode, score, dense_score, rerank_provider,
    and null in all of them where nothing was found. Only cosines and one reranker's scores can reject;
    a missing score or threshold skips the gate.
    """
    none = F.col("retrieval_mode").isNull() & F.col("score").isNull()
    mode, provider = F.lower("retrieval_mode"), F.lower("rerank_provider")
    fused = mode.isin("hybrid", "hybrid_rrf", "rrf")
    space = F.when(none, F.lit(None)).when(mode == "bm25", "bm25").when(F.lit(option.hybrid_enabled) | (fused & F.col("dense_score").isNotNull()), option.dense_space)
    space = space.when(provider == "cohere", "cohere_rerank_score").when(provider == "deterministic", "lexical_score").when(provider.isNotNull(), F.concat(F.lit("unknown_reranker:"), provider)).when(fused, "rrf").otherwise(option.dense_space)
    d = first.withColumn("score_space", space)
    d = d.withColumn("score_used", F.when(F.col("score_space") == option.dense_space, F.when(fused | F.lit(option.hybrid_enabled), F.col("dense_score")).otherwise(F.col("score"))).otherwise(F.col("score")))
    d = d.withColumn("threshold", F.when(F.col("score_space") == "dense_cosine", F.lit(option.dense_threshold).cast("double")).when(F.col("score_space") == "cohere_rerank_score", F.lit(option.rerank_threshold).cast("double")))
    usable = F.col("score_used").isNotNull() & ~F.isnan("score_used")
    reason = F.when(none, "retrieval_returned_no_candidates").when(~F.col("score_space").isin("dense_cosine", "cohere_rerank_score"), F.concat(F.lit("unsupported_score_space:"), F.col("score_space"))).when(~usable, "usable_score_missing").when(F.col("threshold").isNull(), "threshold_not_configured").when(F.col("score_used") < F.col("threshold"), "score_below_threshold").otherwise("score_meets_threshold")
    d = d.withColumn("reason", reason)
    action = F.when(none, "no_candidates").when(F.col("reason") == "score_below_threshold", "rejected").when(F.col("reason") == "score_meets_threshold", "accepted").otherwise("skipped")
    return d.withColumn("action", action).select("query_id", "action", "reason", "score_space", F.col("score_used").alias("gate_score"), "threshold")


def score_space(model: str, distance: str | None = None, store: str = "memory") -> str:
    """The space that an index's scores are in: a hash model's cosines aren't those of a trained one, a store names its
    distance, and the index in memory gives cosines."""
    if model.lower().startswith("hash"):
        return "hash_cosine"
    if store != "memory" and distance:
        return f"dense_{distance.lower()}"
    return "dense_cosine"


def gate_stats(decisions: DataFrame) -> DataFrame:
    """(what, value, n) over actions, reasons of skipping and score spaces."""
    rows = decisions.select(F.explode(F.array(F.struct(F.lit("action").alias("what"), F.col("action").alias("value")), F.struct(F.lit("skip_reason").alias("what"), F.when(F.col("action") == "skipped", F.col("reason")).alias("value")), F.struct(F.lit("score_space").alias("what"), F.col("score_space").alias("value")))).alias("x")).select("x.*").where("value is not null")
    return rows.groupBy("what", "value").agg(F.count("*").alias("n"))


def exact_dedup(sources: DataFrame, key: list[str]) -> DataFrame:
    """Keeps the first by (query_id, key) in the order of ``source_index``; rows with a null key stay."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    w = Window.partitionBy("query_id", *key, F.when(whole, F.lit(0)).otherwise(F.col("source_index"))).orderBy("source_index")
    return sources.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def shingles(c: Column, n: int = 5) -> Column:
    """Hashes of the distinct runs of ``n`` characters of a text that is lower-cased and single-spaced
    already; a shorter text is its own shingle. Spark's array functions use hash sets for numbers only,
    and compare strings one by one with all others, hence the hashes; ``substring`` walks from the
    start of a text each time, hence one pass of a pattern that takes a character and looks at the run."""
    size = F.char_length(c)
    return F.when(size == 0, F.array().cast("array<bigint>")).when(size <= n, F.array(F.xxhash64(c))).otherwise(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1)), lambda g: F.xxhash64(g))))


def near_duplicates(sources: DataFrame, threshold: float) -> DataFrame:
    """(query_id, a, b, jaccard): pairs of a query's sources, a before b, whose shingles are that similar.

    ``sources`` has (query_id, source_index, content) once each. Null contents take no part; two
    empty ones are alike, an empty and another aren't. Pairs whose sizes rule them out are dropped before the sets are
    compared. A query has at most some dozens of sources; for a whole corpus use another operator.
    """
    s = sources.where("content is not null").select("query_id", "source_index", F.lower("content").alias("c")).withColumn("c", F.trim(F.regexp_replace("c", r"\s+", " ")))
    s = s.select("query_id", "source_index", shingles(F.col("c")).alias("g")).withColumn("n", F.size("g"))
    x = s.select("query_id", F.col("source_index").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"))
    y = s.select("query_id", F.col("source_index").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"))
    fit = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    p = x.join(y, "query_id").where(fit).withColumn("both", F.size(F.array_intersect("ga", "gb")))
    jaccard = F.when((F.col("na") == 0) & (F.col("nb") == 0), 1.0).otherwise(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    return p.select("query_id", "a", "b", F.round(jaccard, 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def dedup_key() -> Column:
    """What makes two sources one: the same slice of a source, else the same id, else the same parent; null is like no other."""
    span = F.when(F.col("source").isNotNull() & F.col("start_char").isNotNull() & F.col("end_char").isNotNull(), F.concat_ws("\u0000", F.lit("span"), "source", F.col("start_char").cast("string"), F.col("end_char").cast("string")))
    named = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat_ws("\u0000", F.lit(c), c))
    return F.coalesce(span, named("record_id"), named("parent_id"))


@dataclass(frozen=True)
class Packing:
    exact: bool = False
    near_threshold: float | None = None
    # Marks after which a source that is too large may be cut.
    separators: tuple[str, ...] = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ")

    def __post_init__(self) -> None:
        if self.near_threshold is not None and not 0 <= self.near_threshold <= 1:
            raise ValueError("near_threshold must be within 0..1")


def _shingle_set(text: str) -> set[str]:
    t = " ".join((text or "").lower().split())
    return {t} if 0 < len(t) <= 5 else {t[k : k + 5] for k in range(len(t) - 4)}


def _tokens(text: str) -> int:
    cjk = sum("一" <= c <= "鿿" for c in text)
    return max(1, cjk + -(-(len(text) - cjk) // 4))


def _kept(sources: list, option: Packing) -> tuple[list, list[str], list[str]]:
    """(sources without repeats, ids of repeats, why each is one)."""
    kept: list = []
    keys: set[str] = set()
    grams: list[set[str]] = []
    gone, reasons = [], []
    for s in sources:
        reason = "exact" if option.exact and s["key"] is not None and s["key"] in keys else None
        if reason is None and option.near_threshold is not None:
            g = _shingle_set(s["content"])
            alike = ((1.0 if not (g or h) else len(g & h) / len(g | h)) for h in grams)
            reason = "near" if any(x >= option.near_threshold for x in alike) else None
            if reason is None:
                grams.append(g)
        if reason:
            gone.append(s["name"])
            reasons.append(reason)
            continue
        keys.add(s["key"])
        kept.append(s)
    return kept, gone, reasons


def _cuts(text: str, marks: tuple[str, ...]) -> list[int]:
    """Ends of the text's beginnings at marks, the longest first."""
    ends = {len(text)} | {m.end() for mark in marks for m in re.finditer(re.escape(mark), text)}
    return sorted(ends - {0}, reverse=True)


def _packed(sources: list, limit: int, unit: str, option: Packing) -> tuple:
    size = _tokens if unit == "tokens" else len
    kept, gone, reasons = _kept(sources, option)
    blocks: list[str] = []
    used, skipped, shortened = [], [], []

    def fits(block: str) -> bool:
        return size("\n\n".join([*blocks, block])) <= limit

    for s in kept:
        head, text = f"[{len(blocks) + 1}] {s['label']}\n", s["content"] or ""
        block = (head + text).strip()
        if not fits(block) and size(block) > limit:
            short = ((head + part).strip() for e in _cuts(text, option.separators) if (part := text[:e].strip()))
            cut = next((b for b in short if size(b) <= limit), None)
            if cut is not None and fits(cut):
                shortened.append(s["name"])
                block = cut
        if fits(block):
            blocks.append(block)
            used.append(s["name"])
        else:
            skipped.append(s["name"])
    context = "\n\n".join(blocks) if blocks else "No relevant context was retrieved."
    return context, used, gone, reasons, skipped, shortened, size(context)


def pack_contexts(sources: DataFrame, budgets: DataFrame, option: Packing = Packing()) -> DataFrame:
    """One row per request: context, ids used, deduped (with dedup_reasons), skipped and truncated, budget used, limit and unit.

    ``sources`` has (request_id, source_index, record_id, content, score) and may have source, chunk_index,
    start_char, end_char and parent_id, ``budgets`` (request_id, budget_limit, budget_unit). Sources are taken in order,
    whole or not at all, and renumbered; one that is larger than the whole budget is cut at the last boundary that fits. A request's sources are a handful and are
    folded in one row. Repeated rows count once; a null or non-positive limit leaves the request out. A source goes by its id, else its
    parent's, else its slice, else its place.
    """
    ship_package(sources.sparkSession)
    extra = {"source": "string", "chunk_index": "int", "start_char": "int", "end_char": "int", "parent_id": "string"}
    s = sources.where("request_id is not null and source_index is not null").withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in sources.columns})
    s = s.groupBy("request_id", "source_index").agg(*[F.min(c).alias(c) for c in ("record_id", *extra)], F.max("content").alias("content"), F.max("score").alias("score"))
    s = s.withColumns({"key": dedup_key(), "name": source_identifier(F.col("record_id"), F.lit(None).cast("string"), F.col("parent_id"), F.col("source"), F.col("start_char"), F.col("end_char"), F.col("source_index")), "label": source_label(F.col("source"), F.col("chunk_index"), F.coalesce("score", F.lit(0.0)))})
    g = s.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("source_index", "name", "key", "label", "content"))).alias("sources"))
    b = budgets.groupBy("request_id").agg(F.max("budget_limit").alias("budget_limit"), F.max("budget_unit").alias("budget_unit")).where("budget_limit > 0")
    names = ["request_id", "context", "used_ids", "deduped_ids", "dedup_reasons", "skipped_ids", "truncated_ids", "budget_used", "budget_limit", "budget_unit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.request_id, *_packed(list(r.sources), int(r.budget_limit), r.budget_unit, option), int(r.budget_limit), r.budget_unit) for r in pdf.itertuples()]
            yield pd.DataFrame(out, columns=names)

    return g.join(b, "request_id").mapInPandas(run, "request_id string, context string, used_ids array<string>, deduped_ids array<string>, dedup_reasons array<string>, skipped_ids array<string>, truncated_ids array<string>, budget_used int, budget_limit int, budget_unit string")


def cut_context(blocks: DataFrame, limit: int) -> DataFrame:
    """(query_id, context) from (query_id, source_index, block): blocks in order up to ``limit`` characters, the last one cut there and nothing after it."""
    ordered = F.array_sort(F.collect_list(F.struct("source_index", "block")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(limit) - acc["n"]
        part = F.when(F.char_length(x["block"]) > room, F.rtrim(F.left(x["block"], room))).otherwise(x["block"])
        return F.when(room <= 0, acc).otherwise(F.struct((acc["n"] + F.char_length(x["block"])).alias("n"), F.concat(acc["out"], F.array(part)).alias("out")))

    folded = F.aggregate(ordered, start, step)
    return blocks.groupBy("query_id").agg(F.array_join(folded["out"], "\n\n").alias("context"))


SCOPES = {
    "relevance": "Name every source that bears on the question and say briefly why. ",
    "lookup": "Answer in one sentence that names the document and what it holds. ",
    "relation": "Answer in one sentence that ties the name to what it does. ",
    "plain": "Do not answer with the name of a source alone. ",
    "workaround": "Give the listed actions and the condition under which they apply.",
    "scenario": "Give the listed actions or checks in the words of the source.",
    "actions": "Begin with the actions or names that are asked for.",
    "narrow": "Keep to the value or action that is asked for and its condition.",
}


def build_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, prompt): context, question and instructions by the question's shape."""
    q = questions.select("query_id", "question").withColumns(question_shape(F.col("question")))
    entity = F.when(F.col("is_source_relevance"), SCOPES["relevance"]).when(F.col("is_lookup"), SCOPES["lookup"]).when(F.col("is_relationship"), SCOPES["relation"]).otherwise(SCOPES["plain"])
    answer = F.when(F.col("is_workaround"), SCOPES["workaround"]).when(F.col("is_scenario"), SCOPES["scenario"]).when(F.col("is_action_list"), SCOPES["actions"]).otherwise(SCOPES["narrow"])
    context = F.coalesce("context", F.lit("No relevant context was retrieved."))
    joined = q.join(contexts.select("query_id", "context"), "query_id", "left")
    return joined.select("query_id", F.concat(F.lit("Answer from this context and cite its numbers.\n\nContext:\n"), context, F.lit("\n\nQuestion:\n"), "question", F.lit("\n\n"), entity, answer).alias("prompt"))
