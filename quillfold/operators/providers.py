"""Seams to services that Spark doesn't have: embedding models, rerankers, chat models, judges.

Each is an object with one method from DataFrame to DataFrame. The deterministic ones here
need no network; one that calls a service does so per Arrow batch in ``mapInPandas``.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.text import canned_answer, normalize_question, parse_variants, token_count
from quillfold.operators import embedding, lexical


class Embedder(Protocol):
    def embed(self, df: DataFrame, text_col: str) -> DataFrame: ...


class Reranker(Protocol):
    def rerank(self, candidates: DataFrame, top_n: int) -> DataFrame: ...


class Generator(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame: ...


class Rewriter(Protocol):
    def rewrite(self, questions: DataFrame) -> DataFrame: ...


class Judge(Protocol):
    def judge(self, answers: DataFrame) -> DataFrame: ...


class HashEmbedder:
    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, df: DataFrame, text_col: str) -> DataFrame:
        return embedding.embed_documents(df, text_col, self.dimension)


ERRORS = (ConnectionError, TimeoutError)  # of a call, after which it is tried again


def _called(client: Callable, tries: int, wait: float, *args):
    for n in range(tries):
        try:
            return client(*args)
        except ERRORS:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


class CallEmbedder:
    """Calls ``client(texts) -> [(index, vector)]`` on batches of at most ``batch`` texts and ``tokens`` tokens, as the
    package estimates them. Answers may come in any order. A text above the budget is an error; calls that break off are tried again."""

    def __init__(self, client: Callable[[list[str]], list[tuple[int, list[float]]]], model: str, batch: int = 64, tokens: int = 8192, query_prefix: str = "", tries: int = 3, wait: float = 0.5):
        self.client, self.model, self.batch, self.tokens, self.query_prefix, self.tries, self.wait = client, model, batch, tokens, query_prefix, tries, wait

    def embed(self, df: DataFrame, text_col: str, query: bool = False) -> DataFrame:
        """Adds embedding, embedding_model and embedding_tokens, what the text counts for; the prefix stands before queries only."""
        client, batch, budget, tries, wait = self.client, self.batch, self.tokens, self.tries, self.wait

        @F.pandas_udf("array<double>")
        def call(texts: pd.Series, sizes: pd.Series) -> pd.Series:
            out: list[list[float] | None] = [None] * len(texts)
            now: list[int] = []
            used = 0
            for k, n in enumerate([*sizes, None]):
                if n is not None and n > budget:
                    raise ValueError(f"a text of {n} tokens exceeds the budget of {budget}")
                if now and (n is None or len(now) == batch or used + n > budget):
                    for index, vector in _called(client, tries, wait, [texts.iloc[i] for i in now]):
                        out[now[index]] = vector
                    now, used = [], 0
                if n is not None:
                    now.append(k)
                    used += n
            return pd.Series(out)

        sent = F.concat(F.lit(self.query_prefix if query else ""), F.coalesce(F.col(text_col), F.lit("")))
        return df.withColumn("__sent", sent).withColumn("embedding_tokens", token_count(F.col("__sent"))).withColumns({"embedding": call(F.col("__sent"), F.col("embedding_tokens")), "embedding_model": F.lit(self.model)}).drop("__sent")


class LexicalReranker:
    provider = "deterministic"

    def rerank(self, candidates: DataFrame, top_n: int) -> DataFrame:
        return lexical.lexical_rerank(candidates, top_n)


class CallReranker:
    """Calls ``client(question, contents) -> [(index, score)]`` per question in batches of 32, each with its own indexes from 0.

    Calls that break off are tried again; if they still do, the question keeps the incoming order with null scores. Other errors aren't hidden.
    """

    provider = "call"

    def __init__(self, client: Callable[[str, list[str]], list[tuple[int, float]]], batch: int = 32, tries: int = 3, wait: float = 0.5):
        self.client, self.batch, self.tries, self.wait = client, batch, tries, wait

    def rerank(self, candidates: DataFrame, top_n: int) -> DataFrame:
        client, size, tries, wait = self.client, self.batch, self.tries, self.wait
        kind = candidates.schema["id"].dataType.simpleString()
        rows = candidates.groupBy("query_id", "question").agg(F.sort_array(F.collect_list(F.struct("dense_rank", "id", "content"))).alias("c"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    items = list(r.c)
                    scores: list[float | None] = [None] * len(items)
                    try:
                        for at in range(0, len(items), size):
                            for index, score in _called(client, tries, wait, r.question, [i["content"] or "" for i in items[at : at + size]]):
                                scores[at + index] = float(score)
                    except ERRORS:
                        scores = [None] * len(items)
                    order = sorted(range(len(items)), key=lambda k: (-scores[k] if scores[k] is not None else math.inf, k))
                    out += [(r.query_id, items[k]["id"], scores[k], n) for n, k in enumerate(order, 1) if n <= top_n]
                yield pd.DataFrame(out, columns=["query_id", "id", "score", "rank"])

        q = candidates.schema["query_id"].dataType.simpleString()
        return rows.mapInPandas(run, f"query_id {q}, id {kind}, score double, rank int")


class CannedGenerator:
    """Answers from what the prompt holds; for tests and offline runs."""

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("query_id", canned_answer(F.col("prompt")).alias("answer"))


class TableRewriter:
    """Rewrites from a table (question_key, pos, rewrite)."""

    def __init__(self, rewrites: DataFrame):
        self.rewrites = rewrites

    def rewrite(self, questions: DataFrame) -> DataFrame:
        keys = questions.select(normalize_question(F.col("question")).alias("question_key")).distinct()
        return self.rewrites.join(keys, "question_key", "left_semi").select("question_key", "pos", "rewrite")


class CallRewriter:
    """Calls ``client(question) -> reply`` once per distinct question and reads the variants from the reply."""

    def __init__(self, client: Callable[[str], str], tries: int = 3, wait: float = 0.5):
        self.client, self.tries, self.wait = client, tries, wait

    def rewrite(self, questions: DataFrame) -> DataFrame:
        client, tries, wait = self.client, self.tries, self.wait

        @F.pandas_udf("string")
        def call(texts: pd.Series) -> pd.Series:
            return pd.Series([_called(client, tries, wait, t) for t in texts])

        keys = questions.where("question is not null").select(normalize_question(F.col("question")).alias("question_key")).distinct()
        replies = keys.withColumn("reply", call(F.col("question_key")))
        return replies.select("question_key", F.posexplode(parse_variants(F.col("reply"))).alias("pos", "rewrite"))


def token_counter(name: str = "estimate", exact: Callable[[str], int] | None = None) -> Callable[[Column], Column]:
    """A column function that counts tokens: by the estimate, or by ``exact`` where its library can be imported; else the estimate again."""
    if name == "estimate":
        return token_count
    if name != "exact":
        raise ValueError("a token counter is estimate or exact")
    if exact is None:
        return token_count

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else exact(t) for t in texts], dtype="Int32")

    return count


ABSTENTION = "I do not know based on the provided context."


def answer_queries(prompts: DataFrame, decisions: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, answer, generated): rejected queries get the abstention and never reach the generator."""
    rejected = decisions.where("action in ('rejected', 'no_candidates')").select("query_id")
    made = generator.answer(prompts.join(rejected, "query_id", "left_anti")).withColumn("generated", F.lit(True))
    return made.unionByName(prompts.join(rejected, "query_id", "left_semi").select("query_id", F.lit(ABSTENTION).alias("answer"), F.lit(False).alias("generated")))
