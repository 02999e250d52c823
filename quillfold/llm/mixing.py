"""Problem 8: mixing sources to target shares by pivotal dependent rounding.

A source of ``n`` tokens whose target is ``t`` tokens gets ``t / n`` copies of each of its
documents, at most its ``max_repeats``: the whole part for certain and the fraction by
dependent rounding. Two documents with fractions p and q, of v and w tokens, give one another
mass so that v*p + w*q stays and one of them becomes 0 or 1; which of the two ways is drawn
so that each keeps its expectation. So a group of any size ends with one fraction at most.
Groups of documents do this apart, and their leftovers meet in a reduction tree until one
document per source is left, which a last draw settles. The tokens of a source therefore miss
their target by less than one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.encode import count_tokens
from quillfold.sources.tables import stored

FAN_IN = 256
LEAF = 20_000
EPS = 1e-9


def allocate(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int]) -> dict[str, float]:
    """Copies per document of each source: shares of the whole, with capped sources at their
    cap and what they can't use spread over the others in proportion to their shares."""
    total = sum(tokens.values())
    live = {s for s in tokens if tokens[s] > 0 and share.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    copies = {s: 0.0 for s in tokens}
    rest = float(total)
    while live:
        weight = sum(share[s] for s in live)
        full = {s for s in live if rest * share[s] / weight >= repeats[s] * tokens[s]}
        if not full:
            copies |= {s: rest * share[s] / weight / tokens[s] for s in live}
            break
        for s in full:
            copies[s] = float(repeats[s])
            rest -= repeats[s] * tokens[s]
        live -= full
    return copies


def pivotal(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds ``p`` to 0 and 1 but for one place at most, and keeps sum(w * p)."""
    p = p.copy()
    draws = rng.random(len(p))
    held = -1
    for k in range(len(p)):
        if p[k] <= EPS or p[k] >= 1 - EPS:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        a, b, v, u = p[held], p[k], w[held], w[k]
        up = min((1 - a) * v, b * u)  # mass that may move to the held one
        down = min(a * v, (1 - b) * u)
        move = up if draws[k] * (up + down) < down else -down
        a, b = a + move / v, b - move / u
        p[held], p[k] = a, b
        if EPS < b < 1 - EPS:
            p[held] = round(a)
            held = k
        else:
            p[k] = round(b)
            if not EPS < a < 1 - EPS:
                p[held] = round(a)
                held = -1
    return p


def _round_groups(df: DataFrame, seed: int) -> DataFrame:
    """One level: within each (source, grp), all fractions but one become whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "p"], ignore_index=True)
        pdf["p"] = pivotal(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(dtype=float), np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF, len(pdf)]))
        return pdf

    return df.groupBy("source", "grp").applyInPandas(run, df.schema)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses of each document, report per source).

    ``targets`` has (source, target_share, max_repeats), one row per source; it is read to the
    driver with the token sums per source, at most 100,000 sources. Documents with null
    source or null or blank text take no part; a repeated id counts once; a source that isn't
    in ``targets`` is used 0 times; a null or negative share or repeat counts as 0. The report
    has every source of ``targets`` or of the documents: target_share, tokens, mixed_tokens,
    actual_share, max_repeats, capped. Empty tables give empty results.
    """
    spark = docs.sparkSession
    part = docs.where(F.col(source_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = stored(count_tokens(part, ["doc_id", "source"], "text", folder=folder).where("tokens > 0").groupBy("doc_id").agg(F.min_by("source", F.struct("source", "tokens")).alias("source"), F.min_by("tokens", F.struct("source", "tokens")).alias("tokens")), "mix")
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(100_001).collect()
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("rep")).limit(100_001).collect()
    if max(len(sums), len(wanted)) > 100_000:
        raise ValueError("more than 100,000 sources")
    tokens = {r.source: r.tokens for r in sums}
    share = {r.source: max(0.0, r.share or 0.0) for r in wanted}
    repeats = {r.source: max(0, r.rep or 0) for r in wanted}
    copies = allocate(tokens, share, repeats)
    leaves = {r.source: max(1, math.ceil(r.n / LEAF)) for r in sums}
    plan = spark.createDataFrame([(s, float(math.floor(c + EPS)), max(0.0, c - math.floor(c + EPS)), leaves[s]) for s, c in copies.items()], "source string, whole double, p double, leaves int")
    level = counted.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", "whole", "p", (F.pmod(F.xxhash64("doc_id"), F.col("leaves"))).cast("int").alias("grp"))
    width = max(leaves.values(), default=1)
    done: list[DataFrame] = []
    while True:
        level = stored(_round_groups(level, seed), "mix-level")
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(level.where(~open_))
        level = level.where(open_)
        if width == 1:
            break
        width = math.ceil(width / FAN_IN)
        level = level.withColumn("grp", (F.col("grp") / FAN_IN).cast("int"))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = level.withColumn("p", F.when(luck < F.col("p"), 1.0).otherwise(0.0))
    for d in done:
        rows = rows.unionByName(d)
    uses = rows.select("doc_id", "source", "tokens", (F.col("whole") + F.round("p")).cast("int").alias("uses"))
    names = sorted({*tokens, *share})
    fixed = spark.createDataFrame([(s, share.get(s, 0.0), repeats.get(s, 0), int(tokens.get(s, 0)), bool(tokens.get(s) and copies[s] >= repeats.get(s, 0) > 0)) for s in names], "source string, target_share double, max_repeats int, tokens bigint, capped boolean")
    got = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("mixed_tokens"))
    whole = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = fixed.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", "tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.round(F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), "capped")
    return uses, report
