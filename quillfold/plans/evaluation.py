"""Evaluation of a folder of documents against golden questions, by profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.operators import chunking, evaluation
from quillfold.plans import retrieval
from quillfold.sources.tables import stored

FLAT, PARENTS, CHILDREN = chunking.Chunking(500, 80), chunking.Chunking(1600, 200), chunking.Chunking(400, 80)


def records_of(documents: DataFrame, option: retrieval.Options) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, parents or None) of loaded documents (source, file_type, content), cut as the options have it, with ids and places."""
    if not (option.hierarchical or option.expand):
        return stored(chunking.load_and_split(documents, FLAT), "chunks"), None
    parents = chunking.parent_child(documents.withColumn("__id", F.col("source")), "__id", "content", PARENTS, CHILDREN, "source")[0]
    return stored(chunking.load_and_split(documents, parent=PARENTS, child=CHILDREN), "chunks"), parents.select("parent_id", "content")


def run_of(documents: DataFrame, golden: DataFrame, option: retrieval.Options, rewrites: DataFrame | None = None) -> DataFrame:
    """(qid, rank, source, chunk_index, score): what the plan retrieves for each golden question."""
    chunks, parents = records_of(documents, option)
    found = retrieval.retrieve(golden.select(F.col("qid").alias("query_id"), "question"), chunks, option, rewrites=rewrites if option.multi_query else None, parents=parents if option.expand else None)
    if option.gate is not None:
        found = found.where("action not in ('rejected', 'no_candidates')")
    return found.join(chunks.select("id", "source", "chunk_index"), "id").select(F.col("query_id").alias("qid"), "rank", "source", "chunk_index", "score")


def evaluate(documents: DataFrame, golden: DataFrame, profiles: dict[str, retrieval.Options] = retrieval.PROFILES, rewrites: DataFrame | None = None, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """The metrics of every profile, per k and slice, with a column ``mode``. The profile of rewrites is left out where there are none."""
    every = None
    for name, option in profiles.items():
        if option.multi_query and rewrites is None:
            continue
        found = evaluation.cases(golden, run_of(documents, golden, option, rewrites), ks).withColumn("mode", F.lit(name))
        every = found if every is None else every.unionByName(found)
    return evaluation.summary(every, ["mode"])
