"""Spans of texts, parent and child chunks, and identities of records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfold.sources.tables import ship_package, shuffle_partitions, stored

SPANS = "array<struct<start:int,end:int>>"
SEPARATORS = ("\n\n", "\n", "。", "；", "，", ".", ";", ",", " ", "")


@dataclass(frozen=True)
class Chunking:
    size: int = 800
    overlap: int = 120
    separators: tuple[str, ...] = SEPARATORS

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("size must be positive and overlap at least 0 and less than size")


def fixed_spans(text: Column, size: int, overlap: int) -> Column:
    """Spans of ``size`` code points that step by size - overlap; the last ends with the text."""
    Chunking(size, overlap)
    n, step = F.char_length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).cast("int").alias("start"), F.least(n, k * step + size).cast("int").alias("end")))).otherwise(F.array().cast(SPANS))


def _pieces(text: str, span: tuple[int, int], option: Chunking) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` between separators, the strongest first; worked off with a stack, no recursion."""
    done: list[tuple[int, int]] = []
    todo = [(*span, 0)]
    while todo:
        a, b, level = todo.pop()
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a >= b:
            continue
        if b - a <= option.size:
            done.append((a, b))
            continue
        mark = option.separators[level] if level < len(option.separators) else ""
        if not mark:
            done += [(k, min(k + option.size, b)) for k in range(a, max(a + 1, b - option.overlap), option.size - option.overlap)]
            continue
        cuts, at = [], text.find(mark, a, b)
        while at >= 0:
            cuts.append(at)
            at = text.find(mark, at + len(mark), b)
        starts, ends = [a, *(c + len(mark) for c in cuts)], [*cuts, b]
        todo += [(s, e, level + 1) for s, e in zip(reversed(starts), reversed(ends))]
    return done


def text_spans(text: str | None, option: Chunking) -> list[tuple[int, int]]:
    """Chunks as runs of neighbouring pieces: every chunk is a slice of at most ``size`` that begins where its first
    piece does, or ``overlap`` before the end of the chunk before, as far as it has room for its first piece."""
    pieces = _pieces(text or "", (0, len(text or "")), option)
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(pieces):
        start, reach = pieces[k]
        if out:
            begun, stop = out[-1]
            if start >= stop:  # pieces that overlap of themselves stay as they are
                shared = max(begun, stop - option.overlap, reach - option.size)
                start = shared if shared < stop else start
        k += 1
        while k < len(pieces) and max(reach, pieces[k][1]) - start <= option.size:
            reach = max(reach, pieces[k][1])
            k += 1
        out.append((start, reach))
    return out


def chunk_spans(option: Chunking):
    """A pandas UDF text -> spans; only the offsets leave Python."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in text_spans(t, option)] for t in texts])

    return spans


def chunks(docs: DataFrame, id_col: str, text_col: str, option: Chunking = Chunking()) -> DataFrame:
    """(id, chunk_index, total_chunks, start_char, end_char, chunk_size, content); null and blank texts have no chunks."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("spans", chunk_spans(option)(F.coalesce("text", F.lit(""))))
    return d.select("id", F.size("spans").alias("total_chunks"), "text", F.posexplode("spans").alias("chunk_index", "s")).select("id", "chunk_index", "total_chunks", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), (F.col("s.end") - F.col("s.start")).alias("chunk_size"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("content"))


def parent_child(docs: DataFrame, id_col: str, text_col: str, parent: Chunking = Chunking(1600, 200), child: Chunking = Chunking(400, 80), source_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(parents, children): the children's offsets are of the document, and their index runs over it.

    A parent's id is the identity of its content, source, start and end. The children's size must be less than the parents'.
    """
    if child.size >= parent.size:
        raise ValueError("children must be smaller than parents")
    ship_package(docs.sparkSession)
    source = F.col(source_col).cast("string") if source_col else F.col(id_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), source.alias("source"), F.col(text_col).alias("text")).withColumn("spans", chunk_spans(parent)(F.coalesce("text", F.lit(""))))
    p = d.select("id", "source", F.size("spans").alias("total_parents"), "text", F.posexplode("spans").alias("parent_index", "s")).select("id", "source", "parent_index", "total_parents", F.col("s.start").alias("parent_start_char"), F.col("s.end").alias("parent_end_char"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("content"))
    p = p.withColumn("parent_id", record_id(F.col("content"), [("source", F.col("source")), ("start_char", F.col("parent_start_char")), ("end_char", F.col("parent_end_char"))]))
    c = p.withColumn("spans", chunk_spans(child)(F.col("content"))).select("id", "source", "parent_id", "parent_index", "parent_start_char", "parent_end_char", "content", F.explode("spans").alias("s"))
    w = Window.partitionBy("id")
    c = c.select("id", "source", "parent_id", "parent_index", "parent_start_char", "parent_end_char", (F.col("parent_start_char") + F.col("s.start")).alias("start_char"), (F.col("parent_start_char") + F.col("s.end")).alias("end_char"), (F.col("s.end") - F.col("s.start")).alias("chunk_size"), F.expr("substring(content, s.start + 1, s.end - s.start)").alias("content"))
    return p, c.withColumn("chunk_index", F.row_number().over(w.orderBy("parent_index", "start_char", "end_char")) - 1).withColumn("total_chunks", F.count("*").over(w))


def record_identity(explicit: Column, document_id: Column, content: Column, keys: Sequence[tuple[str, Column]]) -> Column:
    """The id that a chunk brings, else that of its document, else the digest of its content and metadata."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(document_id, F.lit("")), record_id(content, keys))


def in_sequence(df: DataFrame, order: Sequence[Column], name: str = "ingest_sequence") -> DataFrame:
    """The rows with numbers from 0 in a total order. Ranges are sorted apart and numbered from the
    sizes of those before them, so that no task holds all rows."""
    spark = df.sparkSession
    keyed = df.withColumns({f"__o{k}": c for k, c in enumerate(order)})
    names = [f"__o{k}" for k in range(len(order))]
    ranges = keyed.repartitionByRange(shuffle_partitions(spark), *names).sortWithinPartitions(*names)
    placed = stored(ranges.withColumns({"__p": F.spark_partition_id(), "__k": F.monotonically_increasing_id()}), "sequence")
    sizes = sorted(tuple(r) for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total - (part << 33)))
        total += n
    start = F.broadcast(spark.createDataFrame(starts, "__p int, __s bigint"))
    return placed.join(start, "__p").withColumn(name, F.col("__k") + F.col("__s")).drop("__p", "__k", "__s", *names)


def load_and_split(documents: DataFrame, option: Chunking | None = None, *, parent: Chunking | None = None, child: Chunking | None = None) -> DataFrame:
    """Chunks of loaded documents (source, file_type, content), flat or of two levels, with record ids and the order of ingestion.

    Files come in the order of their lower-cased path and then the path, chunks in theirs.
    """
    if parent is None:
        cut = chunks(documents, "source", "content", option or Chunking()).withColumnRenamed("id", "source").withColumn("parent_id", F.lit(None).cast("string"))
    else:
        cut = parent_child(documents.withColumn("__id", F.col("source")), "__id", "content", parent, child or Chunking(400, 80), "source")[1].drop("id")
    keys = [(c, F.col(c)) for c in ("source", "chunk_index", "start_char", "end_char")]
    named = cut.join(documents.select("source", "file_type"), "source").withColumn("id", record_id(F.col("content"), keys)).withColumn("loader_entrypoint", F.lit("load_and_split"))
    return in_sequence(named.select("id", "source", "file_type", "parent_id", "chunk_index", "total_chunks", "start_char", "end_char", "chunk_size", "content", "loader_entrypoint"), [F.lower("source"), F.col("source"), F.col("chunk_index")])


def locate(needle: Column, text: Column, start: Column) -> Column:
    """Where ``needle`` begins (from 0) at or after ``start``, else anywhere, else ``start`` within the text."""
    after, any_ = F.call_function("locate", needle, text, start + 1), F.call_function("locate", needle, text)
    return F.when(after > 0, after - 1).when(any_ > 0, any_ - 1).otherwise(F.greatest(F.lit(0), F.least(start, F.char_length(text))))


def record_id(content: Column, keys: Sequence[tuple[str, Column]]) -> Column:
    """sha256 of the canonical JSON of content and the metadata that is present.

    Keys are sorted, separators are ``", "`` and ``": "``, letters aren't escaped; slashes of the
    source point forward. Python's form of control characters needs Python.
    """
    names = [k for k, _ in keys]
    columns = [c.cast("string") for _, c in keys]
    numeric = {"chunk_index", "start_char", "end_char"}

    @F.pandas_udf("string")
    def digest(frame: pd.DataFrame) -> pd.Series:
        out = []
        for row in frame.itertuples(index=False):
            meta = {k: (int(v) if k in numeric else v) for k, v in zip(names, row[1:]) if isinstance(v, str)}
            if "source" in meta:
                meta["source"] = meta["source"].replace("\\", "/")
            text = json.dumps({"content": row[0] or "", "metadata": meta}, ensure_ascii=False, sort_keys=True)
            out.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        return pd.Series(out)

    return digest(F.struct(content.alias("content"), *[c.alias(f"m{k}") for k, c in enumerate(columns)]))


def record_order() -> list[Column]:
    """The sort columns of the index: sequence, source, chunk, start, end, id; missing numbers last."""
    far = F.lit((1 << 63) - 1)
    return [F.coalesce("ingest_sequence", far), F.coalesce("source", F.lit("")), *[F.coalesce(F.col(c).cast("bigint"), far) for c in ("chunk_index", "start_char", "end_char")], F.col("id")]
