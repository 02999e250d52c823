"""Hash embeddings, batches by budget, the profile of an index, and the wire form of vectors."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.functions.text import raw_tokens


def hash_embedding(dimension: int = 128):
    """A pandas UDF array<string> -> array<double>: signed counts of hashed tokens, to length 1.

    Spark has no blake2b, so the digests are Python's; each distinct token of a batch is hashed once.
    No tokens and null give the zero vector.
    """
    if dimension <= 0:
        raise ValueError("dimension must be positive")

    @F.pandas_udf("array<double>")
    def embed(lists: pd.Series) -> pd.Series:
        place: dict[str, tuple[int, float]] = {}
        out = []
        for tokens in lists:
            v = np.zeros(dimension)
            for t in tokens if tokens is not None else ():
                at = place.get(t)
                if at is None:
                    n = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                    at = place[t] = (n % dimension, 1.0 if (n >> 1) % 2 == 0 else -1.0)
                v[at[0]] += at[1]
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def embed_documents(docs: DataFrame, text_col: str, dimension: int = 128, model: str = "hash") -> DataFrame:
    return docs.withColumns({"embedding": hash_embedding(dimension)(raw_tokens(F.col(text_col))), "embedding_model": F.lit(f"{model}-{dimension}"), "embedding_dimension": F.lit(dimension), "embedding_normalized": F.lit(True)})


def request_batches(items: DataFrame, max_count: int = 64, max_tokens: int = 8192) -> DataFrame:
    """(group_key, item, batch_no from 1): items of a group in order, a new batch where the next would exceed a budget.

    An item over the token budget is an error. ``items`` has (group_key, item, tokens).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, rows in zip(pdf["group_key"], pdf["rows"]):
                number, count, used = 1, 0, 0
                for r in rows:
                    if r["tokens"] > max_tokens:
                        raise ValueError(f"an item of {r['tokens']} tokens exceeds the budget of {max_tokens}")
                    if count and (count == max_count or used + r["tokens"] > max_tokens):
                        number, count, used = number + 1, 0, 0
                    count, used = count + 1, used + r["tokens"]
                    out.append((g, r["item"], number))
            yield pd.DataFrame(out, columns=["group_key", "item", "batch_no"])

    kind = items.schema["item"].dataType.simpleString()
    grouped = items.groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct("item", F.col("tokens").cast("int").alias("tokens")))).alias("rows"))
    return grouped.mapInPandas(run, f"group_key string, item {kind}, batch_no int")


def embedding_profile(index: DataFrame) -> DataFrame:
    """(embedding_model, dimension, n): the profiles that an index mixes; null vectors have dimension null."""
    return index.groupBy("embedding_model", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension")).agg(F.count("*").alias("n"))


def check_profile(index: DataFrame, model: str, dimension: int) -> None:
    """Raises unless every record has a vector of this model and dimension."""
    rows = embedding_profile(index).limit(100).collect()
    if not rows:
        raise ValueError("the index is empty")
    wrong = [r for r in rows if r.embedding_model != model or r.dimension != dimension]
    if wrong:
        raise ValueError(f"the index has other vectors than {model} of {dimension}: {wrong[:3]}")


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Length and big-endian doubles."""
    return pd.Series([None if v is None else struct.pack(">I", len(v)) + np.asarray(v, dtype=">f8").tobytes() for v in vectors])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_vector(raw: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else np.frombuffer(b[4 : 4 + 8 * struct.unpack(">I", b[:4])[0]], dtype=">f8").astype(float).tolist() for b in raw])


