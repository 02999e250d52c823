"""Problem 6: cutting oversized texts at natural boundaries with one regular expression.

Every piece is one match of alternatives ordered by the strength of the boundary at which
they end: the rest of the text, a blank line, a line break, the end of a sentence, of a
clause, a space, and any character at all. The quantifiers are bounded by what the piece may
take, so that a match never exceeds the limit. The first piece may take the whole limit, a
later one the limit less the overlap; the overlap itself is added by looking back from where
the match starts. All of it is built-in SQL (``regexp_extract_all`` and array functions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = " \t\r\n"  # what is cut off both ends of a text


def _alternatives(limit: int, nearest: int = 1) -> str:
    """Matches of at most ``limit`` code points; a boundary counts from half the limit on, a space from ``nearest`` on."""
    least = max(1, limit // 2)
    kept = [rf".{{{least},{limit}}}(?<={end})" for end in (r"\n[ \t]{0,3}\n", r"\n", r"[.!?]\s|[。！？]", r"[,;:]\s|[，；：、]", r"[ \t]")]
    return "|".join([rf".{{1,{limit}}}\z", *kept, rf".{{{nearest},{limit}}}(?<=[ \t\n])", rf".{{1,{limit}}}"])


def boundary_pattern(size: int, overlap: int) -> str:
    overlap = min(overlap, size - 1)
    if overlap <= 0:
        return f"(?s){_alternatives(size)}"
    # A first piece no longer than the overlap would stand whole in the second one.
    return rf"(?s)\A(?:{_alternatives(size, overlap + 1)})|{_alternatives(size - overlap)}"


def pieces(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<start int, length int>>`` (code points, start from 0) over a text without edges."""
    overlap = max(0, min(overlap, size - 1))
    taken = F.transform(F.regexp_extract_all(text, F.lit(boundary_pattern(size, overlap)), F.lit(0)), F.char_length)
    grown = F.aggregate(
        taken,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, n: F.struct(
            (acc["end"] + n).alias("end"),
            F.concat(acc["out"], F.array(F.struct(F.greatest(F.lit(0), acc["end"] - overlap).alias("start"), (n + F.least(acc["end"], F.lit(overlap))).alias("length")))).alias("out"),
        ),
    )
    return grown["out"]


def split_oversized(df: DataFrame, settings: DataFrame, text_col: str = "content", type_col: str = "file_type", default: str = "default") -> DataFrame:
    """The rows of ``df`` with ``pieces array<struct<start, length>>`` of the text without edges.

    ``settings`` holds (file_type, chunk_size, chunk_overlap) with one row per file type, a
    list of settings that is read to the driver (at most 1,000 rows; more is an error). A null or unlisted type takes
    the row ``default``; without one its rows stay whole. A null text has null pieces, an
    empty or blank one an empty array, a text within its limit one piece. Repeated rows come
    out as often as they went in. A text of any length is cut whole. A column of ``df`` that
    is named ``pieces`` or ``trimmed`` is replaced.
    """
    rows = settings.groupBy("file_type").agg(F.max("chunk_size").alias("s"), F.max("chunk_overlap").alias("o")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 splitter settings")
    by_type = {r.file_type: (r.s, r.o or 0) for r in rows if r.file_type is not None and r.s and r.s > 0}
    df = df.withColumn("trimmed", F.btrim(F.col(text_col), F.lit(EDGE)))
    text, n = F.col("trimmed"), F.char_length("trimmed")

    def cut(size: int, overlap: int) -> Column:
        return F.when(n > size, pieces(text, size, overlap))

    def whole() -> Column:
        return F.when(n > 0, F.array(F.struct(F.lit(0).alias("start"), n.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))

    by_size: dict[tuple[int, int], list[str]] = {}
    for kind, key in by_type.items():
        by_size.setdefault(key, []).append(kind)
    listed = [k for k in by_type if k != default]
    out = F.when(text.isNull(), F.lit(None))
    for (size, overlap), kinds in by_size.items():
        named = [k for k in kinds if k != default]
        here = F.col(type_col).isin(named) if named else F.lit(False)
        if default in kinds:
            here = F.coalesce(here, F.lit(False)) | F.col(type_col).isNull() | (~F.col(type_col).isin(listed) if listed else F.lit(True))
        out = out.when(F.coalesce(here, F.lit(False)) & (n > size), cut(size, overlap))
    return df.withColumn("pieces", out.otherwise(whole()))


def piece_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per piece: the kept columns, ``piece_no`` from 1, ``start_char``, ``piece``."""
    at = df.select(*keep, "trimmed", F.posexplode("pieces").alias("k", "p"))
    return at.select(*keep, (F.col("k") + 1).alias("piece_no"), F.col("p.start").alias("start_char"), F.expr("substring(trimmed, p.start + 1, p.length)").alias("piece"))
