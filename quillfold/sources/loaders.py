"""Documents from files: text, Markdown, and PDF and Word where their readers are installed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions import markdown
from quillfold.functions.text import clean_text
from quillfold.sources.tables import ship_package

TEXT, MARKDOWN, PDF, WORD = ("txt",), ("md", "markdown"), ("pdf",), ("docx",)
SUPPORTED = TEXT + MARKDOWN + PDF + WORD
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16", "latin-1")
BOMS = (b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding). Binary content is an error: a NUL, or over 30 % control bytes, in the first 4,096 bytes."""
    head = raw[:4096]
    if not raw.startswith(BOMS):
        control = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
        if 0 in head or (head and control > 0.3 * len(head)):
            raise ValueError("the file is binary")
    if raw.startswith(BOMS[0]):
        return raw[3:].decode("utf-8"), "utf-8"
    if raw.startswith(BOMS[1:]):
        return raw.decode("utf-16"), "utf-16"
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def pdf_text(raw: bytes, table_rows: bool = True) -> str:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF, which isn't installed") from e
    pages = []
    with fitz.open(stream=raw, filetype="pdf") as doc:
        for n, page in enumerate(doc, 1):
            text = page.get_text()
            if table_rows and hasattr(page, "find_tables"):
                text += "".join("\n[Table]\n" + table_markdown(t.extract()) for t in page.find_tables())
            pages.append(f"\n--- Page {n} ---\n{text}")
    return "".join(pages)


def table_markdown(rows: list[list[str | None]]) -> str:
    lines = ["| " + " | ".join((c or "").strip() for c in r) + " |" for r in rows]
    return "\n".join(lines[:1] + ["| " + " | ".join("---" for _ in rows[0]) + " |"] * bool(rows) + lines[1:])


def word_text(raw: bytes) -> str:
    try:
        import io

        import docx
    except ImportError as e:
        raise RuntimeError("reading Word files needs python-docx, which isn't installed") from e
    d = docx.Document(io.BytesIO(raw))
    parts = [p.text for p in d.paragraphs if p.text.strip()]
    for n, t in enumerate(d.tables, 1):
        parts.append(f"[Table {n}]\n" + "\n".join(" | ".join(c.text.strip() for c in r.cells) for r in t.rows))
    return "\n\n".join(parts)


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, name, ext, length) of the supported files under a folder, or of the one file."""
    if path.startswith("/") and not os.path.exists(path):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), ext.alias("ext"), "length").where(ext.isin(list(SUPPORTED)))


def load_documents(spark: SparkSession, path: str, *, recursive: bool = True, clean: bool = True, code: str = "preserve") -> DataFrame:
    """(source, file_type, encoding, title, content, cleaned) of all supported files, one row each.

    Decoding runs on the executors; the Markdown and cleaning steps are expressions. A file that
    can't be read is an error that names it.
    """
    ship_package(spark)
    if path.startswith("/") and not os.path.exists(path):
        raise FileNotFoundError(path)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext")).where(F.col("ext").isin(list(SUPPORTED)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c, e in zip(pdf["path"], pdf["content"], pdf["ext"]):
                try:
                    text, name = (pdf_text(c), "pdf") if e in PDF else (word_text(c), "docx") if e in WORD else decode(c)
                except ValueError as x:
                    raise ValueError(f"{p}: {x}") from x
                rows.append((p, e, name, text))
            yield pd.DataFrame(rows, columns=["source", "ext", "encoding", "text"])

    text = raw.mapInPandas(run, "source string, ext string, encoding string, text string")
    is_md = F.col("ext").isin(list(MARKDOWN))
    plain = F.when(is_md, markdown.to_text(F.col("text"), code)).otherwise(F.col("text"))
    title = F.when(is_md, F.coalesce(markdown.front_matter(F.col("text"))["title"], markdown.headings(F.col("text"))[0]["title"]))
    return text.select(F.regexp_replace("source", "^file:(//)?", "").alias("source"), F.when(is_md, "md").otherwise(F.col("ext")).alias("file_type"), "encoding", title.alias("title"), (clean_text(plain) if clean else plain).alias("content"), F.lit(clean).alias("cleaned"))
