"""Readers of evaluation files (JSON lines), metric texts and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.functions.text import normalize_question

GOLDEN = "qid string, question string, relevant array<struct<source:string,chunk_index:int>>, ground_truth string, capability string, note string"
PROBE_KINDS = ("out_of_domain", "near_domain_out_of_scope", "explicitly_excluded", "hallucinated_entity")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")


def _guard(bad: DataFrame, what: str) -> None:
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions; ids are unique, negatives have no labels and the others one or more."""
    rows = _lines(spark, path).select(F.from_json("value", GOLDEN).alias("r")).select("r.*")
    _guard(rows.where("qid is null or trim(question) = '' or question is null"), "rows without id or question")
    _guard(rows.groupBy("qid").count().where("count > 1"), "repeated ids")
    _guard(rows.where("(capability = 'negative') <> (coalesce(size(relevant), 0) <= 0)"), "labels that don't suit the capability")
    if rows.isEmpty():
        raise ValueError("no golden questions")
    return rows


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Negative probes in the form of golden questions."""
    rows = _lines(spark, path).select(F.from_json("value", "probe_id string, question string, category string, note string, relevant string").alias("r")).select("r.*")
    _guard(rows.where(~F.col("category").isin(list(PROBE_KINDS)) | F.col("relevant").isNotNull()), "wrong categories, or labels")
    _guard(rows.groupBy("probe_id").count().where("count > 1"), "repeated ids")
    _guard(rows.groupBy(normalize_question(F.col("question")).alias("q")).count().where("count > 1"), "repeated questions")
    return rows.select(F.col("probe_id").alias("qid"), "question", F.array().cast("array<struct<source:string,chunk_index:int>>").alias("relevant"), F.lit(None).cast("string").alias("ground_truth"), F.concat(F.lit("negative_probe_"), "category").alias("capability"), "note")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(qid, capability, run_index, metric, value) of recorded judgements; scores are finite and in 0..1."""
    runs = "array<struct<faithfulness:double,answer_relevance:double,context_precision:double,context_recall:double>>"
    rows = _lines(spark, path).select(F.from_json("value", f"qid string, capability string, runs {runs}, negative_runs array<struct<abstained:boolean,fabricated:boolean>>").alias("r")).select("r.*").where("qid is not null")
    _guard(rows.where("coalesce(size(runs), 0) < 2 and coalesce(size(negative_runs), 0) < 2"), "fewer than two repetitions")
    long = rows.select("qid", "capability", F.posexplode("runs").alias("run_index", "r")).select("qid", "capability", "run_index", F.expr("stack(4, 'faithfulness', r.faithfulness, 'answer_relevance', r.answer_relevance, 'context_precision', r.context_precision, 'context_recall', r.context_recall) as (metric, value)"))
    neg = rows.select("qid", "capability", F.posexplode("negative_runs").alias("run_index", "r")).select("qid", "capability", "run_index", F.expr("stack(2, 'abstained', cast(r.abstained as double), 'fabricated', cast(r.fabricated as double)) as (metric, value)"))
    every = long.unionByName(neg)
    _guard(every.where("value is null or isnan(value) or value < 0 or value > 1"), "scores outside 0..1")
    return every


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """(question_key, pos, rewrite); the later of two lines of one question wins."""
    rows = _lines(spark, path).withColumn("line", F.monotonically_increasing_id()).select("line", F.from_json("value", "question string, rewrites array<string>, variants array<string>").alias("r"))
    keyed = rows.select(normalize_question(F.col("r.question")).alias("question_key"), "line", F.coalesce("r.rewrites", "r.variants").alias("w"))
    return keyed.groupBy("question_key").agg(F.max_by("w", "line").alias("w")).select("question_key", F.posexplode("w").alias("pos", "rewrite"))


def parse_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels map, number) of metric lines; comments and what can't be read are left out."""
    pattern = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)\s*$"
    line = F.trim(column)
    number = F.expr(f"try_cast(regexp_extract(trim({column}), r'{pattern}', 3) as double)")
    labels = F.regexp_replace(F.regexp_extract(line, pattern, 2), '"', "")
    return lines.where(~line.startswith("#") & line.rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("name"), F.when(labels != "", F.str_to_map(labels, F.lit(","), F.lit("="))).alias("labels"), number.alias("number")).where("number is not null")


def parse_events(blocks: DataFrame, column: str = "value") -> DataFrame:
    """(event, data) of server-sent event blocks; data lines are joined by line ends, a block without data is left out."""
    lines = F.split(column, r"\r?\n")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substr(x, F.lit(6))))
    name = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.trim(F.substr(x, F.lit(7))))
    return blocks.select(F.coalesce(F.try_element_at(name, F.lit(-1)), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data")).where("data <> ''")


def parse_chat_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    """The pieces of text of a streamed chat reply; the end mark and malformed lines are left out."""
    body = F.trim(F.regexp_replace(column, r"^data:\s*", ""))
    return lines.where(F.col(column).startswith("data:") & (body != "[DONE]")).select(F.get_json_object(body, "$.choices[0].delta.content").alias("piece")).where("piece is not null")
