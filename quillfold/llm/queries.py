"""The queries of the nine problems, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.llm import binpack, encode, mixing, neardup, neighbours, pairs, scans, spam, split
from quillfold.sources.tables import table


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "vector_records").select(F.lit("vector_records").alias("rel"), F.lit("").alias("grp"), F.col("id").alias("key"), "content")
    key = F.format_string("%s#%02d", "request_id", "source_index")
    sources = table(spark, folder, "retrieved_sources").where("request_id is not null and source_index is not null").select(F.lit("retrieved_sources").alias("rel"), F.col("request_id").alias("grp"), key.alias("key"), "content")
    return records.unionByName(sources)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(_contents(spark, folder))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each chunk that has similar ones: its class of equal shingles, its group, and how many are similar to it."""
    return neardup.similar_groups(_contents(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rag = table(spark, folder, "rag_responses").select(F.lit("rag_responses").alias("rel"), F.col("request_id").alias("row_key"), "question", "answer", F.lit(False).alias("abstains"))
    gold = table(spark, folder, "golden_set").select(F.lit("golden_set").alias("rel"), F.col("qid").alias("row_key"), "question", F.col("ground_truth").alias("answer"), (F.col("capability") == "negative").alias("abstains"))
    return rag.unionByName(gold)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder)
    return pairs.faulty_pairs(rows, pairs.fit(rows.where("not coalesce(abstains, false)")))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "vector_records").select("id", "content", "source", "file_type")
    counts = scans.vocabulary(records)
    scanned = records.where((F.col("file_type") == "pdf") | F.lower("source").endswith(".pdf")).where("id is not null")
    return scans.repair_scans(scanned, counts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).select("id", F.explode("noise").alias("noise")).distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text and the noise of each record of a PDF source."""
    return _repaired(spark, folder).groupBy("id").agg(F.max("repaired").alias("repaired"), F.max("noise").alias("noise"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    packed = binpack.fill_containers(binpack.request_items(table(spark, folder, "retrieved_sources"), table(spark, folder, "packed_contexts")))
    return packed.where("piece_no > 1").select(F.col("group_key").alias("request_id"), F.col("item").alias("source_index")).distinct()


def _packed_requests(spark: SparkSession, folder: str) -> DataFrame:
    return binpack.fill_containers(binpack.request_items(table(spark, folder, "retrieved_sources"), table(spark, folder, "packed_contexts")))


def p4_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The context number of each source or piece, and the used budget of each context."""
    return _packed_requests(spark, folder).select(F.col("group_key").alias("request_id"), F.col("item").alias("source_index"), "piece_no", "piece_start", "piece_size", F.col("container_no").alias("context_no"), F.col("used").alias("budget_used"))


TOKENS, SEGMENTS, LOSS = 512, 12, 256  # of a container of question and answer pairs


def _packed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs_ = table(spark, folder, "rag_responses").select(F.col("request_id").alias("row_key"), "model", "question", "answer")
    return binpack.fill_containers(binpack.pair_items(pairs_, TOKENS), SEGMENTS, LOSS)


def p4_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Question and answer pairs of each model in containers of 512 tokens, 12 pairs and 256 loss-bearing tokens (those of the answers)."""
    return _packed_pairs(spark, folder).select(F.col("group_key").alias("model"), F.col("item").alias("request_id"), "piece_no", "piece_size", "piece_loss", "container_no", "used", "used_loss", "segments")


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """What the packings of pairs and of requests hold, and how many containers break a limit or cut what fits."""
    v = _packed_pairs(spark, folder)
    held = v.groupBy("group_key").agg(F.countDistinct("item").alias("items"), F.sum("piece_size").alias("size"), F.sum(((F.col("used") > TOKENS) | (F.col("segments") > SEGMENTS) | ((F.col("used_loss") > LOSS) & (F.col("used_loss") > F.col("piece_loss"))) | ((F.col("piece_no") > 1) & (F.col("piece_start") % TOKENS != 0))).cast("int")).alias("broken")).withColumn("what", F.concat(F.lit("pairs "), "group_key")).drop("group_key")
    c = _packed_requests(spark, folder).where("container_no is not null")
    limit = table(spark, folder, "packed_contexts").groupBy(F.col("request_id").alias("group_key")).agg(F.max("budget_limit").alias("lim"))
    inside = c.join(limit, "group_key").agg(F.count_distinct("group_key", "item").alias("items"), F.sum("piece_size").alias("size"), F.sum(((F.col("used") > F.col("lim")) | ((F.col("piece_no") > 1) & (F.col("piece_start") % F.col("lim") != 0))).cast("int")).alias("broken")).withColumn("what", F.lit("requests"))
    return held.select("what", "items", "size", "broken").unionByName(inside.select("what", "items", "size", "broken"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vector_records").select("id", "embedding").unionByName(table(spark, folder, "embedded_documents").select("id", "embedding"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.close_pairs(_vectors(spark, folder), 0.9)


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest of every vector whose id, a hexadecimal number, is divisible by 20."""
    # 16 leaves 1 when divided by 5, so the number's digits' sum tells about 5 and its last digit about 4.
    ask = (F.conv(F.substring("id", -1, 1), 16, 10).cast("int") % 4 == 0) & (F.aggregate(F.transform(F.split("id", ""), lambda c: F.coalesce(F.conv(c, 16, 10).cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b) % 5 == 0)
    return neighbours.neighbours(_vectors(spark, folder).withColumn("ask", ask), 5, cells=400, stop=9.0, share=0.05)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "vector_records").select("id", "content", "file_type")
    cut = split.split_oversized(records, table(spark, folder, "splitter_settings"))
    return cut.where(F.size("pieces") > 1).select("id").distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all records, those within their limit as one piece."""
    records = table(spark, folder, "vector_records").select("id", "content", "file_type", "ingest_sequence")
    cut = split.split_oversized(records, table(spark, folder, "splitter_settings"))
    last = cut.where("id is not null").groupBy("id").agg(F.max_by(F.struct("trimmed", "pieces"), "ingest_sequence").alias("r")).select("id", "r.*")
    return split.piece_rows(last, ["id"])


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each record cover, the places where two of them leave a gap or overlap too little, and those above the limit."""
    p = p6_pieces(spark, folder).withColumn("stop", F.col("start_char") + F.char_length("piece"))
    kinds = table(spark, folder, "vector_records").where("id is not null").groupBy("id").agg(F.max_by("file_type", "ingest_sequence").alias("file_type"))
    s = table(spark, folder, "splitter_settings")
    limit = kinds.join(F.broadcast(s.where("file_type <> 'default'")), "file_type", "left").crossJoin(F.broadcast(s.where("file_type = 'default'").select(F.col("chunk_size").alias("d"), F.col("chunk_overlap").alias("o")))).select("id", F.coalesce("chunk_size", "d").alias("size"), F.coalesce("chunk_overlap", "o").alias("overlap"))
    before = F.lag("stop").over(Window.partitionBy("id").orderBy("piece_no"))
    at = p.withColumn("gap", F.coalesce(before, F.lit(0)) - F.col("start_char")).join(limit, "id")
    return at.groupBy("id").agg(F.max("stop").cast("bigint").alias("chars"), F.sum(((F.col("piece_no") > 1) & (F.col("gap") != F.col("overlap"))).cast("int")).alias("gaps"), F.sum((F.col("stop") - F.col("start_char") > F.col("size")).cast("int")).alias("over"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p8_uses(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


_TOK = "(length(regexp_replace({0}, '[^一-鿿]', '', 'g')) + CAST(ceil(length(regexp_replace({0}, '[一-鿿]', '', 'g')) / 4.0) AS BIGINT))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_repaired, p4_found, p4_contexts, p4_vector, p4_limits, p5_found, p5_neighbours, p6_found, p6_pieces, p6_cover, p7_ids, p8_uses, p8_shares, p9_found)}

SQL: dict[str, str] = {
    "p4_found": """
        WITH c AS (SELECT request_id, max(budget_limit) AS lim, max(budget_unit) AS unit FROM packed_contexts GROUP BY request_id),
        s AS (SELECT request_id, source_index, content, length(content) AS chars, length(regexp_replace(content, '[^一-鿿]', '', 'g')) AS cjk
              FROM retrieved_sources WHERE content IS NOT NULL)
        SELECT DISTINCT s.request_id, s.source_index FROM s JOIN c ON s.request_id = c.request_id
        WHERE CASE WHEN unit = 'tokens' THEN cjk + ceil((chars - cjk) / 4.0) ELSE chars END > lim""",
    "p4_limits": """
        WITH r AS (SELECT request_id, min({'m': coalesce(model, ''), 'q': question, 'a': answer}) AS r FROM rag_responses WHERE question IS NOT NULL AND answer IS NOT NULL AND request_id IS NOT NULL GROUP BY 1),
        c AS (SELECT request_id, max(budget_limit) AS lim, max(budget_unit) AS unit FROM packed_contexts GROUP BY request_id),
        s AS (SELECT request_id, source_index, max(length(content)) AS chars, max(TOK_content) AS toks FROM retrieved_sources WHERE content IS NOT NULL GROUP BY ALL)
        SELECT 'pairs ' || r.m AS what, count(*) AS items, CAST(sum(TOK_r.q + TOK_r.a) AS BIGINT) AS size, CAST(0 AS BIGINT) AS broken FROM r GROUP BY r.m
        UNION ALL SELECT 'requests', count(*), CAST(sum(CASE WHEN unit = 'tokens' THEN toks ELSE chars END) AS BIGINT), 0 FROM s JOIN c USING (request_id) WHERE lim > 0""".replace("TOK_content", _TOK.format("content")).replace("TOK_r.q", _TOK.format("r.q")).replace("TOK_r.a", _TOK.format("r.a")),
    "p6_cover": """
        WITH r AS (SELECT id, arg_max(content, ingest_sequence) AS content FROM vector_records WHERE id IS NOT NULL GROUP BY id)
        SELECT id, length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) AS chars, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS over FROM r WHERE length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) > 0""",
    "p6_found": """
        SELECT DISTINCT id FROM vector_records v
        LEFT JOIN splitter_settings t ON v.file_type = t.file_type AND t.file_type <> 'default'
        WHERE length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) > coalesce(t.chunk_size, (SELECT chunk_size FROM splitter_settings WHERE file_type = 'default'))""",
}
