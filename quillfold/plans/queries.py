"""The queries over the test tables, each an operator at work, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.functions import markdown, text, vectors
from quillfold.operators import access, cache, chunking, context, dense, embedding, evaluation, fusion, lexical, observe
from quillfold.plans import retrieval
from quillfold.sources import index as store
from quillfold.sources.tables import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- pieces of SQL

class _Template(str):
    """SQL with a place for an expression; other braces stay."""

    def format(self, expression: str) -> str:
        return self.replace("{0}", expression)


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RAW = "regexp_extract_all(lower({0}), '[A-Za-z0-9_]+|[一-鿿]')"
_CUT = "CASE WHEN length(t) <= 3 THEN t " + " ".join(f"WHEN suffix(t, '{s}') AND length(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)})" for s in text.SUFFIXES) + " ELSE t END"
_TOKENS = _Template(
    "list_filter(list_transform(list_transform(" + _RAW + ", lambda t: " + _CUT + "), lambda c: CASE WHEN length(c) > 4 AND suffix(c, 'e') THEN left(c, length(c) - 1) ELSE c END), "
    "lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "))"
)
_STRIP = _Template(f"regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g')")
_QUESTION = _Template(f"regexp_replace(regexp_replace(lower({{0}}), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')")
_RECORDS = "(SELECT id, arg_max(content, ingest_sequence) AS content, arg_max(source, ingest_sequence) AS source, arg_max(chunk_index, ingest_sequence) AS chunk_index, any_value(embedding) AS embedding FROM vector_records WHERE id IS NOT NULL GROUP BY id)"
_SOURCES = "(SELECT request_id, source_index, min(record_id) AS record_id, max(content) AS content, max(score) AS score, min(retrieval_mode) AS retrieval_mode FROM retrieved_sources WHERE request_id IS NOT NULL AND source_index IS NOT NULL GROUP BY ALL)"
_GOLDEN = "(SELECT qid, min(question) AS question, min(capability) AS capability, any_value(relevant) AS relevant FROM golden_set GROUP BY qid)"
_LOG = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC, latency_ms DESC NULLS LAST, ts DESC) AS rn FROM request_log WHERE request_id IS NOT NULL) WHERE rn = 1)"
_DIVISIBLE = "(instr('0123456789abcdef', right(id, 1)) - 1) % 4 = 0 AND list_sum(list_transform(string_split(id, ''), lambda c: instr('0123456789abcdef', c) - 1)) % 5 = 0"


def _bm25(docs: str, doc_id: str, body: str, asked: str, k: int) -> str:
    return f"""
        d AS (SELECT {doc_id} AS id, {_TOKENS.format(body)} AS ts FROM {docs}),
        st AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avgdl FROM d),
        tf AS (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM d),
        p AS (SELECT id, token, count(*) AS tf, any_value(dl) AS dl FROM tf GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
        q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('question')}) AS token FROM {asked}),
        s AS (SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
              FROM q JOIN p USING (token) JOIN df USING (token) CROSS JOIN st GROUP BY ALL),
        b AS (SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


# ---------------------------------------------------------------- tables


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last delivery of each record."""
    cols = list(dict.fromkeys(["id", *columns, "ingest_sequence"]))
    return store.latest(table(spark, folder, "vector_records").select(*cols).where("id is not null"), "id", ["ingest_sequence"])


def sources(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "retrieved_sources").where("request_id is not null and source_index is not null")
    return s.groupBy("request_id", "source_index").agg(F.min("record_id").alias("record_id"), F.max("content").alias("content"), F.max("score").alias("score"), F.min("retrieval_mode").alias("retrieval_mode"))


def golden(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "golden_set").groupBy("qid").agg(F.min("question").alias("question"), F.min("capability").alias("capability"), F.min_by("relevant", F.to_json("relevant")).alias("relevant"))


def log(spark: SparkSession, folder: str) -> DataFrame:
    return observe.one_delivery(table(spark, folder, "request_log"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rag_responses").where("request_id is not null").groupBy("request_id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))


_QUESTIONS = "(SELECT request_id, min(question) AS question, min(answer) AS answer FROM rag_responses WHERE request_id IS NOT NULL GROUP BY request_id)"


def divisible_by_20(c: str = "id"):
    """16 leaves 1 when divided by 5, so a hexadecimal number's digits' sum tells about 5, and its last digit about 4."""
    digit = lambda x: F.coalesce(F.conv(x, 16, 10).cast("int"), F.lit(0))
    return (digit(F.right(c, F.lit(1))) % 4 == 0) & (F.aggregate(F.transform(F.split(c, ""), digit), F.lit(0), lambda a, b: a + b) % 5 == 0)


# ---------------------------------------------------------------- texts


@query(f"""SELECT doc_id, {_STRIP.format("regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), chr(13) || chr(10) || '?', chr(10), 'g'), '([一-鿿A-Za-z0-9，,；;：:])\\n([一-鿿A-Za-z0-9])', '\\1\\2', 'g'), '([一-鿿A-Za-z0-9，,；;：:])\\n([一-鿿A-Za-z0-9])', '\\1\\2', 'g'), '-\\n([A-Za-z])', '-\\1', 'g'), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: " + _STRIP.format('x') + "), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned FROM documents""")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens, CAST(coalesce(len({_TOKENS.format('text')}), -1) AS INTEGER) AS n_tokens FROM documents")
def tokenize_docs(spark: SparkSession, folder: str) -> DataFrame:
    t = documents(spark, folder).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("tokens"), F.when(F.col("t").isNull(), -1).otherwise(F.size("t")).alias("n_tokens"))


@query("""
    WITH c AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk FROM documents)
    SELECT doc_id, CAST(greatest(1, cjk + ceil((n - cjk) / 4.0)) AS INTEGER) AS tokens, CAST(greatest(1, ceil(n / 4.0)) AS INTEGER) AS quarter,
           round(abs(greatest(1, ceil(n / 4.0)) - greatest(1, cjk + ceil((n - cjk) / 4.0))) / greatest(1, cjk + ceil((n - cjk) / 4.0)) * 100.0, 6) AS error_percent FROM c WHERE n IS NOT NULL""")
def token_count(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).where("text is not null").select("doc_id", text.token_count(F.col("text")).alias("tokens"), text.quarter_count(F.col("text")).alias("quarter"))
    return d.withColumn("error_percent", F.round(text.error_percent(F.col("quarter"), F.col("tokens")), 6))


def _has(x: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


@query(f"""
    WITH q AS (SELECT request_id, ' ' || {_QUESTION.format('question')} || ' ' AS x FROM {_QUESTIONS} WHERE question IS NOT NULL)
    SELECT request_id, trim(x) AS question, {_has('x', text.SCENARIO_KEYWORDS)} OR ({_has('x', text.PROCEDURAL_INTENT)} AND {_has('x', text.SITUATION)}) AS is_scenario, contains(x, 'workaround') AS is_workaround,
      {_has('x', text.LOOKUP_MARKERS)} AND {_has('x', text.LOOKUP_TARGETS)} AS is_lookup, {_has('x', text.RELEVANCE_MARKERS)} AND {_has('x', text.RELEVANCE_TARGETS)} AS is_source_relevance,
      {_has('x', text.RELATION_TARGETS)} AND {_has('x', text.RELATION_MARKERS)} AS is_relationship, {_has('x', text.ACTION_MARKERS)} AS is_action_list FROM q""")
def question_shape(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).where("question is not null").select("request_id", text.normalize_question(F.col("question")).alias("question"))
    return q.withColumns(text.question_shape(F.col("question")))


@query(f"SELECT request_id, {_has(_QUESTION.format('coalesce(answer, chr(32))'), ('i do not know based on the provided context', *text.ABSTENTIONS))} AS abstains, left(answer, 180) AS preview FROM {_QUESTIONS}")
def abstentions(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("request_id", text.is_abstention(F.col("answer")).alias("abstains"), text.preview(F.col("answer")).alias("preview"))


@query("""SELECT DISTINCT principal_id, CASE WHEN length(principal_id) <= 4 THEN repeat('*', length(principal_id)) ELSE left(principal_id, 2) || repeat('*', length(principal_id) - 4) || right(principal_id, 2) END AS masked FROM request_log WHERE principal_id IS NOT NULL""")
def mask_principals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "request_log").where("principal_id is not null").select("principal_id").distinct().withColumn("masked", text.mask(F.col("principal_id"), 2))


@query(f"""
    SELECT request_id, source_index, 'source=' || coalesce(v.source, 'unknown source') || CASE WHEN v.chunk_index IS NULL THEN '' ELSE '; chunk=' || v.chunk_index END || '; score=' || CAST(CAST(CAST(s.score AS VARCHAR) AS DECIMAL(18, 4)) AS VARCHAR) AS label
    FROM {_SOURCES} s LEFT JOIN {_RECORDS} v ON s.record_id = v.id WHERE s.score IS NOT NULL""")
def source_labels(spark: SparkSession, folder: str) -> DataFrame:
    v = records(spark, folder, "source", "chunk_index").select(F.col("id").alias("record_id"), "source", "chunk_index")
    return sources(spark, folder).where("score is not null").join(v, "record_id", "left").select("request_id", "source_index", text.source_label(F.col("source"), F.col("chunk_index"), F.col("score")).alias("label"))


_FENCE = r"(?ms)^```([A-Za-z0-9_+.\-]*)[ \t]*\n(.*?)^[ \t]*```[ \t]*$"
_FRONT = r"(?s)\A\s*---\s*\n(.*?)\n---\s*?(?:\n|\z)"
_BREAKS = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_BODY = f"""
    a AS (SELECT doc_id, replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(57344), '') AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, w AS whole, CASE WHEN regexp_matches(w, '{_FRONT}') THEN regexp_replace(regexp_replace(w, '{_FRONT}', ''), '\\A\\n+', '') ELSE w END AS w FROM a),
    c AS (SELECT doc_id, whole, w, regexp_extract_all(w, '{_FENCE}', 1) AS langs, list_transform(regexp_extract_all(w, '{_FENCE}', 2), lambda k: regexp_replace(k, '\\n\\z', '')) AS codes FROM b)"""


def _plain(marked: str, filled_first: str, filled_last: str) -> str:
    """SQL of the text rules; ``x`` runs from the marked text to the result."""
    row = "CASE WHEN length(l) - length(replace(l, '|', '')) >= 2 THEN array_to_string(list_filter(list_transform(string_split(trim(" + _STRIP.format("l") + ", '|'), '|'), lambda v: " + _STRIP.format("v") + "), lambda v: v <> ''), ' | ') ELSE l END"
    lines = f"list_transform(list_filter(string_split(regexp_replace(x, '{_BREAKS}', chr(10), 'g'), chr(10)), lambda l: NOT regexp_matches({_STRIP.format('l')}, '{markdown.RULE_ROW}')), lambda l: {row})"
    steps = [marked, filled_first, f"array_to_string({lines}, chr(10))"]
    rules = [(r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\(([^)]+)\)", r"\1"), (r"(?m)^(#{1,6})\s+(.+)$", r"\2"), (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"), (r"\*(.*?)\*|_(.*?)_", r"\1\2"), (r"`([^`]+)`", r"\1"), (r"~~(.*?)~~", r"\1"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*[-*_]{3,}\s*$", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
    steps += [f"regexp_replace(x, '{a}', '{b}', 'g')" for a, b in rules] + [filled_last, _STRIP.format("x")]
    out = "d0 AS (SELECT *, w AS x FROM c)"
    for k, step in enumerate(steps, 1):
        out += f", d{k} AS (SELECT doc_id, codes, langs, {step} AS x FROM d{k - 1})"
    return out + f", d AS (SELECT doc_id, x FROM d{len(steps)})"


def _filled_sql(block: str) -> str:
    return f"array_to_string(list_transform(range(1, len(string_split(x, chr(57344))) + 1), lambda i: string_split(x, chr(57344))[i] || coalesce({block}, '')), '')"


_MARKED = f"regexp_replace(x, '{_FENCE}', chr(10) || chr(57344) || chr(10), 'g')"


@query(f"""
    WITH {_BODY}, t AS (SELECT doc_id, regexp_replace(w, '{_FENCE}', chr(10), 'g') AS t, codes FROM c)
    SELECT doc_id, CAST(len(regexp_extract_all(t, '(?m)^(#{{1,6}})\\s+(.+)$', 2)) AS INTEGER) AS n_headings, array_to_string(list_transform(regexp_extract_all(t, '(?m)^(#{{1,6}})\\s+(.+)$', 2), lambda h: {_STRIP.format('h')}), '|') AS titles,
      array_to_string(list_transform(regexp_extract_all(t, '(?m)^(#{{1,6}})\\s+(.+)$', 1), lambda h: CAST(length(h) AS VARCHAR)), ',') AS levels, CAST(len(codes) AS INTEGER) AS n_code FROM t""")
def markdown_outline(spark: SparkSession, folder: str) -> DataFrame:
    t = documents(spark, folder).where("text is not null")
    h = t.select("doc_id", markdown.metadata(F.col("text")).alias("m")).select("doc_id", F.col("m.headings").alias("h"), F.col("m.code_blocks").alias("c"))
    return h.select("doc_id", F.size("h").alias("n_headings"), F.array_join(F.transform("h", lambda x: x["title"]), "|").alias("titles"), F.array_join(F.transform("h", lambda x: x["level"].cast("string")), ",").alias("levels"), F.size("c").alias("n_code"))


@query(f"WITH {_BODY}, {_plain(_MARKED, 'x', _filled_sql('codes[i]'))} SELECT doc_id, x AS content FROM d")
def markdown_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where("text is not null").select("doc_id", markdown.to_text(F.col("text")).alias("content"))


_EXTRACTED = _filled_sql("CASE WHEN i <= len(codes) THEN '[Code block ' || i || ': ' || CASE WHEN langs[i] = '' THEN 'unknown' ELSE langs[i] END || ']' END")


@query(f"WITH {_BODY}, {_plain(_MARKED, _EXTRACTED, 'x')} SELECT doc_id, x AS content FROM d")
def markdown_extract(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where("text is not null").select("doc_id", markdown.to_text(F.col("text"), "extract").alias("content"))


@query(f"WITH {_BODY}, {_plain(_MARKED.replace('chr(10) || chr(57344) || chr(10)', repr('')), 'x', 'x')} SELECT doc_id, x AS content FROM d")
def markdown_drop(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where("text is not null").select("doc_id", markdown.to_text(F.col("text"), "drop").alias("content"))


@query(f"""
    WITH {_BODY}, f AS (SELECT doc_id, unnest(string_split(regexp_extract(whole, '{_FRONT}', 1), chr(10))) AS l FROM b), k AS (SELECT doc_id, {_STRIP.format('l')} AS l FROM f),
    e AS (SELECT doc_id, {_STRIP.format("regexp_extract(l, '(?s)^([^:]*):', 1)")} AS key, trim({_STRIP.format("regexp_extract(l, '(?s)^[^:]*:(.*)$', 1)")}, '"' || chr(39)) AS v FROM k WHERE l <> '' AND NOT prefix(l, '#') AND regexp_matches(l, '(?s)^\\s*[^\\s:][^:]*:'))
    SELECT doc_id, key, CASE WHEN prefix(v, '[') AND suffix(v, ']') THEN 'list' WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(v, '[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float' ELSE 'string' END AS kind,
      CASE WHEN prefix(v, '[') AND suffix(v, ']') THEN array_to_string(list_transform(list_filter(list_transform(string_split(substring(v, 2, length(v) - 2), ','), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), lambda x: trim(x, '"' || chr(39))), chr(31)) WHEN lower(v) IN ('true', 'false') THEN lower(v) ELSE v END AS value FROM e""")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    e = documents(spark, folder).where("text is not null").select("doc_id", F.explode(markdown.front_matter_entries(F.col("text"))).alias("e"))
    return e.select("doc_id", "e.key", "e.kind", "e.value")


# ---------------------------------------------------------------- chunks and identities


@query("""
    WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
    k AS (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 800) / 680.0) AS INTEGER)))) AS k FROM d)
    SELECT doc_id, CAST(k * 680 AS INTEGER) AS start_char, CAST(least(n, k * 680 + 800) AS INTEGER) AS end_char FROM k""")
def fixed_spans(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.explode(chunking.fixed_spans(F.col("text"), 800, 120)).alias("s")).select("doc_id", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"))


_MARKS = "[。；，.;,]"  # may stand between two chunks
_LETTERS = f"length(regexp_replace(regexp_replace(text, '{_WS}', '', 'g'), '{_MARKS}', '', 'g'))"
_WHOLE = f"SELECT doc_id, CAST({_LETTERS} AS BIGINT) AS letters, CAST(0 AS BIGINT) AS broken FROM documents WHERE {_LETTERS} > 0"


def _covered(cut: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, letters, broken): the characters other than white space and marks that the chunks cover, once each, and the chunks that
    aren't a slice of the text of at most ``size`` characters, aren't numbered from 0 to their total, or aren't ``fine``."""
    by_place, by_number = Window.partitionBy("id").orderBy("start_char", "end_char"), Window.partitionBy("id").orderBy("chunk_index")
    at = cut.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("stop", F.coalesce(F.max("end_char").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("no", F.row_number().over(by_number) - 1).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    fresh = F.greatest("start_char", "stop")
    new = F.when(F.col("end_char") > fresh, F.char_length(F.regexp_replace(F.substr("text", fresh + 1, F.col("end_char") - fresh), f"{text.WS}|{_MARKS}", ""))).otherwise(0)
    good = (F.col("content") == F.substr("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))) & (F.col("chunk_size") == F.char_length("content")) & F.col("chunk_size").between(1, size) & (F.col("chunk_index") == F.col("no")) & (F.col("total_chunks") == F.col("n")) & F.col("fine")
    return at.groupBy("id").agg(F.sum(new).cast("bigint").alias("letters"), F.sum(F.when(good, 0).otherwise(1)).cast("bigint").alias("broken")).where("letters > 0 or broken > 0").withColumnRenamed("id", "doc_id")


@query(_WHOLE)
def chunk_spans(spark: SparkSession, folder: str) -> DataFrame:
    """What the chunks of every document cover, and the chunks that break a rule."""
    d = documents(spark, folder)
    c = chunking.chunks(d, "doc_id", "text")
    later = F.coalesce(F.col("start_char") > F.lag("start_char").over(Window.partitionBy("id").orderBy("chunk_index")), F.lit(True))
    return _covered(c.withColumn("fine", later), d, 800)


# The digest of a parent by another way: Spark's JSON, where no control character is written differently.
_JSON = "regexp_extract(to_json(named_struct('v', {0})), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1)"
_DIGEST = "content rlike '[\\u0000-\\u0008\\u000b\\u000e-\\u001f]' or parent_id = sha2(concat('{\"content\": ', " + _JSON.format("content") + ", ', \"metadata\": {\"end_char\": ', parent_end_char, if(source is null, '', concat(', \"source\": ', " + _JSON.format("source") + ")), ', \"start_char\": ', parent_start_char, '}}'), 256)"


@query(_WHOLE)
def parent_child_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the children; one that leaves its parent, or whose parent's id isn't the digest of it, is broken too."""
    d = documents(spark, folder)
    parents, children = chunking.parent_child(d, "doc_id", "text", source_col="source")
    p = parents.select("id", "parent_index", F.col("parent_id").alias("named"), F.expr(_DIGEST).alias("right"))
    inside = (F.col("named") == F.col("parent_id")) & F.col("right") & (F.col("start_char") >= F.col("parent_start_char")) & (F.col("end_char") <= F.col("parent_end_char"))
    return _covered(children.join(p, ["id", "parent_index"]).withColumn("fine", inside), d, 400)


@query("SELECT id, CAST(row_number() OVER (ORDER BY lower(coalesce(s, '')), coalesce(s, ''), coalesce(k, 9223372036854775807), id) - 1 AS BIGINT) AS position FROM (SELECT id, arg_max({'s': source}, ingest_sequence).s AS s, arg_max({'k': chunk_index}, ingest_sequence).k AS k FROM vector_records WHERE id IS NOT NULL GROUP BY id)")
def ingest_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every record in the order of ingestion: by source, chunk and id."""
    far = F.lit((1 << 63) - 1)
    r = records(spark, folder, "source", "chunk_index").select("id", F.coalesce("source", F.lit("")).alias("s"), F.coalesce(F.col("chunk_index").cast("bigint"), far).alias("k"))
    return chunking.in_sequence(r, [F.lower("s"), F.col("s"), F.col("k"), F.col("id")], "position").select("id", "position")


@query(f"""
    WITH r AS (SELECT id, arg_max({{'c': content, 's': source, 'k': chunk_index, 'a': start_char, 'e': end_char}}, ingest_sequence) AS r FROM vector_records WHERE id IS NOT NULL GROUP BY id)
    SELECT id, sha256('{{"content": ' || CAST(to_json(coalesce(r.c, '')) AS VARCHAR) || ', "metadata": {{' || array_to_string(list_filter([CASE WHEN r.k IS NOT NULL THEN '"chunk_index": ' || r.k END, CASE WHEN r.e IS NOT NULL THEN '"end_char": ' || r.e END,
      CASE WHEN r.s IS NOT NULL THEN '"source": ' || CAST(to_json(replace(r.s, chr(92), '/')) AS VARCHAR) END, CASE WHEN r.a IS NOT NULL THEN '"start_char": ' || r.a END], lambda x: x IS NOT NULL), ', ') || '}}}}') AS record_id FROM r""")
def record_ids(spark: SparkSession, folder: str) -> DataFrame:
    r = records(spark, folder, "content", "source", "chunk_index", "start_char", "end_char")
    return r.select("id", chunking.record_id(F.col("content"), [(c, F.col(c)) for c in ("source", "chunk_index", "start_char", "end_char")]).alias("record_id"))


@query("SELECT id, ingest_sequence, updated_at FROM (SELECT id, ingest_sequence, updated_at, row_number() OVER (PARTITION BY id ORDER BY ingest_sequence DESC) AS r FROM vector_records WHERE id IS NOT NULL) WHERE r = 1")
def upsert_records(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "vector_records").select("id", "ingest_sequence", "updated_at", "ingested_at").where("id is not null")
    late = F.coalesce(F.col("ingested_at") > F.col("updated_at") + F.expr("interval 1 day"), F.lit(False))
    return store.upsert(v.where(~late), v.where(late)).select("id", "ingest_sequence", "updated_at")


@query(f"SELECT id, ingest_sequence FROM (SELECT id, max(ingest_sequence) AS ingest_sequence FROM vector_records WHERE id IS NOT NULL GROUP BY id) WHERE id NOT IN (SELECT record_id FROM retrieved_sources WHERE record_id IS NOT NULL)")
def delete_records(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "retrieved_sources").where("record_id is not null").select(F.col("record_id").alias("id"))
    return store.delete(records(spark, folder), gone).select("id", "ingest_sequence")


@query("SELECT id, ingest_sequence FROM vector_records ORDER BY coalesce(ingest_sequence, 9223372036854775807), coalesce(source, ''), coalesce(chunk_index, 9223372036854775807), coalesce(start_char, 9223372036854775807), coalesce(end_char, 9223372036854775807), id LIMIT 100")
def list_records(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 records in the order of the index; the limit is the operator's."""
    v = table(spark, folder, "vector_records").select("id", "ingest_sequence", "source", "chunk_index", "start_char", "end_char")
    return v.orderBy(*chunking.record_order()).limit(100).select("id", "ingest_sequence")


@query("""
    WITH i AS (SELECT DISTINCT id AS k FROM vector_records WHERE id IS NOT NULL), b AS (SELECT left(sha256(k), 3) AS b, sha256(string_agg(k, chr(0) ORDER BY k)) AS d, count(*) AS n FROM i GROUP BY 1)
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce(string_agg(d, chr(0) ORDER BY b), '')) AS identity FROM b""")
def corpus_identity(spark: SparkSession, folder: str) -> DataFrame:
    return store.corpus_identity(table(spark, folder, "vector_records").select("id"))


@query("SELECT embedding_model, CAST(CASE WHEN embedding IS NULL THEN NULL ELSE len(embedding) END AS INTEGER) AS dimension, count(*) AS n FROM vector_records GROUP BY ALL")
def embedding_profile(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.embedding_profile(table(spark, folder, "vector_records"))


@query()
def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    e = embedding.embed_documents(records(spark, folder, "content").select("id", "content"), "content", 64)
    return e.select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"), "embedding_dimension")


@query(f"""
    WITH t AS (SELECT request_id AS group_key, greatest(1, length(regexp_replace(content, '[^一-鿿]', '', 'g')) + CAST(ceil(length(regexp_replace(content, '[一-鿿]', '', 'g')) / 4.0) AS BIGINT)) AS n FROM {_SOURCES} WHERE content IS NOT NULL)
    SELECT group_key, count(*) AS items, CAST(sum(n) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS broken FROM t GROUP BY 1""")
def embedding_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What the batches of each request hold, and those that are too large or had room for the next item."""
    s = sources(spark, folder).where("content is not null").select(F.col("request_id").alias("group_key"), F.col("source_index").alias("item"), text.token_count(F.col("content")).alias("tokens"))
    b = embedding.request_batches(s, 4, 8192).join(s, ["group_key", "item"])
    batch = b.groupBy("group_key", "batch_no").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.min_by("tokens", "item").alias("first"))
    w = Window.partitionBy("group_key").orderBy("batch_no")
    at = batch.withColumn("had", F.lag("tokens").over(w)).withColumn("held", F.lag("items").over(w)).withColumn("no", F.row_number().over(w))
    bad = (F.col("items") > 4) | (F.col("tokens") > 8192) | (F.col("no") != F.col("batch_no")) | F.coalesce((F.col("held") < 4) & (F.col("had") + F.col("first") <= 8192), F.lit(False))
    return at.groupBy("group_key").agg(F.sum("items").alias("items"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum(bad.cast("bigint")).alias("broken"))


# ---------------------------------------------------------------- retrieval


@query(f"WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents), p AS (SELECT DISTINCT doc_id, unnest(ts) AS token FROM d) SELECT token, count(*) AS df FROM p GROUP BY token")
def bm25_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(documents(spark, folder), "doc_id", "text"))


@query("WITH" + _bm25("documents", "doc_id", "text", f"(SELECT qid AS query_id, question FROM {_GOLDEN})", 10) + " SELECT * FROM b")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.bm25_topk(golden(spark, folder).select(F.col("qid").alias("query_id"), "question"), documents(spark, folder), 10, id_col="doc_id")


def _dense_sql(score: str) -> str:
    return f"""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({score}, 6) AS score FROM e AS q CROSS JOIN e WHERE q.vec_id % 20 = 0)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""


def _dense(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return dense.dense_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 10, metric)


@query(_dense_sql("CASE WHEN list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v) = 0 THEN 0 ELSE list_cosine_similarity(q.v, e.v) END"))
def dense_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, "cosine")


@query(f"""
    WITH a AS (SELECT id AS query_id, max(embedding) AS e FROM embedded_documents WHERE {_DIVISIBLE} GROUP BY id),
    r AS (SELECT id, arg_max({{'s': source, 'k': chunk_index, 'a': start_char, 'z': end_char}}, ingest_sequence) AS r, max(embedding) AS embedding FROM vector_records WHERE id IS NOT NULL GROUP BY id),
    s AS (SELECT query_id, id, replace(coalesce(r.s, ''), chr(92), '/') AS s, r, round(CASE WHEN list_dot_product(e, e) * list_dot_product(embedding, embedding) = 0 THEN 0 ELSE list_cosine_similarity(e, embedding) END, 6) AS score FROM a CROSS JOIN r WHERE e IS NOT NULL AND embedding IS NOT NULL),
    k AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(s), s, coalesce(r.k, 9223372036854775807), coalesce(r.a, 9223372036854775807), coalesce(r.z, 9223372036854775807), id) AS INTEGER) AS rank FROM s)
    SELECT * FROM k WHERE rank <= 20""")
def dense_topk_records(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest records of chunks that aren't in the index yet; equal scores in the order of sources and places."""
    recs = table(spark, folder, "vector_records").where("id is not null").groupBy("id").agg(F.max_by(F.struct("source", "chunk_index", "start_char", "end_char"), "ingest_sequence").alias("r"), F.max("embedding").alias("embedding")).select("id", "embedding", "r.*")
    return dense.dense_topk(_asked(spark, folder).select("query_id", "embedding"), recs, 20, ties=dense.record_ties())


@query(_dense_sql("list_dot_product(q.v, e.v)"))
def dense_topk_dot(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, "dot")


@query(_dense_sql("-list_distance(q.v, e.v)"))
def dense_topk_euclid(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, "euclid")


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS unit_sum FROM embeddings")
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(F.aggregate(vectors.normalize(F.col("embedding")), F.lit(0.0), lambda a, b: a + b), 6).alias("unit_sum"))


_VARIANTS = f"""(WITH g AS (SELECT qid, min(question) AS question, min(ground_truth) AS truth FROM golden_set GROUP BY qid),
    w AS (SELECT {_QUESTION.format('question')} AS key, min(truth) AS rewrite FROM g WHERE truth IS NOT NULL GROUP BY 1),
    q AS (SELECT qid, {_STRIP.format('question')} AS question, {_QUESTION.format('question')} AS key FROM g WHERE {_STRIP.format('question')} <> '')
    SELECT qid || '#0' AS query_id, question FROM q UNION ALL SELECT qid || '#1', {_STRIP.format('rewrite')} FROM q JOIN w USING (key) WHERE {_STRIP.format('rewrite')} <> '' AND {_QUESTION.format('rewrite')} <> key)"""


@query("WITH" + _bm25("documents", "doc_id", "text", _VARIANTS, 20) + """,
    f AS (SELECT split_part(query_id, '#', 1) AS query_id, id, round(sum(CASE WHEN suffix(query_id, '#0') THEN 1.0 ELSE 0.7 END / (60.0 + rank)), 6) AS score FROM b GROUP BY 1, 2)
    SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f) WHERE rank <= 10""")
def multi_query_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Every golden question with its rewrites (the table's reference answers stand in for them), fused."""
    g = table(spark, folder, "golden_set").groupBy("qid").agg(F.min("question").alias("question"), F.min("ground_truth").alias("truth"))
    rewrites = g.where("truth is not null").groupBy(text.normalize_question(F.col("question")).alias("question_key")).agg(F.min("truth").alias("rewrite")).withColumn("pos", F.lit(0))
    v = stored(fusion.variants(g.select(F.col("qid").alias("query_id"), "question"), rewrites, 3), "variants")
    ranked = lexical.bm25_topk(v.select(F.concat_ws("#", "query_id", "variant_no").alias("query_id"), F.col("text").alias("question")), documents(spark, folder), 20, id_col="doc_id")
    part = F.split("query_id", "#")
    return fusion.multi_query(ranked.select(part[0].alias("query_id"), part[1].cast("int").alias("variant_no"), "id", "rank"), 10)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embedded_documents").where(divisible_by_20())
    return e.groupBy("id").agg(F.max("content").alias("question"), F.max("embedding").alias("embedding")).withColumnRenamed("id", "query_id")


def _paths(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked, recs = _asked(spark, folder), table(spark, folder, "vector_records").where("id is not null").groupBy("id").agg(F.max_by("content", "ingest_sequence").alias("content"), F.max("embedding").alias("embedding"))
    return dense.dense_topk(asked.select("query_id", "embedding"), recs.select("id", "embedding"), 30), lexical.bm25_topk(asked.select("query_id", "question"), recs.select("id", "content"), 30, text_col="content")


_HYBRID = (
    f"""WITH a AS (SELECT id AS query_id, any_value(content) AS question, any_value(embedding) AS e FROM embedded_documents WHERE {_DIVISIBLE} GROUP BY id),
    rec AS {_RECORDS},
    ds AS (SELECT query_id, id, round(CASE WHEN list_dot_product(e, e) * list_dot_product(embedding, embedding) = 0 THEN 0 ELSE list_cosine_similarity(e, embedding) END, 6) AS score FROM a CROSS JOIN rec WHERE e IS NOT NULL AND embedding IS NOT NULL),
    dn AS (SELECT query_id, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ds) WHERE rank <= 30),"""
    + _bm25("rec", "id", "content", "a", 30)
    + """, u AS (SELECT query_id, 'dense' AS path, id, rank FROM dn UNION ALL SELECT query_id, 'sparse', id, rank FROM b),
    f AS (SELECT query_id, id, round(sum(CASE WHEN path = 'dense' THEN 0.2 ELSE 1.0 END / (60.0 + rank)), 6) AS score, min(path) AS representative, min(CASE WHEN path = 'dense' THEN rank END) AS dense_rank, min(CASE WHEN path = 'sparse' THEN rank END) AS sparse_rank FROM u GROUP BY ALL)
    SELECT query_id, id, score, representative, dense_rank, sparse_rank, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f) WHERE rank <= 10"""
)


@query(_HYBRID)
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    d, s = _paths(spark, folder)
    return fusion.hybrid(d, s, 10)


_RERANK = f"""
    WITH c0 AS (SELECT s.request_id AS query_id, s.source_index AS id, s.source_index AS dr, {_TOKENS.format('q.question')} AS q, coalesce({_TOKENS.format('s.content')}, []) AS t FROM {_SOURCES} s JOIN {_QUESTIONS} q ON s.request_id = q.request_id WHERE q.question IS NOT NULL),
    c AS (SELECT *, list_filter(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN list_position(q, q[i]) = i THEN q[i] END), lambda x: x IS NOT NULL) AS qd FROM c0),
    n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
    tt AS (SELECT query_id, id, unnest(t) AS token FROM c), tf AS (SELECT query_id, id, token, count(*) AS tf FROM tt GROUP BY ALL),
    qq AS (SELECT DISTINCT query_id, q FROM c), qt AS (SELECT query_id, unnest(q) AS token FROM qq), qf AS (SELECT query_id, token, count(*) AS qtf FROM qt GROUP BY ALL),
    m AS (SELECT tf.*, qtf FROM tf JOIN qf USING (query_id, token)),
    f AS (SELECT query_id, token, count(*) AS f FROM m GROUP BY ALL),
    w AS (SELECT m.query_id, m.id, sum(qtf * (1 + ln(tf)) * (ln((n + 1.0) / (f + 1)) + 1)) AS w, count(*) AS shared FROM m JOIN f USING (query_id, token) JOIN n USING (query_id) GROUP BY ALL),
    s AS (SELECT c.query_id, c.id, dr, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE coalesce(w, 0) + 2.0 * coalesce(shared, 0) / greatest(len(qd), 1)
        + 0.25 * len(list_intersect(list_transform(range(1, len(qd)), lambda i: qd[i] || ' ' || qd[i + 1]), list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))) + 1 / (1000.0 + dr) END, 6) AS score FROM c LEFT JOIN w USING (query_id, id))
    SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr, id) AS INTEGER) AS rank FROM s) WHERE rank <= 5"""


@query(_RERANK)
def lexical_rerank(spark: SparkSession, folder: str) -> DataFrame:
    s = sources(spark, folder).join(questions(spark, folder).where("question is not null"), "request_id")
    return lexical.lexical_rerank(s.select(F.col("request_id").alias("query_id"), "question", F.col("source_index").alias("id"), "content", F.col("source_index").alias("dense_rank")), 5)


@query()
def retrieval_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The whole plan over the children of all documents, for all golden questions with the reference answer as a
    rewrite: hybrid search per variant, fusion, rerank, parents, gate, packing. These tables name no readers of documents, so no access filter."""
    parents, children = chunking.parent_child(documents(spark, folder), "doc_id", "text", source_col="source")
    chunks = stored(children.select(F.concat_ws("#", "id", "chunk_index").alias("id"), "parent_id", "content"))
    g = table(spark, folder, "golden_set").groupBy("qid").agg(F.min("question").alias("question"), F.min("ground_truth").alias("rewrite"))
    rewrites = g.where("rewrite is not null").groupBy(text.normalize_question(F.col("question")).alias("question_key")).agg(F.min("rewrite").alias("rewrite")).withColumn("pos", F.lit(0))
    option = retrieval.Options(rerank=True, multi_query=True, expand=True, gate=context.Gate(), pack=context.Packing(exact=True))
    found = retrieval.contexts(g.select(F.col("qid").alias("query_id"), "question"), chunks, option, rewrites=rewrites, parents=parents.groupBy("parent_id").agg(F.max("content").alias("content")))
    return found.withColumn("used_ids", F.array_join("used_ids", ","))


# ---------------------------------------------------------------- access


@query("""SELECT trim(principal) AS principal, array_to_string(list_sort(list(DISTINCT trim(acl_subject))), ',') AS subjects FROM principal_acl_membership WHERE trim(principal) <> '' AND trim(acl_subject) <> '' GROUP BY 1""")
def acl_for_principal(spark: SparkSession, folder: str) -> DataFrame:
    return access.allowed_subjects(table(spark, folder, "principal_acl_membership")).select("principal", F.array_join("subjects", ",").alias("subjects"))


@query("""
    WITH m AS (SELECT DISTINCT trim(principal) AS principal, trim(acl_subject) AS s FROM principal_acl_membership WHERE trim(principal) <> '' AND trim(acl_subject) <> ''),
    r AS (SELECT id, unnest(acl) AS s FROM vector_records WHERE id IS NOT NULL), v AS (SELECT DISTINCT id, trim(s) AS s FROM r WHERE trim(s) <> '')
    SELECT principal, count(DISTINCT id) AS n_visible FROM v JOIN m USING (s) GROUP BY principal""")
def acl_filter(spark: SparkSession, folder: str) -> DataFrame:
    return access.visible_counts(table(spark, folder, "principal_acl_membership"), table(spark, folder, "vector_records").where("id is not null").select("id", "acl"))


@query(f"""
    WITH r AS (SELECT id, arg_max({{'s': source, 'k': chunk_index, 'a': acl}}, ingest_sequence) AS r FROM vector_records WHERE id IS NOT NULL GROUP BY id),
    document AS (SELECT DISTINCT r.s AS id, r.s AS source FROM r WHERE r.s IS NOT NULL), chunk AS (SELECT id, r.s AS document_id FROM r),
    acl_binding AS (SELECT CASE WHEN r.k = 0 THEN r.s END AS document_id, CASE WHEN r.k <> 0 OR r.k IS NULL THEN id END AS chunk_id, unnest(r.a) AS acl_subject FROM r),
    m AS (SELECT d.source AS direct, e.source AS through, trim(acl_subject) AS s FROM acl_binding b LEFT JOIN document d ON b.document_id = d.id LEFT JOIN chunk c ON b.chunk_id = c.id LEFT JOIN document e ON c.document_id = e.id)
    SELECT source, array_to_string(list_sort(list(DISTINCT s)), ',') AS subjects FROM (SELECT direct AS source, s FROM m UNION SELECT through, s FROM m) WHERE trim(source) <> '' AND s <> '' GROUP BY source""")
def acl_for_source(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every source. The first chunk's subjects are bound to the document, the others' to their chunk."""
    r = records(spark, folder, "source", "chunk_index", "acl")
    first = F.col("chunk_index") == 0
    bindings = r.select(F.when(first, F.col("source")).alias("document_id"), F.when(F.coalesce(~first, F.lit(True)), F.col("id")).alias("chunk_id"), F.explode("acl").alias("acl_subject"))
    docs = r.where("source is not null").select(F.col("source").alias("id"), "source").distinct()
    return access.subjects_of_source(bindings, docs, r.select("id", F.col("source").alias("document_id"))).select("source", F.array_join("subjects", ",").alias("subjects"))


_NUMBERED = f"(SELECT p.principal AS query_id, g.question, p.subjects FROM (SELECT principal, subjects, row_number() OVER (ORDER BY principal) AS n FROM (SELECT trim(principal) AS principal, list(DISTINCT trim(acl_subject)) AS subjects FROM principal_acl_membership WHERE trim(principal) <> '' AND trim(acl_subject) <> '' GROUP BY 1)) p JOIN (SELECT question, row_number() OVER (ORDER BY qid) AS n FROM {_GOLDEN}) g USING (n))"


@query("WITH rec AS " + _RECORDS + ", asks AS " + _NUMBERED + ", may AS (SELECT DISTINCT id, trim(s) AS s FROM (SELECT id, unnest(acl) AS s FROM (SELECT id, arg_max({'a': acl}, ingest_sequence).a AS acl FROM vector_records WHERE id IS NOT NULL GROUP BY id))),"
    + _bm25("rec", "id", "content", "asks", 1_000_000_000) + """,
    v AS (SELECT DISTINCT b.query_id, b.id, b.score FROM b JOIN asks USING (query_id) JOIN may USING (id) WHERE list_contains(subjects, may.s))
    SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM v) WHERE rank <= 5""")
def acl_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Each principal asks a golden question, and sees the best of the records that its subjects allow."""
    p = access.allowed_subjects(table(spark, folder, "principal_acl_membership"))
    number = lambda df, c: chunking.in_sequence(df, [F.col(c)], "n")
    asks = number(p, "principal").join(number(golden(spark, folder).select("qid", "question"), "qid").select("question", "n"), "n").select(F.col("principal").alias("query_id"), "question", "subjects")
    r = records(spark, folder, "content", "acl").select("id", "content", access.normalize_subjects(F.col("acl")).alias("acl"))
    return lexical.bm25_topk(asks, r, 5, text_col="content", acl_col="acl")


# ---------------------------------------------------------------- context


@query(f"""
    SELECT query_id, parent_id, min(source_index) AS rank, count(*) AS n_children, arg_min(record_id, source_index) AS id, array_to_string(list(record_id ORDER BY source_index, record_id), ',') AS child_ids
    FROM (SELECT s.request_id AS query_id, coalesce(v.source, s.record_id) AS parent_id, s.source_index, s.record_id FROM {_SOURCES} s LEFT JOIN {_RECORDS} v ON s.record_id = v.id WHERE s.record_id IS NOT NULL) GROUP BY ALL""")
def parent_collapse(spark: SparkSession, folder: str) -> DataFrame:
    v = records(spark, folder, "source").select(F.col("id").alias("record_id"), F.col("source").alias("parent_id"))
    s = sources(spark, folder).where("record_id is not null").join(v, "record_id", "left")
    c = context.collapse_siblings(s.select(F.col("request_id").alias("query_id"), F.col("record_id").alias("id"), "parent_id", F.col("source_index").alias("rank")))
    return c.withColumn("child_ids", F.array_join("child_ids", ","))


_FIRST = f"(SELECT request_id, arg_min(coalesce(retrieval_mode, ''), source_index) AS retrieval_mode, min(source_index) AS i FROM {_SOURCES} GROUP BY request_id)"


def _gate_input(spark: SparkSession, folder: str) -> DataFrame:
    s = sources(spark, folder)
    first = s.groupBy("request_id").agg(F.min_by(F.struct("retrieval_mode", "score"), "source_index").alias("f"))
    return first.select(F.col("request_id").alias("query_id"), "f.retrieval_mode", "f.score", F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("string").alias("rerank_provider"))


_GATE = f"""
    WITH f AS (SELECT s.request_id AS query_id, lower(s.retrieval_mode) AS m, s.score FROM {_SOURCES} s JOIN (SELECT request_id, min(source_index) AS source_index FROM {_SOURCES} GROUP BY 1) USING (request_id, source_index)),
    g AS (SELECT query_id, score, m IS NULL AND score IS NULL AS none_, CASE WHEN m IS NULL AND score IS NULL THEN NULL WHEN m = 'bm25' THEN 'bm25' WHEN m IN ('hybrid', 'hybrid_rrf', 'rrf') THEN 'rrf' ELSE 'dense_cosine' END AS space FROM f),
    h AS (SELECT query_id, score, space, none_, CASE WHEN none_ THEN 'retrieval_returned_no_candidates' WHEN space <> 'dense_cosine' THEN 'unsupported_score_space:' || space WHEN score IS NULL THEN 'usable_score_missing' WHEN score < 0.63 THEN 'score_below_threshold' ELSE 'score_meets_threshold' END AS reason FROM g),
    d AS (SELECT query_id, CASE WHEN none_ THEN 'no_candidates' WHEN reason = 'score_below_threshold' THEN 'rejected' WHEN reason = 'score_meets_threshold' THEN 'accepted' ELSE 'skipped' END AS action, reason, space AS score_space, score AS gate_score, CASE WHEN space = 'dense_cosine' THEN CAST(0.63 AS DOUBLE) END AS threshold FROM h)"""


@query(_GATE + " SELECT * FROM d")
def relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    return context.gate(_gate_input(spark, folder))


@query(_GATE + """, u AS (SELECT 'action' AS what, action AS value FROM d UNION ALL SELECT 'skip_reason', reason FROM d WHERE action = 'skipped' UNION ALL SELECT 'score_space', score_space FROM d)
    SELECT what, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL""")
def gate_stats(spark: SparkSession, folder: str) -> DataFrame:
    return context.gate_stats(context.gate(_gate_input(spark, folder)))


@query(f"SELECT request_id AS query_id, min(source_index) AS source_index, record_id FROM {_SOURCES} WHERE record_id IS NOT NULL GROUP BY request_id, record_id")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    s = sources(spark, folder).where("record_id is not null").select(F.col("request_id").alias("query_id"), "source_index", "record_id")
    return context.exact_dedup(s, ["record_id"])


@query(f"""
    WITH s AS (SELECT request_id, source_index, {_QUESTION.format('content')} AS c FROM {_SOURCES} WHERE content IS NOT NULL)
    SELECT request_id, source_index, CAST(CASE WHEN length(c) = 0 THEN 0 WHEN length(c) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(c) - 3), lambda i: substring(c, i, 5)))) END AS INTEGER) AS n_shingles FROM s""")
def shingle_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = sources(spark, folder).where("content is not null").select("request_id", "source_index", text.normalize_question(F.col("content")).alias("c"))
    return s.select("request_id", "source_index", F.size(context.shingles(F.col("c"))).alias("n_shingles"))


_SHINGLES = "CASE WHEN length(c) = 0 THEN [] WHEN length(c) <= 5 THEN [c] ELSE list_distinct(list_transform(range(1, length(c) - 3), lambda i: substring(c, i, 5))) END"


@query(f"""
    WITH s AS (SELECT request_id, source_index, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS c FROM {_SOURCES} WHERE content IS NOT NULL),
    g AS (SELECT request_id, source_index, {_SHINGLES} AS g FROM s),
    p AS (SELECT x.request_id AS query_id, x.source_index AS a, y.source_index AS b, len(x.g) AS na, len(y.g) AS nb, len(list_intersect(x.g, y.g)) AS shared FROM g x JOIN g y ON x.request_id = y.request_id AND x.source_index < y.source_index),
    j AS (SELECT query_id, a, b, round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 ELSE shared / (na + nb - shared) END, 6) AS jaccard FROM p)
    SELECT * FROM j WHERE jaccard >= 0.8""")
def near_dup_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    s = sources(spark, folder).select(F.col("request_id").alias("query_id"), "source_index", "content")
    return context.near_duplicates(s, 0.8)


_SOURCES_OF = f"(SELECT s.request_id, s.source_index FROM {_SOURCES} s JOIN (SELECT request_id, max(budget_limit) AS lim FROM packed_contexts GROUP BY 1) b USING (request_id) WHERE lim > 0)"


def _pack(spark: SparkSession, folder: str, option: context.Packing = context.Packing()) -> DataFrame:
    v = records(spark, folder, "source", "chunk_index", "start_char", "end_char").drop("ingest_sequence").withColumnRenamed("id", "record_id")
    s = sources(spark, folder).join(v, "record_id", "left")
    return context.pack_contexts(s, table(spark, folder, "packed_contexts"), option)


@query(f"SELECT request_id, count(*) AS sources, CAST(0 AS INTEGER) AS broken FROM {_SOURCES_OF} GROUP BY request_id")
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    """How many sources each request has, and the rules that its packed context breaks: every source is used, skipped or a repeat,
    the budget holds and is what the context measures, the blocks are numbered on."""
    p = _pack(spark, folder, context.Packing(exact=True))
    size = F.when(F.col("budget_unit") == "tokens", text.token_count(F.col("context"))).otherwise(F.char_length("context"))
    n = F.size("used_ids") + F.size("deduped_ids") + F.size("skipped_ids")
    heads = F.size(F.regexp_extract_all("context", F.lit(r"(?m)^\[\d+\] source="), F.lit(0)))
    bad = (size != F.col("budget_used")).cast("int") + ((F.size("used_ids") > 0) & (F.col("budget_used") > F.col("budget_limit"))).cast("int") + (heads < F.size("used_ids")).cast("int") + (F.size("deduped_ids") != F.size("dedup_reasons")).cast("int")
    return p.select("request_id", n.cast("bigint").alias("sources"), bad.alias("broken"))


@query(f"""
    WITH s AS (SELECT s.request_id, s.source_index, s.record_id, coalesce(v.source || '|' || v.chunk_index || '|' || v.a || '|' || v.e, s.record_id) AS key FROM {_SOURCES} s LEFT JOIN (SELECT id, arg_max(source, ingest_sequence) AS source, arg_max(chunk_index, ingest_sequence) AS chunk_index, arg_max(start_char, ingest_sequence) AS a, arg_max(end_char, ingest_sequence) AS e FROM vector_records WHERE id IS NOT NULL GROUP BY id) v ON s.record_id = v.id)
    SELECT request_id, CAST(count(*) - count(DISTINCT key) - sum(CASE WHEN key IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS repeats FROM s JOIN {_SOURCES_OF} USING (request_id, source_index) GROUP BY request_id""")
def pack_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """The repeats that packing leaves out by exact keys."""
    return _pack(spark, folder, context.Packing(exact=True)).select("request_id", F.size("deduped_ids").cast("bigint").alias("repeats"))


_BLOCKS = f"(SELECT request_id, source_index, '[' || source_index || '] ' || content AS block FROM {_SOURCES} WHERE content IS NOT NULL)"
_CUT = f"""b AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY request_id ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_BLOCKS}),
    cut AS (SELECT request_id AS query_id, string_agg(CASE WHEN length(block) > 4000 - before THEN rtrim(left(block, CAST(4000 - before AS BIGINT)), ' ') ELSE block END, chr(10) || chr(10) ORDER BY source_index) AS context FROM b WHERE before < 4000 GROUP BY 1)"""


@query(f"WITH {_CUT} SELECT * FROM cut")
def cut_contexts(spark: SparkSession, folder: str) -> DataFrame:
    s = sources(spark, folder).where("content is not null")
    return context.cut_context(s.select(F.col("request_id").alias("query_id"), "source_index", F.concat(F.lit("["), "source_index", F.lit("] "), "content").alias("block")), 4000)


_SHAPE = f"""q AS (SELECT request_id AS query_id, question, ' ' || {_QUESTION.format('question')} || ' ' AS x FROM {_QUESTIONS} WHERE question IS NOT NULL)"""


@query(f"""
    WITH {_CUT}, {_SHAPE}
    SELECT query_id, 'Answer from this context and cite its numbers.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, 'No relevant context was retrieved.') || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10)
      || CASE WHEN {_has('x', text.RELEVANCE_MARKERS)} AND {_has('x', text.RELEVANCE_TARGETS)} THEN '{context.SCOPES["relevance"]}' WHEN {_has('x', text.LOOKUP_MARKERS)} AND {_has('x', text.LOOKUP_TARGETS)} THEN '{context.SCOPES["lookup"]}' WHEN {_has('x', text.RELATION_TARGETS)} AND {_has('x', text.RELATION_MARKERS)} THEN '{context.SCOPES["relation"]}' ELSE '{context.SCOPES["plain"]}' END
      || CASE WHEN contains(x, 'workaround') THEN '{context.SCOPES["workaround"]}' WHEN {_has('x', text.SCENARIO_KEYWORDS)} OR ({_has('x', text.PROCEDURAL_INTENT)} AND {_has('x', text.SITUATION)}) THEN '{context.SCOPES["scenario"]}' WHEN {_has('x', text.ACTION_MARKERS)} THEN '{context.SCOPES["actions"]}' ELSE '{context.SCOPES["narrow"]}' END AS prompt
    FROM q LEFT JOIN cut USING (query_id)""")
def build_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return context.build_prompts(questions(spark, folder).where("question is not null").select(F.col("request_id").alias("query_id"), "question"), cut_contexts(spark, folder))


@query(f"""
    SELECT request_id, source_index, '[' || source_index || '] ' || coalesce(nullif(regexp_extract(replace(v.source, chr(92), '/'), '([^/]*)/*$', 1), ''), s.record_id, 'source-' || source_index) || ': ' || content AS citation
    FROM {_SOURCES} s LEFT JOIN {_RECORDS} v ON s.record_id = v.id WHERE s.content IS NOT NULL""".replace("content AS citation", "s.content AS citation"))
def citations(spark: SparkSession, folder: str) -> DataFrame:
    v = records(spark, folder, "source").select(F.col("id").alias("record_id"), "source")
    s = sources(spark, folder).where("content is not null").join(v, "record_id", "left")
    return s.select("request_id", "source_index", text.citation_context(F.col("source_index"), F.col("source"), F.col("content"), F.col("record_id")).alias("citation"))


@query(f"""
    WITH w AS (SELECT request_id, answer, string_split(answer, ' ') AS w FROM {_QUESTIONS} WHERE answer IS NOT NULL)
    SELECT request_id, array_to_string(CASE WHEN len(w) <= 2 THEN [answer] ELSE list_transform(range(0, CAST(ceil(len(w) / 3.0) AS BIGINT)), lambda k: array_to_string(w[3 * k + 1 : 3 * k + 3], ' ') || CASE WHEN 3 * k + 3 < len(w) THEN ' ' ELSE '' END) END, '|') AS pieces FROM w""")
def answer_pieces(spark: SparkSession, folder: str) -> DataFrame:
    a = questions(spark, folder).where("answer is not null").select("request_id", text.stream_pieces(F.col("answer")).alias("p"))
    return a.select("request_id", F.array_join("p", "|").alias("pieces"))


@query(f"""
    WITH a AS (SELECT request_id, coalesce(encode(question), ''::BLOB) AS q, coalesce(encode(answer), ''::BLOB) AS a FROM {_QUESTIONS})
    SELECT request_id, sha256(unhex(lpad(hex(octet_length(q)), 16, '0')) || q || unhex(lpad(hex(octet_length(a)), 16, '0')) || a) AS digest FROM a""")
def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder)
    return q.select("request_id", text.content_digest(F.array(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))).alias("digest"))


# ---------------------------------------------------------------- evaluation


def _run(spark: SparkSession, folder: str) -> DataFrame:
    recs = records(spark, folder, "content", "source", "chunk_index")
    ranked = lexical.bm25_topk(golden(spark, folder).select(F.col("qid").alias("query_id"), "question"), recs.select("id", "content"), 5, text_col="content")
    return ranked.join(recs.select("id", "source", "chunk_index"), "id").select(F.col("query_id").alias("qid"), "rank", "source", "chunk_index")


_NORM = _Template("regexp_replace(replace({0}, chr(92), '/'), '^(\\./)+', '')")
_CASES = (
    f"WITH rec AS {_RECORDS}, g AS {_GOLDEN}, a AS (SELECT qid AS query_id, question FROM g),"
    + _bm25("rec", "id", "content", "a", 5)
    + f""", run AS (SELECT query_id AS qid, rank, {_NORM.format('source')} AS source, chunk_index FROM b JOIN rec USING (id)),
    lab0 AS (SELECT qid, unnest(relevant) AS r FROM g), lab AS (SELECT DISTINCT qid, {_NORM.format('r.source')} AS source, r.chunk_index AS chunk_index FROM lab0),
    met AS (SELECT lab.qid, lab.source, lab.chunk_index, min(rank) AS rank FROM lab JOIN run ON lab.qid = run.qid AND lab.source = run.source AND (lab.chunk_index IS NULL OR lab.chunk_index = run.chunk_index) GROUP BY ALL),
    ks AS (SELECT unnest([1, 3, 5]) AS k),
    cs AS (SELECT g.qid, capability, k, (SELECT count(*) FROM lab WHERE lab.qid = g.qid) AS n_relevant, (SELECT count(*) FROM run WHERE run.qid = g.qid AND rank <= k) AS n_retrieved, (SELECT count(*) FROM met WHERE met.qid = g.qid AND rank <= k) AS n_matched, (SELECT min(rank) FROM met WHERE met.qid = g.qid AND rank <= k) AS first_rank FROM g CROSS JOIN ks),
    e AS (SELECT *, CASE WHEN n_relevant > 0 THEN CAST(n_matched > 0 AS INTEGER) END AS hit, CASE WHEN n_relevant > 0 THEN coalesce(1.0 / first_rank, 0.0) END AS rr, CASE WHEN n_relevant > 0 THEN n_matched / n_relevant END AS recall FROM cs)"""
)
_MEANS = """count(*) AS n, coalesce(round(avg(hit), 6), 0) AS hit_rate, coalesce(round(avg(rr), 6), 0) AS mrr, coalesce(round(avg(recall), 6), 0) AS recall,
    coalesce(round(avg(CASE WHEN n_relevant = 0 THEN CAST(n_retrieved = 0 AS INTEGER) END), 6), 0) AS negative_empty_rate, coalesce(round(avg(CASE WHEN n_relevant = 0 THEN CAST(n_retrieved > 0 AS INTEGER) END), 6), 0) AS negative_false_recall_rate,
    coalesce(round(avg(CASE WHEN n_relevant > 0 THEN CAST(n_retrieved = 0 AS INTEGER) END), 6), 0) AS positive_false_abstention_rate"""


@query(_CASES + f" SELECT k, 'all' AS slice, {_MEANS} FROM e GROUP BY k UNION ALL SELECT k, coalesce(capability, 'unknown'), {_MEANS} FROM e GROUP BY k, capability")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summary(evaluation.cases(golden(spark, folder), _run(spark, folder), (1, 3, 5)))


@query(_CASES + f""", got AS (SELECT e.qid, e.k, string_agg(run.source || '#' || coalesce(CAST(run.chunk_index AS VARCHAR), ''), ',' ORDER BY run.rank, run.source, run.chunk_index) AS retrieved FROM e JOIN run ON run.qid = e.qid AND run.rank <= e.k WHERE run.source IS NOT NULL GROUP BY ALL)
    SELECT e.qid, e.k, n_relevant, CAST(n_retrieved AS INTEGER) AS n_retrieved, CAST(n_matched AS INTEGER) AS n_matched, first_rank, CASE WHEN n_matched = 0 THEN '{text.MISS_REASONS[0]}' WHEN n_matched < n_relevant THEN printf('{text.MISS_REASONS[1]}', n_matched, n_relevant) ELSE '{text.MISS_REASONS[2]}' END AS reason, coalesce(retrieved, '') AS retrieved
    FROM e LEFT JOIN got USING (qid, k) WHERE (n_relevant > 0 AND recall < 1) OR (n_relevant = 0 AND n_retrieved > 0)""")
def low_recall_cases(spark: SparkSession, folder: str) -> DataFrame:
    low = evaluation.low_recall(evaluation.cases(golden(spark, folder), _run(spark, folder), (1, 3, 5)))
    shown = F.array_join(F.transform("retrieved", lambda x: F.concat(x["source"], F.lit("#"), F.coalesce(x["chunk_index"].cast("string"), F.lit("")))), ",")
    return low.select("qid", "k", "n_relevant", "n_retrieved", "n_matched", "first_rank", "reason", shown.alias("retrieved"))


@query(f"SELECT route, round(avg(latency_ms), 6) AS mean, round(median(latency_ms), 6) AS median, round(stddev_pop(latency_ms), 6) AS stddev, round(mad(latency_ms), 6) AS mad, round(min(latency_ms), 6) AS min, round(max(latency_ms), 6) AS max, count(*) AS n FROM {_LOG} WHERE latency_ms IS NOT NULL GROUP BY route")
def value_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summarize(log(spark, folder), ["route"], "latency_ms")


@query(f"""
    WITH s AS (SELECT retrieval_mode, route, round(avg(latency_ms), 6) AS m, round(stddev_pop(latency_ms), 6) AS d FROM {_LOG} WHERE latency_ms IS NOT NULL GROUP BY ALL)
    SELECT a.route, a.m AS before, b.m AS after, round(b.m - a.m, 6) AS delta, greatest(a.d, b.d) AS noise_band, abs(b.m - a.m) > greatest(a.d, b.d) AS resolved FROM s a JOIN s b USING (route) WHERE a.retrieval_mode = 'dense' AND b.retrieval_mode <> 'dense' AND b.retrieval_mode = (SELECT max(retrieval_mode) FROM s)""")
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    v = log(spark, folder).where("latency_ms is not null")
    s = evaluation.summarize(v, ["retrieval_mode", "route"], "latency_ms")
    last = s.agg(F.max("retrieval_mode").alias("last"))
    after = s.join(F.broadcast(last), s["retrieval_mode"] == last["last"]).where("retrieval_mode <> 'dense'")
    return evaluation.compare(s.where("retrieval_mode = 'dense'"), after, "route")


_VERDICTS = f"""v AS (SELECT {_QUESTION.format('question')} AS qid, CASE WHEN {_has(_QUESTION.format('coalesce(answer, chr(32))'), ('i do not know based on the provided context', *text.ABSTENTIONS))} THEN 0.0 ELSE 1.0 END AS answered,
    CASE WHEN length(answer) > 0 THEN least(1.0, length(answer) / 200.0) ELSE 0.0 END AS fullness FROM {_QUESTIONS} WHERE question IS NOT NULL), l AS (SELECT qid, 'answered' AS metric, CAST(answered AS DOUBLE) AS value FROM v UNION ALL SELECT qid, 'fullness', CAST(fullness AS DOUBLE) FROM v),
    c AS (SELECT qid, metric, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(mad(value), 6) AS mad FROM l GROUP BY ALL),
    t AS (SELECT * FROM (VALUES ('answered', CAST(0.5 AS DOUBLE), CAST(0.1 AS DOUBLE)), ('fullness', 0.2, 0.3)) x(metric, bound, margin))"""


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """What a plain judge says of every answer, questions asked again being further runs: whether it answers, and how full it is."""
    q = questions(spark, folder).where("question is not null")
    v = q.select(text.normalize_question(F.col("question")).alias("qid"), F.when(text.is_abstention(F.col("answer")), 0.0).otherwise(1.0).alias("answered"), F.least(F.lit(1.0), F.coalesce(F.char_length("answer"), F.lit(0)) / 200.0).alias("fullness"))
    return v.select("qid", F.lit(None).cast("string").alias("capability"), F.expr("stack(2, 'answered', answered, 'fullness', fullness) as (metric, value)"))


@query(f"""
    WITH {_VERDICTS}
    SELECT metric, round(avg(mean), 6) AS mean, min(med) AS lowest_median, max(mad) AS largest_mad, CAST(sum(CASE WHEN med < bound THEN 1 ELSE 0 END) AS BIGINT) AS failures,
      sum(CASE WHEN med < bound THEN 1 ELSE 0 END) = 0 AND max(mad) * 3 <= max(margin) AS passed FROM c JOIN t USING (metric) GROUP BY metric""")
def verdict_gate(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.replay(_verdicts(spark, folder), {"answered": 0.5, "fullness": 0.2}, {"answered": 0.1, "fullness": 0.3})[0]


@query(f"""
    WITH {_VERDICTS}, w AS (SELECT metric, arg_max(qid, (mad, qid)) AS qid, max(mad) AS mad FROM c GROUP BY metric)
    SELECT 'median' AS kind, metric, qid, med AS value, bound FROM c JOIN t USING (metric) WHERE med < bound
    UNION ALL SELECT 'margin', metric, qid, mad * 3.0, margin FROM w JOIN t USING (metric) WHERE mad * 3 > margin""")
def verdict_failures(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.replay(_verdicts(spark, folder), {"answered": 0.5, "fullness": 0.2}, {"answered": 0.1, "fullness": 0.3})[1]


# ---------------------------------------------------------------- observation


_LATE = "(SELECT date_trunc('day', max(ts)) - INTERVAL 14 DAY FROM request_log)"


def _late(spark: SparkSession, folder: str):
    """The begin of the last 14 days of the log, a single value."""
    return F.lit(table(spark, folder, "request_log").agg((F.date_trunc("day", F.max("ts")) - F.expr("interval 14 days")).alias("d")).first().d)


@query(f"WITH l AS {_LOG} SELECT route, count(*) - sum(CASE WHEN ts < {_LATE} THEN 1 ELSE 0 END) AS delta FROM l GROUP BY route".replace("count(*) - sum(CASE WHEN ts", "CAST(count(*) - sum(CASE WHEN ts").replace("ELSE 0 END) AS delta", "ELSE 0 END) AS BIGINT) AS delta"))
def counter_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The requests of each route between two snapshots of the counters: at the begin of the last 14 days, and at their end."""
    r = log(spark, folder)
    by = lambda df: df.groupBy("route").agg(F.count("*").alias("n"))
    return observe.delta(by(r.where(F.col("ts") < _late(spark, folder))), by(r), "route")


@query(f"SELECT route, count(*) AS n, round(min(latency_ms), 3) AS min_ms, round(avg(latency_ms), 3) AS mean_ms, round(quantile_disc(latency_ms, 0.5), 3) AS p50_ms, round(quantile_disc(latency_ms, 0.95), 3) AS p95_ms, round(CASE WHEN count(*) >= 1000 THEN quantile_disc(latency_ms, 0.99) END, 3) AS p99_ms, round(max(latency_ms), 3) AS max_ms FROM {_LOG} WHERE latency_ms IS NOT NULL GROUP BY route")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return observe.latency_summary(log(spark, folder), ["route"])


_HISTOGRAM = """b AS (SELECT unnest(['5.0', '10.0', '25.0', '50.0', '100.0', '250.0', '500.0', '1000.0', '2500.0', '5000.0', '10000.0', '+Inf']) AS le),
    h AS (SELECT route, le, CAST(sum(CASE WHEN le = '+Inf' OR latency_ms <= try_cast(le AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS cumulative, count(*) AS n, round(sum(latency_ms), 3) AS total FROM l CROSS JOIN b WHERE latency_ms IS NOT NULL GROUP BY route, le)"""


@query(f"WITH l AS {_LOG}, {_HISTOGRAM} SELECT * FROM h")
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return observe.histogram(log(spark, folder), ["route"])


@query(f"""
    WITH l AS (SELECT retrieval_mode, score FROM {_SOURCES} WHERE score IS NOT NULL), b AS (SELECT unnest(['-1.0', '-0.5', '0.0', '0.25', '0.5', '0.75', '0.9', '1.0', '+Inf']) AS le)
    SELECT retrieval_mode, le, CAST(sum(CASE WHEN le = '+Inf' OR score <= try_cast(le AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS cumulative, count(*) AS n, round(sum(score), 3) AS total FROM l CROSS JOIN b GROUP BY ALL""")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return observe.histogram(sources(spark, folder), ["retrieval_mode"], observe.BOUNDS_SCORE, "score")


@query(f"""
    WITH l AS {_LOG}, {_HISTOGRAM}, k AS (SELECT route, cache_outcome, count(*) AS n FROM l GROUP BY ALL)
    SELECT unnest(['# HELP request_duration_ms Latency of requests.', '# TYPE request_duration_ms histogram', '# HELP cache_operations_total Outcomes of the cache.', '# TYPE cache_operations_total counter']) AS line
    UNION ALL SELECT 'request_duration_ms_bucket{{route="' || coalesce(route, '') || '",le="' || regexp_replace(le, '\\.0$', '') || '"}} ' || cumulative FROM h
    UNION ALL SELECT 'request_duration_ms_sum{{route="' || coalesce(route, '') || '"}} ' || printf('%.3f', total) FROM h WHERE le = '+Inf' UNION ALL SELECT 'request_duration_ms_count{{route="' || coalesce(route, '') || '"}} ' || n FROM h WHERE le = '+Inf'
    UNION ALL SELECT 'cache_operations_total{{route="' || coalesce(g.route, '') || '",cache_outcome="' || coalesce(g.cache_outcome, '') || '"}} ' || coalesce(k.n, 0) FROM (SELECT * FROM (SELECT DISTINCT route FROM l) CROSS JOIN (SELECT DISTINCT cache_outcome FROM l)) g LEFT JOIN k ON g.route IS NOT DISTINCT FROM k.route AND g.cache_outcome IS NOT DISTINCT FROM k.cache_outcome""")
def metrics_exposition(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the metrics page; ``place`` orders them where they are written."""
    r = log(spark, folder)
    lines = observe.histogram_exposition(observe.histogram(r, ["route"]), "request_duration_ms", ["route"], "Latency of requests.")
    return lines.unionByName(observe.exposition(observe.counters(r, ["route", "cache_outcome"]), "cache_operations_total", ["route", "cache_outcome"], "n", "Outcomes of the cache.")).select("line")


@query(f"""
    WITH l AS {_LOG}, g AS (SELECT * FROM (SELECT DISTINCT route FROM l) CROSS JOIN (SELECT DISTINCT cache_outcome FROM l))
    SELECT g.route, g.cache_outcome, count(l.request_id) AS n FROM g LEFT JOIN l ON g.route IS NOT DISTINCT FROM l.route AND g.cache_outcome IS NOT DISTINCT FROM l.cache_outcome GROUP BY ALL""")
def cache_counters(spark: SparkSession, folder: str) -> DataFrame:
    return observe.counters(log(spark, folder), ["route", "cache_outcome"])


@query(f"""
    WITH l AS {_LOG}, s AS (SELECT route, status_code, count(*) AS c, min(ts) AS a, max(ts) AS b FROM l GROUP BY ALL)
    SELECT route, CAST(sum(c) AS BIGINT) AS n, CAST(sum(CASE WHEN status_code >= 400 THEN c ELSE 0 END) AS BIGINT) AS errors, round(sum(c) / ((epoch_us(max(b)) - epoch_us(min(a))) / 1e6), 6) AS qps, array_to_string(list_sort(list(status_code || ':' || c)), ',') AS statuses FROM s GROUP BY route""")
def scenario_summary(spark: SparkSession, folder: str) -> DataFrame:
    return observe.scenario_summary(log(spark, folder), ["route"])


@query(f"""
    WITH l AS {_LOG}, r AS (SELECT principal_id, date_trunc('day', ts) AS day, count(*) AS c FROM l WHERE principal_id IS NOT NULL GROUP BY ALL), u AS (SELECT principal_id, day, sum(c) OVER (PARTITION BY principal_id ORDER BY day) AS used FROM r)
    SELECT principal_id, strftime(day, '%Y-%m-%d') AS day, CAST(greatest(0, used - coalesce(lag(used) OVER (PARTITION BY principal_id ORDER BY day), 0)) AS BIGINT) AS claimed FROM u""")
def usage_delta(spark: SparkSession, folder: str) -> DataFrame:
    r = log(spark, folder).where("principal_id is not null").groupBy("principal_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("c"))
    used = r.withColumn("used", F.sum("c").over(Window.partitionBy("principal_id").orderBy("day")))
    return observe.usage_delta(used, ["principal_id"], ["day"], "used").select("principal_id", "day", "claimed")


@query(f"""
    SELECT request_id, outcome, cache_outcome, CASE WHEN status_code >= 500 THEN 'error' WHEN coalesce(len(source_ids), 0) = 0 THEN 'empty' WHEN latency_ms > 1000 THEN 'slow' ELSE 'none' END AS alert FROM {_LOG}""")
def request_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return observe.completion(log(spark, folder))


def _hmac_sql(domain: str, value: str, salt: bytes = b"salt") -> str:
    """SQL of the keyed digest: the inner and the outer hash over the padded key."""
    inner, outer = (bytes(k ^ pad for k in salt.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('{domain}') || unhex('00') || encode({value}))))"


@query(f"""
    SELECT request_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, route, CASE WHEN trim(coalesce(principal_id, '')) = '' THEN 'anonymous' ELSE 'p_' || {_hmac_sql('principal', 'trim(principal_id)')} END AS principal_id, 'q_' || {_hmac_sql('query', 'question')} AS query_hash, top_k, retrieval_mode,
      CAST(coalesce(len(source_ids), 0) AS INTEGER) AS n_sources, array_to_string(list_transform(coalesce(source_ids, []), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9._:-]{{1,128}}') THEN x ELSE 's_' || sha256('salt' || x) END), ',') AS source_ids, round(greatest(0.0, latency_ms), 3) AS latency_ms, cache_outcome, status_code, outcome FROM {_LOG}""")
def audit_records(spark: SparkSession, folder: str) -> DataFrame:
    return observe.audit_records(log(spark, folder), "salt").withColumn("source_ids", F.array_join("source_ids", ","))


@query(f"""
    WITH g AS (SELECT {_QUESTION.format('question')} AS question FROM golden_set WHERE question IS NOT NULL UNION SELECT {_QUESTION.format('ground_truth')} FROM golden_set WHERE ground_truth IS NOT NULL), c AS (SELECT DISTINCT {_QUESTION.format('question')} AS question FROM rag_responses WHERE question IS NOT NULL)
    SELECT question, sha256(question) AS query_hash FROM g WHERE question NOT IN (SELECT question FROM c)""")
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """The questions and variants of the golden set whose embedding the answered requests haven't left in the cache."""
    cached = table(spark, folder, "rag_responses").where("question is not null").select(F.sha2(text.normalize_question(F.col("question")), 256).alias("query_hash"))
    g = table(spark, folder, "golden_set")
    return observe.cache_misses(g.select("question").unionByName(g.select(F.col("ground_truth").alias("question"))), cached)


_KEY = f"""'rag:cache-v1:retrieval:' || sha256('{{"config":' || CASE WHEN retrieval_mode IS NULL THEN 'null' ELSE CAST(to_json(retrieval_mode) AS VARCHAR) END || ',"corpus":"kb","filter":"{{}}","question":' || CASE WHEN question IS NULL THEN 'null' ELSE CAST(to_json({_QUESTION.format('question')}) AS VARCHAR) END || ',"top_k":' || coalesce(CAST(top_k AS VARCHAR), 'null') || ',"version":1}}')"""


@query(f"""
    WITH l AS (SELECT *, {_KEY} AS cache_key FROM {_LOG} WHERE question IS NOT NULL), live AS (SELECT cache_key, arg_max(request_id, (ts, request_id)) AS payload FROM l WHERE ts < {_LATE} AND ts > {_LATE} - INTERVAL 7 DAY GROUP BY 1)
    SELECT request_id, l.cache_key, CASE WHEN live.cache_key IS NULL THEN 'miss' ELSE 'hit' END AS cache_outcome, CASE WHEN live.cache_key IS NULL THEN (SELECT min(request_id) FROM l x WHERE x.cache_key = l.cache_key AND x.ts >= {_LATE}) ELSE payload END AS payload FROM l LEFT JOIN live USING (cache_key) WHERE ts >= {_LATE}""")
def retrieval_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The last 14 days' requests served from what the seven days before left in the cache; the payload names the request that it was made for."""
    r, now = log(spark, folder).where("question is not null"), _late(spark, folder)
    parts = cache.retrieval_parts(F.col("question"), "kb", 1, F.col("top_k"), F.lit("{}"), "") | {"config": F.col("retrieval_mode")}
    keyed = cache.with_key(r, "retrieval", parts).select("request_id", "ts", "cache_key")
    entries = keyed.where(F.col("ts") < now).groupBy("cache_key").agg(F.max(F.struct(F.col("ts"), "request_id")).alias("r")).select("cache_key", F.col("r.request_id").alias("payload"), F.col("r.ts").alias("stored_at"))
    first = lambda missing: missing.select("cache_key", F.col("first").alias("payload"))
    today = keyed.where(F.col("ts") >= now).withColumn("first", F.min("request_id").over(Window.partitionBy("cache_key")))
    return cache.served(today, entries, first, now, 7 * 86_400)[0].select("request_id", "cache_key", "cache_outcome", "payload")


@query("""
    WITH r AS (SELECT id, max(ingest_sequence) AS n, arg_max({'s': source}, ingest_sequence).s AS s, arg_max({'c': content}, ingest_sequence).c AS c FROM vector_records WHERE id IS NOT NULL GROUP BY id)
    SELECT s AS parent_id, arg_min(c, n) AS content FROM r WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY s""")
def parent_store(spark: SparkSession, folder: str) -> DataFrame:
    """The store of parents rebuilt from records that carry a parent's text: here each source's text is its first record's."""
    r = records(spark, folder, "source", "content").where("source is not null and content is not null")
    return store.parents_of(r.select("id", "ingest_sequence", F.col("source").alias("parent_id"), F.col("content").alias("parent_content")))
