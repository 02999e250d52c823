"""Column functions over texts. All are built-in expressions; none runs Python.

Null in gives null out unless a function says otherwise. Where a text is used several times in
a lambda, materialize it in a column first: a lambda evaluates what it captures per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.isspace has it; Java's \s lacks 23 of these.
WS = r"[\s\x0b\x1c-\x1f\u0085   -     　]"

# Words left out of the lexical index, and the suffixes that are cut, in order.
STOPWORDS = "a an and are as at be by can does for from how in is it of on or should the this to what when where which who with".split()
SUFFIXES = ("ingly", "edly", "ing", "ed", "es", "s")

# Markers of question shapes, as substrings of " " + normalized question + " ".
SCENARIO_KEYWORDS = ("workaround", "which checks should", "what checks should", "which steps should", "what steps should")
PROCEDURAL_INTENT = (" what should ", " how should ", " what do ", " how do ", " how can ")
SITUATION = (" when ", " if ", " after ", " while ", " not ready", " delayed", " stale", " fails", " failure", " loses ", " lost ")
LOOKUP_MARKERS = ("where is", "what source", "which source", "which document", "what document", "which runbook", "what runbook", "what policy", "which policy")
LOOKUP_TARGETS = ("defines", "defined", "described", "contains", "mentions", "explains")
RELEVANCE_MARKERS = ("which sources", "what sources", "which documents", "what documents", "which policies", "what policies", "which runbooks", "what runbooks")
RELEVANCE_TARGETS = (" relevant", " apply", " applies", " needed", " should be used", " should i use")
RELATION_TARGETS = ("tool", "service", "workflow")
RELATION_MARKERS = (" helps ", " routes ", " sends ", " forwards ", " used to ", " responsible for ")
ACTION_MARKERS = (" what should ", " which checks should ", " what checks should ", " what has to happen ", " who must approve ")

# Phrases of an answer that abstains.
ABSTENTIONS = ("not provided in the knowledge base", "knowledge base does not contain", "knowledge base does not provide", "insufficient context", "cannot answer from the provided context")


def strip(c: Column) -> Column:
    """Without white space at both ends. A run is tried once, from its start: texts padded by
    thousands of spaces would take quadratic time otherwise."""
    return F.regexp_replace(c, f"^{WS}++|(?<!{WS}){WS}++$", "")


def clean_text(c: Column) -> Column:
    """Control characters out, line ends to ``\\n``, broken lines joined, spaces and blank lines squeezed. Null gives ''."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"(?<=[一-鿿A-Za-z0-9，,；;：:])\n(?=[一-鿿A-Za-z0-9])", "")
    x = F.regexp_replace(x, r"(?<=-)\n(?=[A-Za-z])", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.array_join(F.transform(F.split(x, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def raw_tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and ``_``, and single CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9_]+|[一-鿿]"), F.lit(0))


def stem(t: Column) -> Column:
    """Cuts the first suffix that leaves three letters or more, then a last ``e`` of words over four."""
    n = F.length(t)
    cut = F.when(n <= 3, t)
    for s in SUFFIXES:
        cut = cut.when(t.endswith(s) & (n > len(s) + 2), t.substr(F.lit(1), n - len(s)))
    cut = cut.otherwise(t)
    return F.when((n > 3) & (F.length(cut) > 4) & cut.endswith("e"), cut.substr(F.lit(1), F.length(cut) - 1)).otherwise(cut)


def tokens(c: Column) -> Column:
    """Stemmed tokens without stop words."""
    return F.filter(F.transform(raw_tokens(c), stem), lambda t: (t != "") & ~t.isin(STOPWORDS))


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[一-鿿]"))


def token_count(c: Column) -> Column:
    """CJK characters plus a quarter of the others, rounded up; at least 1."""
    return F.greatest(F.lit(1), cjk_count(c) + F.ceil((F.char_length(c) - cjk_count(c)) / 4)).cast("int")


def quarter_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(c) / 4)).cast("int")


def error_percent(estimate: Column, exact: Column) -> Column:
    """Absolute error in percent of ``exact``; null where that is 0."""
    return F.when(exact != 0, F.abs(estimate - exact) / exact * 100.0)


def normalize_question(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), f"{WS}+", " ")


def _any(x: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | x.contains(m)
    return out


def question_shape(c: Column) -> dict[str, Column]:
    """Six flags by name. Give it a materialized column."""
    x = F.concat(F.lit(" "), normalize_question(c), F.lit(" "))
    return {
        "is_scenario": _any(x, SCENARIO_KEYWORDS) | (_any(x, PROCEDURAL_INTENT) & _any(x, SITUATION)),
        "is_workaround": x.contains("workaround"),
        "is_lookup": _any(x, LOOKUP_MARKERS) & _any(x, LOOKUP_TARGETS),
        "is_source_relevance": _any(x, RELEVANCE_MARKERS) & _any(x, RELEVANCE_TARGETS),
        "is_relationship": _any(x, RELATION_TARGETS) & _any(x, RELATION_MARKERS),
        "is_action_list": _any(x, ACTION_MARKERS),
    }


def mask(c: Column, visible: int) -> Column:
    """Keeps ``visible`` characters at both ends; a text of twice that or less is masked whole."""
    n = F.char_length(c)
    return F.when(n <= 2 * visible, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(visible)), F.repeat(F.lit("*"), n - 2 * visible), F.right(c, F.lit(visible))))


def normalize_source(c: Column, root: str = "") -> Column:
    """Slashes forward, a leading ``root`` and ``./`` cut."""
    x = F.replace(c, F.lit("\\"), F.lit("/"))
    if root:
        base = root.rstrip("/") + "/"
        x = F.when(x.startswith(base), x.substr(F.lit(len(base) + 1), F.length(x))).otherwise(x)
    return F.regexp_replace(x, r"^(\./)+", "")


def is_abstention(c: Column, canonical: str = "i do not know based on the provided context") -> Column:
    x = normalize_question(F.coalesce(c, F.lit("")))
    return _any(x, (canonical.lower().rstrip("."), *ABSTENTIONS))


def parse_variants(c: Column) -> Column:
    """Question variants of a model's reply: a JSON list, an object's rewrites or queries, or lines without a leading run of marks and digits."""
    listed = F.from_json(c, "array<string>")
    named = F.from_json(c, "struct<rewrites:array<string>,queries:array<string>>")
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-*0-9. ]+", ""))), lambda x: x != "")
    text = strip(c)
    none = F.array().cast("array<string>")
    return F.when(text.startswith("["), F.coalesce(listed, lines)).when(text.startswith("{"), F.coalesce(named["rewrites"], named["queries"], F.when(F.json_object_keys(text).isNotNull(), none), lines)).otherwise(lines)


def source_label(source: Column, chunk_index: Column, score: Column) -> Column:
    # Rounds the number as it is written, half up.
    shown = F.format_string("%.4f", score)
    where = F.coalesce(source, F.lit("unknown source"))
    return F.when(chunk_index.isNull(), F.concat(F.lit("source="), where, F.lit("; score="), shown)).otherwise(F.concat(F.lit("source="), where, F.lit("; chunk="), chunk_index.cast("string"), F.lit("; score="), shown))


def citation_context(index: Column, source: Column, content: Column, record: Column | None = None) -> Column:
    """``[i] file name: content``; without a source the record's id, else ``source-i``."""
    name = F.regexp_extract(F.replace(source, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    number = index.cast("string")
    label = F.coalesce(F.nullif(name, F.lit("")), F.nullif(record, F.lit("")) if record is not None else F.lit(None), F.concat(F.lit("source-"), number))
    return F.concat(F.lit("["), number, F.lit("] "), label, F.lit(": "), content)


def preview(c: Column, n: int = 180) -> Column:
    return F.substring(c, 1, n)


def source_identifier(id_: Column, child: Column, parent: Column, source: Column, start: Column, end: Column, index: Column) -> Column:
    span = F.concat(source, F.lit("#"), start.cast("string"), F.lit(":"), end.cast("string"))
    named = [F.nullif(x, F.lit("")) for x in (id_, child, parent)]
    return F.coalesce(*named, span, F.concat(F.lit("source-index-"), index.cast("string")))


# What a report says of a question's labels.
MISS_REASONS = ("No relevant source appeared in top-k.", "Only %d/%d relevant items were retrieved.", "All relevant items were retrieved.")


def miss_reason(matched: Column, relevant: Column) -> Column:
    return F.when(matched == 0, MISS_REASONS[0]).when(matched < relevant, F.format_string(MISS_REASONS[1], matched, relevant)).otherwise(MISS_REASONS[2])


def clamp_score(c: Column, tolerance: float = 1e-6) -> Column:
    """A score into 0..1 if it is there within the tolerance; others, null and what isn't a number are an error."""
    return F.when(c.between(-tolerance, 1 + tolerance) & ~F.isnan(c), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(F.raise_error(F.concat(F.lit("a score isn't within 0..1: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("double"))


def chat_content(c: Column) -> Column:
    return F.get_json_object(c, "$.choices[0].message.content")


# The offline generator's answers by what the prompt holds, in order.
CANNED = (
    ("No relevant context was retrieved.", "The answer is not available in the knowledge base."),
    ("Nimbus Gateway", "Nimbus Gateway routes IoT device telemetry into regional ingestion clusters [1]."),
    ("Apollo Dashboard", "Apollo Dashboard helps account teams inspect renewal risk [1]."),
    ("ORION-17", "The ORION-17 onboarding checklist is completed within the first three business days [1]."),
    ("EXP-204", "EXP-204 allows distance-based mileage reimbursement without fuel receipts [1]."),
)
CANNED_REST = "The answer is supported by the retrieved local benchmark context [1]."


def canned_answer(prompt: Column) -> Column:
    out = F.lit(CANNED_REST)
    for part, answer in reversed(CANNED):
        out = F.when(prompt.contains(part), answer).otherwise(out)
    return out


def stream_pieces(c: Column) -> Column:
    """An answer in pieces of three words, each but the last with its space; one of up to two words is one piece."""
    words = F.split(c, " ", -1)
    n = F.size(words)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int")), lambda k: F.concat(F.array_join(F.slice(words, 3 * k + 1, 3), " "), F.when(3 * k + 3 < n, " ").otherwise("")))
    return F.when(n <= 2, F.array(c)).otherwise(cut)


# What marks a rationale, and what makes a clause hold at a time or on a condition only.
RATIONALE = r"(?i)\bis\s+relevant\s+because\b"
QUALIFIED = r"(?is)(\b(?:before|after|when|while|if)\b.*)$"


def guarded_statements(answer: Column, statements: Column) -> Column:
    """The statements a judge sees of an answer: an answer of one sentence stays whole where it gives a rationale, or where the
    qualifier of its last clause was put to its first one in a statement; otherwise the statements stay."""
    whole = F.regexp_replace(strip(answer), f"{WS}+", " ")
    bare = strip(F.regexp_replace(whole, r"\s*\[\d+\]\s*$", ""))
    sentences = lambda c: F.size(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: strip(x) != ""))
    clean = lambda c: F.lower(F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(strip(c), r"\s*\[\d+\]\s*$", ""), r"[.!?]+$", "")), f"{WS}+", " "))
    pattern = r"(?is)^(.+?),\s+and\s+(.+)$"
    trimmed = F.regexp_replace(bare, r"[.!?]+$", "")
    left, right = clean(F.regexp_extract(trimmed, pattern, 1)), F.regexp_extract(trimmed, pattern, 2)
    qualifier = clean(F.regexp_extract(right, QUALIFIED, 1))
    moved = F.exists(statements, lambda x: clean(x).startswith(left) & clean(x).contains(qualifier))
    return F.when((sentences(whole) == 1) & whole.rlike(RATIONALE), F.array(whole)).when((sentences(bare) == 1) & (left != "") & (qualifier != "") & moved, F.array(whole)).otherwise(statements)


def content_digest(parts: Column) -> Column:
    """sha256 of the texts of an array in order, each after its length in bytes (8 bytes, big-endian)."""
    one = lambda x: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(x).cast("bigint")), 16, "0")), F.encode(x, "UTF-8"))
    return F.sha2(F.aggregate(F.transform(parts, one), F.lit(b""), lambda a, x: F.concat(a, x)), 256)
