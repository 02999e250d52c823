"""Access control: subjects of principals, and filters before ranking. Without a match access is denied."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_subjects(c: Column) -> Column:
    """Trimmed, without empty ones, distinct and sorted; null gives an empty array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def matches(df: DataFrame, wanted: Mapping[str, object]) -> Column:
    """All conditions hold. A list of values needs one of them in the column, an empty list denies;
    a single value needs equality, so that an array column never equals it. Null and missing deny."""
    ok = F.lit(True)
    for name, value in wanted.items():
        if name not in df.columns:
            return F.lit(False)
        is_array = df.schema[name].dataType.typeName() == "array"
        if isinstance(value, (list, tuple, set)):
            values = [v for v in value if v is not None]
            if not values:
                return F.lit(False)
            lits = F.array(*[F.lit(v) for v in values])
            ok = ok & (F.coalesce(F.size(F.array_intersect(F.col(name), lits)) > 0, F.lit(False)) if is_array else F.coalesce(F.col(name).isin(values), F.lit(False)))
        else:
            ok = ok & (F.lit(False) if is_array else F.col(name).eqNullSafe(F.lit(value)))
    return ok


class AccessDenied(PermissionError):
    """Nothing is allowed, or it can't be told what is."""


def subject_filter(subjects: Sequence[str | None] | None, column: str = "acl", default_deny: bool = True) -> dict[str, object]:
    """The filter of a principal's subjects for ``matches``. None at all is an error under ``default_deny``; else an empty list, which denies."""
    values = sorted({s.strip() for s in subjects or () if s and s.strip()})
    if not values and default_deny:
        raise AccessDenied("the principal has no subjects")
    return {column: values}


def principal_of(headers: Mapping[str, str], body: Mapping[str, object], header: str = "x-principal-id", body_allowed: bool = False) -> str:
    """The principal of a request: the header's, else the body's where that is allowed; else an error."""
    named = {k.lower(): v for k, v in headers.items()}.get(header.lower(), "")
    told = str(body.get("principal_id") or "") if body_allowed else ""
    for value in (named, told):
        if value and value.strip():
            return value.strip()
    raise AccessDenied("the request names no principal")


def parse_filter(text: str | None) -> dict[str, object]:
    """A filter from JSON, which must be an object; nothing gives an empty one."""
    if not text or not text.strip():
        return {}
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a filter must be a JSON object")
    return value


def _values(value: object) -> set:
    many = value if isinstance(value, (list, tuple, set)) else [value]
    return {v.strip() if isinstance(v, str) else v for v in many if v is not None and v != "" and not (isinstance(v, str) and not v.strip())}


def merge_filters(client: Mapping[str, object], server: Mapping[str, object]) -> dict[str, object]:
    """The client may narrow what the server allows and never widen it; no overlap is an error."""
    out = dict(server)
    for name, value in client.items():
        if name not in out:
            out[name] = value
            continue
        a, b = _values(value), _values(out[name])
        if not a & b:
            raise AccessDenied(f"the filter on {name} leaves nothing that is allowed")
        out[name] = sorted(a & b)
    return out


def allowed_subjects(membership: DataFrame) -> DataFrame:
    """(principal, subjects sorted) of principals that aren't blank and have a subject."""
    m = membership.select(F.trim("principal").alias("principal"), F.trim("acl_subject").alias("s")).where("principal <> '' and s <> ''")
    return m.groupBy("principal").agg(F.sort_array(F.collect_set("s")).alias("subjects"))


def visible(principals: DataFrame, membership: DataFrame, records: DataFrame) -> DataFrame:
    """(principal, id): records that a principal may see, by an equi-join on the subject."""
    subjects = principals.select("principal").distinct().join(allowed_subjects(membership), "principal").select("principal", F.explode("subjects").alias("subject"))
    of = records.select("id", F.explode(normalize_subjects(F.col("acl"))).alias("subject")).distinct()
    return of.join(subjects, "subject").select("principal", "id").distinct()


def visible_counts(membership: DataFrame, records: DataFrame) -> DataFrame:
    """(principal, n_visible). Records are counted by their set of subjects first, so that no pair of principal and record is made."""
    sets = records.select("id", normalize_subjects(F.col("acl")).alias("acl")).where(F.size("acl") > 0).distinct()
    per_id = sets.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("acl")))).alias("acl")).groupBy("acl").agg(F.count("*").alias("n"))
    subjects = allowed_subjects(membership).select("principal", F.explode("subjects").alias("subject"))
    met = per_id.select("acl", "n", F.explode("acl").alias("subject")).join(subjects, "subject").select("principal", "acl", "n").distinct()
    return met.groupBy("principal").agg(F.sum("n").alias("n_visible"))


def subjects_of_source(bindings: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, subjects): the subjects bound to a document of a source or to a chunk of such a document.

    ``bindings`` has (document_id, chunk_id, acl_subject), ``documents`` (id, source), ``chunks`` (id, document_id). A binding that
    meets neither gives nothing; blank subjects and sources are left out.
    """
    d = documents.select(F.col("id").alias("document_id"), F.col("source").alias("direct"))
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("chunk_document"))
    e = documents.select(F.col("id").alias("chunk_document"), F.col("source").alias("through"))
    met = bindings.join(d, "document_id", "left").join(c, "chunk_id", "left").join(e, "chunk_document", "left")
    named = met.select(F.explode(F.array_distinct(F.array("direct", "through"))).alias("source"), F.trim("acl_subject").alias("s")).where("trim(source) <> '' and s <> ''")
    return named.groupBy("source").agg(F.sort_array(F.collect_set("s")).alias("subjects"))


def stamp(records: DataFrame, bindings: DataFrame | None = None, default: Sequence[str] = ()) -> DataFrame:
    """Records with ``acl``: the constant subjects where there are no bindings, else those of their source from (source,
    subjects). A source without a binding is an error, unless there is a default."""
    plain = F.array(*[F.lit(s) for s in default]).cast("array<string>")
    if bindings is None:
        return records.withColumn("acl", plain)
    bound = bindings.select("source", F.col("subjects").alias("__s"))
    missing = plain if default else F.raise_error(F.concat(F.lit("no subjects are bound to the source "), F.coalesce("source", F.lit("(none)")))).cast("array<string>")
    return records.drop("acl").join(bound, "source", "left").withColumn("acl", F.when(F.size("__s") > 0, F.col("__s")).otherwise(missing)).drop("__s")
