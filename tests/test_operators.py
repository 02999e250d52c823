import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quillfold.operators import access, chunking, context, dense, embedding, evaluation, fusion, lexical, observe
from quillfold.sources import index as store


def test_bm25_matching_beats_others_and_access_comes_first(spark):
    docs = spark.createDataFrame([("a", "annual leave policy"), ("b", "travel policy"), ("c", None), ("d", "")], "id string, text string")
    q = spark.createDataFrame([("q", "annual leave"), ("r", ""), ("s", None)], "query_id string, question string")
    got = lexical.bm25_topk(q, docs, 5).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in got] == [("q", "a", 1)]
    allowed = spark.createDataFrame([("q", "b")], "query_id string, id string")
    assert lexical.bm25_topk(q, docs, 5, allowed=allowed).count() == 0
    with pytest.raises(ValueError):
        lexical.Bm25(k1=0)


def test_bm25_formula(spark):
    docs = spark.createDataFrame([("a", "x1 x1 y1"), ("b", "y1")], "id string, text string")
    q = spark.createDataFrame([("q", "x1")], "query_id string, question string")
    score = lexical.bm25_topk(q, docs, 1).first().score
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert score == round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), 6)


def test_rerank_without_terms_keeps_order(spark):
    c = spark.createDataFrame([("q", "the", 1, "alpha", 1), ("q", "the", 2, None, 2), ("w", "alpha beta", 1, "beta", 1), ("w", "alpha beta", 2, "alpha beta", 2)], "query_id string, question string, id int, content string, dense_rank int")
    got = {(r.query_id, r["rank"]): r.id for r in lexical.lexical_rerank(c, 5).collect()}
    assert got == {("q", 1): 1, ("q", 2): 2, ("w", 1): 2, ("w", 2): 1}


def test_dense_ties_go_to_the_lesser_id(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, embedding array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    got = [(r.id, r.score) for r in dense.dense_topk(q, index, 3).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0), ("z", 0.0)]
    assert dense.dense_topk(q.limit(0), index, 3).count() == 0
    with pytest.raises(ValueError):
        dense.dense_topk(q, index, 0)


def test_rrf_weights_and_representative(spark):
    r = spark.createDataFrame([("q", "dense", "a", 1), ("q", "sparse", "b", 1), ("q", "sparse", "a", 2), ("q", "other", "c", 1)], "query_id string, path string, id string, rank int")
    got = {x.id: x for x in fusion.rrf(r, 5).collect()}
    assert set(got) == {"a", "b"} and got["a"].score == round(0.2 / 61 + 1 / 62, 6) and got["a"].representative == "dense" and got["a"]["rank"] == 1
    assert fusion.multi_query(spark.createDataFrame([("q", 0, "a", 1), ("q", 1, "b", 1)], "query_id string, variant_no int, id string, rank int"), 5).orderBy("rank").first().id == "a"


def test_variants_cap_is_looked_at_after_taking(spark):
    q = spark.createDataFrame([("1", " How long? "), ("2", "")], "query_id string, question string")
    w = spark.createDataFrame([("how long?", 0, "HOW  long?"), ("how long?", 1, "which term"), ("how long?", 2, "x")], "question_key string, pos int, rewrite string")
    got = [(r.variant_no, r.text) for r in fusion.variants(q, w, 1).orderBy("variant_no").collect()]
    assert got == [(0, "How long?"), (1, "which term")]


def test_access_denies_by_default(spark):
    df = spark.createDataFrame([("1", ["g1", None], "md"), ("2", [], "md"), ("3", None, None)], "id string, acl array<string>, kind string")
    ids = lambda wanted: [r.id for r in df.where(access.matches(df, wanted)).collect()]
    assert ids({"acl": ["g1"]}) == ["1"] and ids({"acl": []}) == [] and ids({"acl": "g1"}) == [] and ids({"kind": "md"}) == ["1", "2"] and ids({"no": 1}) == [] and ids({}) == ["1", "2", "3"]
    assert access.merge_filters({"acl": ["a", "b"]}, {"acl": ["b", "c"]}) == {"acl": ["b"]}
    with pytest.raises(PermissionError):
        access.merge_filters({"acl": ["a"]}, {"acl": ["b"]})
    assert access.merge_filters({"acl": [" b ", ""], "kind": "md"}, {"acl": ["b", "c"]}) == {"acl": ["b"], "kind": "md"}
    with pytest.raises(access.AccessDenied):
        access.subject_filter([" ", None])
    assert access.subject_filter([], default_deny=False) == {"acl": []} and access.subject_filter([" b", "a", "a"]) == {"acl": ["a", "b"]}
    assert access.principal_of({"X-Principal-Id": " u "}, {"principal_id": "v"}) == "u" and access.principal_of({}, {"principal_id": "v"}, body_allowed=True) == "v"
    with pytest.raises(access.AccessDenied):
        access.principal_of({}, {"principal_id": "v"})
    assert access.parse_filter(' {"a": 1}') == {"a": 1} and access.parse_filter(" ") == {}
    with pytest.raises(ValueError):
        access.parse_filter("[1]")
    docs = spark.createDataFrame([(1, "x.md"), (2, "y.md")], "id int, source string")
    kids = spark.createDataFrame([(7, 2), (8, 1)], "id int, document_id int")
    bound = spark.createDataFrame([(1, None, "g1"), (None, 8, " g2"), (None, 7, "g3"), (9, None, "g4"), (None, None, "g5"), (1, None, " ")], "document_id int, chunk_id int, acl_subject string")
    of = access.subjects_of_source(bound, docs, kids)
    assert {r.source: r.subjects for r in of.collect()} == {"x.md": ["g1", "g2"], "y.md": ["g3"]}
    rec = spark.createDataFrame([("x.md",), ("z.md",)], "source string").withColumn("acl", F.lit("clash"))
    assert {r.source: r.acl for r in access.stamp(rec, of, ["d"]).collect()} == {"x.md": ["g1", "g2"], "z.md": ["d"]} and access.stamp(rec, default=["d"]).first().acl == ["d"]
    with pytest.raises(Exception, match="no subjects are bound"):
        access.stamp(rec, of).collect()
    m = spark.createDataFrame([(" p ", "g1"), ("p", "g1"), ("", "g2"), ("r", None)], "principal string, acl_subject string")
    assert [(r.principal, r.subjects) for r in access.allowed_subjects(m).collect()] == [("p", ["g1"])]
    assert [(r.principal, r.id) for r in access.visible(spark.createDataFrame([("p",), ("r",)], "principal string"), m, df).collect()] == [("p", "1")]


def test_access_beside_the_documents_equals_the_join(spark):
    docs = spark.createDataFrame([(f"d{k}", f"leave policy {'annual ' * (k % 5)}number {k}", [["a"], ["b"], ["a", "b"], [], None][k % 5]) for k in range(60)], "id string, text string, acl array<string>")
    asked = spark.createDataFrame([("q1", "annual leave", ["a"]), ("q2", "annual leave policy", ["b", "c"]), ("q3", "number", []), ("q4", None, ["a"])], "query_id string, question string, subjects array<string>")
    allowed = asked.select("query_id", F.explode("subjects").alias("s")).join(docs.select("id", F.explode("acl").alias("s")), "s").select("query_id", "id").distinct()
    fast = {tuple(r) for r in lexical.bm25_topk(asked, docs, 7, acl_col="acl").collect()}
    assert fast and fast == {tuple(r) for r in lexical.bm25_topk(asked, docs, 7, allowed=allowed).collect()}
    index = lexical.write_index(docs)
    assert {tuple(r) for r in lexical.bm25_topk(asked, docs, 7, index=index).collect()} == {tuple(r) for r in lexical.bm25_topk(asked, docs, 7).collect()}
    assert lexical.bm25_topk(asked.limit(0), docs, 7).count() == 0 and lexical.bm25_topk(asked, docs.limit(0), 7).count() == 0


def test_equal_scores_follow_sources_and_places(spark):
    rows = [("support", "docs\\\\support.md".replace("\\\\", "\\"), 0, 0), ("product", "docs/product.md", 0, 0), ("late", "docs/product.md", 1, 0), ("upper", "Docs/alpha.md", None, None), ("none", None, None, None)]
    x = spark.createDataFrame([(i, [1.0, 0.0], s, c, a, None) for i, s, c, a in rows], "id string, embedding array<double>, source string, chunk_index int, start_char int, end_char int")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    for df in (x, x.orderBy(F.desc("id"))):
        assert [r.id for r in dense.dense_topk(q, df, 5, ties=dense.record_ties()).orderBy("rank").collect()] == ["none", "upper", "product", "late", "support"]


def test_gate_matrix(spark):
    rows = [("a", "dense", 0.7, None, None), ("b", "dense", 0.1, None, None), ("c", "bm25", 9.0, None, None), ("d", "dense", None, None, None), ("e", "hybrid", 0.02, 0.9, None), ("f", "dense", 0.4, None, "cohere"), ("g", "dense", 0.4, None, "deterministic"), ("h", None, None, None, None), ("i", "hybrid", 0.02, None, None)]
    f = spark.createDataFrame(rows, "query_id string, retrieval_mode string, score double, dense_score double, rerank_provider string")
    got = {r.query_id: (r.action, r.score_space) for r in context.gate(f).collect()}
    assert got == {"a": ("accepted", "dense_cosine"), "b": ("rejected", "dense_cosine"), "c": ("skipped", "bm25"), "d": ("skipped", "dense_cosine"), "e": ("accepted", "dense_cosine"), "f": ("skipped", "cohere_rerank_score"), "g": ("skipped", "lexical_score"), "h": ("no_candidates", None), "i": ("skipped", "rrf")}


def test_packing(spark):
    s = spark.createDataFrame([("r", 1, "a", "one two three", 0.5), ("r", 2, "a", "again", 0.4), ("r", 3, "b", "First. Second is far too long to be taken here at all.", 0.3), ("r", 3, "b", "First. Second is far too long to be taken here at all.", 0.3), ("x", 1, "c", "t", None)], "request_id string, source_index int, record_id string, content string, score double")
    b = spark.createDataFrame([("r", 90, "chars"), ("x", None, "chars")], "request_id string, budget_limit int, budget_unit string")
    got = context.pack_contexts(s, b).collect()
    assert len(got) == 1 and got[0].used_ids == ["a"] and got[0].deduped_ids == [] and got[0].skipped_ids == ["a", "b"] and got[0].budget_used == len(got[0].context) <= 90
    got = context.pack_contexts(s, b, context.Packing(exact=True)).collect()
    assert got[0].deduped_ids == ["a"] and got[0].dedup_reasons == ["exact"] and got[0].skipped_ids == ["b"]
    cut = context.pack_contexts(s.where("source_index = 3").withColumn("source", F.lit("d.md")).withColumn("chunk_index", F.lit(4)), spark.createDataFrame([("r", 60, "chars")], b.schema)).first()
    assert cut.context == "[1] source=d.md; chunk=4; score=0.3000\nFirst." and cut.used_ids == ["b"] == cut.truncated_ids
    near = context.pack_contexts(s.withColumn("content", F.concat("content", F.lit(""))).withColumn("record_id", F.col("source_index").cast("string")).unionByName(spark.createDataFrame([("r", 9, "9", "ONE two  three", 0.1)], s.schema)), spark.createDataFrame([("r", 900, "tokens")], b.schema), context.Packing(near_threshold=0.9)).first()
    assert near.deduped_ids == ["9"] and near.dedup_reasons == ["near"]
    keys = spark.createDataFrame([("s", 1, 2, "a", "p"), ("s", 1, None, "a", "p"), (None, None, None, "", "p"), (None, None, None, None, None)], "source string, start_char int, end_char int, record_id string, parent_id string").select(context.dedup_key().alias("k")).collect()
    assert [None if r.k is None else r.k.split("\0")[0] for r in keys] == ["span", "record_id", "parent_id", None]
    assert [context.score_space(*x) for x in (("hash-64",), ("bge",), ("bge", "Cosine", "remote"))] == ["hash_cosine", "dense_cosine", "dense_cosine"]
    small = context.pack_contexts(s, spark.createDataFrame([("r", 40, "chars")], "request_id string, budget_limit int, budget_unit string")).first()
    assert small.used_ids == [] or small.budget_used <= 40


def test_collapse_and_parents(spark):
    r = spark.createDataFrame([("q", "c1", "p", 2), ("q", "c2", "p", 1), ("q", "c3", None, 3)], "query_id string, id string, parent_id string, rank int")
    got = {x.parent_id: x for x in context.expand_parents(context.collapse_siblings(r), spark.createDataFrame([("p", "text")], "parent_id string, content string")).collect()}
    assert got["p"].id == "c2" and got["p"].child_ids == ["c2", "c1"] and got["p"].expanded and not got["c3"].expanded


def test_chunks_are_slices(spark):
    body = "Para one. " * 60 + "\n\n" + "x" * 900 + "\n\n" + "末尾。" * 300
    docs = spark.createDataFrame([(1, body), (2, None), (3, "  \n "), (4, "short")], "id bigint, text string")
    got = chunking.chunks(docs, "id", "text", chunking.Chunking(500, 80)).collect()
    for r in got:
        t = {1: body, 4: "short"}[r.id]
        assert r.content == t[r.start_char : r.end_char] and 0 < len(r.content) <= 500
    assert {r.id for r in got} == {1, 4}
    p, c = chunking.parent_child(docs, "id", "text", chunking.Chunking(600, 50), chunking.Chunking(200, 30))
    parents = {r.parent_id: r for r in p.collect()}
    for r in c.collect():
        q = parents[r.parent_id]
        assert q.parent_start_char <= r.start_char and r.end_char <= q.parent_end_char
    assert [(s.start, s.end) for s in docs.where("id = 1").select(chunking.fixed_spans(F.lit("abcdefghij"), 4, 1).alias("s")).first().s] == [(0, 4), (3, 7), (6, 10)]
    with pytest.raises(ValueError):
        chunking.Chunking(10, 10)


def test_record_id_is_canonical_json(spark):
    df = spark.createDataFrame([("é\u001f", "a\\b.md", 3)], "content string, source string, chunk_index int")
    got = df.select(chunking.record_id(F.col("content"), [("source", F.col("source")), ("chunk_index", F.col("chunk_index"))]).alias("r")).first().r
    want = json.dumps({"content": "é\u001f", "metadata": {"chunk_index": 3, "source": "a/b.md"}}, ensure_ascii=False, sort_keys=True)
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in embedding.embed_documents(docs, "t", 16).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12 and not any(got[2]) and not any(got[3])
    back = spark.createDataFrame([([1.5, -2.0],)], "v array<double>").select(embedding.decode_vector(embedding.encode_vector("v")).alias("r")).first().r
    assert back == [1.5, -2.0]
    items = spark.createDataFrame([("g", k, 5) for k in range(5)], "group_key string, item int, tokens int")
    assert [r.batch_no for r in embedding.request_batches(items, 2, 100).orderBy("item").collect()] == [1, 1, 2, 2, 3]


def test_metrics_by_hand(spark):
    g = spark.createDataFrame([("1", [("a", 0), ("b", None)], "x"), ("2", [("c", 1)], "y"), ("3", [], "negative")], "qid string, relevant array<struct<source:string,chunk_index:int>>, capability string")
    run = spark.createDataFrame([("1", 1, "b", 7), ("1", 2, "a", 0), ("2", 1, "c", 0), ("3", 1, "z", 0)], "qid string, rank int, source string, chunk_index int")
    s = {(r.k, r["slice"]): r for r in evaluation.summary(evaluation.cases(g, run, (1, 2))).collect()}
    assert s[1, "all"].hit_rate == 0.5 and s[1, "all"].mrr == 0.5 and s[1, "all"].recall == 0.25 and s[2, "all"].recall == 0.5
    assert s[1, "all"].negative_false_recall_rate == 1.0 and s[1, "negative"].mrr == 0.0
    v = spark.createDataFrame([("a", "m", x) for x in (1.0, 2.0, 9.0)] + [("a", "m", None)], "qid string, metric string, value double")
    r = evaluation.summarize(v, ["qid"], "value").first()
    assert (r["mean"], r["median"], r.mad, r.n) == (4.0, 2.0, 1.0, 3)
    gate = evaluation.verdict_gate(v, {"m": 0.5}, {"m": 0.1}).first()
    assert gate.failures == 0 and not gate.passed
    d = evaluation.set_difference(spark.createDataFrame([("a",), ("b",)], "qid string"), spark.createDataFrame([("b",), ("c",)], "qid string"), "qid")
    assert {(x.qid, x.side) for x in d.collect()} == {("a", "missing"), ("c", "extra")}


def test_observation(spark):
    log = spark.createDataFrame([("a", float(k), "r", 200) for k in range(1, 11)] + [("a", None, "r", 500)], "route string, latency_ms double, request_id string, status_code int")
    s = observe.latency_summary(log, ["route"]).first()
    assert (s.p50_ms, s.p95_ms, s.p99_ms, s.n) == (5.0, 10.0, None, 10)
    h = {r.le: r.cumulative for r in observe.histogram(log, ["route"]).collect()}
    assert h["5.0"] == 5 and h["+Inf"] == 10
    page = observe.exposition(spark.createDataFrame([('a"', 2)], "route string, n int"), "m", ["route"], "n", "Help.").orderBy("place").collect()
    assert [r.line for r in page] == ["# HELP m Help.", "# TYPE m counter", 'm{route="a\\""} 2']
    hist = observe.histogram(spark.createDataFrame([("a", 7.0), ("a", 20000.0), ("a", None)], "route string, latency_ms double"), ["route"])
    page = [r.line for r in observe.histogram_exposition(hist, "d", ["route"]).orderBy("place").collect()][2:]
    assert page[:2] == ['d_bucket{route="a",le="5"} 0', 'd_bucket{route="a",le="10"} 1'] and page[-4:] == ['d_bucket{route="a",le="10000"} 1', 'd_bucket{route="a",le="+Inf"} 2', 'd_sum{route="a"} 20007.000', 'd_count{route="a"} 2']


def test_index_table(spark):
    a = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "x", 1)], "id string, content string, ingest_sequence bigint")
    got = {r.id: r.content for r in store.upsert(a, spark.createDataFrame([("2", "y", 1)], a.schema)).collect()}
    assert got == {"1": "new", "2": "y"}
    assert [r.id for r in store.delete(a, spark.createDataFrame([("1",)], "id string")).collect()] == ["2"]
    with pytest.raises(Exception):
        store.upsert(a, spark.createDataFrame([(None, "y", 1)], a.schema)).collect()


def test_counters_keep_every_label_value(spark):
    log = spark.range(10_050).selectExpr("'r' AS route", "cast(id AS string) AS label")
    assert observe.counters(log, ["route", "label"]).agg(F.sum("n")).first()[0] == 10_050


def test_upsert_records_merges_late_deliveries(spark, monkeypatch, tmp_path):
    from quillfold.plans import queries as core

    rows = [("a", 1, "2024-01-01", "2024-01-01"), ("a", 2, "2024-01-02", "2024-01-09"), ("b", 4, "2024-01-01", "2024-01-01"), ("b", 3, "2024-01-01", "2024-01-08"), ("c", 5, "2024-01-01", "2024-01-07"), ("d", 6, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "id string, ingest_sequence bigint, u string, i string").selectExpr("id", "ingest_sequence", "cast(u AS timestamp) AS updated_at", "cast(i AS timestamp) AS ingested_at")
    df.write.parquet(str(tmp_path / "vector_records.parquet"))
    sizes, real = [], core.store.upsert
    monkeypatch.setattr(core.store, "upsert", lambda old, new: sizes.append((old.count(), new.count())) or real(old, new))
    got = {r.id: r.ingest_sequence for r in core.QUERIES["upsert_records"](spark, str(tmp_path)).collect()}
    assert sizes == [(3, 3)] and got == {"a": 2, "b": 4, "c": 5, "d": 6}
