import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillfold.operators import cache, context, providers
from quillfold.plans import evaluation, retrieval
from quillfold.sources import loaders, reports


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("a", "annual leave lasts thirty days for every employee"), ("b", "travel expenses are paid after approval by finance"), ("c", "the data centre is closed at night"), ("d", None)]
    return spark.createDataFrame(rows, "id string, content string"), spark.createDataFrame([("q1", "how many days of annual leave"), ("q2", "who pays travel expenses")], "query_id string, question string")


@pytest.mark.parametrize("mode", ["dense", "bm25", "hybrid"])
def test_modes_find_the_right_chunk(corpus, mode):
    chunks, questions = corpus
    got = {r.query_id: r.id for r in retrieval.retrieve(questions, chunks, retrieval.Options(mode=mode, top_k=2)).where("rank = 1").collect()}
    assert got == {"q1": "a", "q2": "b"}


def test_access_before_ranking(spark, corpus):
    chunks, questions = corpus
    allowed = spark.createDataFrame([("q1", "b"), ("q2", "b")], "query_id string, id string")
    got = {r.id for r in retrieval.retrieve(questions, chunks, retrieval.Options(mode="hybrid"), allowed=allowed).collect()}
    assert got == {"b"}


def test_rerank_and_variants(spark, corpus):
    chunks, questions = corpus
    got = {r.query_id: r.id for r in retrieval.retrieve(questions, chunks, retrieval.Options(mode="dense", rerank=True)).where("rank = 1").collect()}
    assert got == {"q1": "a", "q2": "b"}
    w = spark.createDataFrame([("who pays travel expenses", 0, "approval by finance")], "question_key string, pos int, rewrite string")
    got = {r.query_id: r.id for r in retrieval.retrieve_variants(questions, w, chunks, retrieval.Options(mode="bm25")).where("rank = 1").collect()}
    assert got == {"q1": "a", "q2": "b"}
    call = providers.CallReranker(lambda q, c: [(k, float(len(x))) for k, x in reversed(list(enumerate(c)))])
    c = spark.createDataFrame([("q", "x", "a", "zz", 1), ("q", "x", "b", "zzz", 2)], "query_id string, question string, id string, content string, dense_rank int")
    assert [r.id for r in call.rerank(c, 1).collect()] == ["b"]


def test_every_stage_that_an_option_asks_for_is_done(spark, corpus):
    chunks, questions = corpus
    rewrites = spark.createDataFrame([("how many days of annual leave", 0, "travel expenses approval finance")], "question_key string, pos int, rewrite string")
    parents = spark.createDataFrame([("p", "the whole handbook")], "parent_id string, content string")
    family = chunks.withColumn("parent_id", F.when(F.col("id").isin("a", "b"), "p").when(F.col("id") == "c", "lost"))

    def ids(option, **more):
        return {(r.query_id, r.id) for r in retrieval.retrieve(questions, chunks, option, **more).collect()}

    plain, many = retrieval.Options(mode="bm25", top_k=3), retrieval.Options(mode="bm25", top_k=3, multi_query=True)
    assert ("q1", "b") not in ids(plain) and ("q1", "b") in ids(many, rewrites=rewrites)
    assert ("q1", "b") not in ids(retrieval.Options(mode="bm25", top_k=3, multi_query=True, variant_weight=0.0), rewrites=rewrites)
    may = spark.createDataFrame([("q1", "b"), ("q2", "c")], "query_id string, id string")
    assert {r.id for r in retrieval.retrieve_variants(questions, rewrites, chunks, plain, allowed=may).where("query_id = 'q1'").collect()} == {"b"}
    both = retrieval.Options(mode="bm25", rerank=True)
    got = retrieval.retrieve_variants(questions, rewrites, chunks, both).where("query_id = 'q1'").orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].score > 1  # the reranker's score of the original question
    got = retrieval.retrieve(questions, family, retrieval.Options(mode="dense", expand=True), parents=parents).where("query_id = 'q1'").collect()
    assert sorted(r.content for r in got if r.expanded) == ["the whole handbook"] and any(r.id == "c" and not r.expanded for r in got)
    strict = retrieval.Options(mode="dense", gate=context.Gate(dense_threshold=1.1), pack=context.Packing())
    assert {(r.action, r.context) for r in retrieval.contexts(questions, chunks, strict).collect()} == {("rejected", None)}
    assert {r.action for r in retrieval.retrieve(questions, chunks, strict).collect()} == {"rejected"}
    small = retrieval.contexts(questions, chunks, retrieval.Options(mode="dense", pack=context.Packing(), budget=90, budget_unit="chars")).collect()
    assert len(small) == 2 and all(0 < len(r.context) <= 90 for r in small)
    for option in (retrieval.PROFILES["multi_query"], retrieval.Options(mode="dense", expand=True)):
        with pytest.raises(ValueError):
            retrieval.retrieve(questions, chunks, option)


def test_rejected_queries_never_reach_the_generator(spark, corpus):
    _, questions = corpus
    contexts = spark.createDataFrame([("q1", "[1] leave")], "query_id string, context string")
    prompts = context.build_prompts(questions, contexts)
    decisions = spark.createDataFrame([("q1", "accepted"), ("q2", "rejected")], "query_id string, action string")
    got = {r.query_id: (r.answer, r.generated) for r in providers.answer_queries(prompts, decisions, providers.CannedGenerator()).collect()}
    assert got["q2"] == (providers.ABSTENTION, False) and got["q1"][1]
    cut = context.cut_context(spark.createDataFrame([("q", 1, "abcd"), ("q", 2, "efgh"), ("q", 3, "x")], "query_id string, source_index int, block string"), 6).first().context
    assert cut == "abcd\n\nef"


def test_calls_are_tried_again_in_batches(spark):
    def vectors(texts):
        if not hasattr(vectors, "failed"):
            vectors.failed = True
            raise TimeoutError
        return [(k, [float(len(t))]) for k, t in reversed(list(enumerate(texts)))]

    df = spark.createDataFrame([("a",), ("bbb",), (None,), ("cc",)], "t string").coalesce(1)
    e = providers.CallEmbedder(vectors, "m", batch=3, query_prefix="query: ", wait=0.0)
    assert [r.embedding[0] for r in e.embed(df, "t").collect()] == [1, 3, 0, 2]
    assert [r.embedding[0] for r in e.embed(df, "t", query=True).collect()] == [8, 10, 7, 9]
    with pytest.raises(Exception, match="exceeds the budget"):
        providers.CallEmbedder(vectors, "m", tokens=1, wait=0.0).embed(spark.createDataFrame([("a" * 50,)], "t string"), "t").collect()

    def broken(q, c):
        raise ConnectionError

    c = spark.createDataFrame([("q", "x", "a", "zz", 1), ("q", "x", "b", "zzz", 2)], "query_id string, question string, id string, content string, dense_rank int")
    assert [(r.id, r.score) for r in providers.CallReranker(broken, wait=0.0).rerank(c, 2).collect()] == [("a", None), ("b", None)]
    r = providers.CallRewriter(lambda q: '["x y", "z"]' if q == "one" else "1. first\\n- second".replace("\\n", "\n")).rewrite(spark.createDataFrame([(" ONE ",), ("two",), (None,)], "question string"))
    assert sorted((x.question_key, x.pos, x.rewrite) for x in r.collect()) == [("one", 0, "x y"), ("one", 1, "z"), ("two", 0, "first"), ("two", 1, "second")]
    count = providers.token_counter("exact", lambda t: len(t.split()))
    assert [x.n for x in spark.createDataFrame([("a b c",), (None,)], "t string").select(count(F.col("t")).alias("n")).collect()] == [3, None]


def test_cache_serves_what_is_there_once_for_a_key(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 1, n)
    r = spark.createDataFrame([("1", "A  b?"), ("2", "a B?"), ("3", "new"), ("4", "old")], "request_id string, question string")
    parts = lambda v: cache.retrieval_parts(F.col("question"), "kb", v, F.lit(5), F.lit("{}"), "x")
    keyed = cache.with_key(r, "retrieval", parts(1))
    keys = {x.request_id: x.cache_key for x in keyed.collect()}
    want = 'rag:cache-v1:retrieval:' + hashlib.sha256(json.dumps({"config": "x", "corpus": "kb", "filter": "{}", "question": "a b?", "top_k": 5, "version": 1}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert keys["1"] == keys["2"] == want and len(set(keys.values())) == 3
    stored_ = spark.createDataFrame([(keys["1"], "p1", day(9)), (keys["1"], "p0", day(8)), (keys["4"], "p4", day(1))], "cache_key string, payload string, stored_at timestamp")
    rows, fresh = cache.served(keyed, stored_, lambda m: m.select("cache_key", F.concat(F.lit("made "), "question").alias("payload")), F.lit(day(10)), 3 * 86400)
    assert {x.request_id: (x.payload, x.cache_outcome) for x in rows.collect()} == {"1": ("p1", "hit"), "2": ("p1", "hit"), "3": ("made new", "miss"), "4": ("made old", "miss")} and fresh.count() == 2
    assert cache.served(cache.with_key(r, "retrieval", parts(2)), stored_, lambda m: m.select("cache_key", F.lit("n").alias("payload")), F.lit(day(10)), 3 * 86400)[0].where("cache_outcome = 'hit'").count() == 0
    old = '[{"index": 1, "content": "c", "score": 0.5, "metadata": {"id": "a"}}]'
    both = spark.createDataFrame([(old,), (f'{{"sources": {old}}}',)], "p string").select(cache.decoded_sources(F.col("p")).alias("s"))
    assert [x.s[0].metadata["id"] for x in both.collect()] == ["a", "a"]
    assert [x.s[0].content for x in both.select(cache.decoded_sources(cache.encoded_sources(F.col("s"))).alias("s")).collect()] == ["c", "c"]


def test_profiles_over_a_folder(spark, tmp_path):
    for name, body in (("Leave.md", "# Leave\n\nEvery employee has thirty days of annual leave."), ("b/travel.md", "# Travel\n\nFinance approves travel expenses within five days."), ("a.txt", "The data centre is closed at night.")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    docs = loaders.load_documents(spark, str(tmp_path))
    g = spark.createDataFrame([("q1", "days of annual leave", [(f"{tmp_path}/Leave.md", None)], "exact_name"), ("q2", "who approves travel expenses", [(f"{tmp_path}/b/travel.md", 0)], "paraphrase"), ("q3", "weather", [], "negative")], "qid string, question string, relevant array<struct<source:string,chunk_index:int>>, capability string")
    got = {(r.mode, r.k): r for r in evaluation.evaluate(docs, g, {k: retrieval.PROFILES[k] for k in ("baseline", "hybrid", "rerank", "parent_child", "multi_query")}).where("slice = 'all'").collect()}
    assert {m for m, _ in got} == {"baseline", "hybrid", "rerank", "parent_child"} and all(r.mrr == 1.0 for r in got.values()) and all(r.negative_false_recall_rate == 1.0 for (m, _), r in got.items() if m != "hybrid")
    chunks = evaluation.records_of(docs, retrieval.PROFILES["baseline"])[0].orderBy("ingest_sequence").collect()
    assert [r.source.rsplit("/", 1)[1] for r in chunks] == ["a.txt", "travel.md", "Leave.md"] and [r.ingest_sequence for r in chunks] == [0, 1, 2]


def test_options_are_validated():
    for bad in ({"mode": "x"}, {"top_k": 0}, {"variant_weight": 2.0}, {"weights": {"dense": 0.0}}):
        with pytest.raises(ValueError):
            retrieval.Options(**bad)


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("é", 1, None)], "b string, a int, c double").select("a", "b", "c")
    reports.write_json(m, str(tmp_path / "r.json"))
    reports.write_markdown(m, str(tmp_path / "r.md"), "T")
    reports.write_lines(m.withColumn("d", F.lit(2)), str(tmp_path / "r.jsonl"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"a": 1, "b": "é", "c": None}]
    assert "| 1 | é |  |" in (tmp_path / "r.md").read_text()
