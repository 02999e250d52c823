import json

import pytest
from pyspark.sql import functions as F

from quillfold.sources import fixtures, index, loaders
from quillfold.streaming import metrics


def test_load_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grüße\r\nend".encode("utf-8"))
    (tmp_path / "b.md").write_text("---\ntitle: T\n---\n# H\n\ntext **b**\n")
    (tmp_path / "g.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "x.bin").write_bytes(b"\0\1")
    got = {r.source.rsplit("/", 1)[1]: r for r in loaders.load_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.md", "g.txt"}
    assert got["b.md"].content == "H\n\ntext b" and got["b.md"].title == "T" and got["g.txt"].content == "中文" and got["g.txt"].encoding == "gbk"
    assert loaders.list_files(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        loaders.load_documents(spark, str(tmp_path / "no"))
    with pytest.raises(ValueError):
        loaders.decode(b"ab\0")
    assert loaders.table_markdown([["a", None], ["b", "c"]]) == "| a |  |\n| --- | --- |\n| b | c |"


def test_fixture_readers(spark, tmp_path):
    golden = tmp_path / "g.jsonl"
    golden.write_text("# c\n\n" + json.dumps({"qid": "1", "question": "q", "relevant": [{"source": "a", "chunk_index": 0}], "capability": "exact_name"}) + "\n" + json.dumps({"qid": "2", "question": "q", "relevant": [], "capability": "negative"}))
    assert fixtures.read_golden(spark, str(golden)).count() == 2
    golden.write_text(json.dumps({"qid": "1", "question": "q", "relevant": [], "capability": "exact_name"}))
    with pytest.raises(ValueError):
        fixtures.read_golden(spark, str(golden))
    w = tmp_path / "w.jsonl"
    w.write_text(json.dumps({"question": "A  b", "rewrites": ["x"]}) + "\n" + json.dumps({"question": "a B", "variants": ["y", "z"]}))
    assert [(r.question_key, r.pos, r.rewrite) for r in fixtures.read_rewrites(spark, str(w)).orderBy("pos").collect()] == [("a b", 0, "y"), ("a b", 1, "z")]
    v = tmp_path / "v.jsonl"
    run = {"faithfulness": 1, "answer_relevance": 0.5, "context_precision": 0, "context_recall": 1}
    v.write_text(json.dumps({"record_type": "metadata"}) + "\n" + json.dumps({"qid": "1", "capability": "x", "runs": [run, run]}))
    assert fixtures.read_verdicts(spark, str(v)).count() == 8


def test_parsers(spark):
    m = spark.createDataFrame([("# x",), ('a_total{r="q",s="1"} 2.5',), ("b 3",), ("bad",)], "value string")
    assert [(r.name, r.labels, r.number) for r in fixtures.parse_exposition(m).collect()] == [("a_total", {"r": "q", "s": "1"}, 2.5), ("b", None, 3.0)]
    e = spark.createDataFrame([("event: token\ndata: a\ndata: b",), ("data: c",), (": ping",)], "value string")
    assert [(r.event, r.data) for r in fixtures.parse_events(e).collect()] == [("token", "a\nb"), ("message", "c")]
    c = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"hi"}}]}',), ("data: [DONE]",), ("data: {",)], "value string")
    assert [r.piece for r in fixtures.parse_chat_stream(c).collect()] == ["hi"]


def test_windowed_metrics(spark, tmp_path):
    df = spark.sql("select 'r' || (id % 3) as request_id, timestamp'2025-01-01 00:10:00' as ts, timestamp'2025-01-01 00:10:00' as received_at, '/query' as route, 'p' as principal_id, 'q' as question, 5 as top_k, 'dense' as retrieval_mode, 10.0D as latency_ms, 'miss' as cache_outcome, 200 as status_code, 'ok' as outcome, array('a') as source_ids from range(6)")
    df.write.parquet(str(tmp_path / "in"))
    out = metrics.windowed_metrics(metrics.request_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.route, r.n) for r in spark.table("w").select("route", F.col("n")).collect()] == [("/query", 3)]


def test_snapshots_parents_and_dimensions(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    a = spark.createDataFrame([("1", [1.0, 2.0], 1)], "id string, embedding array<double>, ingest_sequence bigint")
    assert index.write_snapshot(a, root) == 1
    b = index.add_records(index.read_snapshot(spark, root), spark.createDataFrame([("1", [3.0, 4.0], 1), ("2", [0.0, 1.0], 2)], a.schema))
    assert index.write_snapshot(b, root) == 2 and index.versions(spark, root) == [1, 2]
    assert index.read_snapshot(spark, root, 1).count() == 1 and {r.id: r.embedding for r in index.read_snapshot(spark, root).collect()} == {"1": [3.0, 4.0], "2": [0.0, 1.0]}
    with pytest.raises(Exception, match="exist"):
        index.write_snapshot(a, root, 2)
    with pytest.raises(FileNotFoundError):
        index.read_snapshot(spark, root, 7)
    with pytest.raises(Exception, match="isn't of 2 numbers"):
        index.add_records(a, spark.createDataFrame([("3", [1.0], 3)], a.schema)).collect()
    parents = index.add_parents(index.add_parents(None, spark.createDataFrame([("p", "old"), ("r", "x")], "parent_id string, content string")), spark.createDataFrame([("p", "new")], "parent_id string, content string"))
    assert {r.parent_id: r.content for r in parents.collect()} == {"p": "new", "r": "x"} and index.get(parents, "p", "parent_id").first().content == "new"
    with pytest.raises(Exception, match="parent_id is missing"):
        index.add_parents(None, spark.createDataFrame([(None, "x")], "parent_id string, content string")).collect()
    kids = index.with_parent_payload(spark.createDataFrame([("c1", "p", 1), ("c2", "p", 2), ("c3", "gone", 3)], "id string, parent_id string, ingest_sequence bigint"), parents)
    assert index.parents_of(kids.where("parent_id = 'p'")).collect() == [("p", "new")]
    with pytest.raises(Exception, match="no text of the parent"):
        index.parents_of(kids).collect()


def test_audit_of_a_stream(spark, tmp_path):
    from quillfold.operators import observe

    log = "request_id string, ts timestamp, route string, principal_id string, question string, top_k int, retrieval_mode string, latency_ms double, cache_outcome string, status_code int, outcome string, source_ids array<string>"
    rows = spark.sql("select '1' request_id, timestamp'2026-01-01' ts, 'query' route, 'u' principal_id, 'q?' question, 5 top_k, 'dense' retrieval_mode, -1.0D latency_ms, 'hit' cache_outcome, 200 status_code, 'success' outcome, array('ok', 'a b') source_ids")
    rows.write.json(f"file://{tmp_path}/log")
    for _ in range(2):
        observe.audit_stream(spark.readStream.schema(log).json(f"file://{tmp_path}/log"), "salt", f"file://{tmp_path}/audit", f"file://{tmp_path}/at").awaitTermination(60)
    observe.write_audit(observe.audit_records(rows, "salt"), f"file://{tmp_path}/audit2")
    got = [spark.read.json(f"file://{tmp_path}/{x}").collect() for x in ("audit", "audit2")]
    assert len(got[0]) == 1 and got[0][0].principal_id == got[1][0].principal_id != "u" and got[0][0].source_ids[1].startswith("s_") and got[0][0].latency_ms == 0.0


def test_stored_tables_are_released(spark):
    from quillfold.sources.tables import release, stored

    kept = stored(spark.range(3).toDF("k"))
    assert kept.count() == 3 and release(spark) >= 1 and release(spark) == 0
