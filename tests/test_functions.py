from pyspark.sql import functions as F

from quillfold.functions import markdown, text, vectors


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(make(F.col("v")).alias("r")).first().r


def test_clean_text_edges(spark):
    assert one(spark, None, text.clean_text) == ""
    assert one(spark, "a\x00b\r\nc", text.clean_text) == "abc"
    assert one(spark, "a. \n\n\n\n b", text.clean_text) == "a.\n\nb"
    assert one(spark, "well-\nknown", text.clean_text) == "well-known"
    assert one(spark, "  x 　", text.clean_text) == "x"
    assert one(spark, "一\n二", text.clean_text) == "一二"


def test_tokens_stem_and_stop(spark):
    got = one(spark, "The policies of NAMED things 中", text.tokens)
    assert got == ["polici", "nam", "thing", "中"]
    assert one(spark, "", text.tokens) == []
    assert one(spark, None, text.tokens) is None


def test_token_count(spark):
    assert one(spark, "", text.token_count) == 1
    assert one(spark, "abcde", text.token_count) == 2
    assert one(spark, "中文ab", text.token_count) == 3


def test_mask_and_labels(spark):
    assert one(spark, "abcd", lambda c: text.mask(c, 2)) == "****"
    assert one(spark, "abcdef", lambda c: text.mask(c, 2)) == "ab**ef"
    df = spark.createDataFrame([("a.md", None, 0.5), (None, 3, 1.0)], "s string, i int, x double")
    got = [r.r for r in df.select(text.source_label(F.col("s"), F.col("i"), F.col("x")).alias("r")).collect()]
    assert got == ["source=a.md; score=0.5000", "source=unknown source; chunk=3; score=1.0000"]


def test_variants_of_a_reply(spark):
    assert one(spark, '["a","b"]', text.parse_variants) == ["a", "b"]
    assert one(spark, '{"queries":["c"]}', text.parse_variants) == ["c"]
    assert one(spark, "1. x\n- y\n\n", text.parse_variants) == ["x", "y"]


def test_question_shapes(spark):
    df = spark.createDataFrame([("What should I do when the job fails?",), ("Which document defines leave?",)], "q string")
    a, b = [r.asDict() for r in df.withColumns(text.question_shape(F.col("q"))).collect()]
    assert a["is_scenario"] and a["is_action_list"] and not a["is_lookup"]
    assert b["is_lookup"] and not b["is_scenario"]


def test_markdown(spark):
    doc = '---\ntitle: "T"\nx: 1\n---\n\n# Head\n\nA **b** [c](http://d) ![e](f)\n\n| a | b |\n| --- | --- |\n| 1 |  |\n\n```py\nx = 1\n```\n- item\n> quote\n'
    out = one(spark, doc, markdown.to_text)
    assert out == "Head\n\nA b c e\n\na | b\n1\n\nx = 1\nitem\nquote"
    assert one(spark, doc, markdown.front_matter) == {"title": "T", "x": "1"}
    assert [tuple(h) for h in one(spark, doc, markdown.headings)] == [(1, "Head")]
    assert "x = 1" not in one(spark, doc, lambda c: markdown.to_text(c, "drop"))
    assert one(spark, None, markdown.to_text) is None
    code = "---\n# only a remark\n---\n\n\nA *b*\n```c++\nmy_var = a * b * c\n- item_x_y  **z**\n# no heading\n```\n```\nx\n\n\n\ny\n```\n## _H_ [l](u)\n"
    assert one(spark, code, markdown.to_text) == "A b\n\nmy_var = a * b * c\n- item_x_y  **z**\n# no heading\n\nx\n\n\n\ny\n\nH l"
    assert one(spark, code, lambda c: markdown.to_text(c, "extract")) == "A b\n\n[Code block 1: c++]\n\n[Code block 2: unknown]\n\nH l"
    assert one(spark, code, lambda c: markdown.to_text(c, "drop")) == "A b\n\nH l"
    m = one(spark, code, markdown.metadata, "string")
    assert m.title is None and not m.has_front_matter and [tuple(h) for h in m.headings] == [(2, "_H_ [l](u)")] and [b.language for b in m.code_blocks] == ["c++", "unknown"]
    front = "---\ntags: [a, 'b' ,]\ndraft: True\nn: 007\nf: -1.5\n#c: d\n: x\nt: \"x: y\"\n---\nz"
    got = [tuple(e) for e in one(spark, front, markdown.front_matter_entries)]
    assert got == [("tags", "list", "a\x1fb"), ("draft", "bool", "true"), ("n", "int", "007"), ("f", "float", "-1.5"), ("t", "string", "x: y")]
    assert one(spark, "```\nopen fence\n*x*", markdown.to_text) == "```\nopen fence\nx"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalize(F.col("a")).alias("n"), vectors.negated_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.c for r in rows] == [0.0, 1.0] and rows[0].n == [0.6, 0.8] and rows[0].d == -5.0


def test_replies_pieces_and_guards(spark):
    for reply, want in (('["a", "b"]', ["a", "b"]), ('{"rewrites": ["c"]}', ["c"]), ('{"queries": ["d"]}', ["d"]), ('{"x": 1}', []), ("1. one\n-- 2 two\n\n* three", ["one", "two", "three"]), ("", [])):
        assert one(spark, reply, text.parse_variants) == want, reply
    assert one(spark, "a b c d", text.stream_pieces) == ["a b c ", "d"] and one(spark, "a b", text.stream_pieces) == ["a b"] and one(spark, "a b c", text.stream_pieces) == ["a b c"]
    assert one(spark, "x Apollo Dashboard y", text.canned_answer).startswith("Apollo") and one(spark, "y", text.canned_answer) == text.CANNED_REST
    guard = lambda answer, statements: spark.createDataFrame([(answer, statements)], "a string, s array<string>").select(text.guarded_statements(F.col("a"), F.col("s")).alias("r")).first().r
    assert guard("The policy  is relevant because it lists fees.", ["x", "y"]) == ["The policy is relevant because it lists fees."]
    whole = "Records must be encrypted, and the owner must archive the ticket before the release. [1]"
    assert guard(whole, ["Records must be encrypted before the release.", "The owner must archive."]) == [whole]
    assert guard(whole, ["Records must be encrypted.", "b"]) == ["Records must be encrypted.", "b"] and guard("One. Two, and three before four.", ["One before four."]) == ["One before four."]
    assert one(spark, 1.0000001, text.clamp_score, "double") == 1.0
    import hashlib

    import pytest

    for bad in (1.1, None, float("nan")):
        with pytest.raises(Exception, match="within 0..1"):
            one(spark, bad, text.clamp_score, "double")
    h = hashlib.sha256()
    for p in ("é", ""):
        h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    assert one(spark, ["é", ""], text.content_digest, "array<string>") == h.hexdigest()
    from quillfold.operators import evaluation

    v = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.6, 0.8])], "qid string, variant_no int, embedding array<double>")
    assert [(r.role, r.cosine) for r in evaluation.semantic_baselines(v).orderBy("variant_no").collect()] == [("original", 1.0), ("variant_1", 0.6)]
    assert evaluation.in_requested_order(v, ["q"]).count() == 2
    with pytest.raises(Exception, match="no rows of the question"):
        evaluation.in_requested_order(v, ["q", "z"]).collect()
    rows = [("p", "pos", k, "faith", x) for k, x in enumerate((0.9, 0.4, 0.5))] + [("n", "negative", k, m, x) for k in range(2) for m, x in (("abstained", float(k)), ("fabricated", 0.0))]
    m, f = evaluation.replay(spark.createDataFrame(rows, "qid string, capability string, run_index int, metric string, value double"), {"faith": 0.7}, {"faith": 0.1})
    got = {r.metric: r for r in m.collect()}
    assert not got["faith"].passed and got["abstained"].mean == 0.5 and not got["abstained"].passed and got["fabricated"].passed
    assert sorted((r.kind, r.metric, r.qid) for r in f.collect()) == [("margin", "faith", "p"), ("median", "faith", "p"), ("negative", "abstained", "n")]
