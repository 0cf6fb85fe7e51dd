"""Operators of the reports on small frames with answers worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import budgets, coerce, text, urls
from loomtrace.operators import attribution, blocks, replays, stats, threads, transitions
from loomtrace.operators import messages as M
from loomtrace.plans import quality, registry, sources


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


MARK = "citeturn0search1"


@pytest.fixture(scope="module")
def turns(spark):
    msgs = [
        {"content": {"content_type": "thoughts", "thoughts": [{"content": "think"}, {}]}, "metadata": {"user_context_message_data": {"about_user_message": "likes walrus"}}},
        {"metadata": {"search_result_groups": [{"domain": "a.org", "entries": [{"url": "https://www.a.org/x/", "title": "T", "snippet": "alpha", "ref_id": {"turn_index": 0, "ref_index": 1}}, None]}], "image_results": [{"url": "https://i.org/p.png", "title": "I"}]}},
        {"metadata": {"search_queries": [{"q": "one walrus"}, {"q": "one walrus"}], "safe_urls": ["https://a.org/x?utm_source=chatgpt.com", "", None]}},
        {"metadata": {"search_model_queries": {"queries": ["two alpha"]}}},
        {"metadata": {"search_result_groups": {"entries": json.dumps([{"url": "https://b.org"}])}}},
        {"metadata": {"content_references": [
            {"matched_text": MARK, "url": "https://www.a.org/x", "refs": [{"turn_index": 5, "ref_index": 6}], "items": [{"url": "https://c.org/1"}, {"url": "https://c.org/2", "refs": [{"turn_index": 1, "ref_index": 2}]}]},
            {"matched_text": MARK, "url": "https://www.a.org/x", "title": "rich"},
            {"matched_text": "no mark", "url": "https://z.org"},
        ]}},
    ]
    rows = [(1, json.dumps(msgs)), (2, "[{"), (3, None), (4, "[]"), (5, json.dumps([{"metadata": {}}]))]
    return spark.createDataFrame(rows, "row_id long, turn_msgs string").withColumns({"pos": F.lit(1), "url": F.lit("x"), "m": F.lit("y")})


def test_sources_in_one_pass(turns):
    s = M.sources(turns)
    got = sorted((r.kind, r.url, r.turn_index, r.ref_index) for r in s.collect())
    assert sum(k == "cited" for k, *_ in got) == 4 and sum(k == "safe" for k, *_ in got) == 1 and sum(k == "retrieved" for k, *_ in got) == 3
    assert ("safe", "https://a.org/x", None, None) in got and ("retrieved", "https://i.org/p.png", None, 0) in got
    assert ("cited", "https://c.org/1", 5, 6) in got and ("cited", "https://c.org/2", 1, 2) in got
    c = M.cited(turns).filter("url = 'https://www.a.org/x'").collect()
    assert len(c) == 1 and c[0].title == "rich" and c[0].g == 0
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 or "RoundRobin" in plan
    assert M.sources(turns.limit(0)).count() == 0


def test_sets_count_turns_without_sources(turns):
    got = {r.row_id: r for r in M.turn_sets(turns.select("row_id"), turns).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and all(got[i].retrieved == [] == got[i].cited for i in (2, 3, 4, 5))
    assert got[1].retrieved == ["https://b.org", "https://i.org/p.png", "https://www.a.org/x"] and got[1].safe == ["https://a.org/x"]
    assert got[1].cited_domains == ["a.org", "c.org"]


def test_loop_context(turns):
    got = sorted(M.loop_context(turns).collect(), key=lambda r: r.loop_idx)
    assert [(r.loop_idx, r.queries) for r in got] == [(1, ["one walrus"]), (2, ["two alpha"])]
    assert got[0].thoughts == ["think", ""] and got[0].sources == ["T\na.org\nalpha", "I\n\n"] and got[0].memories == ["likes walrus"]
    assert got[1].thoughts == [] == got[1].sources


@pytest.mark.parametrize("name", ["q32_top_domains", "q34_url_counts_by_month", "q35_grounding_rate", "q36_counts_by_topic", "q40_novel_citations", "q30_subset_relations"])
def test_nested_column_is_read_once(spark, data, name):
    """No report reads the nested column more often than there are scans that share their shuffle."""
    df = registry.queries()[name](spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "Scan parquet" in line and "turn_msgs" in line]
    assert 1 <= len(scans) - final.count("ReusedExchange") - final.count("Reused") or len(scans) == 1


def test_images(spark):
    got = one(spark, [("https://a.org/x.MOV",), ("https://a.org/x.pjpeg",), ("https://a.org/x.png?size=1",), ("https://tse1.mm.bing.net/th?id=1",), ("https://a.org/tse.mm.bing.net",), ("https://a.org/x.ico",), (None,)], "u string", urls.is_image(F.col("u")))
    assert [g[0] for g in got] == [True, True, False, True, False, False, None]


def test_blocks_equal_plain_windows(spark):
    rows = [("a", i // 7, i, i % 3) for i in range(50)] + [("b", 0, 1, 2), ("c", 5, 1, None), ("c", 9, 2, None)]
    d = spark.createDataFrame(rows, "k string, day int, o int, v int")
    got = {(r.k, r.o): (r.s, r.x, r.p) for r in blocks.previous(blocks.running(blocks.running(d, ["k"], "day", ["o"], F.col("v"), "s"), ["k"], "day", ["o"], F.col("v"), "x", inclusive=False), ["k"], "day", ["o"], "v", "p").collect()}
    total, before = 0, None
    for k, _, o, v in rows[:50]:
        assert got[k, o] == (total + v, total, before)
        total, before = total + v, v
    assert got["b", 1] == (2, 0, None) and got["c", 2] == (0, 0, None)


def test_threads(spark):
    schema = "conv_id string, msg_id string, parent_id string, child_no int, msg_row long, batch_no int, end_turn boolean"
    rows = [
        ("a", "1", " ROOT ", 0, 1, 1, False), ("a", "2", "1", 1, 2, 1, False), ("a", "3", "1", 0, 3, 1, True), ("a", "3", "1", 5, 9, 0, False), ("a", "4", "3", None, 4, 1, False),
        ("b", "2", "gone", 0, 5, 1, True), ("b", "3", None, 0, 6, 1, True), ("c", "1", "2", 0, 7, 1, True), ("c", "2", "1", 0, 8, 1, True), (None, "1", None, 0, 9, 1, True),
    ]
    m = threads.newest(spark.createDataFrame(rows, schema).withColumn("depth", F.lit(1)), "end_turn")
    want = [("a", "1", 0), ("a", "3", 1), ("a", "4", 2), ("b", "2", 0)]
    assert sorted(map(tuple, threads.path(m).select("conv_id", "msg_id", "depth").collect())) == want
    assert sorted(map(tuple, threads.path(m, group_rows=1).select("conv_id", "msg_id", "depth").collect())) == want
    assert threads.path(m.limit(0)).count() == 0


def test_turn_export_has_one_row_per_turn(spark, data):
    got = quality.q50_turn_export(spark, data)
    assert got.count() == got.select("turn_id").distinct().count() > 0


def test_shares(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", 3, None)], "k string, n int, x int")
    assert sorted((r.k, r.share) for r in stats.share_of_all(d, "n").collect()) == [("a", 0.25), ("b", 0.75)]
    assert stats.share_of_all(d.limit(0), "n").count() == 0


def test_replays(spark):
    response = json.dumps({"output": [{"type": "web_search_call", "action": {"queries": ["a", " a ", "b"]}}, {"type": "message"}, {"type": "web_search_call", "action": {"queries": []}}, {"type": "web_search_call", "action": {"queries": ["c"]}}]})
    d = spark.createDataFrame([("k", "auto", response), ("k", "none", response), ("l", "auto", None), ("m", "auto", "broken")], "result_key string, mode string, response string")
    got = sorted((r.result_key, r.loop_idx, r.queries, r.thoughts) for r in replays.replay_loops(d, "auto").collect())
    assert got == [("k", 1, ["a", "b"], []), ("k", 2, ["c"], [])]
    scores = ["none_factuality", "none_completeness", "none_relevance", "required_factuality", "required_completeness", "required_relevance"]
    rows = [(True, 3.0, 3.0, None, 4.0, 2.0, 1.0), (True, 3.0, 3.0, 3.0, 3.0, 2.0, 3.0), (False, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (False, 1.0, 1.0, None, 2.0, 2.0, 2.0), (True, None, None, None, None, None, None)]
    better, worse = replays.preferences()
    got = one(spark, rows, "web boolean, " + ", ".join(f"{s} double" for s in scores), stats.strict_outcome(F.col("web"), better, worse, 3), replays.mean_outcome(F.col("web")))
    assert got == [("Right", "Over Call"), ("Over", "Over Call"), ("Under", "Under Call"), ("Right", "Under Call"), ("Right", "Right Call")]
    a = spark.createDataFrame([("c", "t", 1), ("d", "t", 2), (None, "t", 3)], "conv_id string, turn_id string, x int")
    assert [tuple(r) for r in replays.merged({"p": a, "q": a.filter("x <> 2")}, ["conv_id", "turn_id"]).collect()] == [("c", "t", 1, 1)]
    flags = spark.createDataFrame([(True, True), (True, False), (False, False), (True, False)], "a boolean, b boolean")
    assert [(r.tools, r.n) for r in replays.combinations(flags, {"a": "a", "b": "b"}).collect()] == [("a+b", 1), ("a", 2), ("No Tool", 1)]
    assert sorted(map(tuple, replays.agreement(flags, "a", ["b"]).collect())) == [(False, 0, 0), (False, 1, 1), (True, 0, 2), (True, 1, 1)]


def test_transitions(spark):
    ids = [("U", "1.1"), ("1.2", "2.1"), ("2.1", "1.1"), ("1.1", "3.1"), ("x", "1.1"), (None, "1.1")]
    assert [g[0] for g in one(spark, ids, "a string, b string", transitions.iteration(F.col("a"), F.col("b")))] == [1, 2, 2, None, None, None]
    starts = spark.createDataFrame([(1, "a b"), (2, None)], "row_id long, q string")
    loops = spark.createDataFrame([(1, 1, ["a", "a b c"]), (1, 2, ["d"]), (2, 1, ["z"])], "row_id long, loop_idx int, queries array<string>")
    e = transitions.edges(starts, loops)
    got = sorted((r.from_id, r.to_id, r.k) for r in e.select("*", transitions.kind(F.col("from_words"), F.col("to_words")).alias("k")).collect())
    assert got == [("1.1", "2.1", "rewriting"), ("1.2", "2.1", "rewriting"), ("U", "1.1", "narrowing"), ("U", "1.2", "expansion")]
    said = spark.createDataFrame([(1, "U", "1.1", 2, "late"), (1, "U", "1.1", 1, "early"), (1, "2.1", "U", 1, "no candidate")], "row_id long, from_id string, to_id string, ord int, label string")
    first = transitions.labelled(e, said)
    assert [r.label for r in first.filter("label is not null").collect()] == ["early"] and first.count() == 4
    asked = spark.createDataFrame([(1, "1.1", "U", True)], "row_id long, from_id string, to_id string, ok boolean")
    assert transitions.validated(first, asked).filter("label = 'early'").count() == 1 and transitions.validated(first, asked.limit(0)).filter("label is not null").count() == 0
    assert sorted((r.from_id, r.to_id) for r in transitions.reversed_edges(e).collect())[0] == ("1.1", "U")


def test_attribution_in_a_turn(spark):
    source = "struct<key:string,cited:boolean,cited_refs:array<string>,got_refs:array<string>,place:struct<pos:int,g:int,src:int,e:int>,words:array<string>>"
    a = ("a", True, ["0::1"], [], (0, 0, 0, 0), ["nothing"])
    b = ("b", True, ["0::2"], [], (0, 1, 0, 0), ["walrus", "swims"])
    c = ("c", False, [], ["0::1"], (0, 2, 0, 0), ["walrus"])
    via = ("via", True, [], ["0::1"], (0, 3, 0, 0), ["walrus"])
    rows = [(1, 0, "Walrus swims", "0::1", [c, b, a]), (2, 0, "Walrus", "0::1", [via, b, a]), (3, 0, "Fish", None, [a]), (4, 0, "Walrus", None, [c, a]), (5, 0, "...", None, [a])]
    d = spark.createDataFrame(rows, f"row_id long, chunk int, text string, ref string, sources array<{source}>")
    got = {r.row_id: (r.bucket, r.source, r.checked) for r in attribution.attributed(d).collect()}
    assert got == {1: ("Other Citations", "b", 2), 2: ("Marked Citations", "via", 2), 3: ("Unexplained", None, 1), 4: ("Retrieved Sources", "c", 2), 5: ("Unexplained", None, 1)}


def test_budgets(spark):
    got = one(spark, [("abcdef",), (None,)], "t string", budgets.page_tokens(F.col("t")), budgets.prompt_tokens(F.col("t")), budgets.tail_in_budget(F.col("t"), F.lit(1)), budgets.tail_in_budget(F.col("t"), F.lit(0)), budgets.head_in_context(F.col("t"), F.lit(125_743)), budgets.head_in_context(F.col("t"), F.lit(200_000)))
    assert got[0] == (2, 1, "cdef", "", "abc", "") and got[1][2] is None
    long = "word " * 9 + "x" * 30
    parts = one(spark, [(long,), ("",), (None,)], "t string", budgets.pieces(F.col("t"), 12))
    assert "".join(parts[0][0]) == long and max(map(len, parts[0][0])) <= 12 and parts[1][0] == [] and parts[2][0] is None
    rows = [(["old " * 40, "newer"], "now", "t" * 100), (None, None, None), ([], "now", "")]
    got = [g[0] for g in one(spark, rows, "h array<string>, c string, t string", budgets.bounded_prompt(F.col("h"), F.col("c"), F.col("t"), 20))]
    assert got[0] == "newer\nnow\n" + "t" * 32 and got[2] == "\nnow" and len(got[0]) <= 84


def test_words_and_labels(spark):
    assert text.nested_text([{"content": [" a ", {"q": "b"}]}, None, {"x": 1, "y": ["c"]}, True]) == "a\nb\n1\nc"
    assert [g[0] for g in one(spark, [('["a", {"text": "b"}]',), ("plain ",), (None,)], "t string", text.json_text("t"))] == ["a\nb", "plain", ""]
    got = one(spark, [(1, 8), (1, 0), (None, 3)], "a int, b int", text.percent(F.col("a"), F.col("b")), text.bracketed(F.col("a") + 0.125))
    assert got[0] == ("12.5%", "(1.12)") and got[1][0] == "NA"
    got = [g[0] for g in one(spark, [("4",), ('x {"Output": "{\\"score\\": 3.5}"}',), ('{"score": 2}',), ("-1",), ("none",), (None,)], "t string", coerce.score_of(F.col("t")))]
    assert got == [4.0, 3.5, 2.0, None, None, None]
    got = one(spark, [("User_Query",), ("(1.1)",), (" 2 . 1 ",), ("",), (None,)], "t string", coerce.endpoint(F.col("t")))
    assert [g[0] for g in got] == ["U", "1.1", "2.1", None, None]
    got = one(spark, [("Hybrid: rewriting",), ("expansion",), ("rewriting with other",), ("Rewrite",), (None,)], "t string", coerce.reason(F.col("t")))
    assert [g[0] for g in got] == ["Hybrid", "Expansion", "Other", "Rewriting", "Other"]
    assert [g[0] for g in one(spark, [(" Neutral",), ("maybe",), (None,)], "t string", coerce.valid_label(F.col("t")))] == ["neutral", None, None]
    assert [g[0] for g in one(spark, [("a",), ("b",), (None,)], "t string", coerce.shown(F.col("t"), {"a": "A"}))] == ["A", "b", None]
    got = one(spark, [("1.5",), ("inf",), ("nan",), ("-2",), ("x",)], "t string", coerce.valid_number(F.col("t")))
    assert [g[0] for g in got] == [1.5, None, None, None, None]
    got = one(spark, [("a b/c",)], "t string", text.file_part(F.col("t")), text.last_chars(F.lit(" abc "), 2), text.claims(F.array(F.lit(" A claim here. "), F.lit("short"), F.lit("A claim here."))))
    assert got[0] == ("a_b_c", "bc", ["A claim here."])


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from loomtrace import session

    class Context:
        master, _jsc = "spark://host:7077", None

        class sc:  # noqa: N801
            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return type("No", (), {"isEmpty": staticmethod(lambda: True)})

    Context._jsc = type("J", (), {"sc": staticmethod(lambda: Context.sc)})
    conf = type("C", (), {"get": staticmethod(lambda *a: None)})
    frame = type("D", (), {"sparkSession": type("S", (), {"sparkContext": Context, "conf": conf})})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpointed(frame)


def test_top_domains_of_groups(spark):
    rows = [("t", f"d{i}", i % 2 == 0) for i in range(30) for _ in range(30 - i)] + [("u", "z", True)]
    got = sources._top(spark.createDataFrame(rows, "topic string, domain string, external boolean"), "topic").collect()
    assert len(got) == 21 and {r.domain for r in got if r.topic == "u"} == {"z"} and max(r.k for r in got) == 20
    assert abs(sum(r.share for r in got if r.topic == "t") - sum(30 - i for i in range(20)) / 465) < 1e-4


def test_deep_and_long_inputs():
    from loomtrace.operators import shredding, timestamps

    for depth in (900, 5_000):
        assert len(list(shredding.records(["[" * depth + "]" * depth, '[{"a": 1}]'], False))) == 2
    v = json.dumps([{"url": "u"}])
    for _ in range(12):
        v = json.dumps(v)
    paths = [x for _, cols in shredding.records([f'[{{"entries": {v}}}]'], True) for n in cols if n.element is not None for x in shredding.assemble(n.element)]
    assert paths == [("$[0]", "$"), ("$[0].entries[0]", "$[0]")]
    value, ok = timestamps.convert(["2025-01-01T00:00:00." + "5" * 300 + "Z", "x" * 5_000], [None, None], [None, None], {})
    assert ok.tolist() == [True, False] and value[0] == 1_735_689_600_555_555
