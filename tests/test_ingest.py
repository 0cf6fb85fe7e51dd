import json

import pytest

from loomtrace.operators import ingest as I
from loomtrace.sources import adapters, readers
from loomtrace.streaming import events


def node(parent, children, m=None):
    return {"parent": parent, "children": children, "message": m}


def test_tree():
    mapping = {"r": node(None, ["a"]), "a": node("r", ["b", "c"], {"id": "a"}), "b": node("a", ["gone"], {"id": "b"}), "c": node("a", [], {"id": "c"})}
    assert I.root_of(mapping) == "r" and [m["id"] for m in I.first_child_path(mapping)] == ["a", "b"]
    assert I.root_of({"x": node("missing", [])}) == "x" and I.root_of({"x": node("root", [])}) == "x" and I.root_of({}) is None
    assert I.first_child_path({"x": node(None, ["x"], {"id": "x"})}) == [{"id": "x"}]


def test_seconds():
    assert I.seconds(1735718418000) == 1735718418 == I.seconds("1735718418")
    assert I.seconds({"$date": {"$numberLong": "1735718418000"}}) == 1735718418
    assert I.seconds("2025-01-01T08:00:18+08:00") == 1735718418 and I.seconds(None) is None and I.seconds("x") is None
    with pytest.raises(ValueError):
        I.seconds(1, "other")


def test_topic():
    assert I.resolve_topic([], []) == "Other" and I.resolve_topic(["a"], ["b"]) == "a"
    assert I.resolve_topic(["a", "b"], ["b", "c", "c", "b"]) == "b" and I.resolve_topic(["a", "b"], [None, ""]) == "a"


def test_turns(spark):
    def msg(i, role, recipient="all", end=False, at=1.0, **k):
        return {"id": i, "author": {"role": role}, "recipient": recipient, "create_time": at, "end_turn": end, "content": {"content_type": "text", "parts": ["x"]}, "metadata": k}

    order = [msg("s", "system"), msg("u", "user"), msg("w", "assistant", "web", reasoning_status="x"), msg("a", "assistant", end=True, model_slug="m"), msg("u2", "user"), msg("tail", "assistant")]
    mapping = {m["id"]: node(order[i - 1]["id"] if i else None, [order[i + 1]["id"]] if i + 1 < len(order) else [], m) for i, m in enumerate(order)}
    claude = {"chat_messages": [{"uuid": "1", "sender": "human", "text": "t", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}], "created_at": "2025-01-01T00:00:00Z"}]}
    rows = [("chatgpt", "c", json.dumps({"mapping": mapping})), ("claude", "d", json.dumps(claude)), ("grok", "e", "broken"), ("grok", "f", json.dumps({"responses": [{"_id": "2", "create_time": 2, "message": "b"}, {"_id": "1", "create_time": 1, "message": "a"}]}))]
    m = I.messages_of(spark.createDataFrame(rows, "platform string, conv_id string, conversation string")).cache()
    assert m.filter("platform = 'claude'").first().body == "p\nq"
    assert [r.msg_id for r in m.filter("platform = 'grok'").orderBy("pos").collect()] == ["1", "2"]
    t = I.turns_of(m).collect()
    assert len(t) == 1 and t[0].turn_id == "a" and t[0].tools == ["web"] and t[0].reasoning == 1 and t[0].interactions == ["user:all", "assistant:web", "assistant:all"]
    topics = spark.createDataFrame([("c", "nan")], "conv_id string, topic string")
    assert I.attach_topics(I.turns_of(m), topics).first().topic == "Other"


def test_readers(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q"\nx', ["p"]), (2, None, None)], "i int, t string, l array<string>")
    paths = readers.write(d, str(tmp_path / "x"), ("parquet", "csv", "json"))
    assert readers.read(spark, paths[0]).count() == 2 and readers.read(spark, paths[1]).filter("i = '1'").first().t == 'a "q"\nx'
    assert readers.read_first(spark, [str(tmp_path / "no.parquet"), paths[0]]).count() == 2
    with pytest.raises(readers.MissingColumns):
        readers.read(spark, paths[0], ["zz"])
    with pytest.raises(ValueError):
        readers.read(spark, "x.pkl")
    (tmp_path / "user_3").mkdir()
    (tmp_path / "user_3" / "conversations.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.user_id for r in readers.read_user_exports(spark, str(tmp_path)).collect()] == [3, 3]


def test_pending_and_first(spark):
    todo = spark.createDataFrame([("a", None), ("a", 1), ("b", 1)], "k string, n int")
    assert readers.pending(todo, spark.createDataFrame([("a", None)], "k string, n int"), ["k", "n"]).count() == 2
    assert readers.first_of_key(spark.createDataFrame([("a", 2, "x"), ("a", 1, ""), ("a", 3, "y")], "k string, o int, r string"), "k", "o", ["r"]).first().o == 2


def test_adapters(spark):
    d = spark.createDataFrame([("p",), ("p",), (None,), ("bad",)], "prompt string")
    store = spark.createDataFrame([("p", "known")], "prompt string, answer string")

    def answer(x):
        if x == "bad":
            raise ValueError
        return "new"

    assert {r.prompt: (r.answer, r.status) for r in adapters.ask(d, "prompt", answer, store).collect()} == {"p": ("known", "stored"), "bad": (None, "failed: ValueError")}
    assert adapters.stub_judge("x") == adapters.stub_judge("x") and adapters.stub_entailment("a b c\ta b") == "entailment"
    plan = adapters.replay_plan(spark.createDataFrame([("s", "c", "t", "p1"), ("s", "c", "t", "p2")], "source string, conv_id string, turn_id string, prompt string"))
    assert plan.count() == 6 and plan.select("result_key").distinct().count() == 2


def test_resumed_pages_and_reachability(spark, tmp_path):
    path, calls = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def fetch(url):
        calls.add(1)
        return f"text of {url}"

    one = spark.createDataFrame([("a",), ("b",)], "url string")
    assert {r.url: r.answer for r in adapters.resumed(one, "url", fetch, path).collect()} == {"a": "text of a", "b": "text of b"} and calls.value == 2
    more = one.unionByName(spark.createDataFrame([("c",), (None,)], "url string"))
    assert adapters.resumed(more, "url", fetch, path).count() == 3 and calls.value == 3
    steps = [(lambda u: u.startswith("w"), lambda u: None), (lambda u: True, lambda u: u.upper() if u != "n" else None)]
    got = adapters.page_cascade(spark.createDataFrame([("wx",), ("n",)], "url string"), "url", steps)
    assert {r.url: (r.answer, r.status) for r in got.collect()} == {"wx": ("WX", "ok"), "n": (None, "empty")}
    urls = spark.createDataFrame([("a.org/x",), ("https://b.org",), ("https://c.org",), ("no host",), (None,)], "url string")
    status = spark.createDataFrame([("https://a.org/x", 403), ("https://b.org", 404)], "url string, status int")
    assert {r.url: r.alive for r in adapters.reachable(urls, status).collect()} == {"a.org/x": True, "https://b.org": False, "https://c.org": False, "no host": False}


def test_stream(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    events.run_available(events.once(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select("event_id").distinct().count()
    events.run_available(events.tumbling(stream), str(tmp_path / "w"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "w")).count() >= 1
