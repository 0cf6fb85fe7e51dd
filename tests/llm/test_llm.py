import json
import random

import pytest

from loomtrace.llm import conversations, language, leakage, pairs, pii, queries, reading, subjects, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return lambda n: spark.read.parquet(f"{SF}/{n}.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return language.trained(tables("subject_samples"), tables("documents"), tables("web_data_summary"))


def test_label_spellings():
    assert [language.code_of(x) for x in ("en_GB", " EN ", "Deutsch", "fra", "zh_CN", "und", "??", "", None, "Dutch")] == ["en", "en", "de", "fr", "zh", None, None, None, None, "nl"]


def test_held_out_languages(tables):
    rows = sorted((r.sample_id, r.text, r.lang) for r in tables("subject_samples").collect())
    m = language.fit([(t, c) for i, t, c in rows if i % 3])
    held = [(t, c) for i, t, c in rows if i % 3 == 0]
    right = sum({s[3] for s in language.segments(t, m)} == {c} for t, c in held)
    assert right >= 0.97 * len(held)


def test_segments(model):
    got = [s[3] for s in language.segments("What should I know about knee pain? ¿Hay noticias recientes sobre los antibióticos?", model)]
    assert got == ["en", "es"]
    assert [s[3] for s in language.segments("请给我三个关于国债的可靠来源。 我的名字是 Marisol Wexcombe 。", model)] == ["zh"]
    assert language.segments("404 500", model) == [] and language.segments("", model) == [] and language.segments(None, model) == []


def test_language_frame(spark, model):
    rows = [(1, "fr", ["What should I know about knee pain?"]), (2, "en", ["What should I know about knee pain?"]), (3, None, None), (4, None, []), (5, None, [None]), (6, "", ["???"]), (7, None, ["What should I know about knee pain?"])]
    d = spark.createDataFrame(rows, "row_id long, language string, user_msg_history array<string>").selectExpr("*", "1 as k", "2 as lang")
    assert sorted(map(tuple, language.mislabelled(d, model).collect())) == [(1, 1, "en"), (7, 1, "en")]
    assert language.mislabelled(d.limit(0), model).count() == 0
    assert language.prompt_segments(d, model).filter("confidence between 0 and 1").count() == 3


BEGUN = frozenset({"figures from 9 put", "a practical first step"})


@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("What should I know about knee pain?", None, "empty"),
        ("What should I know about knee pain?", "​ \n", "empty"),
        ("What should I know about knee pain?", "> What should I know about knee pain?", "copy"),
        ("What should I know about knee pain?", "You asked: What should I know about knee pain?", "copy"),
        ("What should I know about knee pain?", "I'm sorry, but I can't help with that.", "refusal"),
        ("Was sollte ich über Knieschmerzen wissen?", "Diese Anfrage kann ich leider nicht beantworten.", "refusal"),
        ("What should I know about knee pain?", "I'm sorry to hear about the trouble; here is what usually helps. Rest the knee for a week.", None),
        ("What should I know about knee pain?", "Rest the knee for a week. Figures from 2019 put", "truncated"),
        ("What should I know about knee pain?", "A prac", "truncated"),
        ("What should I know about knee pain?", "Rest the knee.\n```\ncurl -I https://st", "truncated"),
        ("What should I know about knee pain?", "Rest the knee.\n```\ncurl -I x\n```", None),
        ("What should I know about knee pain?", "Rest the knee.\n- ice\n- rest", None),
        ("What should I know about knee pain?", "About 10 percent", None),
        ("What should I know about knee pain?", "No", None),
        ("What should I know about knee pain?", "Rest the knee. 🙂", None),
        ("What should I know about knee pain?", "Rest the knee. https://a.example/b", None),
        ("What should I know about knee pain?", "No hay una respuesta única, porque depende de dónde vive usted.", "wrong_language"),
        ("Please answer in Spanish: What should I know about knee pain?", "No hay una respuesta única, porque depende de dónde vive usted.", None),
        (None, "Rest the knee.", None),
        ("What should I know about knee pain?", "Rest the knee. Most guides suggest looking at…", "truncated"),
        ("What should I know about knee pain?", "Most guides suggest looking at...", "truncated"),
        ("What should I know about knee pain?", "Do this:\n1. ice\n2. rest\n3.", "truncated"),
        ("What is six times seven?", "42.", None),
    ],
)
def test_pairs(model, prompt, answer, want):
    assert next(pairs.Rules(model, BEGUN).triggered(prompt, answer), None) == want


def test_every_triggered_type(spark, model):
    said = "What should I know about knee pain? Tell me, as I"
    d = spark.createDataFrame([(1, [said, "q"], [said, None])], "row_id long, user_msg_history array<string>, assistant_msg_history array<string>")
    got = sorted(map(tuple, pairs.triggered_pairs(d, model, BEGUN).collect()))
    assert got == [(1, 1, "copy", 1), (1, 1, "truncated", 2), (1, 2, "empty", 1)]
    assert sorted(map(tuple, pairs.defective_pairs(d, model, BEGUN).collect())) == [(1, 1, "copy"), (1, 2, "empty")]


def test_openings_are_those_of_finished_sentences(spark):
    rows = [(1, ["Rest the knee for a week. Rest the knee"]), (2, ["Rest the knee for long! 大多数指南建议先看。"]), (3, ["Rest the knee for fun. Do not"]), (4, None), (5, [None, ""])]
    d = spark.createDataFrame(rows, "row_id long, assistant_msg_history array<string>")
    assert pairs.openings(d) == {"rest the knee for"} and pairs.openings(d.limit(0)) == frozenset()


def test_pairs_of_any_length(model):
    rules = pairs.Rules(model, BEGUN)
    assert list(rules.triggered("什么是国债？", "什么是国债？"))[0] == "copy" and list(rules.triggered("No?", "It depends on the case.")) == []
    refusal = "I'm sorry, but I can't help with that. " * 15
    assert next(rules.triggered("What should I know about knee pain?", refusal.strip())) == "refusal"
    assert "refusal" not in rules.triggered("What should I know about knee pain?", refusal + "Rest the knee for a week.")


def test_fits_on_whole_documents(spark, monkeypatch):
    tail = "The last sentence speaks of a walrus and its long journey home."
    text = "This is a plain sentence about the weather in the north. " * 80 + tail
    assert len(text) > 4_500
    docs = spark.createDataFrame([(1, text, "en", "https://a.example/science-1")], "doc_id long, text string, lang string, url string")
    samples = spark.createDataFrame([(f"What should I know about the weather and the north {i}?", "en", "science") for i in range(5)], "text string, lang string, subject string")
    seen, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda texts, *a: seen.append(texts) or fit(texts, *a))
    language.trained(samples, docs)
    assert any("walrus" in t for t, _ in seen[-1])


def test_confidence_is_calibrated(tables):
    """On beginnings of texts the fit never saw, the confidence is as high as the share of right answers."""
    rows = sorted((r.sample_id, r.text, r.lang) for r in tables("subject_samples").collect())
    texts = [[(t, c) for i, t, c in rows if i % 3 == k] for k in range(3)]
    apart = language.fit(texts[0])
    heat = language.temperature(language.beginnings(texts[1], apart))
    cases = language.beginnings(texts[2], language.fit(texts[0] + texts[1]))
    said = [(language._best(s, n, heat), k) for s, n, k in cases]
    bins: dict[int, list] = {}
    for (best, c), k in said:
        bins.setdefault(min(9, int(c * 10)), []).append((c, best == k))
    error = sum(abs(sum(c for c, _ in b) - sum(ok for _, ok in b)) for b in bins.values()) / len(said)
    assert error < 0.08
    assert language.temperature([]) == 1.0


def test_subject_chain_learns_from_known_sets(spark, tables, monkeypatch):
    seen, fit, calibrate = [], subjects.Chain.fit, subjects.Chain.calibrate
    monkeypatch.setattr(subjects.Chain, "fit", lambda self, e, c, y: seen.append(("fit", y)) or fit(self, e, c, y))
    monkeypatch.setattr(subjects.Chain, "calibrate", lambda self, e, c, y: seen.append(("calibrate", y)) or calibrate(self, e, c, y))
    subjects.trained(tables("subject_areas"), tables("subject_samples"), tables("documents"), tables("web_data_summary"))
    assert [k for k, _ in seen] == ["fit", "calibrate"]
    sizes = {int(n) for _, y in seen for n in y.sum(axis=1)}
    assert {0, 1, 2} <= sizes and len(seen[1][1]) > 0.15 * len(seen[0][1])


def test_stored_models(spark, tmp_path):
    from loomtrace.llm import models

    calls = []
    fit = lambda: calls.append(1) or {"a": 1}
    assert models.fitted(spark, "m", fit) == {"a": 1} and models.fitted(spark, "m", fit) == {"a": 1} and len(calls) == 2
    spark.conf.set(models.FOLDER, str(tmp_path))
    try:
        assert models.fitted(spark, "m", fit) == {"a": 1} == models.fitted(spark, "m", fit) and len(calls) == 3
    finally:
        spark.conf.unset(models.FOLDER)


def test_short_items():
    def held(item, text):
        return leakage.Index([(1, item)]).leaks(text)

    ten = "alder birch cedar drift ember fjord grove heath islet jetty"
    assert held(ten, "we saw alder birch cedar drift ember there") == [1] and held(ten, "then cedar drift ember fjord grove heath and more") == [1]
    assert held(ten, "only alder birch cedar here") == []
    assert held("Alder, birch!", "an ALDER birch tree") == [1] and held("alder birch", "birch alder") == [] and held("walrus", "one walrus") == [1]
    assert held("...", "one walrus") == []


def test_pairs_frame(spark, model):
    rows = [(1, ["q"], None), (2, None, ["a"]), (3, ["What should I know?", "b"], ["Rest the knee for a week."]), (4, [], [])]
    d = spark.createDataFrame(rows, "row_id long, user_msg_history array<string>, assistant_msg_history array<string>")
    assert sorted(map(tuple, pairs.defective_pairs(d, model, pairs.openings(d)).collect())) == [(1, 1, "empty"), (3, 2, "empty")]
    assert pairs.openings(d.limit(0)) == frozenset()


@pytest.mark.parametrize("part", [0, 1])
def test_subjects_held_out(tables, spark, part):
    rows = tables("subject_samples")
    big = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    m = subjects.trained(tables("subject_areas"), rows.filter(f"sample_id % 4 <> {part}"), big("documents"), big("web_data_summary"))
    held = rows.filter(f"sample_id % 4 = {part}").collect()
    got = m.predict([r.text for r in held])
    assert sum(r.subject in g for r, g in zip(held, got)) >= 0.9 * len(held)
    assert sum(map(len, got)) <= 1.1 * len(held)
    both = [(a.subject, b.subject, f"{a.text} {b.text}") for a, b in zip(held[::2], held[1::2]) if a.subject != b.subject]
    got = m.predict([t for _, _, t in both])
    assert sum((a in g) + (b in g) for (a, b, _), g in zip(both, got)) >= 0.75 * 2 * len(both)


def test_subjects_edges(tables, spark):
    rows = tables("subject_samples")
    m = subjects.trained(tables("subject_areas"), rows, tables("documents"), tables("web_data_summary"))
    assert m.predict(["", None, "???"]) == [[], [], []] and m.predict([]) == []
    assert "science" not in m.predict(["Give me three sources about savings accounts. (My cousin, who can only talk of coral bleaching, says hi.)"])[0]
    none = tables("subject_areas").limit(0)
    assert subjects.subject_rows(tables("web_data_summary"), subjects.trained(none, rows, tables("documents"), tables("web_data_summary"))).count() == 0
    bare = subjects.trained(tables("subject_areas"), rows.limit(0), tables("documents").limit(0), tables("web_data_summary").limit(0))
    assert bare.predict(["What about savings accounts?"]) == [[]]


LEX = pii.Lexicon({w: 5.0 for w in ("Ilse", "Otto", "Montevere", "Noor")}, frozenset({"Ormstead", "Port Halden"}))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Send it to noor34@mail.example.net.", [("email", "noor34@mail.example.net")]),
        ("Write to jessopson_ilse (at) example.com please", [("email", "jessopson_ilse (at) example.com")]),
        ("mail zofia.r+chat at mail dot example dot net now", [("email", "zofia.r+chat at mail dot example dot net")]),
        ("Call +44 20 7946 0303 or (202) 555-0126", [("phone", "+44 20 7946 0303"), ("phone", "(202) 555-0126")]),
        ("My number is QQ 53 54 21 A.", [("id_number", "QQ 53 54 21 A")]),
        ("Passport ZX2094152, SSN 929-26-6027", [("id_number", "ZX2094152"), ("id_number", "929-26-6027")]),
        ("home: 541 Old Quarry Street, Ormstead What should I know", [("address", "541 Old Quarry Street, Ormstead")]),
        ("Flat 23, 94 Old Quarry Street, Ormstead ZZ5 9ZZ.", [("address", "Flat 23, 94 Old Quarry Street, Ormstead ZZ5 9ZZ")]),
        ("Vivo en Calle del Olmo Viejo 91, 2º B, 00341 Monteclaro.", [("address", "Calle del Olmo Viejo 91, 2º B, 00341 Monteclaro")]),
        ("J'habite 109 bis avenue des Trois Merles, 00831 Saint-Orlan.", [("address", "109 bis avenue des Trois Merles, 00831 Saint-Orlan")]),
        ("Ich wohne in Ziegelgrabenstraße 119, 00036 Oberhalden.", [("address", "Ziegelgrabenstraße 119, 00036 Oberhalden")]),
        ("Dr. Ilse-Otto B. Montevere said so", [("name", "Ilse-Otto B. Montevere")]),
        ("Me llamo Montevere, Otto.", [("name", "Montevere, Otto")]),
        ("My name is Xaver Unheard, hello", [("name", "Xaver Unheard")]),
        ("Order 4471-2290-17 of 2024-03-24, ISBN 978-0-00-313311-2, server 192.0.2.26, build 10.4.25.225, 1,212.50 at 3 @ 4.20, @lanternpost near Port Halden", []),
    ],
)
def test_pii(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find(text, LEX)] == want


def test_pii_frame(spark):
    rows = [(1, ["mail a.b@c.example", None], '[{"x": "[{\\"y\\": \\"call +44 20 7946 0303\\"}]"}]'), (2, None, "[{"), (3, [], None)]
    d = spark.createDataFrame(rows, "row_id long, user_msg_history array<string>, turn_msgs string")
    assert sorted(map(tuple, pii.findings(d, pii.learn(d)).collect())) == [(1, "turn_msgs", "phone", "+44 20 7946 0303"), (1, "user_msg_history", "email", "a.b@c.example")]
    assert pii.sanitised("write a.b@c.example now", LEX) == "write [EMAIL] now" and pii.sanitised(None, LEX) is None
    assert pii.findings(d.limit(0), pii.learn(d.limit(0))).count() == 0


def test_values_that_begin_with_a_link(spark):
    values = ["https://a.example/b and mail a.b@c.example", "http://a.example，请写信：d@e.example", "msg_ from f@g.example", "https://a.example/b", "msg_12-a"]
    d = spark.createDataFrame([(1, None, json.dumps(values))], "row_id long, user_msg_history array<string>, turn_msgs string")
    assert {r.pii_text for r in pii.findings(d, LEX).collect()} == {"a.b@c.example", "d@e.example", "f@g.example"}
    assert json.loads(pii.sanitised_texts(d, LEX).first().text) == ["https://a.example/b and mail [EMAIL]", "http://a.example，请写信：[EMAIL]", "msg_ from [EMAIL]", *values[3:]]


def test_terms_of_distinct_texts_of_both_fields(spark):
    """A text sent again and again counts once; texts inside turn_msgs count like prompts."""
    cued = [f"My name is Zelmira Quandrel and this is question {w}" for w in ("one", "two", "three")]
    rest = [f"Tell Me About Old Town Hall Number {i} In The Large City Of Rivers And Hills" for i in range(20)]
    rows = [(i, [t], None) for i, t in enumerate(cued + rest)] + [(100 + i, ["Zelmira Quandrel again"], None) for i in range(60)]
    rows += [(200 + i, None, json.dumps([f"My name is Ottoline Varsk and this is question {w}"])) for i, w in enumerate(("one", "two", "three"))]
    d = spark.createDataFrame(rows, "row_id long, user_msg_history array<string>, turn_msgs string")
    assert set(pii.learn(d).bits) == {"Zelmira", "Quandrel", "Ottoline", "Varsk"}
    assert pii.findings(d, pii.learn(d)).filter("row_id between 100 and 159 and pii_text = 'Zelmira Quandrel'").count() == 60


def test_sanitised_both_fields(spark):
    inner = json.dumps([{"note": "call +44 20 7946 0303"}])
    msgs = json.dumps([{"id": "msg_1", "parts": ["Zoë \U0001f642 write a.b@c.example", None, "plain\n"], "items": inner, "n": 1.50}])
    cut = '[{"id":"msg_2","parts":["mail d@e.example or \\u00e9 f@g.example, \\u00'
    rows = [(1, ["mail a.b@c.example", None, ""], msgs), (2, None, cut), (3, [], None), (4, None, "no JSON, h@i.example"), (5, None, "[see] h@i.example")]
    d = spark.createDataFrame(rows, "row_id long, user_msg_history array<string>, turn_msgs string")
    got = {(r.row_id, r.field_name, r.pos): r.text for r in pii.sanitised_texts(d, pii.learn(d)).collect()}
    assert {k[2]: v for k, v in got.items() if k[1] == "user_msg_history"} == {0: "mail [EMAIL]", 1: None, 2: ""}
    back = json.loads(got[1, "turn_msgs", 0])
    assert json.loads(back[0].pop("items")) == [{"note": "call [PHONE]"}]
    assert back == [{"id": "msg_1", "parts": ["Zoë \U0001f642 write [EMAIL]", None, "plain\n"], "n": 1.5}]
    assert got[2, "turn_msgs", 0] == '[{"id":"msg_2","parts":["mail [EMAIL] or \\u00e9 [EMAIL], \\u00'
    assert got[4, "turn_msgs", 0] == "no JSON, [EMAIL]" and got[5, "turn_msgs", 0] == "[see] [EMAIL]" and len(got) == 7
    assert pii.sanitised_texts(d.limit(0), LEX).count() == 0


def test_sanitised_leaves_nothing(spark, tables):
    turns = tables("web_data_summary")
    lex = pii.learn(turns)
    texts = {(r.row_id, r.pos): r.text for r in pii.sanitised_texts(turns, lex).filter("field_name = 'turn_msgs'").collect()}
    for r in turns.filter("turn_msgs is not null").select("row_id", "turn_msgs").collect():
        try:
            before = list(pii.text_values(json.loads(r.turn_msgs)))
        except ValueError:
            continue
        after = list(pii.text_values(json.loads(texts[r.row_id, 0])))
        assert after == [pii.sanitised(v, lex) if pii._worth(v) else v for v in before]
    assert pii.findings(turns, lex).filter("field_name = 'turn_msgs'").count() > 0


def test_conversations_both_ways(tables, spark):
    m = tables("turn_messages")
    small = sorted(map(tuple, conversations.rebuild(m).collect()))
    large = sorted(map(tuple, conversations.rebuild(m, group_rows=15).collect()))
    assert small == large and len(small) > 50
    assert conversations.rebuild(m.limit(0)).count() == 0


def test_sessions_split_at_gaps(spark):
    schema = "msg_row long, conv_id string, msg_id string, parent_id string, child_no int, author_role string, recipient string, content_type string, body string, batch_no int, create_time double, platform string"
    rows, at = [], 1.7e9
    for i in range(400):  # 200 exchanges a minute apart, a pause of a day after the 100th; the last question has no answer
        at += 60 if i != 200 else 86_400
        rows.append((i, "a", f"m{i:03d}", None if i == 0 else f"m{i - 1:03d}", 0, "human" if i % 2 == 0 else "BOT", "all", "text", "x", 1, at * (1000 if i % 7 == 0 else 1) if i % 11 else None, "p"))
    rows += [(400, "b", "1", None, 0, "user", "all", "text", "q", 1, 1.7e9, "p"), (401, "c", "1", None, 0, "user", "all", "text", "q", 1, None, "q"), (402, "c", "2", "1", 0, "bot", "all", "text", "r", 1, None, "q")]
    d = spark.createDataFrame(rows, schema).selectExpr("*", "1 as session", "2 as block")
    got = conversations.sessionise(d, quantile=0.995).collect()
    per = {}
    for r in got:
        per.setdefault((r.conv_id, r.session), []).append((r.pos, r.msg_id, r.speaker))
    assert set(per) == {("a", 0), ("a", 1), ("c", 0)} and len(per["a", 0]) == 200 == len(per["a", 1])
    assert [x[0] for x in sorted(per["a", 0])] == list(range(1, 201)) and sorted(per["c", 0]) == [(1, "1", "user"), (2, "2", "assistant")]
    assert [m for _, m, _ in sorted(per["a", 1])] == [f"m{i:03d}" for i in range(200, 400)]
    assert conversations.sessionise(d.limit(0)).count() == 0


def test_conversation_rules(spark):
    schema = "msg_row long, conv_id string, msg_id string, parent_id string, child_no int, author_role string, recipient string, content_type string, body string, batch_no int"
    rows = [
        (1, "a", "1", "root", 0, "Human", "all", "text", "q", 1), (2, "a", "2", "1", 1, "bot", None, "text", "late", 1), (3, "a", "3", "1", 0, "BOT", None, "text", "r", 1), (4, "a", "3", "1", 0, "bot", None, "text", " ", 0),
        (5, "b", "1", None, 0, "user", "all", "text", "q", 1), (6, "b", "2", "gone", 0, "bot", "all", "text", "r", 1),
        (7, "c", "1", " ", 0, "user", "all", "text", "q", 1), (8, "d", "1", "", 0, "bot", "all", "text", "q", 1), (9, None, "1", "", 0, "bot", "all", "text", "q", 1),
        (10, "e", "1", "", 0, "user", "all", "text", "q", 1), (11, "e", "2", "1", 0, "bot", "web", "code", "x", 1), (12, "e", "3", "2", None, "assistant", "all", "multimodal_text", "r", 1),
    ]
    d = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as speaker", "'y' as m")
    want = [("a", 1, "1", "user"), ("a", 2, "3", "assistant"), ("e", 1, "1", "user"), ("e", 2, "3", "assistant")]
    assert sorted(map(tuple, conversations.rebuild(d).collect())) == want == sorted(map(tuple, conversations.rebuild(d, group_rows=1).collect()))


def test_tokens_match_library(tables, spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = [r.text for r in tables("documents").select("text").collect()] + ["a" * 3000, "中文" * 300, "<|endoftext|>", "ẞß\x00🙂"] + ["".join(rng.choice("ab \n'st9é中") for _ in range(60)) for _ in range(300)]
    got = list(tokens.Encoder(*tokens.default_paths()).encode(texts))
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [list(g) for g in got] == want
    d = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (3, "ab")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as k")
    assert sorted((r.doc_id, len(r.ids)) for r in tokens.encode_corpus(d).collect()) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert tokens.encode_corpus(d.limit(0)).count() == 0


def test_myers_matches_table():
    rng = random.Random(2)
    for _ in range(300):
        p, t = ([rng.randrange(4) for _ in range(n)] for n in (rng.randrange(1, 9), rng.randrange(0, 15)))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert leakage.myers(p, t) == best


def test_leaks(tables, spark):
    items = [(r.item_id, r.text) for r in tables("eval_items").collect()]
    index = leakage.Index(items)
    key, text = items[0]
    w = text.split()
    half = " ".join(w[5 : 5 + len(w) // 2 + 4])
    assert index.leaks("Some words before it. " + half.upper().replace(" ", "\n", 3) + " and after") == [key]
    changed = list(w)
    changed[10] = changed[30] = "other"
    assert index.leaks("<p>" + " ".join(changed) + "</p>") == [key]
    assert index.leaks(" ".join(w[: len(w) // 3])) == [] and index.leaks("") == [] and index.leaks(None) == []
    docs = spark.createDataFrame([(1, text), (2, None), (1, text)], "doc_id long, text string").selectExpr("*", "5 as item_id")
    assert sorted(map(tuple, leakage.leaked(docs, tables("eval_items")).collect())) == [(1, key), (1, key)]
    assert leakage.leaked(docs, tables("eval_items").limit(0)).count() == 0
    real = tables("documents")
    whole = sorted(map(tuple, leakage.leaked(real, tables("eval_items")).collect()))
    assert whole and whole == sorted(map(tuple, leakage.leaked(real, tables("eval_items"), block_chars=5_000).collect()))


def test_reading_held_out(tables, spark):
    docs, samples = tables("documents"), tables("reading_samples")
    held = samples.filter("sample_id % 3 = 0").selectExpr("sample_id as doc_id", "text")
    # the held-out texts are rated with the corpus ranks, as the corpus decides them
    both = docs.select("doc_id", "text").unionByName(held.selectExpr("-doc_id as doc_id", "text"))
    got = {r.doc_id: r.reading_level for r in reading.levels(both, samples.filter("sample_id % 3 > 0")).collect()}
    truth = {-r.sample_id: r.reading_level for r in samples.filter("sample_id % 3 = 0").collect()}
    assert sum(got.get(k) == v for k, v in truth.items()) >= 0.9 * len(truth)
    short = spark.createDataFrame([(1, None), (2, ""), (3, "Too short."), (4, '{"a": 1} ' * 80)], "doc_id long, text string")
    assert reading.levels(short, samples).count() == 0
    assert reading.levels(short, samples.limit(0)).count() == 0


#: What holds for every row of a query without SQL.
RULES = {
    "p1_found": "seg_no >= 1 and lang in ('en', 'de', 'fr', 'es', 'it', 'pt', 'nl', 'ru', 'zh')",
    "p1_segments": "seg_no >= 1 and confidence > 0 and confidence <= 1 and start < `end`",
    "p2_found": "pair_no >= 1 and defect in ('empty', 'copy', 'refusal', 'truncated', 'wrong_language')",
    "p2_triggered": "rank >= 1 and pair_no >= 1",
    "p3_found": "subject is not null",
    "p4_found": "field_name in ('user_msg_history', 'turn_msgs') and pii_type in ('email', 'phone', 'id_number', 'address', 'name') and length(pii_text) > 3",
    "p4_sanitised": "field_name in ('user_msg_history', 'turn_msgs') and pos >= 0",
    "p7_found": "pos >= 1 and speaker in ('user', 'assistant')",
    "p7_sessions": "pos >= 1 and session >= 0 and speaker in ('user', 'assistant')",
    "p8_ids": "ids is not null and forall(ids, x -> x between 0 and 60000)",
    "p9_found": "doc_id is not null and item_id is not null",
    "p10_found": "reading_level between 1 and 4",
}
KEYS = {"p1_found": 2, "p1_segments": None, "p2_found": 2, "p2_triggered": 3, "p3_found": 2, "p4_found": 4, "p4_sanitised": 3, "p7_found": 2, "p7_sessions": 3, "p8_ids": 1, "p9_found": 2, "p10_found": 1}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    got = queries.queries()[name](spark, SF).cache()
    n = got.count()
    assert n > 0 and got.filter(f"not coalesce({RULES[name]}, false)").count() == 0
    if KEYS[name]:
        assert got.select(*got.columns[: KEYS[name]]).distinct().count() == n
    got.unpersist()
