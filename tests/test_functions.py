import math
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import coerce, kernels, text, urls
from loomtrace.operators import attribution, stats


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_bools(spark):
    got = one(spark, [("true",), ("Yes ",), ("0",), ("2",), ("NaN",), (None,), ("f",), ("",)], "x string", coerce.parse_bool(F.col("x")))
    assert [g[0] for g in got] == [True, True, False, True, False, False, False, False]


def test_literal_lists():
    f = coerce.literal_list
    assert f(None) == [] and f("") == [] and f("[]") == []
    assert f('["a"]') == ["a"] and f("['a', None]") == ["a", None] and f('["it\'s"]') == ["it's"] and f("plain") == ["plain"]


def test_literal_list_column(spark):
    got = one(spark, [('["a","b"]',), ("['a', None]",), (None,)], "x string", coerce.as_list(F.col("x")))
    assert [g[0] for g in got] == [["a", "b"], ["a", None], []]


def test_instants(spark):
    got = one(spark, [("1735718418",), ("1735718418000",), ("nan",), ("x",)], "x string", F.unix_seconds(coerce.instant(F.col("x"))))
    assert [g[0] for g in got] == [1735718418, 1735718418, None, None]


def test_judged_json(spark):
    got = one(spark, [('{"a":1}',), ('```json\n{"a":2}\n```',), ("none",), (None,)], "x string", F.try_variant_get(coerce.judged_json(F.col("x")), "$.a", "int"))
    assert [g[0] for g in got] == [1, 2, None, None]


def test_urls(spark):
    rows = [("https://WWW.a.com:8/x",), ("https://www.b.org//?utm_source=chatgpt.com",), ("en.wikipedia.org",), ("https://en.wikipedia.org/w/A/",), (None,)]
    got = one(spark, rows, "u string", urls.domain(F.col("u")), urls.match_key(F.col("u")), urls.plain_domain(urls.domain(F.col("u"))))
    assert got[0][0] == "WWW.a.com:8" and got[0][2] == "a.com:8"
    assert got[1] == ("b.org", "https://www.b.org", "b.org")
    assert got[2][0] == "" and got[3][2] == "wikipedia.org" and got[4] == (None, None, None)


def test_citation_refs(spark):
    marked = "see citeturn0search1turn2news3 end"
    got = one(spark, [(marked,), ("none",), ("",), (None,)], "t string", text.refs_key(text.citation_refs(F.col("t"))))
    assert [g[0] for g in got] == ["0::1;2::3", "", "", None]


def test_chunks():
    m1, m2 = "citeturn0search1", "citeturn1search0"
    got = text.chunks(f"First sentence here. Second one here. {m1} {m2} Tail sentence stands here.")
    assert got[0] == ("First sentence here. Second one here.", [(0, 1), (1, 0)], m1 + m2)
    assert got[1] == ("Tail sentence stands here.", [], "")
    assert text.chunks("") == [] and text.chunks(None) == []
    latest = text.chunks(f"Claim one is here. {m1} Claim two is here. {m1} x", claims_of=text.py_sentences, latest_only=True)
    assert latest == [("Claim two is here.", [(0, 1)], m1 + m1)]


def test_html_text():
    assert text.html_text("<p>a<script>x</script> b</p><style>y</style><div><b>c &amp; d</b></div>") == "a b\nc & d"
    assert text.html_text(None) == "" and text.html_text("") == ""


def test_recent_history(spark):
    got = one(spark, [(["aaaa" * 10, "bbbb" * 2, "cccc"],), (["x" * 100],), ([],), ([None, "dd"],)], "h array<string>", text.recent_within(F.col("h"), 4))
    assert got[0][0] == ["bbbb" * 2, "cccc"] and got[1][0] == ["x" * 16] and got[2][0] == [] and got[3][0] == ["dd"]


def test_bleu_and_f1(spark):
    rows = [("a b c".split(), "a b d".split()), (["x"], ["y"]), ([], ["y"])]
    c, r = F.col("c"), F.col("r")
    got = one(spark, rows, "c array<string>, r array<string>", kernels.unigram_precision(c, r), kernels.unigram_recall(c, r), kernels.bleu(c, r, 1))
    assert got[0] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and got[1] == (0, 0, 0) and got[2] == (0, 0, 0)


def test_lcs_matches_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert kernels.lcs_length(a, b) == t[-1][-1]


def test_fleiss_kappa_textbook(spark):
    counts = [(0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1), (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7)]
    rows = [([str(k) for k, n in enumerate(c) for _ in range(n)],) for c in counts] + [(["1", None],)]
    got = stats.fleiss_kappa(spark.createDataFrame(rows, "l array<string>"), "l").first()
    assert got["items"] == 10 and got["kappa"] == pytest.approx(0.21, abs=0.001)


def test_majority(spark):
    got = dict(tuple(r)[:2] for r in stats.majority(spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "", None])], "i int, l array<string>"), "i", "l").collect())
    assert got == {1: "a", 2: "tie: a|b|c", 3: "a"}


def test_student_t():
    assert stats.student_t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.student_t_two_sided(0.0, 5) == 1.0
    assert math.isclose(stats.student_t_two_sided(12.706, 1), 0.05, abs_tol=1e-4)


def test_paired_t_degenerate(spark):
    d = stats.paired_t(spark.createDataFrame([(1.0, 0.5), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert d["n"] == 1 and d["t"] is None and d["p"] is None


def test_cascade(spark):
    rows = [(1, "u", 1, 1, False), (1, "v", 2, 1, True), (1, "w", 2, 2, True), (2, "u", 1, 1, True), (2, "v", 1, 2, False), (3, "x", 3, 1, False), (1, "v", 3, 9, True)]
    got = {r["k"]: (r["bucket"], r["source"], r["checked"]) for r in attribution.cascade(spark.createDataFrame(rows, "k int, source string, tier int, pos int, entailed boolean"), ["k"]).collect()}
    assert got == {1: ("Other Citations", "v", 2), 2: ("Marked Citations", "u", 2), 3: ("Unexplained", None, 1)}


def test_latest_claims(spark):
    rows = [("a", 1, "r"), ("a", 2, "r"), ("a", 3, ""), ("a", 4, "r"), ("b", 1, "r"), ("b", 2, None)]
    got = sorted((r["s"], r["i"]) for r in attribution.latest_claims(spark.createDataFrame(rows, "s string, i int, refs string"), "s", "i", "refs").collect())
    assert got == [("a", 2), ("a", 4), ("b", 1)]
