import json
import random

import pytest

from loomtrace.operators import shredding as S


def brute(v, path="$", parent="$"):
    out = []
    if isinstance(v, dict):
        for k, x in v.items():
            out += brute(S.as_list(x) if k in S.LIST_FIELDS and x is not None else x, f"{path}.{k}", parent)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            q = f"{path}[{i}]"
            if isinstance(x, dict):
                out.append((q, parent))
            out += brute(x, q, q if isinstance(x, dict) else parent)
    return out


def nodes(text):
    return sorted(x for _, cols in S.records([text], True) for n in cols if n.element is not None for x in S.assemble(n.element))


def random_value(rng, depth=0):
    kind = rng.choice(["dict", "list", "text", "null", "number"] if depth < 4 else ["text", "null", "number"])
    if kind == "dict":
        return {k: random_value(rng, depth + 1) for k in rng.sample(["items", "a", "entries", "b", "thoughts"], rng.randrange(4))}
    if kind == "list":
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"text": rng.choice(["x", "", '[{"a": 1}]', '{"items": [{}]}', "[broken"]), "null": None, "number": 3}[kind]


def test_random_values():
    rng = random.Random(5)
    for _ in range(1500):
        v = [random_value(rng) for _ in range(rng.randrange(4))]
        flat = [x for x in brute(v) if x[0].count("[") == x[0].count("[")]
        got = nodes(json.dumps(v))
        assert sorted(p for p, _ in got) == sorted(p for p, _ in flat)


@pytest.mark.parametrize("text", [None, "", "[{", "NaN", '[{"a": NaN}]', "[] x", "null", "3"])
def test_nothing(text):
    assert nodes(text) == []


def test_special_fields():
    v = [{"metadata": {"search_result_groups": {"entries": '[{"url": "u"}, null, {"url": "w"}]'}}}, None, {"content": {"thoughts": "no json", "parts": ["x", {"a": 1}, None]}}]
    assert nodes(json.dumps(v)) == [
        ("$[0]", "$"),
        ("$[0].metadata.search_result_groups[0]", "$[0]"),
        ("$[0].metadata.search_result_groups[0].entries[0]", "$[0].metadata.search_result_groups[0]"),
        ("$[0].metadata.search_result_groups[0].entries[2]", "$[0].metadata.search_result_groups[0]"),
        ("$[2]", "$"),
        ("$[2].content.parts[1]", "$[2]"),
    ]


def test_tables(spark):
    v = [{"id": "m", "metadata": {"search_result_groups": [{"entries": [{"url": "u", "title": None}, {"url": "w"}]}, {"entries": []}, {"entries": [{"url": "z"}]}]}}]
    d = spark.createDataFrame([(1, json.dumps(v), "x"), (2, None, "x"), (3, "[{", "x")], "row_id long, turn_msgs string, node_path string")
    assert S.node_table(d, "row_id", "turn_msgs").count() == 7
    t = S.leaf_table(S.shredded(d, "row_id", "turn_msgs"), "row_id", "$[].metadata.search_result_groups[].entries[]")
    got = sorted((r.node_path, r.parent_path, r.leaf, r.value) for r in t.collect())
    g = "$[0].metadata.search_result_groups"
    assert got == [(f"{g}[0].entries[0]", f"{g}[0]", "url", "u"), (f"{g}[0].entries[1]", f"{g}[0]", "url", "w"), (f"{g}[2].entries[0]", f"{g}[2]", "url", "z")]
    assert S.node_table(d.limit(0), "row_id", "turn_msgs").count() == 0


def brute_values(v, table="$", node="$", parent=None, name=""):
    """(list path, node path, parent path, leaf, value) straight from the JSON value."""
    if isinstance(v, dict):
        own = [x for k, w in v.items() if w is not None for x in brute_values(S.as_list(w) if k in S.LIST_FIELDS else w, table, node, parent, f"{name}.{k}" if name else k)]
        return own if name or node == "$" or any(x[1] == node and x[3] is not None for x in own) else [*own, (table, node, parent, None, None)]
    if isinstance(v, list):
        step = f".{name}" if name else ""
        return [x for i, w in enumerate(v) if w is not None for x in brute_values(w, f"{table}{step}[]", f"{node}{step}[{i}]", "$" if node == "$" else node)]
    return [(table, node, parent, name, v if isinstance(v, str) else json.dumps(v))]


def test_flat_rows_of_random_values():
    rng = random.Random(6)
    order = lambda x: tuple(str(y) for y in x)
    for _ in range(1500):
        v = [random_value(rng) for _ in range(rng.randrange(4))]
        got = [x for _, columns in S.records([json.dumps(v)], False) for x in S.flat_rows(columns[0])]
        assert sorted(got, key=order) == sorted(brute_values(v), key=order)


def test_flat_tables(spark):
    v = [{"id": "m", "content": {"parts": ["x", None, "y", {"a": 1}]}, "metadata": {"search_model_queries": {"queries": ["q"]}, "search_result_groups": [{"entries": [{"url": "u"}, {}]}]}}]
    d = spark.createDataFrame([(1, json.dumps(v)), (2, None), (3, "[{"), (4, '{"top": true}')], "row_id long, turn_msgs string")
    m, g = "$[].metadata.", "$[0].metadata.search_result_groups[0]"
    want = {
        (1, "$[]", "$[0]", "$", "id", "m"),
        (1, "$[].content.parts[]", "$[0].content.parts[0]", "$[0]", "", "x"),
        (1, "$[].content.parts[]", "$[0].content.parts[2]", "$[0]", "", "y"),
        (1, "$[].content.parts[]", "$[0].content.parts[3]", "$[0]", "a", "1"),
        (1, m + "search_model_queries.queries[]", "$[0].metadata.search_model_queries.queries[0]", "$[0]", "", "q"),
        (1, m + "search_result_groups[]", g, "$[0]", None, None),
        (1, m + "search_result_groups[].entries[]", f"{g}.entries[0]", g, "url", "u"),
        (1, m + "search_result_groups[].entries[]", f"{g}.entries[1]", g, None, None),
        (4, "$", "$", None, "top", "true"),
    }
    flat = [tuple(r) for r in S.flat_tables(d, "row_id", "turn_msgs").collect()]
    assert len(flat) == len(want) and set(flat) == want
    columns = S.shredded(d, "row_id", "turn_msgs").cache()
    for path in {x[1] for x in want} - {"$"}:
        assert {tuple(r) for r in S.leaf_table(columns, "row_id", path).collect()} == {(x[0], *x[2:]) for x in want if x[1] == path and x[4] is not None}
    assert S.flat_tables(d.limit(0), "row_id", "turn_msgs").count() == 0
