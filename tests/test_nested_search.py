"""Nested layouts and searches for many needles against plain versions."""

import json
import random

import pytest

from shoal.operators import search, tree


def drawn(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return {"type": "leaf", "id": rng.choice(["a", "b", 'quo"te', "é\n", "{x}", ""]) + str(rng.randrange(99))}
    return {"type": "split", "direction": rng.choice(["row", "column"]), "children": [drawn(rng, depth - 1), drawn(rng, depth - 1)], "sizes": [rng.choice([0.5, 0.25, 0.1]), rng.choice([0.5, 0.75, 0.9])]}


def walked(node, path="r"):
    if node["type"] == "leaf":
        return [(path, node["id"], None, None, None)]
    own = [(path, None, node["direction"], *node["sizes"])]
    return own + walked(node["children"][0], path + "0") + walked(node["children"][1], path + "1")


def test_random_nested_layouts_come_in_and_out(spark):
    rng = random.Random(9)
    layouts = {f"t{i}": drawn(rng, rng.randrange(7)) for i in range(60)}
    deep = {"type": "leaf", "id": "end"}
    for i in range(120):
        deep = {"type": "split", "direction": "row", "children": [{"type": "leaf", "id": f"p{i}"}, deep], "sizes": [0.5, 0.5]}
    layouts["deep"] = deep
    df = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, (k, v) in enumerate(layouts.items())], "tab string, layout string")
    table = tree.from_nested(df, "tab", "layout")
    got = {}
    for r in table.collect():
        got.setdefault(r.tab, []).append((r.path, r.id, r.direction, r.size0, r.size1))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(walked(v)) for k, v in layouts.items()}
    assert {r.tab: json.loads(r.layout) for r in tree.nested(table).collect()} == layouts
    again = tree.from_nested(tree.nested(table), "tab", "layout")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, table.collect()))


def test_odd_layouts(spark):
    good = '{"type":"leaf","id":"a"}'
    odd = [None, "", "nonsense", "[]", "null", '{"type":"leaf"}', '{"type":"box","id":"x"}', '{"type":"split","children":[' + good + "]}", '{"type":"split","direction":"diagonal","children":[' + good + ',{"type":"no"}]}', '{"type":"leaf","id":7}']
    df = spark.createDataFrame(list(enumerate(odd)), "tab int, layout string")
    got = {(r.tab, r.path, r.id, r.direction, r.size0) for r in tree.from_nested(df, "tab", "layout").collect()}
    assert got == {(8, "r", None, "row", None), (8, "r0", "a", None, None), (9, "r", "7", None, None)}
    assert tree.from_nested(df.where("false"), "tab", "layout").count() == 0


def score(label, needle):
    low, at = label.lower(), 0
    for c in needle.lower():
        at = low.find(c, at) + 1
        if not at:
            return None
    return at - len(needle)


def test_many_needles_find_what_each_finds(spark):
    rng = random.Random(10)
    labels = [(i, "".join(rng.choice("abcdeé_Z ") for _ in range(rng.randrange(9)))) for i in range(300)] + [(900, None), (901, "aaa"), (902, "aaa")]
    needles = ["".join(rng.choice("abceÉz_") for _ in range(rng.randrange(4))) for _ in range(60)] + ["", "q", "aaa", "aaa", None]
    got = search.many_searches(spark.createDataFrame(labels, "n int, name string"), spark.createDataFrame([(x,) for x in needles], "w string"), "name", "n", "w", limit=7, collation="UTF8_BINARY")
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.needle, r.place)):
        found.setdefault(r.needle, []).append((r.place, r.score, r.ordinal))
    for needle in {x for x in needles if x is not None}:
        scored = [(score(t, needle) if needle else 0, t.encode() if needle else b"", i) for i, t in labels if t is not None and score(t, needle) is not None]
        assert found.pop(needle, []) == [(k + 1, s, i) for k, (s, _, i) in enumerate(sorted(scored)[:7])], needle
    assert not found


def best(labels, needles, limit):
    """needle, place, score, ordinal, by scoring all with all."""
    out = []
    for needle in {x for x in needles if x is not None}:
        scored = [(score(t, needle) if needle else 0, t.encode() if needle else b"", i) for i, t in labels if t is not None and score(t, needle) is not None]
        out += [(needle, k + 1, s, i) for k, (s, _, i) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def broadcasts(plan):
    """Rows of each broadcast of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return broadcasts(plan.executedPlan())
    below = [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    return own + [n for p in below for n in broadcasts(p)]


def crowd(rng):
    """Labels of which some occur more often than a search's limit, under ordinals in no order."""
    texts = ["".join(rng.choice("abcdeé_Z ") for _ in range(rng.randrange(9))) for _ in range(150)] + ["ab_c", "aB_c", "", None] * 40
    ordinals = rng.sample(range(5000), len(texts))
    needles = ["".join(rng.choice("abceÉz_") for _ in range(rng.randrange(4))) for _ in range(40)] + ["", "q", "ab", "abc", None]
    return list(zip(ordinals, texts, strict=True)), needles


@pytest.mark.parametrize("most", [search.MOST_BYTES, 0])
def test_many_needles_among_copies(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_BYTES", most)
    labels, needles = crowd(random.Random(11))
    df = search.many_searches(spark.createDataFrame(labels, "n int, name string"), spark.createDataFrame([(x,) for x in needles], "w string"), "name", "n", "w", limit=7, collation="UTF8_BINARY")
    assert sorted((r.needle, r.place, r.score, r.ordinal) for r in df.collect()) == best(labels, needles, 7)


@pytest.mark.parametrize("most", [search.MOST_BYTES, 0])
def test_labels_that_look_small_are_not_broadcast(spark, monkeypatch, tmp_path, most):
    """In its file a table of labels is far smaller than its index, so an estimate from the file must not decide."""
    monkeypatch.setattr(search, "MOST_BYTES", most)
    spark.range(3000).selectExpr("id as n", "concat('label ', id) as name").write.parquet(str(tmp_path / "labels"))
    needles = spark.createDataFrame([("l9",), ("b12",), ("",)], "w string")
    df = search.many_searches(spark.read.parquet(str(tmp_path / "labels")), needles, "name", "n", "w", limit=5)
    assert df.count() == len(df.collect()) == 15
    assert max(broadcasts(df._jdf.queryExecution().executedPlan()), default=0) <= 5
