"""The pipeline's stages one by one against plain versions, each on its own input, row by row."""

import math
from collections import Counter

import pytest
from fixtures import documents, empty, table
from pyspark.sql import functions as F
from test_joins import brute
from test_native import leak_of, water, words

from shoal.llm import language_id, mixing
from shoal.llm.common import saved

pipeline = pytest.importorskip("corpus_pipeline")
ITEM = "river bright stone walk with from which other thing water house over under the of and"


def plain_language(spark, docs, rows):
    langs, grams = language_id.train(docs)
    return [r for r in rows if (got := language_id.identify(langs, grams, [r.text])) and got[0][0] != "und" and got[1][0] >= pipeline.LEAST_SCORE]


def plain_near(rows):
    """One row of each group stays, that of the least id, and one of equal rows."""
    rows = sorted(set(rows), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    root = brute([(i, r.text) for i, r in enumerate(rows)], 5, 80, 100)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i][1], []).append(r)
    return groups


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = f"so {ITEM} on"
    rows = documents() + [(960, leak, "en", "src1", 9, "", "", ""), (None, leak + " and yet more", "en", "src1", 9, "", "", ""), (3, leak + " the same id with another text", "en", "src1", 9, "", "", "")]
    rows += [rows[2], rows[2], (None, rows[2][1], "en", "src9", 9, "", "", ""), (3, "le la les maison sous forêt", "fr", "src0", 9, "", "", "")]
    docs, inputs = table(spark, rows), {}
    for name, stage in pipeline.STAGES:
        inputs[name] = docs.collect()
        out = saved(stage(spark, docs, str(tmp_path)), name)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "language_id":
            assert Counter(out.collect()) == Counter(plain_language(spark, docs, inputs[name]))
        docs = out
    assert list(inputs) == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
    gone = {r.doc_id for r in inputs["language_id"]} - {r.doc_id for r in inputs["ngram_join"]}
    assert {900, 901, 902, 904} <= gone and len(gone) <= 6
    groups, left = plain_near(inputs["ngram_join"]), Counter(inputs["decontamination"])
    assert sum(left.values()) == len(groups) and set(left.values()) == {1}
    for own in groups.values():
        stays = [r for r in own if r in left]
        assert len(stays) == 1 and (stays[0].doc_id is None, stays[0].doc_id) == (own[0].doc_id is None, own[0].doc_id)
    assert Counter(inputs["mixing"]) == Counter(r for r in inputs["decontamination"] if not leak_of(r.text, ITEM))
    assert len(inputs["mixing"]) <= len(inputs["decontamination"]) - 2
    size, taken = Counter(), Counter()
    for r in inputs["mixing"]:
        size[r.source] += len(words(r.text))
    for r in inputs["sharding"]:
        assert r in inputs["mixing"]
        taken[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s))
    target = water(size, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}, 1.5 * sum(size.values()), 2)
    longest = {s: max(len(words(r.text)) for r in inputs["mixing"] if r.source == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in size)
    assert all(n <= 2 * math.ceil(inputs["mixing"].count(r)) for r, n in Counter(inputs["sharding"]).items())
    last = docs.collect()
    assert Counter(r[:8] for r in last) != {} and len(last) == len(inputs["sharding"]) and {r.shard for r in last} <= set(range(16))


def test_stages_of_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        assert saved(stage(spark, empty(spark), str(tmp_path)), name).count() == 0
    names = "_key _times _copy _row row key component_id virtual_slot place size".split()
    rows = [(1, "water house over the river", "en", "a", 5, *names), (2, "water house over the river", "en", "a", 5, *names), (3, f"so {ITEM}", "en", "b", 5, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in pipeline.STAGES[1:]:
        docs = saved(stage(spark, docs, str(tmp_path)), name)
        assert set(names) <= set(docs.columns)
    assert {r.doc_id for r in docs.collect()} == {1}


def test_rows_that_differ_only_in_where_a_null_stands_stay_apart(spark, tmp_path, monkeypatch):
    """Also where the numbers that the join needs collide."""
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    other = lambda i: " ".join(f"{w}{i}" for w in ITEM.split())
    rows = [(7, other(1), None, "en", 5), (7, other(2), "en", None, 5), (None, other(1) + " and more of it", "7", "en", 5), (7, other(2), None, "en", 5), (7, other(3), "e", "n", 5), (7, other(3), "en", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    keys, key = pipeline.keyed(docs)
    assert keys.select(key).distinct().count() == len(rows)
    for hashed in (F.xxhash64, lambda *c: F.lit(1).cast("long") if len(c) == 1 else F.crc32(c[0])):
        monkeypatch.setattr(pipeline.F, "xxhash64", hashed)
        rows2, num = pipeline.numbered(keys, key)
        assert rows2.select(num).distinct().count() == len(rows) and rows2.count() == len(rows)
    monkeypatch.undo()
    whole = spark.createDataFrame([(None, "a b", "x", None, 1), (None, "a b", None, "x", 1)], docs.schema)
    assert Counter(pipeline.once(*pipeline.keyed(whole.union(whole))).drop("_key").collect()) == Counter(whole.collect())
    mixed = Counter(tuple(r) for r in pipeline.mix(spark, docs, str(tmp_path)).collect())
    assert set(mixed) <= set(rows) and len(mixed) >= 3
    assert {tuple(r) for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} <= set(rows)


def test_run_reads_the_tables(spark, sf):
    assert pipeline.run(spark, sf).count() > 100
