"""Exact dedup, sharding, mixing and decontamination against plain versions, and their plans."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import count, takewhile

import pytest
from fixtures import documents, empty, table, words
from pyspark.sql import functions as F

from shoal.llm import decontamination, exact_dedup, mixing, sharding
from shoal.llm.common import scratch_path


def test_exact_dedup(spark):
    groups = defaultdict(list)
    for r in documents():
        groups[r[1] or ""].append(r[0])
    want = sorted(
        (i is None, i, max((x for x in ids if x is not None), default=None), len(ids), i == max((x for x in ids if x is not None), default=None), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    )
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table(spark)).collect())
    assert got == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_chunks_join_to_the_text(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "x" * 5000, "Ab. " * 700, "é。" * 300 + "\n", "line\n" * 100, "😀" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.t and all(0 < len(c) <= 1024 for c in r.c)


def test_sharding_is_even_gapless_and_edited_in_place(spark):
    maps = lambda: scratch_path(spark, "test-maps")
    rows = Counter((r.doc_id, r.size, r.text_crc32) for r in sharding.shard(table(spark), maps()).collect())
    assert rows == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in documents())
    many = spark.range(5000).selectExpr("id as doc_id", "repeat('a', cast(id % 97 as int)) as text", "'x' as shard")
    at = maps()
    got = sharding.shard(many, at, shards=8).collect()
    loads, slots = defaultdict(int), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # The plain version: largest slots first to the least shard, then of each shard the largest that are above the mean.
    slot = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % sharding.SLOTS
    sizes = dict.fromkeys(range(sharding.SLOTS), 0)
    for i in range(5000):
        sizes[slot(i)] += i % 97 + 1
    load, first = [0] * 8, {}
    for v in sorted(sizes, key=lambda v: (-sizes[v], v)):
        first[v] = load.index(min(load))
        load[first[v]] += sizes[v]
    second, total = dict(first), sum(load)
    for s in range(8):
        moved = 0
        for v in sorted((v for v in first if first[v] == s), key=lambda v: (-sizes[v], v)):
            moved += sizes[v]
            if moved <= load[s] - total / 9:
                second[v] = 8
    assert {(r.doc_id, r.virtual_slot, r.shard, r.next_shard) for r in got} == {(i, slot(i), first[slot(i)], second[slot(i)]) for i in range(5000)}
    for version, want in ((1, first), (2, second), (None, second)):
        assert {r.virtual_slot: r.shard for r in sharding.loaded(spark, at, version).collect()} == want
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sharding.stored(sharding.loaded(spark, at, 1), at)
    third = sharding.rebalanced(sharding.loaded(spark, at), sharding.loaded(spark, at), 9).collect()
    assert all(r.version == 3 and r.shard in (second[r.virtual_slot], 9) for r in third)
    moved = sum(r.bytes for r in third if r.shard == 9)
    assert 0.8 * total / 10 < moved <= total / 10
    assert sharding.shard(empty(spark), maps()).count() == 0
    whole = sharding.assigned(table(spark), maps(), 4)
    assert whole.count() == len(documents()) and whole.schema["shard"].dataType.simpleString() == "int" and len(set(whole.columns)) == len(whole.columns)
    assert sharding.assigned(empty(spark), maps()).count() == 0


def water(sizes, weights, total, most):
    """Shares by weight, what is above a cap dealt out again, until nothing is."""
    target, full = {}, set()
    while True:
        left = total - sum(target[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        for s in sizes:
            if s not in full:
                target[s] = left * weights[s] / w
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
        full |= over


def test_rows_without_ids_are_spread(spark):
    """Half the rows have no id, half of these one text: shards stay as even as slots are, and each row has one place."""
    rows = [(None if i % 2 else i, "same text" if i % 4 == 1 else f"text {i} " * (i % 5), "en", "s", 1, "", "", "") for i in range(20_000)]
    got = sharding.shard(table(spark, rows), scratch_path(spark, "test-maps"), shards=8).collect()
    size, slot = Counter(), Counter()
    for r in got:
        size[r.shard] += r["size"]
        slot[r.virtual_slot] += r["size"]
    assert len(got) == 20_000 and max(size.values()) - min(size.values()) <= max(slot.values())
    assert max(slot.values()) < 4 * sum(slot.values()) / sharding.SLOTS + 200
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))
    whole = sharding.assigned(table(spark, rows), scratch_path(spark, "test-maps"), 8).collect()
    assert Counter(r.shard for r in whole) == Counter(r.shard for r in got) and len(whole) == 20_000


def test_mixing(spark):
    rows = documents()
    got = mixing.mix(table(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table(spark).repartition(2)).collect()))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    target = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    source, taken = {r[0]: r[3] for r in rows}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert mixing.mix(empty(spark)).count() == 0


ITEM = "Tom has 3 apples and gives Anna 2 apples so how many apples does Tom keep in the basket of Anna after lunch"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, "1 2 3 4 5 6 7 8")], "item_id long, text string")
    other = ITEM.replace("Tom", "Bob").replace("Anna", "Mary").replace("3", "7").replace("2", "4")
    mixed = other.replace("keep in the basket of Mary", "keep in the basket of Bob")
    rows = [(1, f"some words here. then {other} done"), (2, f"some words here. then {mixed} done"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9"), (6, f"as {ITEM}."), (7, ITEM[:40] + " other words follow now"), (None, ITEM)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (6, 1), (None, 1)}
    assert got[1, 1].n_changed == got[1, 1].n_slots > 0 and got[6, 1].n_changed == 0
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 7}
    assert decontamination.leaks(empty(spark), bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0


def test_occurrences_are_judged_apart(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    other = ITEM.replace("Tom", "Bob").replace("Anna", "Mary").replace("3", "7").replace("2", "4")
    mixed = other.replace("keep in the basket of Mary", "keep in the basket of Bob")
    altered = ITEM.replace("keep in the basket of Anna", "keep in the basket of Mary")
    rows = [(1, f"so {ITEM} and then {other} end"), (2, f"so {ITEM} and then {mixed} end"), (3, f"so {other} and then {mixed} end"), (4, f"so {mixed} and then {mixed} end"), (5, f"so {altered} end")]
    got = {r.doc_id: r for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3, 5} and got[2].n_changed == 0 and got[5].n_changed == 1


def test_items_of_few_windows_are_found_whole(spark):
    items = ["Yes or no", "12 plus 34 minus 5 is 41", "日本の首都はどこですか", "What colour is grass in spring", "Is 5 kg, 7 kg and 9 kg of 3 m, 4 m or 5 m in Rome", "3 4 5"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    rows = [(i, f"Question: {t}, and on") for i, t in enumerate(items[:2] + ["かな" + items[2] + "はい"] + items[3:], 1)]
    rows += [(11, "yes and or no"), (12, "12 plus 34 minus 5 is 42"), (13, "日本の首都は"), (14, items[4].replace("Rome", "Bonn")), (15, "")]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i) for i in range(1, 6)} | {(12, 2)}  # other figures in a template


def test_templates_in_scripts_without_spaces(spark):
    """Every character is a word there, so other figures and names leave an item's template, other characters don't."""
    ja = "太郎は東京の店でりんごを 3 個と本を 2 冊買いました。全部でいくつありますか"
    zh = "下列关于细胞结构的说法正确的是哪一项并说明 4 个理由"
    th = "กรุงเทพมหานครมีประชากรประมาณ 10 ล้านคนในปีนี้ใช่หรือไม่"
    bench = spark.createDataFrame([(1, ja), (2, zh), (3, th)], "item_id long, text string")
    texts = [ja, ja.replace("3", "7").replace("2", "5"), f"問題{ja}答え", ja.replace("りんごを", "みかんと").replace("東京", "大阪").replace("冊買い", "枚売り"), zh, zh.replace("4", "9"), "下列关于细胞结构的说法正确的是", th.replace("10", "12"), th[: len(th) // 3], ja.replace(" 3 ", "3"), ja[:12] + zh[:12], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 2), (7, 3), (9, 1)}
    assert got[0, 1].n_changed == 0 and got[1, 1].n_changed == 2 and got[9, 1].n_changed == 0
    # The words of a template and of the text are the same places.
    ws = docs.select(decontamination.words(decontamination.template(F.col("text"))).alias("t"), decontamination.words(decontamination.spaced(F.col("text"))).alias("r"))
    assert all(len(r.t) == len(r.r) for r in ws.where("t is not null").collect())


def typed_words(text):
    """The template of a text, word by word."""
    import regex

    out = []
    for w in (text or "").split():
        t = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?!\p{L})", "\x01", w).lower()
        if any(c.isdigit() for c in t):
            t = "\x02"
        m = regex.match(r"(?:%s)(?![\p{L}\p{N}])" % "|".join(decontamination.UNITS), t)
        if m:
            t = "\x03" + t[m.end() :]
        if not regex.search(r"[\p{L}\p{N}\x01-\x03]", t):
            t = "\x04"
        out.append(regex.sub(r"[^\p{L}\p{N}\x01-\x04]", "", t))
    return out


def leak_of(doc, item):
    """Whether a document leaks an item in either form, with its names and in small letters."""
    return leaks_form(doc, item) or leaks_form(doc, (item or "").lower())


def leaks_form(doc, item):
    """Whether a document leaks an item: windows by all places, occurrences by shift, whole items."""
    import regex

    d, b = typed_words(doc), typed_words(item)
    raw_d, raw_b = (doc or "").split(), (item or "").split()
    counted = [i for i in range(len(b) - 4) if sum(not regex.fullmatch("[\x01-\x04]", w) for w in b[i : i + 5]) >= 3]
    bare = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower()
    longest = lambda places: max((sum(1 for _ in takewhile(lambda k: p + k in places, count())) for p in places), default=0)
    shifts = {}
    for i in counted:
        for j in range(len(d) - 4):
            if d[j : j + 5] == b[i : i + 5]:
                shifts.setdefault(j - i, set()).add(i)
    enough = lambda all_of: bool(counted) and (len(set().union(*all_of)) >= 0.8 * len(counted) or max(map(longest, all_of), default=0) + 4 >= 13)
    good = []
    for shift, places in shifts.items():
        if longest(places) + 4 >= 7:
            here = [bare(raw_d[i + shift]) if 0 <= i + shift < len(raw_d) else None for i in range(len(raw_b))]
            own = {i for i in range(len(raw_b)) if here[i] == bare(raw_b[i])}
            images = defaultdict(set)
            for p in {q for p in places for q in range(p, p + 5)}:
                if regex.fullmatch("[\x01-\x03]", b[p]):
                    images[bare(raw_b[p])].add(here[p])
            if any(len(v) > 1 for v in images.values()) and len(own) < 0.8 * len(raw_b) and longest(own) < 13:
                continue
        good.append(places)
    if enough(good):
        return True
    plain = lambda t: regex.sub(r"[^\p{L}\p{M}\p{N}\s]", "", (t or "").lower()).split()
    w, x = plain(item), plain(doc)
    return len(counted) < 5 and any(c.isalpha() for c in item or "") and bool(w) and any(x[i : i + len(w)] == w for i in range(len(x)))


def test_copies_in_one_case_are_found(spark):
    """A copy in capitals or small letters shows no names; one with other names in it is no copy."""
    item = "What is the capital of France and which river runs through the old city of Paris before it meets the Marne near the royal park"
    texts = [item.upper(), item.lower(), f"so {item.upper()} then", item, item.upper().replace("RIVER", "ROAD 7").replace("CAPITAL", "X").replace("OLD CITY", "Y"), "THE CAPITAL OF FRANCE", item.upper().replace("FRANCE", "SPAIN")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item.upper())], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, b in ((1, item), (2, item.upper())) if leak_of(t, b)}
    assert got == want and {(i, 1) for i in range(4)} <= got and not {(4, 1), (5, 1)} & got
    assert {(0, 2), (1, 2), (2, 2)} <= got


def test_leaks_equal_brute_force(spark):
    """Random items and documents of copies, other figures and names, cut and inconsistent ones; repeated and null ids."""
    rng = random.Random(12)
    names, nouns = "Tom Anna Bob Mary Rome Bonn".split(), "apples has gives how many basket lunch keeps and to the of after walks river stone".split()
    word = lambda: rng.choice(rng.choice([nouns, nouns, nouns, names, [str(rng.randrange(30)), "5 kg", "3 m", "-"]]))
    items = [(i % 28, " ".join(word() for _ in range(rng.choice([1, 2, 4, 6, 8, 15, 25, 40])))) for i in range(30)] + [(None, "A null item of many words and two names Tom"), (40, None), (41, "")]

    def other(text):
        to = {w: rng.choice(names) if w in names else str(rng.randrange(99)) for w in text.split() if w in names or w.isdigit()}
        return " ".join(to.get(w, w) if rng.random() < 0.95 else word() for w in text.split())

    docs = []
    for i in range(160):
        parts = [rng.choice(items)[1] or "" for _ in range(rng.randrange(3))]
        parts = [rng.choice([str, other, other, lambda t: " ".join(t.split()[: len(t.split()) * 2 // 3])])(t) for t in parts]
        docs.append((rng.choice([None, i % 60, i]), " ".join(t for p in parts for t in (" ".join(word() for _ in range(rng.randrange(8))), p))))
    docs += [(500, None), (501, ""), docs[0], docs[0]]
    want = {(d, i) for d, t in docs for i, x in items if leak_of(t, x)}
    assert 40 < len(want) and (None in {d for d, _ in want})
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontamination.decontaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (d for d in docs if not any(leak_of(d[1], x) for _, x in items))))


def test_windows_are_those_of_a_loop(spark):
    from pyspark.sql import functions as F

    text = "a b c d e f g a b c d e"
    for width in (1, 2, 3, 5, 8, 13):
        df = spark.createDataFrame([(text,)], "t string").select(F.split("t", " ").alias("w"))
        h = decontamination.windows(df, "w", width).first()["h"]
        w = text.split()
        own = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        assert len(h) == len(own)
        assert all((h[i] == h[j]) == (own[i] == own[j]) for i in range(len(h)) for j in range(len(h)))


def test_native_paths_run_no_python(spark, sf, monkeypatch):
    """Every step of these queries, also those that are written on the way: nothing that needs a Python worker is called."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.group import GroupedData

    from shoal.llm import registry

    def forbidden(*_, **__):
        raise AssertionError("Python on a native path")

    for kind, names in ((DataFrame, ("mapInArrow", "mapInPandas", "toPandas")), (GroupedData, ("applyInArrow", "applyInPandas", "agg_udf"))):
        for name in names:
            monkeypatch.setattr(kind, name, forbidden, raising=False)
    monkeypatch.setattr(DataFrame, "rdd", property(forbidden))
    for name in ("op6_sharding", "op7_mixing", "op8_decontamination", "op9_exact_dedup"):
        df = registry.QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and df.count() > 0
