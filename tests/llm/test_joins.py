"""The n-gram join and line dedup against brute force."""

import random

import numpy as np
import pytest
from fixtures import documents, empty, shingles, table

from shoal.llm import line_dedup, ngram_join


def rooted(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        sets[d] = shingles(t, k)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), root) for d, root in rooted(ids, links).items()}


def near_copies(seed):
    """Families around the threshold, of all sizes, that share a passage."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(24):
        n = rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 60, 150])
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(rng.choice([1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, n // 40, n // 25])):
                w[rng.randrange(n)] = f"w{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(w + passage * (rng.random() < 0.3))))
    return rows


@pytest.mark.parametrize(("k", "num", "common"), [(4, 85, 32), (5, 80, 2)])
def test_components(spark, monkeypatch, k, num, common):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = near_copies(3)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, k, num, 100)


def test_components_of_odd_rows(spark):
    got = ngram_join.ngram_join(table(spark), 4, 85, 100).collect()
    want = brute([(r[0], r[1]) for r in documents() if r[0] is not None], 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(documents()) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, what = rng.randrange(len(s) + 1), rng.random()
        if what < 0.33 or not s:
            s.insert(i, rng.choice("abc"))
        elif what < 0.66:
            del s[min(i, len(s) - 1)]
        else:
            s[min(i, len(s) - 1)] = rng.choice("abc")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_banded_distance_and_signatures(edits):
    rng = random.Random(edits)
    pairs = [(a, changed(rng, a, rng.randrange(6))) for a in ("".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(600))]
    pairs += [("", ""), ("a", ""), ("", "abcdef")]
    assert (line_dedup.within_edits(pairs, edits) == np.array([distance(*p) <= edits for p in pairs])).all()
    for _ in range(400):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randrange(14, 40)))
        short, long = sorted((a, changed(rng, a, edits)), key=len)
        if len(short) >= 12:
            assert set(line_dedup.signatures(short, False, edits, 12)) & set(line_dedup.signatures(long, True, edits, 12))


def test_distance_of_long_lines_follows_diagonals():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        b = changed(rng, a, rng.randrange(5))
        for edits in (1, 2, 3):
            assert line_dedup.followed(a, b, edits) == (distance(a, b) <= edits), (a, b, edits)
    a = "".join(rng.choice("abcd ") for _ in range(1_000_000))
    far = "x" + a[1:500_000] + a[500_001:]
    assert list(line_dedup.near([(a, far), (a, "y" + far[:-1]), ("", "a"), ("ab" * 40, "ab" * 39 + "b")], 2)) == [True, False, True, True]


def test_sketches_allow_for_every_near_pair():
    rng = random.Random(8)
    for _ in range(500):
        a = "".join(rng.choice("abcdefgh éß") for _ in range(rng.randrange(15, 60)))
        x, y = line_dedup.sketches([a, changed(rng, a, 2)])
        differ = int(x ^ y) & (2**64 - 1)
        assert (differ & (2**24 - 1)).bit_count() <= 4 and (differ >> 24).bit_count() <= 8


def brute_lines(rows, th):
    """What each row loses, as a multiset of (id, lines, dropped), by comparing all lines with all."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, th[rows[i][1]]))
    lines = [(i, n, x) for i in order if rows[i][1] for n, x in enumerate(rows[i][1].split("\n")) if x]
    texts = sorted({x for _, _, x in lines})
    near = lambda a, b: distance(a, b) <= min(2, min(len(a), len(b)) // 15)
    root = rooted(range(len(texts)), [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if abs(len(a) - len(b)) <= 2 and near(a, b)])
    at, first, gone = {x: root[i] for i, x in enumerate(texts)}, {}, {}
    for i, n, x in lines:
        if first.setdefault(at[x], (i, n)) != (i, n):
            gone.setdefault(i, []).append(n)
    return [(d, 0 if t is None else t.count("\n") + 1, tuple(gone.get(i, ()))) for i, (d, t) in enumerate(rows)]


def test_line_dedup(spark, tmp_path):
    """Lines of 1 to 60 characters, repeated and null ids, equal rows, one long line twice; through the query."""
    from pyspark.sql import functions as F

    from shoal.llm import registry

    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in [*range(1, 32), 45, 60] * 2]
    rows = [(rng.randrange(60), "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(6)))) for _ in range(90)]
    rows += [(900, None), (901, ""), (902, "\n\nLes.\n"), (903, "Les.\nLes."), (None, base[0] + "\n" + base[40]), (None, base[0] + "\n" + base[40]), rows[0], rows[0], (2, "boilerplate line of some length here"), (2, "a line that only this row has, and it stays")]
    schema = "doc_id long, text string, dropped string, th string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(3)
    th = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = brute_lines(rows, th)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_lines, tuple(r.dropped)) for r in got))) == sorted(map(str, want))
    assert sum(r.n_near for r in got) > 0 and all(r.n_dropped == len(r.dropped) for r in got)
    out = [(r.doc_id, r.text) for r in line_dedup.deduplicated(df).collect()]
    kept = [(d, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)) for (d, t), (_, _, gone) in zip(rows, want, strict=True)]
    assert sorted(map(str, out)) == sorted(map(str, kept)) and line_dedup.deduplicated(df).columns == df.columns
    assert line_dedup.line_dedup(empty(spark)).count() == 0 and line_dedup.deduplicated(empty(spark)).count() == 0


def test_line_dedup_by_pieces(spark, tmp_path, monkeypatch):
    """Every segment and piece counts as shared by many, so that all levels are used; the result stays."""
    monkeypatch.setattr(line_dedup, "MANY", 1)
    test_line_dedup(spark, tmp_path)


def test_pieces_hold_for_every_near_pair():
    """A line within the edits has, by segment and two pieces, a way that it shares with the other."""
    rng = random.Random(12)
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(15, 70)))
        b = changed(rng, a, rng.randrange(3))
        x, y = sorted((a, b), key=len)
        most = line_dedup.allowed(len(x))
        if not most or distance(x, y) > most:
            continue
        ways = [{(h, (t & (1 << 40) - 1, t >> 40)) for h, t in line_dedup.tagged(z, z is y)} for z in (x, y)] if x is not y else []
        for _ in range(4):
            if not ways:
                break
            assert ways[0] & ways[1], (x, y)
            both = ways[0] & ways[1]
            ways = [{(h, (*w, j)) for sig, w in both for h, j in line_dedup.continued(z, sig, w[0], w[1:], probe, most)} for z, probe in ((x, False), (y, True))]


def test_comparisons_grow_with_the_lines_of_a_hot_segment(spark, monkeypatch):
    """Lines that share their first part and differ elsewhere: the pieces asked for and the lines that meet, sketches left aside, don't grow as squares."""
    from pyspark.sql import functions as F

    from shoal.llm.common import ship

    ship(spark)
    rng, met, kept = random.Random(5), {}, line_dedup.saved
    monkeypatch.setattr(line_dedup, "MANY", 20)
    monkeypatch.setattr(line_dedup, "alike", lambda a, b, edits: F.lit(True))

    def counted(df, name):
        out = kept(df, name)
        if name in ("lines-met", "line-pieces"):
            met[n] = met.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "saved", counted)
    lines = ["All rights are reserved " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(4000)]
    for n in (1000, 4000):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines[:n])], "doc_id long, text string")
        assert line_dedup.near_links(df).count() == 0
    assert 0 < met[4000] < 6 * met[1000] and met[4000] < 4000 * 100, met


def test_line_dedup_of_a_long_line(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcd ") for _ in range(1_000_000))
    rows = [(1, a), (2, "x" + a[:-1]), (3, a[:600_000]), (4, "one\n" + a + "x")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.dropped) for r in got} == {1: [], 2: [0], 3: [], 4: [1]}


def test_lines_are_signed_together(monkeypatch):
    """The rows of many lines are those of each by itself, are told apart by tag and substring alone, and take a few calls a
    line, not one a signature."""
    import cProfile
    import pstats

    import pyarrow as pa

    rng = random.Random(3)
    lines = ["".join(rng.choice("abc é\U0001f600\0") for _ in range(rng.randrange(90))) for _ in range(500)] + ["", "-" * 80, "ab" * 40, "-" * 80]
    for block in (64, line_dedup.BLOCK):  # sums run over blocks' edges
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        for probe, (of, sig, tag) in zip((False, True), line_dedup.signed(lines, (False, True)), strict=True):
            meant = {}
            for i, line in enumerate(lines):
                want = {(t, line[s:e]) for t, s, e in line_dedup.plan(len(line), probe, 2, 30).T.tolist()}
                got = sorted(zip(sig[of == i].tolist(), tag[of == i].tolist(), strict=True))
                assert len(got) == len(set(got)) == len(want) and got == sorted(line_dedup.tagged(line, probe))
                by_sig = dict(got)
                for t, sub in want:
                    assert meant.setdefault((t, sub), {h for h, g in by_sig.items() if g == t}) & {h for h, g in by_sig.items() if g == t}
            assert len(set(sig.tolist())) == len({(t, x[s:e]) for x in lines for t, s, e in line_dedup.plan(len(x), probe, 2, 30).T.tolist()})
    batch = pa.record_batch([pa.array(range(2000), pa.int64()), pa.array(["".join(rng.choice("abcdef ") for _ in range(60)) for _ in range(2000)])], names=["k1", "line"])
    with cProfile.Profile() as seen:
        rows = pa.Table.from_batches(line_dedup._signature_rows(2, 30)([batch])).to_pylist()
    assert pstats.Stats(seen).total_calls < 10 * len(rows) < sum(len(r[c]) for r in rows for c in line_dedup.SETS)
    for r, line in zip(rows, batch["line"].to_pylist(), strict=True):
        for side, probe in (("own", False), ("look", True)):
            assert sorted(x % 2**64 for no in range(line_dedup.PASSES) for x in r[f"{side}{no}"]) == sorted(line_dedup.signatures(line, probe))
            assert all(x % 2**64 % line_dedup.PASSES == no for no in range(line_dedup.PASSES) for x in r[f"{side}{no}"])
