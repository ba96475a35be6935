"""Ordered operators over hot keys against loops: range edges, list ranking, composed matchers and as-of joins."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import batches, limits, streams

from shoal.operators import chains, folds, ranges


@pytest.fixture
def parted(spark):
    """Few rows over many range partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def keyed_rows(seed, hot=400, small=30):
    rng = random.Random(seed)
    rows, i = [], 0
    for k, n in [("hot", hot), (None, 40), *((f"k{j}", rng.randrange(1, 6)) for j in range(small))]:
        at = 0
        for _ in range(n):
            at += rng.choice([0, 0, 1, 2, 9])
            rows.append((k, at, i, rng.choice([None, rng.randrange(9)])))
            i += 1
    return rows


def test_positions_and_sums_of_a_hot_key(parted):
    rows = keyed_rows(1)
    df = parted.createDataFrame(rows, "k string, at long, i long, v long").repartition(6)
    got = ranges.scanned(df, "k", ["at", "i"], "pos", {"sum": "v"}).collect()
    want, seen = {}, {}
    for k, _, i, v in rows:
        n, s = seen.get(k, (0, 0))
        want[i] = (n, s)
        seen[k] = (n + 1, s + (v or 0))
    assert {r.i: (r.pos, r["sum"]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("ahead", [False, True])
def test_values_pass_over_range_edges(parted, ahead):
    rng = random.Random(2)
    rows = [(k, at, i, v if rng.random() < 0.05 else None) for k, at, i, v in keyed_rows(2, hot=900)]
    df = parted.createDataFrame(rows, "k string, at long, i long, v long").repartition(6)
    want, last = {}, {}
    for k, _, i, v in rows[::-1] if ahead else rows:
        last[k] = last.get(k) if v is None else v
        want[i] = last[k]
    assert {r.i: r.got for r in ranges.carried(df, "k", ["at", "i"], "v", "got", ahead=ahead).collect()} == want


def test_as_of_joins_take_the_last_change_in_force(parted):
    rng = random.Random(3)
    asked = [(rng.choice(["hot", "hot", "hot", "b", "never", None]), rng.choice([*range(60), None]), i) for i in range(400)]
    changes = [(rng.choice(["hot", "b", None]), rng.choice([*range(60), None]), i, rng.choice([None, rng.randrange(100)])) for i in range(80)]

    def in_force(k, at):
        own = [(a, t, v) for c, a, t, v in changes if c == k and k is not None and a is not None and at is not None and a <= at]
        return max(own, key=lambda x: x[:2])[2] if own else None

    got = ranges.as_of(parted.createDataFrame(asked, "k string, at long, i long"), parted.createDataFrame(changes, "k string, at long, n long, value long"), "k", "at", "value", ["n"])
    assert got.columns == ["k", "at", "i", "value"]
    assert {r.i: r.value for r in got.collect()} == {i: in_force(k, at) for k, at, i in asked}
    none = parted.createDataFrame([], "k string, at long, n long, value long")
    assert {r.value for r in ranges.as_of(parted.createDataFrame(asked, "k string, at long, i long"), none, "k", "at", "value").collect()} == {None}


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_reached_rows_equal_a_walk(parted, block):
    rng = random.Random(block)
    rows, want = [], set()
    for k, n in (("hot", 700), (None, 50), ("one", 1), ("two", 2)):
        nxt = [rng.choice([None if rng.random() < 0.02 else i + rng.choice([1, 1, 2, 5, 40, 300])]) for i in range(n)]
        nxt = [x if x is None or x < n else n for x in nxt]
        rows += [(k, i, x, i * 10) for i, x in enumerate(nxt)]
        at = step = 0
        while at is not None and at < n:
            want.add((k, at, at * 10, step))
            at, step = nxt[at], step + 1
    got = chains.reached(parted.createDataFrame(rows, "k string, pos long, nxt long, extra int").repartition(5), "k", block)
    assert sorted(((r.k, r.pos, r.extra, r.step) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, 5), (2, 16), (3, 1 << 16)])
def test_batches_and_limits_of_hot_keys_equal_the_loop(parted, seed, block):
    data = streams(seed, keys=5)
    data["hot"] = [(a, s) for j, rows in enumerate(streams(seed + 10, keys=25).values()) for a, s in [(x[0] + 1000 * j, x[1]) for x in rows]]
    rows = [(k, a, i, s, "other") for k, each in data.items() for i, (a, s) in enumerate(each)]
    df = parted.createDataFrame(rows, "k string, at long, seq long, size long, pos string").repartition(5)
    got: dict = {}
    for r in sorted(chains.micro_batches(df, "k", ["at", "seq"], "at", "size", 8, 60, block=block).collect(), key=lambda r: (r.k, r.batch_id)):
        assert r.batch_id == len(got.setdefault(r.k, []))
        got[r.k].append((r.opened_at, r.n_chunks, r.size, r.reason))
    assert got == {k: batches(each, 8, 60) for k, each in data.items()}
    accepted: dict = {}
    for r in sorted(chains.rate_limited(df, "k", ["at", "seq"], "at", "size", 50, 10, block=block).collect(), key=lambda r: (r.k, r.at, r.seq)):
        accepted.setdefault(r.k, []).append(r.accepted)
    assert accepted == {k: limits(each, 50, 10) for k, each in data.items()}


def test_keys_go_by_their_size(parted):
    """Large keys by list ranking, small ones and the null key by the fold; together the same as all by the fold."""
    rows = [(k, at, i, (v or 0)) for k, at, i, v in keyed_rows(4)]
    df = parted.createDataFrame(rows, "k string, at long, seq long, size long").repartition(5)
    seen = []
    fold = lambda part: seen.append(("fold", part.select("k").distinct().count())) or folds.micro_batches(part, "k", ["at", "seq"], "at", "size", 8, 20)
    rank = lambda part: seen.append(("rank", part.select("k").distinct().count())) or chains.micro_batches(part, "k", ["at", "seq"], "at", "size", 8, 20, block=50)
    got = Counter(map(tuple, chains.by_size(df, "k", fold, rank, most=100).select("k", "batch_id", "opened_at", "n_chunks", "size", "reason").collect()))
    assert seen == [("fold", 31), ("rank", 1)]
    assert got == Counter(map(tuple, folds.micro_batches(df, "k", ["at", "seq"], "at", "size", 8, 20).collect()))
    assert Counter(map(tuple, chains.by_size(df, "k", fold, rank, most=10_000).collect())) == got and seen[-1] == ("fold", 32)


def test_a_hot_key_is_spread_over_tasks(parted):
    """One key of 200,000 rows: the same batches as the fold, while no task walks through more than a block."""
    df = parted.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 3 + F.col("id") % 7).alias("at"), F.col("id").alias("seq"), (F.col("id") % 11).alias("size"))
    args = ("k", ["at", "seq"], "at", "size", 40, 60)
    fields = ("k", "batch_id", "opened_at", "n_chunks", "size", "reason")
    ranked = chains.micro_batches(df, *args, block=5000).select(*fields)
    assert Counter(map(tuple, ranked.collect())) == Counter(map(tuple, folds.micro_batches(df, *args).select(*fields).collect()))
    assert parted.createDataFrame([], df.schema).transform(lambda e: chains.micro_batches(e, *args)).count() == 0


@pytest.mark.parametrize("wanted", ["abab", "a", "", "aab.", "éa"])
def test_text_is_found_across_chunks(parted, wanted):
    rng = random.Random(len(wanted))
    rows, joined = [], {}
    for k in [None, *(f"k{j}" for j in range(25)), "hot"]:
        for i in range(300 if k == "hot" else rng.randrange(1, 9)):
            t = rng.choice([None, "", *("".join(rng.choice("ab.é") for _ in range(rng.randrange(4))) for _ in range(4))])
            rows.append((k, i, t))
            joined[k] = joined.get(k, "") + (t or "")
    df = parted.createDataFrame(rows, "k string, i long, t string").repartition(5)
    got = [r.k for r in chains.holding(df, "k", ["i"], "t", wanted, fan=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k, t in joined.items() if wanted in t}


def test_offsets_place_chunks(parted):
    rows = [("a", 0, "xy"), ("a", 1, None), ("a", 2, "é"), ("a", 3, ""), ("a", 4, "zzz"), (None, 0, "q")]
    got = chains.offsets(parted.createDataFrame(rows, "k string, i long, t string"), "k", ["i"], "t")
    assert sorted(((r.k or "", r.i, r.start, r.n) for r in got.collect())) == [("", 0, 0, 1), ("a", 0, 0, 2), ("a", 1, 2, 0), ("a", 2, 2, 1), ("a", 3, 3, 0), ("a", 4, 3, 3)]
