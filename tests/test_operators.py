import random

from pyspark.sql import functions as F

from shoal.operators import folds, lookup, raster, resolve, tree

TREE = "tab string, path string, id string, direction string, size0 double, size1 double"


class Model:
    """A nested model of one layout tree."""

    def __init__(self):
        self.root = "a"

    def rows(self, node=None, path="r"):
        node = self.root if node is None else node
        if isinstance(node, str):
            return [(path, node)]
        return [(path, None), *self.rows(node[0], path + "0"), *self.rows(node[1], path + "1")]

    def change(self, f):
        def walk(n):
            if isinstance(n, str):
                return f(n)
            kept = [x for x in map(walk, n) if x is not None]
            return tuple(kept) if len(kept) == 2 else kept[0] if kept else None

        self.root = walk(self.root)


def test_random_trees_split_and_remove(spark):
    rng, models = random.Random(1), {}
    for t in range(30):
        m = Model()
        for i in range(rng.randrange(0, 9)):
            target = rng.choice([x for _, x in m.rows() if x])
            m.change(lambda n, target=target, i=i: (n, f"n{i}") if n == target else n)
        models[f"t{t}"] = m
    table = spark.createDataFrame([(t, p, i, None if i else "row", None if i else 0.5, None if i else 0.5) for t, m in models.items() for p, i in m.rows()], TREE)
    picks = {t: rng.choice([x for _, x in m.rows() if x] + ["absent"]) for t, m in models.items()}
    edits = spark.createDataFrame([(t, x, "new", "diagonal") for t, x in picks.items()], "tab string, target string, new_id string, direction string")
    got = {(r.tab, r.path, r.id) for r in tree.split_leaves(table, edits).collect()}
    gone = {(r.tab, r.path, r.id) for r in tree.remove_leaves(table, edits).collect()}
    want, want_gone = set(), set()
    for t, m in models.items():
        before = m.root
        m.change(lambda n, t=t: (n, "new") if n == picks[t] else n)
        want |= {(t, p, i) for p, i in m.rows()}
        m.root = before
        m.change(lambda n, t=t: None if n == picks[t] else n)
        want_gone |= {(t, p, i) for p, i in m.rows()} if m.root is not None else set()
    assert got == want
    assert gone == want_gone


def test_resize_and_neighbours(spark):
    t = spark.createDataFrame([("t", "r", None, "row", 0.5, 0.5), ("t", "r0", "a", None, None, None), ("t", "r1", "b", None, None, None)], TREE)
    for ratio, sizes in ((-5.0, (0.1, 0.9)), (99.0, (0.9, 0.1)), (0.25, (0.25, 0.75))):
        e = spark.createDataFrame([("t", "r", ratio), ("t", "r0", 0.3)], "tab string, path string, ratio double")
        out = {r.path: r for r in tree.resize(t, e).collect()}
        assert (out["r"].size0, out["r"].size1) == sizes and out["r0"].size0 is None
    asked = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "x")], "tab string, id string")
    assert {(r.id, r.neighbour) for r in tree.neighbour_of(t, asked).collect()} == {("a", "b"), ("b", "a")}
    assert {r.id for r in tree.contains(t, asked).collect()} == {"a", "b"}
    assert tree.first_leaf(t).first().id == "a"


def batches(rows, gap, most):
    out, state = [], None
    for at, size in rows:
        if state and at >= state[0] + gap:
            out.append((*state, "timer"))
            state = None
        state = (at, 1, size) if state is None else (state[0], state[1] + 1, state[2] + size)
        if state[2] >= most:
            out.append((*state, "size"))
            state = None
    return out + ([(*state, "exit")] if state else [])


def limits(rows, budget, window):
    reset, left, out = None, 0, []
    for at, size in rows:
        if reset is None or at >= reset:
            reset, left = at + window, budget
        out.append(size <= left)
        left -= size if out[-1] else 0
    return out


def streams(seed, keys=20):
    rng, out = random.Random(seed), {}
    for k in range(keys):
        at, rows = 0, []
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice([0, 0, 1, 2, 3, 9, 20])
            rows.append((at, rng.randrange(0, 40)))
        out[f"k{k}"] = rows
    return out


def test_folds_equal_a_loop(spark):
    data = streams(2)
    df = spark.createDataFrame([(k, a, i, s) for k, rows in data.items() for i, (a, s) in enumerate(rows)], "key string, at long, seq long, size long").repartition(3)
    got: dict = {}
    for r in folds.micro_batches(df, "key", ["at", "seq"], "at", "size", 8, 60).orderBy("key", "batch_id").collect():
        got.setdefault(r.key, []).append((r.opened_at, r.n_chunks, r.size, r.reason))
    assert got == {k: batches(rows, 8, 60) for k, rows in data.items()}
    seen: dict = {}
    for r in folds.rate_limited(df, "key", ["at", "seq"], "at", "size", 50, 10).orderBy("key", "at", "seq").collect():
        seen.setdefault(r.key, []).append(r.accepted)
    assert seen == {k: limits(rows, 50, 10) for k, rows in data.items()}
    assert folds.micro_batches(df.where("false"), "key", ["at", "seq"], "at", "size").count() == 0


def test_admission_frees_only_live_sessions(spark):
    log = [(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, -1, "c"), (5, -1, "a"), (6, 1, "d")]
    df = spark.createDataFrame([("w", *r) for r in log], "owner string, at int, change int, session string")
    assert [r.accepted for r in folds.admitted(df, "owner", ["at"], "change", "session", 2).orderBy("at").collect()] == [True, True, False, False, True, True]


def test_lookup_defaults(spark):
    empty, default = spark.createDataFrame([], "x int"), spark.createDataFrame([(7,)], "x int")
    assert [r.x for r in lookup.with_default(empty, default).collect()] == [7]
    assert [r.x for r in lookup.with_default(spark.createDataFrame([(1,)], "x int"), default).collect()] == [1]


def test_resolution(spark):
    cases = [
        ("linux", {}, "/opt/fish", ["/opt/fish", "/bin/bash"], "/opt/fish", ["-l"]),
        ("linux", {}, "/gone", ["/bin/bash"], "/bin/bash", ["-l"]),
        ("linux", {"SHELL": "/bin/zsh"}, None, ["/bin/zsh", "/bin/bash"], "/bin/zsh", ["-l"]),
        ("win32", {"SHELL": "/bin/zsh", "COMSPEC": "C:\\c.exe"}, None, ["/bin/zsh", "C:\\c.exe"], "C:\\c.exe", []),
        ("win32", {"COMSPEC": "C:\\c.exe"}, None, ["C:\\c.exe", "C:\\Windows\\System32\\cmd.exe"], "C:\\Windows\\System32\\cmd.exe", []),
        ("plan9", {}, None, ["/bin/sh"], "/bin/sh", ["-l"]),
        ("darwin", {}, "a\0b", [], "/bin/sh", []),
        ("win32", {}, None, [], "cmd.exe", []),
    ]
    df = spark.createDataFrame(cases, "p string, env map<string,string>, e string, x array<string>, file string, args array<string>")
    for r in df.select(resolve.resolved_program(F.col("p"), F.col("env"), F.col("e"), F.col("x")).alias("got"), "file", "args").collect():
        assert (r.got.file, r.got.args) == (r.file, r.args)
    env = spark.createDataFrame([({"TERM": "dumb", "NODE_OPTIONS": "x", "A": "b"},)], "env map<string,string>").select(resolve.clean_environment(F.col("env"))).first()[0]
    assert env == {"TERM": "xterm-256color", "COLORTERM": "truecolor", "TERM_PROGRAM": "terminal", "A": "b"}


def test_raster(spark):
    px = raster.pixels(spark, 8, 4).select("x", "y", raster.coverage(raster.rounded_box_distance(F.col("x"), F.col("y"), 1, 1, 6, 3, 1)).alias("c")).collect()
    assert len(px) == 32 and {(p.x, p.y): p.c for p in px}[(3.0, 2.0)] == 1.0 and {(p.x, p.y): p.c for p in px}[(7.0, 0.0)] == 0.0
    assert spark.range(1).select(raster.blended(F.lit(10), F.lit(20), F.lit(0.25))).first()[0] == 13


def test_one_burst_of_a_hot_key_takes_linear_time(spark):
    """400,000 rows of one key without a pause: arrays that grow a row at a time would take hours."""
    n = 400_000
    df = spark.range(n).selectExpr("'k' as k", "cast(id div 100 as bigint) as at", "id as seq", "1L as size", "case when id % 3 = 0 then -1 else 1 end as change", "id % 7 as sid")
    made = folds.micro_batches(df, "k", ["at", "seq"], "at", "size", gap=10, most=250)
    assert made.count() == n // 250 and made.agg(F.sum("n_chunks")).first()[0] == n
    assert folds.rate_limited(df, "k", ["at", "seq"], "at", "size", budget=50, window=10).where("accepted").count() == n // 1000 * 50
    assert folds.admitted(df, "k", ["at", "seq"], "change", "sid", most=3).count() == n


def test_folds_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, 1, 5), (None, 2, 2, 5), ("a", 1, 1, 5)], "k string, at long, seq long, size long")
    assert {(r.k, r.n_chunks) for r in folds.micro_batches(df, "k", ["at", "seq"], "at", "size").collect()} == {(None, 2), ("a", 1)}
    assert folds.micro_batches(df.where("false"), "k", ["at", "seq"], "at", "size").count() == 0


def test_a_missing_tree_becomes_a_leaf_and_counts(spark):
    t = spark.createDataFrame([("t", "r", "a", None, None, None)], TREE)
    edits = spark.createDataFrame([("u", "a", "b", "row")], "tab string, target string, new_id string, direction string")
    out = tree.split_leaves(t, edits)
    assert {(r.tab, r.path, r.id) for r in out.collect()} == {("t", "r", "a"), ("u", "r", "b")}
    assert {(r.tab, r.n_leaves, r.many) for r in tree.leaf_counts(out).collect()} == {("t", 1, False), ("u", 1, False)}


def test_keys_are_found_inside_words(spark):
    keys = spark.createDataFrame([("font",), ("size",), ("zz",), ("q",), ("long-key-here",), ("",)], "k string")
    corpus = spark.createDataFrame([("myfontSizes, x",), (None,), ("(long-key-here)=1",)], "t string")
    assert {r.k for r in lookup.unread_keys(keys, corpus, "k", "t").collect()} == {"size", "zz", "q"}


def test_restoring_skips_what_is_gone(spark):
    saved = spark.createDataFrame([("/a",), ("/b",)], "d string")
    default = spark.createDataFrame([("~",)], "d string")
    assert [r.d for r in lookup.restored(saved, spark.createDataFrame([("/b",)], "d string"), "d", default).collect()] == ["/b"]
    assert [r.d for r in lookup.restored(saved, spark.createDataFrame([], "d string"), "d", default).collect()] == ["~"]
    tabs = spark.createDataFrame([(3, "/c"), (1, "/a"), (2, None), (4, "")], "n int, d string")
    assert [r.d for r in lookup.last_directories(tabs, ["n"], "d", 20).collect()] == ["/a", "/c"]
