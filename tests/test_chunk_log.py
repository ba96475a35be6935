"""The log source, the committed sink and the newer stateful operators, each over restarts."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from shoal.operators import folds, lookup
from shoal.sources import chunk_log, listing
from shoal.streaming import stateful


def line(key, at, seq, chunk="", is_exit=False):
    return json.dumps({"key": key, "at": at, "seq": seq, "chunk": chunk, "is_exit": is_exit})


def append(folder, name, text):
    folder.mkdir(exist_ok=True)
    with (folder / name).open("a", newline="") as f:
        f.write(text)


def run(df, check, sink, out, **options):
    q = df.writeStream.format(sink).option("checkpointLocation", str(check)).option("path", str(out)).options(**options).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_a_log_is_read_once_over_restarts(spark, tmp_path, piece):
    """Files grow between restarts, lines end later than they begin, pieces are cut inside lines and characters."""
    log, want = tmp_path / "log", []
    for step in range(3):
        for name in ("a.jsonl", "b.jsonl") if step else ("a.jsonl",):
            for i in range(5):
                want.append((f"{name}{step}", i))
                append(log, name, line(f"{name}{step}", 1, i, "é\n" * i) + "\n")
        if step == 0:
            append(log, "a.jsonl", line("late", 1, 0)[:9])
        if step == 1:
            append(log, "a.jsonl", "")
        df = chunk_log.chunk_log(spark, str(log), piece)
        run(df, tmp_path / "check", "parquet", tmp_path / "out")
        if step == 0:  # the line that had only begun
            assert spark.read.parquet(str(tmp_path / "out")).count() == 5
            append(log, "a.jsonl", line("late", 1, 0)[9:] + "\r\n\n")
            want.append(("late", 0))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.key, r.seq) for r in got.collect()) == sorted(want)
    assert {r.seq: r.chunk for r in got.where("key = 'b.jsonl2'").collect()} == {i: "é\n" * i for i in range(5)}
    assert spark.read.format("chunk_log").option("path", str(log)).option("pieceBytes", piece).load().count() == len(want)


def test_lines_that_are_no_chunks_come_without_a_key(spark, tmp_path):
    append(tmp_path / "log", "a.jsonl", "nonsense\n[1]\n" + '{"key": 1, "at": 2, "seq": 3}\n{"key": "k", "at": 99999999999999999999, "seq": 1}\n' + line("k", 1, 2, "x") + "\n")
    spark.dataSource.register(chunk_log.ChunkLog)
    got = spark.read.format("chunk_log").option("path", str(tmp_path / "log")).load().collect()
    assert [(r.key, r.chunk) for r in got if r.key] == [("k", "x")] and sum(r.key is None for r in got) == 4


def test_a_log_may_not_shrink(spark, tmp_path):
    append(tmp_path / "log", "a.jsonl", line("k", 1, 1) + "\n" + line("k", 1, 2) + "\n")
    run(chunk_log.chunk_log(spark, str(tmp_path / "log")), tmp_path / "check", "parquet", tmp_path / "out")
    (tmp_path / "log" / "a.jsonl").write_text(line("k", 1, 1) + "\n")
    with pytest.raises(Exception, match="logs may only grow"):
        run(chunk_log.chunk_log(spark, str(tmp_path / "log")), tmp_path / "check", "parquet", tmp_path / "out")


def test_a_failed_trigger_leaves_nothing_and_a_retry_each_row_once(spark, tmp_path):
    log, out, check, flag = tmp_path / "log", tmp_path / "out", tmp_path / "check", tmp_path / "fixed"
    schema = "key string, at long, seq long, chunk string, is_exit boolean"
    for k in range(8):
        append(log, f"{k}.jsonl", "".join(line(f"k{k % 3}", 1, 10 * k + i, "x") + "\n" for i in range(10)))

    @F.udf("string")
    def checked(key, seq):
        if seq == 57 and not os.path.exists(flag):
            time.sleep(3)  # other tasks have written by then
            raise ValueError("broken row")
        return key

    df = chunk_log.chunk_log(spark, str(log)).withColumn("key", checked("key", "seq"))
    with pytest.raises(Exception, match="broken row"):
        run(df, check, "chunk_log", out, by="key")
    assert chunk_log.committed(spark, str(out), schema).count() == 0
    assert not list(out.rglob("*.parquet"))  # what other tasks wrote was taken back
    flag.touch()
    run(df, check, "chunk_log", out, by="key")
    got = chunk_log.committed(spark, str(out), schema)
    assert sorted(r.seq for r in got.collect()) == list(range(80))
    assert {(p.parent.name) for p in out.rglob("*.parquet")} == {"key=k0", "key=k1", "key=k2"}
    # the query ends after the sink's commit and before its own: the trigger runs again
    for f in (check / "commits").iterdir():
        f.unlink()
    files = sorted(out.rglob("*.parquet"))
    run(df, check, "chunk_log", out, by="key")
    assert sorted(out.rglob("*.parquet")) == files and chunk_log.committed(spark, str(out), schema).count() == 80
    append(log, "9.jsonl", line("new", 1, 99) + "\n")
    run(df, check, "chunk_log", out, by="key")
    assert chunk_log.committed(spark, str(out), schema).count() == 81


def restarted(spark, tmp_path, rows, schema, build, cuts, name):
    """``build`` of the rows, which come in parts, each read by a query that starts anew from the checkpoint."""
    folder = str(tmp_path / f"in-{name}")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        run(build(spark.readStream.schema(schema).parquet(folder)), tmp_path / f"check-{name}", "parquet", tmp_path / name)
    return spark.read.parquet(str(tmp_path / name))


def test_admission_over_restarts_equals_the_fold(spark, tmp_path):
    rng, rows = random.Random(6), []
    for i in range(300):
        rows.append((rng.choice(["w1", "w2", "w3"]), i // 3, i, rng.choice([1, 1, 1, -1]), f"s{rng.randrange(9)}"))
    schema = "key string, at long, seq long, change int, session string"
    got = restarted(spark, tmp_path, rows, schema, lambda df: stateful.streamed_admission(df, 5), [90, 201], "admitted")
    want = folds.admitted(spark.createDataFrame(rows, schema), "key", ["at", "seq"], "change", "session", most=5)
    pick = lambda df: sorted((r.seq, r.accepted) for r in df.collect())
    assert pick(got) == pick(want) and {a for _, a in pick(got)} == {True, False}


def test_no_value_repeats_over_triggers(spark, tmp_path):
    rng, rows, last, want = random.Random(7), [], {}, []
    for i in range(120):
        k, v = rng.choice("abc"), rng.choice(["/x", "/x", "/y", None])
        rows.append((k, i, i, v))
        if k not in last or last[k] != v:
            want.append(i)
        last[k] = v
    got = restarted(spark, tmp_path, rows, "key string, at long, seq long, value string", stateful.streamed_changes, [7, 8, 60], "changes")
    assert sorted(r.seq for r in got.collect()) == want


def test_settings_in_force_at_each_rows_time(spark, tmp_path):
    """Inside a trigger by time, a later trigger under what came before; over a restart."""
    folder, sets = str(tmp_path / "rows"), str(tmp_path / "sets")
    row, change = "key string, at long, seq long, chunk string", "key string, at long, seq long, value string"
    for part in (([("w", 1, 0, "a"), ("w", 5, 1, "b"), ("w", 9, 2, "c"), ("v", 9, 0, "d")], [("w", 5, 0, "small"), ("w", 7, 1, "big")]), ([("w", 20, 3, "e"), ("w", 31, 4, "f")], [("w", 30, 2, None)])):
        for rows, schema, to in zip(part, (row, change), (folder, sets), strict=True):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(to)
        both = stateful.streamed_in_force(spark.readStream.schema(row).parquet(folder), spark.readStream.schema(change).parquet(sets))
        run(both, tmp_path / "check", "parquet", tmp_path / "out")
    assert {(r.key, r.chunk): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("w", "a"): None, ("w", "b"): "small", ("w", "c"): "big", ("v", "d"): None, ("w", "e"): "big", ("w", "f"): None}


@pytest.mark.parametrize("what", ["batches", "limits"])
def test_ended_keys_leave_no_state(spark, tmp_path, what):
    """Rows soon after an exit are rejected; after the stated time no row of state is left."""
    folder, name = str(tmp_path / "in"), f"ended_{what}"
    schema = "key string, at long, seq long, chunk string, size long, is_exit boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([("k", 1, 0, "a", 5, False), ("k", 2, 1, "", 0, True), ("m", 1, 0, "b", 5, False), ("m", 3, 1, "", 0, True)])
    df = spark.readStream.schema(schema).parquet(folder)
    out = stateful.streamed_batches(df.drop("size"), 8, 60, keep=12_000) if what == "batches" else stateful.streamed_limits(df.drop("chunk"), 50, 10, keep=12_000)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    state = lambda: [op["numRowsTotal"] for p in q.recentProgress[-1:] for op in p["stateOperators"]]
    until = lambda holds, s: next((True for _ in range(2 * s) if holds() or time.sleep(0.5)), False)
    try:
        assert until(lambda: spark.table(name).count() == 2, 90)
        assert until(lambda: state() and state()[0] > 0, 20)
        put([("k", 5, 2, "late", 1, False)])
        assert until(lambda: spark.table(name).count() == 3, 11)
        late = spark.table(name).where("key = 'k'").collect()
        assert sum(r.reason == "rejected" if what == "batches" else not r.accepted for r in late) == 1
        assert until(lambda: state() == [0], 60)
    finally:
        q.stop()


def test_candidates_resolve_against_a_real_folder(spark, tmp_path):
    (tmp_path / "bin" / "deep").mkdir(parents=True)
    for f in ("bin/zsh", "bin/deep/a b", "bin/fish"):
        (tmp_path / f).write_text("x" * len(f))
    files = listing.listed(spark, str(tmp_path / "bin"))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    root = str(tmp_path)
    cases = spark.createDataFrame([(1, 1, f"{root}/bin/bash"), (1, 2, f"{root}/bin/zsh"), (1, 3, f"{root}/bin/fish"), (2, 1, f"{root}/none"), (3, 1, f"{root}/bin/deep/a b")], "case int, priority int, path string")
    got = {r["case"]: (r.resolved, r.validated) for r in lookup.first_existing(cases, files, "case", "priority", "path", "/bin/sh").collect()}
    assert got == {1: (f"{root}/bin/zsh", True), 2: ("/bin/sh", False), 3: (f"{root}/bin/deep/a b", True)}
