"""The streaming operators against the same loops as the batch ones, over a file source."""

import time

from pyspark.sql import functions as F
from test_operators import batches, limits, streams

from shoal.streaming import stateful


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(40)  # one with a clock goes on without data
    q.stop()
    return spark.table(name).collect()


def source(spark, tmp_path, rows, schema, cut):
    """Two files, so that state is carried from one micro-batch to the next."""
    for i, part in enumerate((rows[:cut], rows[cut:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_micro_batches(spark, tmp_path):
    data = streams(4, keys=6)
    first = [(k, a, i, "x" * s, False) for k, rows in data.items() for i, (a, s) in enumerate(rows)]
    last = [(k, rows[-1][0] + 1, 10_000, "", True) for k, rows in data.items()]
    df = source(spark, tmp_path, first + last, "key string, at long, seq long, chunk string, is_exit boolean", len(first))
    got: dict = {}
    for r in sorted(drained(spark, stateful.streamed_batches(df, 8, 60, patience=600_000), "batches"), key=lambda r: (r.key, r.batch_id)):
        assert len(r.payload) == r.size
        got.setdefault(r.key, []).append((r.opened_at, r.n_chunks, r.size, r.reason))
    assert got == {k: batches(rows, 8, 60) for k, rows in data.items()}


def test_rate_limits(spark, tmp_path):
    data = streams(5, keys=6)
    rows = [(k, a, i, s) for k, each in data.items() for i, (a, s) in enumerate(each)]
    rows.sort(key=lambda r: r[1])
    cut = next(i for i, r in enumerate(rows) if r[1] > 60)
    df = source(spark, tmp_path, rows, "key string, at long, seq long, size long", cut)
    got: dict = {}
    for r in sorted(drained(spark, stateful.streamed_limits(df, 50, 10), "limits"), key=lambda r: (r.key, r.at, r.seq)):
        got.setdefault(r.key, []).append(r.accepted)
    assert got == {k: limits(each, 50, 10) for k, each in data.items()}


CHUNKS = "key string, at long, seq long, chunk string, is_exit boolean"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(folder)


def until(holds, seconds=90):
    end = time.time() + seconds
    while not holds() and time.time() < end:
        time.sleep(0.5)
    assert holds()


def test_a_quiet_key_is_flushed_and_an_ended_one_rejects(spark, tmp_path):
    """The last output of a key that stays quiet comes by the clock; after an exit, rows are rejected, ids never repeat."""
    folder = str(tmp_path / "in")
    arrive(spark, folder, [("quiet", 5, 0, "hello", False), ("quiet", 6, 1, " there", False), ("done", 1, 0, "a", False), ("done", 2, 1, "", True), ("done", 3, 2, "late", False)])
    q = stateful.streamed_batches(stateful.chunk_source(spark, folder), 8, 60).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(processingTime="300 milliseconds").start()
    seen = lambda: {(r.key, r.batch_id, r.reason, r.payload) for r in spark.table("flushed").collect()}
    try:
        until(lambda: len(seen()) == 3)
        assert seen() == {("quiet", 0, "timer", "hello there"), ("done", 0, "exit", "a"), ("done", None, "rejected", "late")}
        arrive(spark, folder, [("done", 9, 3, "later", False), ("quiet", 50, 2, "x" * 60, False), ("quiet", 51, 3, "y", False)])
        until(lambda: len(seen()) == 6)
    finally:
        q.stop()
    assert seen() >= {("done", None, "rejected", "later"), ("quiet", 1, "size", "x" * 60), ("quiet", 2, "timer", "y")}


def test_limits_after_an_exit(spark, tmp_path):
    rows = [("k", 1, 0, 5, False), ("k", 2, 1, 0, True), ("k", 3, 2, 1, False), ("m", 1, 0, 99, False), ("k", 9, 3, 1, False)]
    df = source(spark, tmp_path, rows, "key string, at long, seq long, size long, is_exit boolean", 4)
    assert {(r.key, r.seq, r.accepted) for r in drained(spark, stateful.streamed_limits(df, 50, 10), "ended")} == {("k", 0, True), ("k", 2, False), ("m", 0, False), ("k", 3, False)}


def test_pushes_go_to_their_window_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [("a", 1, 0, "x", False), ("b", 1, 0, "y", False), ("nobody", 1, 0, "z", False)])
    arrive(spark, folder, [("a", 2, 1, "w", False)])
    panes = spark.createDataFrame([("a", 1), ("b", 2)], "key string, window_id int")
    routed = stateful.routed_stream(stateful.chunk_source(spark, folder), panes)
    for _ in range(2):  # a restart repeats nothing
        stateful.pushed(routed, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r._window, r.key, r.chunk) for r in got.collect()} == {(1, "a", "x"), (1, "a", "w"), (2, "b", "y")} and got.count() == 3
    assert spark.read.parquet(str(tmp_path / "out" / "_window=2")).count() == 1


def test_settings_reach_consumers_and_the_latest_counts(spark, tmp_path):
    folder, out = str(tmp_path / "settings"), []
    for at, size in ((1, 20), (2, 9999)):
        spark.createDataFrame([("w", at, f'{{"fontSize":{size}}}')], "key string, at long, json string").coalesce(1).write.mode("append").parquet(folder)
    changes = stateful.settings_changes(spark, folder).select("key", "at", F.col("settings.fontSize").alias("size"))
    latest = stateful.latest_by_trigger(changes, "key", "at", "size")
    q = latest.writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.key, r["size"]) for r in spark.table("sizes").collect()] == [("w", 72)]
    chunks = str(tmp_path / "in")
    arrive(spark, chunks, [("w", 1, 0, "x", False), ("v", 1, 0, "y", False)])
    stateful.configured(stateful.chunk_source(spark, chunks), lambda: spark.table("sizes"), "key", lambda df: out.extend(df.select("key", "size").collect())).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.key, r["size"]) for r in out} == {("w", 72), ("v", None)}
