"""The keyed operators of ``operators.folds`` over Structured Streaming, by transformWithState."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from shoal.functions.config import coerced
from shoal.operators.folds import FLUSH_MS, FLUSH_SIZE, RATE_BYTES, RATE_MS

BATCHES = "key string, batch_id long, opened_at long, n_chunks int, size long, reason string, payload string"
WRITES = "key string, at long, seq long, size long, accepted boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(["at", "seq"], kind="stable") if parts else pd.DataFrame()


#: Milliseconds that a key is remembered after its exit.
KEEP_MS = 3_600_000


class MicroBatcher(StatefulProcessor):
    """Rows (key, at in ms, seq, chunk, is_exit) to batches: an open batch ends when a row comes at or after its
    deadline, its size reaches the limit, or an exit row comes. A quiet key's open batch is ended by a timer of the
    engine's clock, ``patience`` after the trigger that opened it.

    With its exit a key's batch state goes and only a mark stays, for ``keep`` ms of the engine's clock: rows that come
    meanwhile are rejected, and so reported, with their number and texts but without a batch id. Then nothing of the key is
    left, and a row of it would begin a new stream.
    """

    def __init__(self, gap: int = FLUSH_MS, most: int = FLUSH_SIZE, patience: int | None = None, keep: int = KEEP_MS):
        self.gap, self.most, self.patience, self.keep = gap, most, gap if patience is None else patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "batch_id long, opened_at long, n_chunks int, size long, payload string, timer long")
        self.ended = handle.getValueState("ended", "ended boolean", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, opened, n, size, text, timer = self.open.get() if self.open.exists() else (0, None, 0, 0, "", None)
        ended = self.ended.exists()
        out, parts, late, before = [], [text], [], ended

        def close(reason: str) -> None:
            nonlocal batch, opened, n, size, parts
            if opened is not None:
                out.append((key[0], batch, opened, n, size, reason, "".join(parts)))
                batch, opened, n, size, parts = batch + 1, None, 0, 0, []

        for r in ordered(rows).itertuples():
            if ended:
                if not r.is_exit:
                    late.append(r)
                continue
            if opened is not None and r.at >= opened + self.gap:
                close("timer")
            if r.is_exit:
                close("exit")
                ended = True
                continue
            opened = r.at if opened is None else opened
            n, size = n + 1, size + len(r.chunk)
            parts.append(r.chunk)
            if size >= self.most:
                close("size")
        if late:
            out.append((key[0], None, late[0].at, len(late), sum(len(r.chunk) for r in late), "rejected", "".join(r.chunk for r in late)))
        if timer is not None and (opened is None or out):
            self.handle.deleteTimer(timer)
            timer = None
        if opened is not None and timer is None:
            timer = int(timerValues.getCurrentProcessingTimeInMs()) + self.patience
            self.handle.registerTimer(timer)
        if ended and not before:
            self.ended.update((True,))
        if ended:
            self.open.clear()
        else:
            self.open.update((batch, None if opened is None else int(opened), n, size, "".join(parts), timer))
        yield framed(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            batch, opened, n, size, text, timer = self.open.get()
            if opened is not None and timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], batch, opened, n, size, "timer", text))
                self.open.update((batch + 1, None, 0, 0, "", None))
        yield framed(out)

    def close(self) -> None:
        pass


def framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "batch_id", "opened_at", "n_chunks", "size", "reason", "payload"])
    return out.astype({"batch_id": "Int64"})


class RateLimiter(StatefulProcessor):
    """Rows (key, at in ms, seq, size) to decisions; the window is anchored at the first row at or after its end. With a
    column is_exit, an exit row gives no decision, and what comes after a key's exit is rejected for ``keep`` ms, after
    which nothing of the key is left; without ``keep``, for ever."""

    def __init__(self, budget: int = RATE_BYTES, window: int = RATE_MS, keep: int | None = None):
        self.budget, self.window, self.keep = budget, window, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "reset_at long, left long")
        self.ended = handle.getValueState("ended", "ended boolean", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reset, left = self.state.get() if self.state.exists() else (None, 0)
        before = ended = self.ended.exists()
        out = []
        for r in ordered(rows).itertuples():
            if getattr(r, "is_exit", False):
                ended = True
                continue
            if ended:
                out.append((key[0], r.at, r.seq, r.size, False))
                continue
            if reset is None or r.at >= reset:
                reset, left = r.at + self.window, self.budget
            ok = r.size <= left
            left -= r.size if ok else 0
            out.append((key[0], r.at, r.seq, r.size, ok))
        if ended and not before:
            self.ended.update((True,))
        if ended:
            self.state.clear()
        else:
            self.state.update((None if reset is None else int(reset), int(left)))
        yield pd.DataFrame(out, columns=["key", "at", "seq", "size", "accepted"])

    def close(self) -> None:
        pass


class Admission(StatefulProcessor):
    """Rows (key, at in ms, seq, change, session) to decisions: +1 is a create, which is rejected while ``most`` sessions of
    the key live, -1 an end, which is accepted if the session lives. The live ones are a map state of at most ``most``
    entries; a key without any has no state."""

    def __init__(self, most: int = 50):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "session string", "n int")  # how often a session has been created

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = {k[0]: v[0] for k, v in self.live.iterator()}
        before, total, out = dict(live), sum(live.values()), []
        for r in ordered(rows).itertuples():
            if r.change > 0:
                ok = total < self.most
                if ok:
                    live[r.session] = live.get(r.session, 0) + 1
                    total += 1
            else:
                n = live.pop(r.session, 0)
                ok, total = n > 0, total - n
            out.append((key[0], r.at, r.seq, r.change, r.session, ok))
        for k in before.keys() - live.keys():
            self.live.removeKey((k,))
        for k, n in live.items():
            if before.get(k) != n:
                self.live.updateValue((k,), (n,))
        yield pd.DataFrame(out, columns=["key", "at", "seq", "change", "session", "accepted"])

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Rows (key, at in ms, seq, value) to those whose value differs from the one before, over triggers too; a key's first
    row counts as a change, and null is a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r = ordered(rows)
        known = self.last.exists()
        value = r["value"].astype(object).where(r["value"].notna(), None)
        prior = value.shift(1)
        prior.iloc[0] = self.last.get()[0] if known else None
        keep = ~((value == prior) | (value.isna() & prior.isna()))
        keep.iloc[0] = keep.iloc[0] or not known
        if keep.any():
            self.last.update((value.iloc[-1],))
        yield pd.DataFrame({"key": key[0], "at": r["at"], "seq": r["seq"], "value": value})[keep]

    def close(self) -> None:
        pass


class InForce(StatefulProcessor):
    """Rows (key, at in ms, seq, chunk, value, is_change): changes of a key's value and rows that it applies to, each of
    which is given with the value in force at its time. At one time changes come first. A row that comes in a later
    trigger than a change is under it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values(["at", "is_change", "seq"], ascending=[True, False, True], kind="stable")
        value = self.now.get()[0] if self.now.exists() else None
        out = []
        for r in parts.itertuples():
            if r.is_change:
                value = r.value
            else:
                out.append((key[0], r.at, r.seq, r.chunk, value))
        if parts["is_change"].any():
            self.now.update((value,))
        yield pd.DataFrame(out, columns=["key", "at", "seq", "chunk", "value"])

    def close(self) -> None:
        pass


def streamed_batches(chunks: DataFrame, gap: int = FLUSH_MS, most: int = FLUSH_SIZE, patience: int | None = None, keep: int = KEEP_MS) -> DataFrame:
    """A stream of (key, at, seq, chunk, is_exit) as a stream of batches. Needs the RocksDB state store provider."""
    return chunks.groupBy("key").transformWithStateInPandas(MicroBatcher(gap, most, patience, keep), BATCHES, outputMode="Append", timeMode="ProcessingTime")


def streamed_limits(writes: DataFrame, budget: int = RATE_BYTES, window: int = RATE_MS, keep: int | None = None) -> DataFrame:
    """A stream of (key, at, seq, size) with ``accepted``. With ``keep``, ended keys are forgotten after so many ms of the
    engine's clock; such a query, as any with a clock, doesn't end by itself under the trigger availableNow."""
    return writes.groupBy("key").transformWithStateInPandas(RateLimiter(budget, window, keep), WRITES, outputMode="Append", timeMode="None" if keep is None else "ProcessingTime")


def streamed_admission(events: DataFrame, most: int = 50) -> DataFrame:
    """A stream of (key, at, seq, change, session) with ``accepted``, as ``folds.admitted`` decides in batch."""
    rows = events.select("key", "at", "seq", F.col("change").cast("int").alias("change"), F.col("session").cast("string").alias("session"))
    return rows.groupBy("key").transformWithStateInPandas(Admission(most), "key string, at long, seq long, change int, session string, accepted boolean", outputMode="Append", timeMode="None")


def streamed_changes(rows: DataFrame) -> DataFrame:
    """A stream of (key, at, seq, value) without rows that repeat their key's last value."""
    return rows.groupBy("key").transformWithStateInPandas(Changes(), "key string, at long, seq long, value string", outputMode="Append", timeMode="None")


def streamed_in_force(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A stream of (key, at, seq, chunk) with the value of a stream of changes (key, at, seq, value) that holds at each row's
    time, null before the first; in batch that is ``ranges.as_of``."""
    none = F.lit(None).cast("string")
    both = rows.select("key", "at", "seq", "chunk", none.alias("value"), F.lit(False).alias("is_change")).unionByName(changes.select("key", "at", "seq", none.alias("chunk"), "value", F.lit(True).alias("is_change")))
    return both.groupBy("key").transformWithStateInPandas(InForce(), "key string, at long, seq long, chunk string, value string", outputMode="Append", timeMode="None")


def chunk_source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Chunks (output, keystrokes, exits as rows with is_exit) from files as they come, so many a trigger."""
    return spark.readStream.schema("key string, at long, seq long, chunk string, is_exit boolean").option("maxFilesPerTrigger", files).parquet(folder)


def routed_stream(batches: DataFrame, panes: DataFrame, key: str = "key") -> DataFrame:
    """Stream-static join: batches of no pane are dropped."""
    return batches.join(panes, key)


def pushed(batches: DataFrame, folder: str, checkpoint: str, window: str = "window_id") -> DataStreamWriter:
    """A writer that appends each window's batches to its own subfolder. A trigger's rows go to a subfolder of its
    number, which a retry overwrites, so that each batch is there once."""

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("_window", F.col(window)).withColumn("_trigger", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_window", "_trigger").parquet(folder)

    return batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def configured(rows: DataFrame, settings: Callable[[], DataFrame], key: str, sink: Callable[[DataFrame], None]) -> DataStreamWriter:
    """A writer that joins each trigger's rows with the settings as they then are, so that changes reach all consumers."""
    return rows.writeStream.outputMode("append").foreachBatch(lambda part, _: sink(part.join(settings(), key, "left")))


def settings_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Configuration rows (key, at, json) from files as they come, coerced."""
    raw = spark.readStream.schema("key string, at long, json string").parquet(folder)
    return raw.select("key", "at", coerced(F.col("json")).alias("settings"))


def latest_by_trigger(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last value of each key so far; in update mode each trigger emits the keys that changed."""
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value))
