"""Micro-batches and rate windows of hot keys by list ranking: no key is read by one task.

Where a batch that starts at a row would end follows from times and running sums alone, so each row has a next start.
The batches of a key are the starts that are reached from its first row. Rows are cut into blocks of places: within a
block, each row's way out is found in one pass; ways out land on few rows, over which pointers are doubled; then each
block knows where it is entered and marks its starts in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators import folds, ranges
from shoal.operators.folds import FLUSH_MS, FLUSH_SIZE, RATE_BYTES, RATE_MS
from shoal.stored import released, saved

#: Rows of a key that one task walks through at a time, and whose ways out it holds.
BLOCK = 1 << 16


def matched(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on columns of ``a`` that may be null; ``b``'s ones are dropped."""
    other = b.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in b.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return a.join(other, same, how).drop(*[f"_on_{c}" for c in on])


def ways_out(nodes: DataFrame, key: str, block: int) -> DataFrame:
    """key, pos, out: the first place beyond its block that each row leads to, null if its way ends before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            out = []
            for k, at, pos, nxt in zip(*(b[i].to_pylist() for i in range(4)), strict=True):
                if (k, at) != now:
                    now, held = (k, at), {}
                held[pos] = nxt if nxt is None or nxt // block != at else held.get(nxt)
                out.append(held[pos])
            yield pa.record_batch([b[0], b[2], pa.array(out, pa.int64())], names=[key, "pos", "out"])

    kind = nodes.schema[key].dataType.simpleString()
    rows = nodes.select(key, F.floor(F.col("pos") / block).alias("_block"), "pos", "nxt")
    return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", F.desc("pos")).mapInArrow(run, f"{key} {kind}, pos long, out long")


def entries(nodes: DataFrame, key: str, block: int) -> DataFrame:
    """key, pos: where the way from each key's place 0 enters blocks, by doubling pointers over the rows that ways out
    lead to. Rounds: the logarithm of the blocks of the longest key."""
    out = saved(ways_out(nodes, key, block), "ways-out")
    far = out.where("out is not null")
    landed = far.select(key, F.col("out").alias("pos")).distinct()
    starts = saved(out.where("pos = 0").select(key, "pos"), "reached")
    jumps = saved(matched(far, landed.union(far.where("pos = 0").select(key, "pos")), [key, "pos"], "left_semi"), "jumps")
    while not jumps.isEmpty():
        hop = matched(jumps, starts, [key, "pos"], "left_semi").select(key, F.col("out").alias("pos"))
        reached = saved(starts.union(hop).distinct(), "reached")
        doubled = jumps.select(key, F.col("pos").alias("_from"), F.col("out").alias("pos"))
        again = saved(matched(doubled, jumps, [key, "pos"]).select(key, F.col("_from").alias("pos"), "out"), "jumps")
        released(starts, jumps)
        starts, jumps = reached, again
    return starts


def reached(nodes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The rows of ``nodes`` (key, pos from 0 without gaps, nxt, others) on the way from place 0 by ``nxt``, with their
    number ``step`` on it."""
    fields = [c for c in nodes.columns if c not in (key, "pos", "nxt")]
    schema = "_block long, _entry long, _step long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(key, "pos", "nxt", *fields).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted, n = None, None, 0
        for b in batches:
            keep, steps = [], []
            for i, (k, at, entry, pos, nxt) in enumerate(zip(*(b[c].to_pylist() for c in (key, "_block", "_entry", "pos", "nxt")), strict=True)):
                if (k, at) != now:
                    now, wanted, n = (k, at), entry, 0
                if pos == wanted:
                    keep.append(i)
                    steps.append(n)
                    wanted, n = nxt, n + 1
            got = b.take(pa.array(keep, pa.int64()))
            cols = {c: got[c] for c in got.schema.names} | {"_step": pa.array(steps, pa.int64())}
            names = ["_block", "_entry", "_step", key, "pos", "nxt", *fields]
            yield pa.record_batch([cols[c] for c in names], names=names)

    place = F.floor(F.col("pos") / block)
    entered = entries(nodes, key, block).select(key, place.alias("_block"), F.col("pos").alias("_entry"))
    rows = matched(nodes.withColumn("_block", place), entered, [key, "_block"])
    on = saved(rows.repartition(key, "_block").sortWithinPartitions(key, "_block", "pos").mapInArrow(run, schema), "reached-rows")
    n = on.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))  # a row a block
    above = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select(key, "_block", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before")).where("_before > 0")
    out = matched(on, before, [key, "_block"], "left")
    return out.select(key, "pos", "nxt", *fields, (F.col("_step") + F.coalesce("_before", F.lit(0))).alias("step"))


def micro_batches(df: DataFrame, key: str, order: list[str], at: str, size: str, gap: int = FLUSH_MS, most: int = FLUSH_SIZE, block: int = BLOCK) -> DataFrame:
    """What ``folds.micro_batches`` gives, for keys of any size: key, batch_id, opened_at, n_chunks, size, reason.

    ``at`` must rise with ``order`` and no size be negative, ``gap`` be over 0: both ends of a batch are then found by
    searches, the deadline in the times and the size in the running sums.
    """
    if gap <= 0:
        raise ValueError("gap must be over 0")
    rows = ranges.scanned(df.select(key, *dict.fromkeys([*order, at, size])), key, order, "pos", {"before": size})
    rows = rows.select(key, F.col(at).cast("long").alias("at"), "pos", "before", (F.col("before") + F.col(size)).alias("upto"))
    timed = ranges.next_from(rows, key, "at", ["pos"], F.col("at") + gap, F.struct("pos", "before"), "late")
    full = ranges.next_from(timed, key, "upto", ["pos"], F.col("before") + most, F.struct("pos", "upto"), "full")
    by_size = F.col("full").isNotNull() & (F.col("late").isNull() | (F.col("full.pos") < F.col("late.pos")))
    end = F.when(by_size, F.col("full.pos") + 1).otherwise(F.col("late.pos"))
    total = F.when(by_size, F.col("full.upto")).otherwise(F.col("late.before"))
    reason = F.when(by_size, "size").when(F.col("late").isNotNull(), "timer").otherwise("exit")
    nodes = saved(full.select(key, "pos", end.alias("nxt"), "at", "before", total.alias("until"), reason.alias("reason")), "batch-ends")
    on = reached(nodes, key, block)
    ends = rows.groupBy(key).agg((F.max("pos") + 1).alias("_rows"), F.max("upto").alias("_sum"))
    open_ = matched(on.where("reason = 'exit'"), ends, [key])
    done = on.where("reason <> 'exit'").withColumns({"_rows": F.col("nxt"), "_sum": F.col("until")})
    out = done.unionByName(open_)
    return out.select(key, F.col("step").alias("batch_id"), F.col("at").alias("opened_at"), (F.col("_rows") - F.col("pos")).cast("int").alias("n_chunks"), (F.col("_sum") - F.col("before")).cast("long").alias("size"), "reason")


def rate_limited(df: DataFrame, key: str, order: list[str], at: str, size: str, budget: int = RATE_BYTES, window: int = RATE_MS, block: int = BLOCK) -> DataFrame:
    """What ``folds.rate_limited`` gives, a window at a time: windows are chained by their anchors, and only the decisions
    inside one window follow from each other in one task. ``at`` must rise with ``order``."""
    fields = list(dict.fromkeys([*order, at, size]))
    rows = ranges.scanned(df.select(key, *fields), key, order, "pos")
    timed = saved(ranges.next_from(rows.withColumn("_time", F.col(at)), key, "_time", ["pos"], F.col(at) + window, F.struct("pos"), "_late"), "window-ends")
    anchors = reached(timed.select(key, "pos", F.col("_late.pos").alias("nxt")), key, block).select(key, "pos", F.col("pos").alias("_anchor"))
    both = matched(timed.select(key, *fields, "pos"), anchors, [key, "pos"], "left")
    placed = ranges.carried(both, key, ["pos"], "_anchor", "_from").withColumn("_window", F.struct(F.col(key).alias("k"), F.col("_from").alias("w")))
    got = folds.rate_limited(placed, "_window", ["pos", *order], at, size, budget, window)
    return got.select(F.col("_window.k").alias(key), *fields, "accepted")


def by_size(df: DataFrame, key: str, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], most: int = BLOCK) -> DataFrame:
    """``small`` of the rows of keys that have at most ``most`` rows, and ``large`` of the other keys': a fold costs one shuffle
    and suits keys that a task reads in no time, list ranking costs several and suits keys of any size."""
    hot = saved(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key), "hot-keys")
    if hot.isEmpty():
        return small(df)
    few = F.broadcast(hot) if hot.count() <= 1_000_000 else hot  # at most one key in ``most`` rows
    return small(matched(df, few, [key], "left_anti")).unionByName(large(matched(df, few, [key], "left_semi")))


def compose(f: Column, g: Column) -> Column:
    """Two maps of states to states as arrays, first ``f``, then ``g``."""
    return F.transform(f, lambda s: F.get(g, s))


def matcher(text: Column, wanted: str) -> Column:
    """What a piece of text does to a matcher of ``wanted``, as an array: the state after it from each state before.

    A state is how many of the first characters of ``wanted`` the text so far ends with; the last one, a hit, stays.
    """
    n, p = len(wanted), F.lit(wanted)
    if not n:
        return F.array(F.lit(0))
    t = F.coalesce(text, F.lit(""))

    def after(s: Column) -> Column:
        so_far = F.substr(p, F.lit(1), s)
        tail = F.right(F.concat(so_far, F.right(t, F.lit(n - 1))), F.lit(n - 1))
        hit = (s == n) | F.contains(t, p) | F.contains(F.concat(so_far, F.left(t, F.lit(n - 1))), p)
        fits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.endswith(tail, F.substr(p, F.lit(1), k)))
        return F.when(hit, F.lit(n)).otherwise(F.array_max(fits))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), after)


#: Neighbours whose maps are composed at a time.
FAN = 256


def holding(chunks: DataFrame, key: str, order: list[str], text: str, wanted: str, fan: int = FAN) -> DataFrame:
    """Keys whose chunks, joined in order, contain the wanted text, also across any number of chunks.

    Each chunk is a map of a matcher's states to states. Composition is associative, so neighbours are composed ``fan`` at a
    time, then the results again: no row holds more than ``fan`` maps of as many numbers as the text has characters.
    """
    maps = chunks.select(key, *order, matcher(F.col(text), wanted).alias("_map"))
    maps = ranges.scanned(maps, key, order, "_pos").select(key, "_pos", "_map")
    same = F.sequence(F.lit(0), F.lit(len(wanted)))
    most = None
    while most is None or most > 0:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_map"))), lambda x: x["_map"])
        up = F.floor(F.col("_pos") / fan).alias("_pos")
        maps = saved(maps.groupBy(key, up).agg(F.aggregate(parts, same, compose).alias("_map")), "composed")
        most = maps.agg(F.max("_pos")).first()[0] or 0
    return maps.where(F.col("_map")[0] == len(wanted)).select(key)


def offsets(chunks: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, the order columns, ``start``, ``n``: where each chunk begins in its key's output and its characters. The output
    can so be read in ranges, and no row holds it whole."""
    sized = chunks.select(key, *order, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"))
    return ranges.scanned(sized, key, order, "_pos", {"start": "n"}).select(key, *order, "start", "n")
