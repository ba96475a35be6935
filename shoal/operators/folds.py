"""Order-dependent operators over keyed streams, in batch form.

Rows are dealt by key and sorted within their partitions, which spills, and a small state runs over them, batch by
batch: a batch of chunks, a window's budget, at most ``most`` live ids. No group is ever held, so a burst or a whole log
of any length takes linear time; a key's rows are read by one task, as each decision follows from the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: 8 ms and 65536 characters a batch; 16 MiB a second.
FLUSH_MS, FLUSH_SIZE, RATE_BYTES, RATE_MS = 8, 65536, 16 * 1024 * 1024, 1000


def folded(df: DataFrame, key: str, order: list[str], fields: list[str], schema: str, fold: Callable) -> DataFrame:
    """``df`` by key and order through ``fold``: called for each key, it gives a function of (fields) and one for the
    end, each of which gives rows (without the key)."""
    fields = list(dict.fromkeys(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, step, end = None, False, None, None
        kinds = [f.type for f in wanted]

        def given(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.name for f in wanted])

        for b in batches:
            out: list[tuple] = []
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or k != now:
                    if begun:
                        out += [(now, *r) for r in end()]
                    now, begun, (step, end) = k, True, fold()
                out += [(k, *r) for r in step(*row)]
            yield given(out)
        if begun:
            yield given([(now, *r) for r in end()])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"{key} {kinds[key]}, " + schema.format(**kinds)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(key, *fields).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def micro_batches(df: DataFrame, key: str, order: list[str], at: str, size: str, gap: int = FLUSH_MS, most: int = FLUSH_SIZE) -> DataFrame:
    """key, batch_id, opened_at, n_chunks, size, reason: chunks gathered from the first one on for ``gap``, or until
    their size reaches ``most``.

    A row at or after the deadline opens the next batch (timer first); the row that reaches ``most`` closes its own.
    A key's last batch, if still open, ends with reason ``exit``, as its stream does. batch_id counts from 0 a key.
    """
    fields = list(dict.fromkeys([*order, at, size]))
    i, j = fields.index(at), fields.index(size)

    def fold():
        batch, opened, n, total = 0, None, 0, 0

        def close(reason: str) -> list[tuple]:
            nonlocal batch, opened, n, total
            row = (batch, opened, n, total, reason)
            batch, opened, n, total = batch + 1, None, 0, 0
            return [row]

        def step(*row) -> list[tuple]:
            nonlocal opened, n, total
            out = close("timer") if opened is not None and row[i] >= opened + gap else []
            opened = row[i] if opened is None else opened
            n, total = n + 1, total + row[j]
            return out + close("size") if total >= most else out

        return step, lambda: close("exit") if opened is not None else []

    return folded(df, key, order, fields, "batch_id long, opened_at long, n_chunks int, size long, reason string", fold)


def rate_limited(df: DataFrame, key: str, order: list[str], at: str, size: str, budget: int = RATE_BYTES, window: int = RATE_MS) -> DataFrame:
    """key, the order columns, size and ``accepted``: at most ``budget`` a window, which is anchored anew at the first
    row at or after its end. A row that doesn't fit is rejected whole and costs nothing; an exact fit passes."""
    fields = list(dict.fromkeys([*order, at, size]))
    i, j = fields.index(at), fields.index(size)

    def fold():
        reset, left = None, 0

        def step(*row) -> list[tuple]:
            nonlocal reset, left
            if reset is None or row[i] >= reset:
                reset, left = row[i] + window, budget
            ok = row[j] <= left
            left -= row[j] if ok else 0
            return [(*row, ok)]

        return step, list

    return folded(df, key, order, fields, ", ".join(f"{f} {{{f}}}" for f in fields) + ", accepted boolean", fold)


def admitted(df: DataFrame, owner: str, order: list[str], change: str, session: str, most: int = 50) -> DataFrame:
    """owner, the order columns, session, ``accepted`` for creates (+1) and ends (-1).

    A create is rejected while ``most`` sessions live; a rejected one doesn't count, and its end frees nothing.
    """
    fields = list(dict.fromkeys([*order, change, session]))
    i, j = fields.index(change), fields.index(session)

    def fold():
        live: list = []

        def step(*row) -> list[tuple]:
            nonlocal live
            if row[i] > 0:
                ok = len(live) < most
                live += [row[j]] if ok else []
            else:
                ok = row[j] in live
                live = [x for x in live if x != row[j]]
            return [(*row, ok)]

        return step, list

    return folded(df, owner, order, fields, ", ".join(f"{f} {{{f}}}" for f in fields) + ", accepted boolean", fold)
