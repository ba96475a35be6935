"""Language-model scores from a probabilistic suffix tree over words.

Symbols are all words, by their hashes, and the end. The root's distribution is the smoothed unigram one. Longer
contexts, up to ``DEPTH`` words, are counted level by level: an event, a word after a context, counts from
``EVIDENCE`` occurrences in the training texts on, however many these are. A context keeps (n - 1) / size for events that
make up a ``SHARE``-th of it or occur ``OFTEN`` times, and the rest of its mass goes to the distribution of the context
less its first word, so every distribution sums to one. A context stays if its training occurrences gain ``DIVERGE``
nats by it, or if a longer one that ends in it stays.

A text's score is its base score and, for each context met that stays, the log of the ratio of its probability to the
shorter context's. An event of one level is a context of the next, so all of this is one value for each event that
occurs in a text: the *table*. Its most frequent rows go to the tasks, the others are joined; nothing that grows with
the corpus is collected, and no key of the join is a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import id_crc, released, saved, ship, slices
from shoal.llm.hashing import lowered, word_hashes

DEPTH, EVIDENCE, SHARE, OFTEN, DIVERGE = 2, 2, 8, 16, 20.0
#: Rows of the table that occur once in so many tokens or more go to the tasks, at most so many a level, 24 bytes each, and
#: at most 20 more in a task to find them: the others' part of the texts, which is joined, follows the input at every size.
HEAD = 2_000_000
END_KEY = 0x0E0D
#: Bits and probes of the filters that keep rows without a partner from the shuffles. They only spare rows, as counts
#: and joins decide: a filter that a large corpus fills lets more through, and the results are the same.
FILTER_BITS, FILTER_PROBES = 1 << 27, 2
#: Ranges of a filter's bits, each set by a group of its own, and tokens for each range of the events' keys, two at the
#: most: a row holds all of a task's numbers in a range, so that they are dealt together instead of one by one.
FILTER_PARTS, PART_TOKENS = 256, 1 << 16
#: Rows for each shuffle partition up to which a join hashes a side instead of sorting both.
HASHED_ROWS = 1_000_000

#: The primes of 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, by: int) -> None:
    """Each number's bits turned to the left, in place."""
    low = h >> np.uint64(64 - by)
    h <<= np.uint64(by)
    h |= low


def joined(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64(pre, suf) gives for two longs: the key of the words that both stand for together."""
    h = np.empty(len(pre), np.uint64)
    for i in range(0, len(h), 1 << 15):  # parts that stay in the processor's cache
        own = slice(i, i + (1 << 15))
        h[own] = _joined(pre[own], suf[own])
    return h


def _joined(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(pre), 42, np.uint64)
        for part in (pre, suf):
            h += _P5 + np.uint64(8)
            x = part * _P2
            _turned(x, 31)
            x *= _P1
            h ^= x
            _turned(h, 27)
            h *= _P1
            h += _P4
            for by, prime in ((33, _P2), (29, _P3), (32, None)):
                np.right_shift(h, np.uint64(by), out=x)
                h ^= x
                if prime is not None:
                    h *= prime
        return h


def sequences(raw: list[bytes], depth: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For every word and end: its text, and for lengths from 1 word on the key of the words up to it and whether it has
    so many. One end may stand before a text's first word."""
    words, text = word_hashes(raw)
    n = np.bincount(text, minlength=len(raw))
    x = np.insert(words, np.cumsum(n), np.uint64(END_KEY))
    place = np.arange(len(x)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    keys, valid = [x], [np.ones(len(x), bool)]
    for back in range(1, depth + 1):
        keys.append(joined(before(keys[-1]), keys[-1]))
        valid.append(place >= back - 1)
    return np.repeat(np.arange(len(raw)), n + 1), keys, valid


def before(keys: np.ndarray) -> np.ndarray:
    """The key one place earlier; before the first text stands an end like between texts."""
    return np.concatenate((np.array([END_KEY], np.uint64), keys[:-1]))


def sorted_places(keys: np.ndarray) -> np.ndarray:
    """The places of keys by their first bits, in order among equal ones. Sorting numbers of these bits and the place is
    several times faster than an argsort. Should two keys share the bits and mix, a fold has them in more rows, that sum up."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    by = keys.view(np.uint64) & ~low
    by |= np.arange(len(keys), dtype=np.uint64)
    by.sort()
    by &= low
    return by.view(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))


def _folding(names: list[str], rows, parts: int = 0):
    """Counts of distinct keys: ``rows`` of a batch gives the key, other columns and the counts to be added. With
    ``parts``, a power of two, a row holds the columns of all keys in one of so many ranges, numbered by ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def fold() -> None:
            """One column after the other, so that no more than two are there twice at a time."""
            whole = lambda j: np.concatenate([h[j] for h in held])
            keys = whole(0)
            order = sorted_places(keys)
            keys = keys[order]
            begin = _runs(keys)
            first, keys = order[begin], keys[begin]
            n = np.add.reduceat(whole(-1)[order], begin) if len(begin) else whole(-1)
            del order
            held[:] = [(keys, *(whole(j)[first] for j in range(1, len(held[0]) - 1)), n)]

        for b in batches:
            for part in slices(b, "text", rows=2048, size=2_000_000):
                held.append(rows(part))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    fold()
                    if len(held[0][0]) > 1_500_000:
                        yield from given(held.pop())
        if held:
            fold()
            yield from given(held.pop())

    def given(cols: tuple) -> Iterator[pa.RecordBatch]:
        own = cols[-len(names) :]
        if parts:
            yield from blocks((cols[0].view(np.uint64) >> np.uint64(65 - parts.bit_length())).astype(np.int32), own, names, parts)
            return
        for i in range(0, len(cols[0]), 1 << 16):
            yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in own], names=names)

    return run


def blocks(part: np.ndarray, cols: tuple, names: list[str], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each part that occurs, with the columns' numbers in it as arrays; ``part`` ascends."""
    begin = _runs(part)
    ends = np.append(begin, len(part)).astype(np.int32)
    step = max(1, (1 << 16) * len(begin) // max(1, len(part)))  # rows for a batch of bounded size
    for i in range(0, len(begin), step):
        at = ends[i : i + step + 1]
        lists = [pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(c[at[0] : at[-1]])) for c in cols]
        yield pa.record_batch([pa.array(part[begin[i : i + step]]), *lists], names=["part", *names])


def _summed(evidence: int):
    """Of all blocks of a part: the events that occur ``evidence`` times or more in all."""

    def run(t: pa.Table) -> pa.Table:
        c, up, n = (pc.list_flatten(t[x]).to_numpy() for x in ("c", "up", "n"))
        keys = joined(c.view(np.uint64), up.view(np.uint64))
        order = sorted_places(keys)
        own = keys[order]
        if (own[1:] < own[:-1]).any():  # two keys share the first bits
            order = np.argsort(keys)
            own = keys[order]
        begin = _runs(own)
        n = np.add.reduceat(n[order], begin) if len(begin) else n
        often = n >= evidence
        first = order[begin[often]]
        return pa.table({"c": c[first], "up": up[first], "n": n[often]})

    return run


def _word_rows(part: pa.RecordBatch) -> tuple:
    raw = lowered(part["text"].to_pylist())
    keys, n = np.unique(word_hashes(raw)[0].view(np.int64), return_counts=True)
    return np.concatenate((keys, [END_KEY])), np.concatenate((n, [len(raw)]))


def _event_rows(length: int, shared, parts: int):
    """part, contexts, shorter, n: how often each word follows a context of ``length`` words, where filters allow it."""

    def rows(part: pa.RecordBatch) -> tuple:
        _, keys, valid = sequences(lowered(part["text"].to_pylist()), length)
        pre, suf, ok = before(keys[length - 1]), keys[length - 1], valid[length]
        seen = maybe(shared.value, suf)
        ok = ok & seen & np.concatenate(([True], seen[:-1]))
        return keys[length][ok], pre[ok].view(np.int64), suf[ok].view(np.int64), np.ones(int(ok.sum()), np.int64)

    return _folding(["c", "up", "n"], rows, parts)


def _spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(keys >> np.uint64(30 * i)) & np.uint64(bits - 1) for i in range(FILTER_PROBES)]


def maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key; it never denies one that it holds."""
    out, octets = np.ones(len(keys), np.uint8), bitmap.view(np.uint8)  # of little-endian numbers
    for at in _spots(keys, len(bitmap) * 64):
        out &= octets[(at >> np.uint64(3)).view(np.int64)] >> (at.astype(np.uint8) & np.uint8(7))
    return out.astype(bool)


def bitmap(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """A filter of the only column of ``keys``. What reaches the driver is bounded by its size."""
    bits = bits or FILTER_BITS
    width = max(64, bits // FILTER_PARTS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def given() -> Iterator[pa.RecordBatch]:
            spots = np.concatenate(held)
            held.clear()
            spots.sort()
            yield from blocks((spots // width).astype(np.int32), ((spots % width).astype(np.int32),), ["spots"], bits // width)

        for b in batches:
            held.extend(at.view(np.int64) for at in _spots(b[0].to_numpy().view(np.uint64), bits))
            if sum(len(x) for x in held) > 2_000_000:
                yield from given()
        if held:
            yield from given()

    def bits_set(t: pa.Table) -> pa.Table:
        on = np.zeros(width, bool)
        on[pc.list_flatten(t["spots"]).to_numpy()] = True
        return pa.table({"part": t["part"][:1], "words": pa.array([np.packbits(on, bitorder="little").view(np.int64)])})

    t = keys.mapInArrow(dealt, "part int, spots array<int>").groupBy("part").applyInArrow(bits_set, "part int, words array<long>").toArrow()
    out = np.zeros((bits // width, width >> 6), np.int64)
    out[t["part"].to_numpy()] = pc.list_flatten(t["words"]).to_numpy().reshape(-1, width >> 6)
    return out.reshape(-1).view(np.uint64)


def key_of(pre: str = "c", suf: str = "up") -> Column:
    return F.xxhash64(pre, suf)


def hashed(side: DataFrame, of: DataFrame) -> DataFrame:
    """A side of a join that has each key once, at most the rows of the saved table ``of``. While these are few in a
    partition, it is hashed there, which needs no sort of either side; otherwise Spark sorts both, and spills."""
    few = of.count() <= HASHED_ROWS * int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash") if few else side


def grown(train: DataFrame, words: DataFrame, norm: float, tokens: int, depth: int = DEPTH, evidence: int = EVIDENCE, diverge: float = DIVERGE) -> DataFrame:
    """key, n, gain, base of the table's rows: what each occurrence of an event adds to a text's log10 probability.

    For an event whose context keeps it and stays, that is the log of its ratio to the shorter context's probability,
    less the context's rest (``back``), which the occurrence of the context itself adds. ``base`` is for words only.
    """
    sc = train.sparkSession.sparkContext
    base = (F.col("n") + F.lit(0.5)) / F.lit(float(norm))
    rest = (F.col("size") - F.col("own")) / F.col("size")
    kept = (F.col("n") * SHARE >= F.col("size")) | (F.col("n") >= OFTEN)
    # Of each level: key, n, its shorter form and probability as an event; the words are level 0.
    lower, rows = words.select("key", "n", F.lit(0).cast("long").alias("up"), base.alias("p")), words
    wanted, levels = bitmap(words.where(F.col("n") >= evidence).select("key")), []
    parts = max(256, 1 << (tokens // PART_TOKENS).bit_length())
    for length in range(1, depth + 1):
        counts = train.select("text").mapInArrow(_event_rows(length, sc.broadcast(wanted), parts), "part int, c array<long>, up array<long>, n array<long>")
        counts = saved(counts.groupBy("part").applyInArrow(_summed(evidence), "c long, up long, n long"), "lm-events")
        if length < depth:
            wanted = bitmap(counts.select(key_of()))
        sized = counts.join(hashed(lower.select(F.col("key").alias("c"), F.col("n").alias("size"), F.col("up").alias("shorter")), rows), "c").withColumn("kept", kept)
        sized = saved(sized if length < depth else sized.where("kept"), "lm-sized")
        sums = sized.where("kept").groupBy("c").agg(F.sum(F.col("n") - 1).alias("own"), F.sum("n").alias("known"), F.first("size").alias("size"), F.first("shorter").alias("shorter"))
        sums = saved(sums, "lm-sums")
        level = sized.join(hashed(sums.select("c", rest.alias("rest")), sums), "c", "left").join(hashed(lower.select(F.col("key").alias("up"), F.col("p").alias("below")), rows), "up")
        p = F.when(F.col("kept"), (F.col("n") - 1) / F.col("size")).otherwise(0) + F.coalesce("rest", F.lit(1.0)) * F.col("below")
        level = level.select("c", "up", "n", F.when(F.col("kept"), F.log(p / F.col("below"))).alias("ratio"), *([p.alias("p")] if length < depth else []))
        level = saved(level, "lm-level")
        released(counts, sized)
        levels.append((level, sums))
        if length < depth:
            lower, rows = level.select(key_of().alias("key"), "n", "up", "p"), level
    out, needed, stays = [], None, []
    for level, sums in levels[::-1]:
        known = level.where("ratio is not null")
        gain = known.groupBy("c").agg(F.sum(F.col("n") * F.col("ratio")).alias("nats")).join(hashed(sums, sums), "c")
        good = F.col("nats") + (F.col("size") - F.col("known")) * F.log(rest) >= diverge
        gain = gain.where(good) if needed is None else gain.join(hashed(needed, stay), "c", "left").where(good | F.col("needed"))
        stay = saved(gain.select("c", "shorter", "size", F.log10(rest).alias("back")), "lm-contexts")
        stays.append(stay)
        needed = stay.select(F.col("shorter").alias("c")).distinct().withColumn("needed", F.lit(True))
        out.append(known.join(hashed(stay.select("c", "back"), stay), "c").select(key_of().alias("key"), "n", (F.col("ratio") / float(np.log(10)) - F.col("back")).alias("gain")))
        out.append(stay.select(F.col("c").alias("key"), F.col("size").alias("n"), F.col("back").alias("gain")))
    *longer, first = out  # the last ones are the words that stay
    for more in longer[1:]:
        longer[0] = longer[0].unionByName(more)
    longer = longer[0].groupBy("key").agg(F.max("n").alias("n"), F.sum("gain").alias("gain"))
    first = words.join(hashed(first.select("key", "gain"), stay), "key", "left").select("key", "n", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.log10(base).alias("base"))
    table = saved(first.unionByName(longer.withColumn("base", F.lit(None).cast("double"))), "lm-table")
    released(*(t for pair in levels for t in pair), *stays)
    return table


def parted(table: DataFrame, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Keys, gains and bases of the frequent rows, sorted by key, and the other rows."""
    frequent = F.col("n") * HEAD >= tokens
    t = table.where(frequent).select("key", "gain", "base").toArrow()
    key = t["key"].to_numpy().view(np.uint64)
    by = np.argsort(key)
    return key[by], t["gain"].to_numpy()[by], t["base"].to_numpy()[by], table.where(~frequent)


class Head:
    """Where sorted keys stand: by a table of the keys' first bits, at most 20 bytes a key, and by a search where several share these."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, 1 + len(keys).bit_length()
        self.shift = np.uint64(64 - bits)
        spot = (keys >> self.shift).astype(np.int64)
        first = np.concatenate((np.ones(min(1, len(keys)), bool), spot[1:] != spot[:-1]))
        self.at = np.full(1 << bits, -1, np.int32)
        self.at[spot[first]] = np.flatnonzero(first)
        self.many = np.zeros(1 << bits, bool)
        self.many[spot[~first]] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is among them at all."""
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        spot = (asked >> self.shift).astype(np.int64)
        at = self.at[spot]
        hit = (self.keys[at] == asked) & (at >= 0)
        more = np.flatnonzero(self.many[spot] & ~hit)
        at[more] = np.minimum(np.searchsorted(self.keys, asked[more]), len(self.keys) - 1)
        hit[more] = self.keys[at[more]] == asked[more]
        return at, hit


def _scored(depth: int, shared):
    """What a text gains by the table's head, and the keys that have to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, gains, bases, every, norm = shared.value
        unknown, head = np.log10(0.5 / norm), Head(head)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for part in slices(b, "text"):
                m = part.num_rows
                text, keys, valid = sequences(lowered(part["text"].to_pylist()), depth)
                of, tail, gain = [], [], np.zeros(m)
                for k, (key, ok) in enumerate(zip(keys, valid, strict=True)):
                    rows, own = (text, key) if ok.all() else (text[ok], key[ok])
                    at, hit = head.find(own)
                    at, of_head = at[hit], rows[hit]
                    gain += np.bincount(of_head, weights=gains[at], minlength=m)
                    rows, own = rows[~hit], own[~hit]
                    held = maybe(every, own)  # the others have no row
                    of.append(rows[held])
                    tail.append(own[held])
                    if not k:  # words; one of the tail may still be unknown, see lm_scores
                        known, asked = np.bincount(of_head, minlength=m), np.bincount(of[0], minlength=m)
                        base = np.bincount(of_head, weights=bases[at], minlength=m) + unknown * np.bincount(rows[~held], minlength=m)
                of, tail = np.concatenate(of), np.concatenate(tail)
                tail = tail[np.argsort(of.astype(np.uint16), kind="stable")].view(np.int64)  # a slice has fewer rows
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=m)))).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + m)), part["doc_id"], part["held_out"], pa.array(np.bincount(text, minlength=m)), pa.array(known), pa.array(asked), pa.array(base), pa.array(gain),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tail)),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "asked", "base", "gain", "tail"],
                )
                row += m

    return run


def lm_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, evidence: int = EVIDENCE, diverge: float = DIVERGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``held_out`` is a boolean Column over ``docs``; rows where it is not true are learned from. Null text counts as
    empty and scores its end alone. Repeated rows count and are scored each; ties don't arise. Very long texts are
    taken whole, one at a time in a task. With nothing to learn from, score and base are the same. An empty table gives
    no rows. Other columns, whatever their names, are not read. Words and contexts are told apart by 64-bit hashes.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where("not held_out")
    words = train.select("text").mapInArrow(_folding(["key", "n"], _word_rows), "key long, n long")
    words = saved(words.groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    norm = n + 0.5 * (v + 1)
    table = grown(train, words, norm, n, depth, evidence, diverge)
    *head, rest = parted(table, n)
    released(words)
    shared = spark.sparkContext.broadcast((*head, bitmap(table.select("key")), norm))
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = rows.mapInArrow(_scored(depth, shared), f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, asked long, base double, gain double, tail array<long>")
    first = saved(first, "lm-texts")
    found = first.select("row", F.explode("tail").alias("key")).join(hashed(rest.select("key", "gain", "base"), table), "key")
    found = found.groupBy("row").agg(F.sum("gain").alias("more_gain"), F.count("base").alias("more_known"), F.sum("base").alias("more_base"))
    out = first.drop("tail").join(hashed(found, first), "row", "left").na.fill(0, ["more_known"]).na.fill(0.0, ["more_gain", "more_base"])
    base = F.col("base") + F.col("more_base") + (F.col("asked") - F.col("more_known")) * F.lit(float(np.log10(0.5 / norm)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + F.col("more_gain")).alias("score"),
    )


def fold_scores(docs: DataFrame) -> DataFrame:
    """Scores with the documents whose crc32(doc_id) mod 5 is 1 held out; null ids are learned from."""
    return lm_scores(docs, F.pmod(id_crc(), F.lit(5)) == 1)
