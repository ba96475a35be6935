"""Phrase collocations from exact counts of all runs of one to four words, held in weighted acyclic automata.

A task sorts the four-word windows of its texts and builds from them, path by path, an automaton whose arcs are words and
whose weight at a state is the number of windows that begin with the words leading there, which is the count of those
words as a phrase. An automaton takes a few bytes an arc, as windows share prefixes. It is cut at fixed places of the
sorted order of windows; the parts of one prefix range meet in one task and are united, weights of equal paths added.
Only phrases that are frequent leave it, and those that lie on a cut, whose weights are summed afterwards. Candidates
are then composed with the counts of their parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import saved, ship, slices

#: Words of the longest phrase.
LONGEST = 4
#: Bytes of text from which a task builds an automaton at once, and bytes of text to a prefix range.
SHARD, RANGE = 4_000_000, 8_000_000
#: Arcs that a task gathers before it unites them.
ARCS = 3_000_000
#: Cuts are of at most so many words of a sample, each cut off after so many bytes, so that they take 170 MB at most; beyond
#: some 8 TB of text ranges grow instead.
MOST_RANGES, CUT_BYTES = 1 << 20, 32
#: The sample that places the cuts (nothing else depends on it): of so many documents one, of its windows so many.
SAMPLE, EVERY = 0.005, 16
UND = "und"

#: What ends a piece, as single bytes.
BREAKS = [bytes([c]) for c in b".,;:!?\x0a\x0b\x0c\x0d"]
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[c[0] for c in BREAKS]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Automaton(NamedTuple):
    """Levels of states from one word on: the word that leads to each, its parent one level up, its weight. A first
    state's parent is its language."""

    langs: list[str]
    words: list[bytes]
    labels: list[np.ndarray]
    parents: list[np.ndarray]
    weights: list[np.ndarray]

    def arcs(self) -> int:
        return sum(map(len, self.labels))


def windows(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Of each word: the number of its text, the ranks of it and the words that follow it in its piece (plus 1, 0 where the
    piece has ended), and the sorted distinct words."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edges = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    kind = _KIND[data]
    inside = kind == 0
    turn = np.flatnonzero(np.diff(np.concatenate(([False], inside))))
    begin, end = turn[::2], turn[1::2]  # the last byte is a line feed, so every word ends
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    own = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    order = pc.array_sort_indices(own.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    ids = rank[own.indices.to_numpy(zero_copy_only=False)] if len(begin) else np.empty(0, np.int32)
    piece = np.cumsum(kind == 2, dtype=np.int64)[begin]
    ranks = [ids]
    for k in range(1, LONGEST):
        later = np.zeros(len(ids), np.int32)
        if len(ids) > k:
            later[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        ranks.append(later)
    return np.searchsorted(edges, begin, "right").astype(np.int32), ranks, own.dictionary.take(pa.array(order))


def built(langs: list[str], lang: np.ndarray, ranks: list[np.ndarray], words: list[bytes], cuts: list[tuple]) -> Iterator[tuple[int, Automaton]]:
    """The automaton of windows, in parts between the cuts: the number of each part that has windows, and the part."""
    if not len(lang):
        return
    pairs, first = np.unique(lang.astype(np.int64) * (len(words) + 1) + ranks[0], return_inverse=True)
    one, two = (first << 32) | ranks[1], (ranks[2].astype(np.int64) << 32) | ranks[3]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    del first, order
    starts = np.array([0, *(placed(c, langs, words, pairs, one, two) for c in cuts), len(one)])
    change = np.zeros(len(one), bool)
    change[starts[:-1][starts[:-1] < len(one)]] = True
    change[0] = True
    labels, parents, weights, at = [], [], [], []
    for d in range(LONGEST):
        column = ((one, two)[d // 2] >> (0 if d % 2 else 32)).astype(np.int32)  # the low half, as it is, or the high one
        change[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(change)
        n, label = np.diff(np.append(begin, len(one))), column[begin]
        begin, n, label = (begin, n, label) if d == 0 else (x[label > 0] for x in (begin, n, label))
        if d == 0:
            parents.append((pairs[label] // (len(words) + 1)).astype(np.int32))
            label = (pairs[label] % (len(words) + 1)).astype(np.int32)
        else:
            parents.append((np.searchsorted(at[-1], begin, "right") - 1).astype(np.int32))
        at.append(begin)
        labels.append(label - 1)
        weights.append(n.astype(np.int32))
    del one, two, change
    for r in np.flatnonzero(np.diff(starts)):
        low, high = zip(*(np.searchsorted(a, starts[r : r + 2]) for a in at), strict=True)
        own = [x[a:b] for x, a, b in zip(labels, low, high, strict=True)]
        used, again = np.unique(np.concatenate(own), return_inverse=True)
        sizes = np.cumsum([len(x) for x in own])[:-1]
        up = [p[a:b] - (low[d - 1] if d else 0) for d, (p, a, b) in enumerate(zip(parents, low, high, strict=True))]
        yield int(r), Automaton(langs, [words[i] for i in used.tolist()], np.split(again, sizes), up, [w[a:b] for w, a, b in zip(weights, low, high, strict=True)])


def placed(cut: tuple, langs: list[str], words: list[bytes], pairs: np.ndarray, one: np.ndarray, two: np.ndarray) -> int:
    """The number of sorted windows before the cut (language, words). A word that the shard doesn't have stands before
    the next that it has, and so do all windows that begin with it."""
    lang = bisect_left(langs, cut[0])
    if lang == len(langs):
        return len(one)
    exact = langs[lang] == cut[0]
    key = []
    for w in cut[1:]:
        if not exact or w is None:
            key.append(0)
            continue
        i = bisect_left(words, w)
        exact = i < len(words) and words[i] == w
        key.append(i + 1)
    pair = lang * (len(words) + 1) + key[0]
    first = int(np.searchsorted(pairs, pair))
    if first == len(pairs):
        return len(one)
    if pairs[first] != pair:
        key[1:] = [0] * (LONGEST - 1)
    a, b = (first << 32) | key[1], (key[2] << 32) | key[3]
    low, high = np.searchsorted(one, [a, a + 1])
    return int(low + np.searchsorted(two[low:high], b))


def united(parts: list[Automaton]) -> Automaton:
    """One automaton with the paths of all and the sums of their weights."""
    langs, words = {}, {}
    to_lang = [np.array([langs.setdefault(x, len(langs)) for x in p.langs], np.int64) for p in parts]
    to_word = [np.array([words.setdefault(x, len(words)) for x in p.words], np.int64) for p in parts]
    labels, parents, weights = [], [], []
    state = to_lang  # of each part, the new number of each state one level up
    for d in range(LONGEST):
        key = np.concatenate([(s[p.parents[d]].astype(np.int64) << 32) | w[p.labels[d]] for p, s, w in zip(parts, state, to_word, strict=True)])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        state = np.split(number, np.cumsum([len(p.labels[d]) for p in parts])[:-1])
        own = np.concatenate([p.weights[d] for p in parts]).astype(np.int64)[order]
        labels.append((ordered[begin] & 0xFFFFFFFF).astype(np.int32))
        parents.append((ordered[begin] >> 32).astype(np.int32))
        weights.append(np.add.reduceat(own, begin) if len(begin) else np.empty(0, np.int64))
    return Automaton(list(langs), list(words), labels, parents, weights)


def packed(a: Automaton) -> bytes:
    """Arrays in their narrowest types, parents as numbers of children (states are in the order of their parents)."""
    out = [b" ".join(a.words)]
    for d in range(LONGEST):
        above = len(a.langs) if d == 0 else len(a.labels[d - 1])
        for x in (a.labels[d], np.bincount(a.parents[d], minlength=above), a.weights[d]):
            kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
            out += [kind.encode(), x.astype(kind).tobytes()]
    sizes = np.array([len(x) for x in out], "<i8").tobytes()
    raw = sizes + b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes, langs: list[str]) -> Automaton:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    head = 8 * (1 + 6 * LONGEST)
    ends = head + np.cumsum(np.frombuffer(raw[:head], "<i8"))
    field = [raw[a:b] for a, b in zip([head, *ends[:-1]], ends, strict=True)]
    arrays = [np.frombuffer(x, k.decode()) for k, x in zip(field[1::2], field[2::2], strict=True)]  # as narrow as they came
    parents = [np.repeat(np.arange(len(n), dtype=np.int32), n) for n in arrays[1::3]]
    return Automaton(langs, field[0].split(b" ") if field[0] else [], arrays[0::3], parents, arrays[2::3])


def at_breaks(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of at most ``size`` bytes, which end where pieces do; a longer piece is a part of its own."""
    start = 0
    while len(text) - start > size:
        end = max(text.rfind(c, start, start + size) for c in BREAKS)
        if end < 0:
            end = min((at for c in BREAKS if (at := text.find(c, start + size)) >= 0), default=len(text) - 1)
        yield text[start : end + 1]
        start = end + 1
    yield text[start:]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, list[np.ndarray], list[bytes]]]:
    """The windows of at most SHARD bytes of text at a time (a longer text is taken in parts): languages, and of each window its one and its ranks."""
    for whole in batches:
        for b in slices(whole, "text", rows=1 << 30, size=SHARD):
            texts, own = b["text"].cast(pa.large_binary()).to_pylist(), b["lang"].to_pylist()
            langs = sorted(set(own), key=str.encode)
            place = {x: i for i, x in enumerate(langs)}
            codes = np.array([place[x] for x in own], np.int32)
            for part in [texts] if len(texts) > 1 else ([t] for t in at_breaks(texts[0], SHARD)):
                of, ranks, words = windows(part)
                yield langs, codes[of], ranks, words.to_pylist()


CUT = ["lang", *(f"w{k}" for k in range(1, LONGEST + 1))]


def cut_points(docs: DataFrame) -> list[tuple]:
    """Where the order of windows is cut: a quantile of sampled windows for each RANGE bytes of text."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, -(-n // RANGE))
    if ranges < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, lang, ranks, words in shards(batches):
            at = np.arange(0, len(lang), EVERY)
            short = [w[:CUT_BYTES] for w in words] + [None]
            cols = [[short[i - 1] for i in r[at].tolist()] for r in ranks]  # rank 0, none, is the last
            yield pa.record_batch([pa.array([langs[i] for i in lang[at].tolist()], pa.string()), *(pa.array(c, pa.binary()) for c in cols)], names=CUT)

    sample = docs.sample(SAMPLE, seed=17).mapInArrow(run, "lang string, " + ", ".join(f"{c} binary" for c in CUT[1:]))
    sample = saved(sample, "window-sample").repartitionByRange(ranges, *CUT)
    got = sample.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*CUT)).alias("cut")).collect()
    cuts = {(c.lang, *(None if w is None else bytes(w) for w in c[1:])) for _, c in got}
    key = lambda c: (c[0].encode(), *(b"" if w is None else w for w in c[1:]))
    return sorted(cuts, key=key)[1:]


def counted(docs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n_words, f of the phrases that occur ``least`` times in a language, and of each language one row with a
    null phrase and the number of its words."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(cut_points(docs))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            for r, a in built(*shard, sent.value):
                used = np.unique(a.parents[0]).tolist()
                own = a._replace(langs=[a.langs[i] for i in used], parents=[np.searchsorted(used, a.parents[0]), *a.parents[1:]])
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([own.langs], pa.list_(pa.string())), pa.array([packed(own)], pa.binary())], names=["part", "langs", "automaton"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, arcs = None, [], 0
        for b in batches:
            for r, langs, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != part and held:
                    yield frequent(united(held), part, sent.value, least)
                    held, arcs = [], 0
                part = r
                held.append(unpacked(data, langs))
                arcs += held[-1].arcs()
                if arcs > ARCS:
                    held = [united(held)]
                    arcs = held[0].arcs() // 2  # so that it isn't united again at every part
        if held:
            yield frequent(united(held), part, sent.value, least)

    parts = docs.mapInArrow(build, "part int, langs array<string>, automaton binary")
    got = parts.repartition(len(sent.value) + 1, "part").sortWithinPartitions("part").mapInArrow(unite, "lang string, phrase string, n_words int, f long")
    return got.groupBy("lang", "phrase", "n_words").agg(F.sum("f").cast("long").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())


def frequent(a: Automaton, part: int, cuts: list[tuple], least: int) -> pa.RecordBatch:
    """Rows of ``counted`` from a range's automaton: frequent phrases, and those of any count that begin like one of the
    range's two cuts and may so have more windows in the next range."""
    keep = [w >= least for w in a.weights]
    lang, word = {x: i for i, x in enumerate(a.langs)}, {x: i for i, x in enumerate(a.words)}
    for cut in cuts[max(0, part - 1) : part + 1]:
        up = lang.get(cut[0])
        for d, w in enumerate(cut[1:]):
            hit = np.flatnonzero((a.parents[d] == up) & (a.labels[d] == word.get(w, -1))) if up is not None and w is not None else ()
            if not len(hit):
                break
            up = int(hit[0])
            keep[d][up] = True
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for i, x in enumerate(a.langs):
        rows[0].append(x), rows[1].append(None), rows[2].append(0), rows[3].append(int(a.weights[0][a.parents[0] == i].sum()))
    for d in range(LONGEST):
        at = np.flatnonzero(keep[d])
        rows[3].extend(a.weights[d][at].tolist())
        rows[2].extend([d + 1] * len(at))
        path = []
        for e in range(d, -1, -1):
            path.append(a.labels[e][at].tolist())
            at = a.parents[e][at]
        rows[1].extend(b" ".join(a.words[i] for i in p).decode() for p in zip(*reversed(path), strict=True))
        rows[0].extend(a.langs[i] for i in at.tolist())
    return pa.record_batch([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["lang", "phrase", "n_words", "f"])


def phrases(docs: DataFrame, least: int = 30, most: int = 2000, text: str = "text", lang: str = "lang", cover: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases (the limit is the feature).

    Texts are lower-cased in A-Z, cut into pieces at ``. , ; : ! ?`` and U+000A to U+000D, pieces into words at spaces and
    tabs. Candidates are phrases of 2 to 4 words within a piece that occur ``a`` >= ``least`` times. The score is
    floor(2000000 a / (l + r)) of the cut into two parts, of l and r occurrences, that scores lowest, after fewest words
    among equals. A candidate within a longer one that occurs at least ``cover`` % as often is dropped. Order: score and
    ``a`` descending, phrase ascending by UTF-8 bytes.

    A null text counts as empty, a null language as ``und``. Rows count each by itself, repeated ones and ones without an id
    too; other columns aren't read. Texts are read whole; an empty table and texts without words give no rows.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(UND)).alias("lang"))
    counts = saved(counted(rows, least), "phrase-counts")
    n = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    known = counts.where("phrase is not null").select("lang", F.col("phrase").alias("part"), "f")
    words = F.split("phrase", " ")
    found = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"))

    # each candidate with the counts of its parts at each cut
    joined = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cut = found.select("lang", "phrase", "n_words", "a", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    cut = cut.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    # the longest count of a longer candidate that holds each shorter one
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inside = found.where("n_words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * cover))
    w = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).join(F.broadcast(n), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
