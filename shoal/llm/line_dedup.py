"""Line dedup by a segment-partition edit join.

Lines of an edit distance up to ``edits`` share, whole and hardly moved, one of any edits + 1 segments of the shorter
line. Each distinct line gives its own segments to an index and, for every shorter length that a partner may have,
the few substrings that such a partner's segments can lie in; both are hashes with length and segment number, and meet
in one hash join. A segment that more than ``MANY`` lines index is not joined: what it leaves of a line is cut into
pieces, more than the edits can touch, so a partner also shares one of them, and such lines meet by segment and piece
together; pieces that are still shared by many are followed by pieces of the rest. So the lines that are compared grow
with the lines. With each goes a sketch of the line's characters, of which an edit changes few bits: lines that meet but
differ in more elsewhere make no row. What is left is verified by a bit-parallel edit distance over the band of
2 * edits + 1 diagonals, for many pairs at once. Verified links' components are the classes; the first line of a class stays.

Lines of all lengths are compared: equal ones always, and from ``least`` characters on with ``edits`` edits, below with
as many edits to a character, as two edits in two words of three letters would make one class of all of them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import among, fresh, released, saved, ship, slices
from shoal.llm.hashing import P, Q, mixed, powers
from shoal.llm.ngram_join import components

#: The edits of a pair whose shorter line has LEAST_CHARS or more; below it there are fewer in proportion.
EDITS, LEAST_CHARS = 2, 30
#: Distinct lines that a task remembers in order not to repeat their rows; beyond it, repeats are only dropped later.
MEMORY = 500_000
#: Lines that may index one segment or piece before a further piece is asked for, and the most pieces that are.
MANY, PIECES = 256, 2
#: Passes over the signatures, each with its part of them; a pass's shuffle files are freed before the next.
PASSES = 2
#: Columns of the signatures that a line indexes and looks up in each pass.
SETS = [f"{side}{no}" for side in ("own", "look") for no in range(PASSES)]
#: Bits of a sketch for single characters and for pairs of them; an edit changes at most 2 and 4 of these.
ONES, TWOS = 24, 40
#: Characters of the lines that are verified at once, and of a line that is followed by its diagonals instead.
CELLS, LONG = 2_000_000, 2_000
#: Characters whose sums are taken at once for the signatures.
BLOCK = 1 << 18


def key(line: str) -> tuple[int, int]:
    """128 bits of a line's content, as two integers."""
    return struct.unpack("<qq", hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of edits + 1 segments of a line, as even as they go, the longer ones last."""
    n = edits + 1
    size, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        own = size + (i >= n - longer)
        out.append((at, own))
        at += own
    return out


def probe_places(length: int, shorter: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings in which a partner of ``shorter`` characters can have its segments.

    A segment that is matched with the fewest edits before it has moved by at most its number, and what follows it
    leaves at most the other edits: both windows hold, so only their overlap is looked at.
    """
    out, gap = [], length - shorter
    for i, (at, size) in enumerate(segments(shorter, edits)):
        low, high = max(at - i, at + gap - (edits - i)), min(at + i, at + gap + (edits - i))
        out += [(i, p, size) for p in range(max(0, low), min(length - size, high) + 1)]
    return out


def allowed(length: int, edits: int = EDITS, least: int = LEAST_CHARS) -> int:
    """The most edits between a line of so many characters and one that is not shorter."""
    return min(edits, edits * length // least)


@lru_cache(100_000)
def plan(n: int, probe: bool, edits: int, least: int) -> np.ndarray:
    """Tag, start and end of each signature of a line of ``n`` characters; a tag has the segment's number and, in the low
    40 bits, the shorter line's length. Those of one tag follow one another."""
    out = []
    if probe:
        for m in range(max(1, n - edits), n + 1):
            most = allowed(m, edits, least)
            if most and n - m <= most:
                out += [(i << 40 | m, at, at + size) for i, at, size in probe_places(n, m, most)]
    elif most := allowed(n, edits, least):
        out = [(i << 40 | n, at, at + size) for i, (at, size) in enumerate(segments(n, most))]
    return np.array(out, np.int64).reshape(-1, 3).T


def coded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' sizes, and their characters one after the other."""
    return np.array([len(x) for x in lines], np.int64), np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")


def signed(lines: list[str], probes: tuple[bool, ...], edits: int = EDITS, least: int = LEAST_CHARS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the line, hash and tag of all that the lines put in the index or, for a probe, look up there, each once.

    A substring's hash is the difference of two sums over the characters before its ends, of each character times a
    power by place, turned back to the substring's start: the work is in proportion to the characters and the
    signatures, whatever their sizes. Equal substrings of one tag have equal hashes, wherever they stand; should others
    have them too, their lines only meet and are told apart later.
    """
    base, block = int(P), BLOCK
    n, codes = coded(lines)
    blocks = len(codes) // block + 1
    up, down = powers(base, block), powers(pow(base, -1, 2**64), block)
    ups, downs = (powers(pow(base, sign * block, 2**64), blocks) for sign in (1, -1))
    sums = np.zeros(len(codes) + 1, np.uint64)
    for i, lift in enumerate(ups):
        own = codes[i * block : (i + 1) * block].astype(np.uint64)
        own *= up[: len(own)]
        own *= lift
        np.cumsum(own, out=own)
        np.add(own, sums[i * block], out=sums[i * block + 1 : i * block + 1 + len(own)])
    begin, out = np.cumsum(n) - n, []
    for probe in probes:
        plans = [plan(k, probe, edits, least) for k in n.tolist()]
        of = np.repeat(np.arange(len(lines)), np.array([p.shape[1] for p in plans], np.int64))
        tag, start, end = np.concatenate([np.empty((3, 0), np.int64), *plans], axis=1)
        start, end = start + begin[of], end + begin[of]
        sig = mixed(((sums[end] - sums[start]) * (down[start % block] * downs[start // block])) ^ (tag.astype(np.uint64) * Q))
        once = np.ones(len(sig), bool)
        for by in range(1, edits + 1):  # a tag has so many further places at most
            once[by:] &= (sig[by:] != sig[:-by]) | (of[by:] != of[:-by])
        out.append((of[once], sig[once], tag[once]))
    return out


def signatures(line: str, probe: bool, edits: int = EDITS, least: int = LEAST_CHARS) -> list[int]:
    """The hashes that a line puts in the index, or those that it looks up there."""
    return [sig for sig, _ in tagged(line, probe, edits, least)]


def tagged(line: str, probe: bool, edits: int = EDITS, least: int = LEAST_CHARS) -> list[tuple[int, int]]:
    """The same, each with its tag."""
    [(_, sig, tag)] = signed([line], (probe,), edits, least)
    return list(zip(sig.tolist(), tag.tolist(), strict=True))


@lru_cache(100_000)
def pieces(length: int, edits: int, way: tuple[int, ...]) -> list[tuple[int, int]]:
    """Start and size of edits + 1 pieces of what is left of a line once the segment and pieces of ``way`` are out: the
    longest is halved until they are as many."""
    left = segments(length, edits)
    for out in way:
        left = [p for i, p in enumerate(left) if i != out]
        while len(left) <= edits:
            at, size = longest = max(left, key=lambda p: p[1], default=(0, 0))
            if size < 2:
                left.append((0, 0))  # nothing is left to cut; an empty piece is whole everywhere
            else:
                i = left.index(longest)
                left[i : i + 1] = [(at, size // 2), (at + size // 2, size - size // 2)]
    return left


def continued(line: str, sig: int, length: int, way: tuple[int, ...], probe: bool, edits: int) -> list[tuple[int, int]]:
    """(hash, number) of each piece after ``way``, where a line has it or, for a probe, where a partner's can lie.

    The pieces outnumber the edits, so one of them is whole in every alignment that keeps those of ``way``. What moved
    it and what moves the end back are edits of their own.
    """
    gap = len(line) - length
    moves = [s for s in range(-edits, edits + 1) if abs(s) + abs(gap - s) <= edits] if probe else [0]
    data = line.encode("utf-32-le", "surrogatepass")
    out = []
    for j, (at, size) in enumerate(pieces(length, edits, way)):
        seed = (sig + (j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
        for p in (at + s for s in moves):
            if 0 <= p and p + size <= len(line):
                out.append((xxhash.xxh3_64_intdigest(data[4 * p : 4 * (p + size)], seed), j))
    return list(dict.fromkeys(out))


def sketches(lines: list[str]) -> np.ndarray:
    """64 bits a line: whether each class of characters, and of pairs of neighbours, occurs an odd number of times."""
    n, codes = coded(lines)
    if not len(codes):
        return np.zeros(len(lines), np.int64)
    one = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= one[1:]
        for x, classes, before in ((one, ONES, 0), (two, TWOS, ONES)):  # each character's and pair's bit
            x *= np.uint64(0x9E3779B97F4A7C15)
            x >>= np.uint64(40)
            x *= np.uint64(classes)
            x >>= np.uint64(24)
            x += np.uint64(before)
            np.left_shift(np.uint64(1), x, out=x)
    end = np.cumsum(n)
    two[end[(end > 0) & (end < len(codes))] - 1] = 0  # no pair over two lines
    one[:-1] ^= two
    out = np.zeros(len(lines), np.uint64)
    out[n > 0] = np.bitwise_xor.reduceat(one, (end - n)[n > 0])
    return out.view(np.int64)


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two sketches allow for so many edits."""
    differ = a.bitwiseXOR(b)
    return (F.bit_count(differ.bitwiseAND(F.lit((1 << ONES) - 1))) <= 2 * edits) & (F.bit_count(F.shiftrightunsigned(differ, ONES)) <= 4 * edits)


def within_edits(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair's edit distance is at most ``edits``: Hyyro's bit vectors, cut to the band, for all pairs at once.

    Bit b of a column's vectors stands for the row b - edits below the diagonal's; the last bit's row is the column's
    number plus edits, where the distance is followed until the rows end, and then along the last row.
    """
    a = [p if len(p) >= len(q) else q for p, q in pairs]  # rows: the longer one
    b = [q if len(p) >= len(q) else p for p, q in pairs]
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    w = 2 * edits + 1
    full, top = np.uint64((1 << w) - 1), np.uint64(1 << (w - 1))
    rows = np.full((len(pairs), int(m.max(initial=0)) + 2 * edits + 1), 0xFFFFFFFF, np.uint32)  # no characters
    cols = np.full((len(pairs), int(n.max(initial=0)) + 1), 0xFFFFFFFE, np.uint32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        rows[i, edits : edits + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
        cols[i, : len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), "<u4")
    vp = np.full(len(pairs), ((1 << (edits + 1)) - 1) << edits, np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    dist = np.full(len(pairs), edits, np.int64)
    last = np.full(len(pairs), top >> np.uint64(1))
    one = np.uint64(1)
    for j in range(int(n.max(initial=0))):
        live = j < n
        x = np.zeros(len(pairs), np.uint64)
        for k in range(w):
            x |= (rows[:, j + k] == cols[:, j]).astype(np.uint64) << np.uint64(k)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        down = j < m - edits  # the last bit's row is still a row of the longer line
        dist += live & down & ((d0 & top) == 0)
        flat = live & ~down
        dist += flat & ((hp & last) != 0)
        dist -= flat & ((hn & last) != 0)
        last = np.where(flat, last >> one, last)
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = (d0 >> one) & hp
    return (dist <= edits) & (m - n <= edits)


def followed(a: str, b: str, edits: int) -> bool:
    """The same for one pair of long lines: how far each diagonal of the band gets with 0, 1, ... edits."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (a, b))

    def equal_from(i: int, j: int) -> int:
        """The end in ``x`` of what ``x`` from i and ``y`` from j have in common."""
        step = 64
        while i < len(x) and j < len(y):
            n = min(step, len(x) - i, len(y) - j)
            other = np.flatnonzero(x[i : i + n] != y[j : j + n])
            if len(other):
                return i + int(other[0])
            i, j, step = i + n, j + n, min(step * 4, 1 << 20)
        return i

    goal = len(x) - len(y)  # the diagonal on which both end
    reach = {0: equal_from(0, 0)}
    for e in range(edits + 1):
        if reach.get(goal, -1) >= len(x):
            return True
        further = {}
        for d in range(-e - 1, e + 2):  # by a changed, a dropped or an added character
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
            i = min(i, len(x), len(y) + d)
            if i >= max(0, d):
                further[d] = equal_from(i, i - d)
        reach = further
    return False


def near(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """``within_edits`` with bounded memory: pairs of like length together, long ones alone."""
    size = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    out, order = np.zeros(len(pairs), bool), np.argsort(size, kind="stable")
    at = 0
    while at < len(order) and size[order[at]] <= LONG:
        end = at + 1
        while end < len(order) and size[order[end]] <= LONG and (end + 1 - at) * size[order[end]] <= CELLS:
            end += 1
        out[order[at:end]] = within_edits([pairs[i] for i in order[at:end]], edits)
        at = end
    for i in order[at:]:
        out[i] = followed(*pairs[i], edits)
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers and keys of all lines that have characters."""
    for b in batches:
        for part in slices(b, "text"):
            of, nos, keys = [], [], []
            for i, t in enumerate(part["text"].to_pylist()):
                for no, line in enumerate((t or "").split("\n")):
                    if line:
                        of.append(i)
                        nos.append(no)
                        keys.append(key(line))
            k = np.array(keys, np.int64).reshape(-1, 2)
            own = [part[c].take(pa.array(of, pa.int64())) for c in ("anon", "doc", "th")]
            yield pa.record_batch([*own, pa.array(nos, pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["anon", "doc", "th", "line_no", "k1", "k2"])


def _texts(edits: int, least: int):
    """The lines that can be near others, with their keys; those a task remembers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for part in slices(b, "text"):
                keys, lines = [], []
                for t in part["text"].to_pylist():
                    for line in (t or "").split("\n"):
                        if allowed(len(line), edits, least) and (k := key(line)) not in seen:
                            if len(seen) < MEMORY:
                                seen.add(k)
                            keys.append(k)
                            lines.append(line)
                k = np.array(keys, np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(lines, pa.string())], names=["k1", "k2", "line"])

    return run


def _signature_rows(edits: int, least: int):
    """A row a line: its key, its sketch, and for each pass the hashes that it indexes and those that it looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "line", rows=4096, size=BLOCK):
                lines, sets = part["line"].to_pylist(), []
                for of, sig, _ in signed(lines, (False, True), edits, least):
                    for no in range(PASSES):
                        own = sig % np.uint64(PASSES) == no
                        ends = np.concatenate(([0], np.cumsum(np.bincount(of[own], minlength=len(lines))))).astype(np.int32)
                        sets.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(sig[own].view(np.int64))))
                yield pa.record_batch([part["k1"], pa.array(sketches(lines)), *sets], names=["k", "sketch", *SETS])

    return run


def _piece_rows(probe: bool, name: str, edits: int, least: int):
    """The next pieces of (sig, way, line); ``way`` is empty for a segment, else the shorter length and the numbers so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "line"):
                sigs, ways, n = [], [], []
                lines = part["line"].to_pylist()
                [(of, sig, tag)] = signed(lines, (probe,), edits, least)
                met = sig == part["sig"].to_numpy().view(np.uint64)[of]
                tags: dict[int, list[int]] = {}
                for i, t in zip(of[met].tolist(), tag[met].tolist(), strict=True):
                    tags.setdefault(i, []).append(t)
                for i, (line, sig, way) in enumerate(zip(lines, part["sig"].to_pylist(), part["way"].to_pylist(), strict=True)):
                    sig &= 2**64 - 1
                    begun = [way] if way else [[t & (1 << 40) - 1, t >> 40] for t in tags.get(i, ())]
                    before = len(sigs)
                    for length, *so_far in begun:
                        for h, j in continued(line, sig, length, tuple(so_far), probe, allowed(length, edits, least)):
                            sigs.append(h)
                            ways.append([length, *so_far, j])
                    n.append(len(sigs) - before)
                yield pa.record_batch(
                    [pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(np.repeat(part["k"].to_numpy(), n)), pa.array(np.repeat(sketches(lines), n)), pa.array(ways, pa.list_(pa.int64()))],
                    names=["sig", name, f"sketch_{name}", "way"],
                )

    return run


def _verified(edits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "line_a", "line_b", rows=4096, size=8_000_000):
                pairs = list(zip(part["line_a"].to_pylist(), part["line_b"].to_pylist(), strict=True))
                most = np.array([allowed(min(map(len, p)), edits, least) for p in pairs])
                ok = np.zeros(len(pairs), bool)
                for own in np.unique(most[most > 0]):
                    which = np.flatnonzero(most == own)
                    ok[which] = near([pairs[i] for i in which], int(own))
                names = ["a1", "a2", "b1", "b2"]
                yield pa.record_batch([part[c].filter(pa.array(ok)) for c in names], names=names)

    return run


def meetings(x, y, edits: int, last: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """(met, hot): the pairs x, y, a table a pass, that share a signature which at most ``MANY`` lines index and whose sketches allow for
    it, and the signatures that more do; at the ``last`` piece all meet. ``x`` and ``y`` give the rows of some passes."""
    hot = None
    if not last:
        hot = saved(x(*range(PASSES)).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("sig"), "hot-segments")
    met = (F.col("x") != F.col("y")) & alike(F.col("sketch_x"), F.col("sketch_y"), edits)
    found = []
    for no in range(PASSES):
        own = x(no) if last else among(x(no), hot, "sig", "left_anti")
        asked = y(no).withColumnRenamed("sig", "asked")
        found.append(saved(own.join(asked, (F.col("sig") == F.col("asked")) & met).select("x", "y"), "lines-met"))
    return found, hot


def near_links(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """(a, b): keys of different lines within the edits that the shorter one is allowed."""
    texts = saved(docs.select("text").mapInArrow(_texts(edits, least), "k1 long, k2 long, line string").dropDuplicates(["k1", "k2"]), "line-texts")
    kinds = ", ".join(f"{name} array<long>" for name in SETS)
    signs = saved(texts.select("k1", "line").mapInArrow(_signature_rows(edits, least), f"k long, sketch long, {kinds}"), "line-segments")

    def side(sets: str, name: str):
        """Rows of some passes: of the first signatures, each pass's have a column of their own."""
        return lambda *nos: signs.select(F.explode(F.concat(*(f"{sets}{no}" for no in nos))).alias("sig"), F.col("k").alias(name), F.col("sketch").alias(f"sketch_{name}"))

    def dealt(rows: DataFrame):
        """The same for pieces."""
        return lambda *nos: rows.drop("way").where(F.pmod("sig", F.lit(PASSES)).isin(*nos))

    x, y = side("own", "x"), side("look", "y")
    met, hot = meetings(x, y, edits, last=False)
    x, y = (rows(*range(PASSES)).withColumn("way", F.array().cast("array<long>")) for rows in (x, y))
    of = texts.select(F.col("k1").alias("k"), "line")
    used, found = [texts, signs, *met, hot], [*met]
    for no in range(1, PIECES + 1):
        if hot is None or hot.isEmpty():
            break
        more = lambda rows, probe, name: saved(
            among(rows, hot, "sig").select("sig", F.col(name).alias("k"), "way").join(of, "k").mapInArrow(_piece_rows(probe, name, edits, least), f"sig long, {name} long, sketch_{name} long, way array<long>"), "line-pieces"
        )
        x, y = more(x, False, "x"), more(y, True, "y")
        met, hot = meetings(dealt(x), dealt(y), edits, last=no == PIECES)
        used += [x, y, *met, *([] if hot is None else [hot])]
        found += met
    pairs = [m.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")) for m in found]
    pairs = saved(reduce(DataFrame.unionByName, pairs).distinct(), "line-pairs")
    one, two = (texts.select(F.col("k1").alias(x), F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("line").alias(f"line_{x}")) for x in "ab")
    links = pairs.join(one, "a").join(two, "b").select("a1", "a2", "b1", "b2", "line_a", "line_b").mapInArrow(_verified(edits, least), "a1 long, a2 long, b1 long, b2 long")
    links = saved(links.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("b")), "line-links")
    released(pairs, *used)
    return links


KIND = ["anon", "doc", "th"]


def kind_of(doc_id: str, text: str) -> list[Column]:
    """What tells rows apart, without nulls: a null id, the id, and the text's hash."""
    return [F.col(doc_id).isNull().alias("anon"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.col(text)).alias("th")]


def kind_decisions(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """anon, doc, th, n_lines, copies, dropped, n_near, lines: one row for each different (id, text).

    ``dropped`` holds for one of the equal rows, and the others lose all ``lines`` that have characters.
    """
    ship(docs.sparkSession)
    n_lines = F.greatest(F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0)), F.lit(0)).alias("n_lines")
    docs = docs.select(*kind_of(doc_id, text), F.col(text).alias("text"), n_lines)
    kinds = saved(docs.groupBy(*KIND).agg(F.count(F.lit(1)).alias("copies"), F.first("n_lines").alias("n_lines")), "line-rows")
    lines = saved(docs.select(*KIND, "text").mapInArrow(_lines, "anon boolean, doc long, th long, line_no int, k1 long, k2 long"), "lines")
    place = F.struct(*KIND, "line_no")
    equal = saved(lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "equal-lines")
    group = components(near_links(docs, edits, least), "line-classes")
    group = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).select("root", "node.k1", "node.k2")
    equal = equal.join(group, ["k1", "k2"], "left")
    heads = equal.where("root is not null").groupBy("root").agg(F.min("first").alias("head"))
    classed = equal.where("root is not null or n > 1").join(heads, "root", "left").select("k1", "k2", "first", F.coalesce("head", "first").alias("head"))
    classed = saved(classed, "classed-lines")
    found = lines.join(classed, ["k1", "k2"]).where(place != F.col("head")).select(*KIND, "line_no", (place == F.col("first")).alias("near"))
    found = found.groupBy(*KIND).agg(F.collect_set(F.struct("line_no", "near")).alias("d"))  # a document's own lines
    again = saved(kinds.where("copies > 1").select(*KIND), "repeated-rows")
    every = lines.join(again, KIND).groupBy(*KIND).agg(F.array_sort(F.collect_set("line_no")).alias("lines"))
    none = F.array().cast("array<int>")
    out = kinds.join(found, KIND, "left").join(every, KIND, "left")
    out = out.select(*KIND, "n_lines", "copies", F.coalesce(F.array_sort(F.col("d.line_no")), none).alias("dropped"), F.coalesce(F.size(F.filter("d", lambda x: x["near"])), F.lit(0)).alias("n_near"), F.coalesce("lines", none).alias("lines"))
    return out.withColumn("n_near", F.greatest("n_near", F.lit(0)))


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near, dropped (line numbers from 0) for every row.

    Lines are cut at line feeds; lines without characters stay. Null text has no lines, an empty text one. Every row
    is judged by itself, also where ids repeat or are null: lines go by id, rows without one last, then by text and
    number, and of equal rows one comes first. ``n_near`` counts the dropped lines that aren't equal to a kept or an
    earlier one. Very long lines are compared like others. An empty table gives no rows. Other columns, whatever
    their names, are not read. Integer ids only.
    """
    got = kind_decisions(docs, edits, least, doc_id, text)
    row = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("row")
    first = F.col("row") == 1
    out = got.select("*", row).select(
        F.when(~F.col("anon"), F.col("doc")).alias("doc_id"), "n_lines", F.when(first, F.col("dropped")).otherwise(F.col("lines")).alias("dropped"), F.when(first, F.col("n_near")).otherwise(F.lit(0)).alias("n_near")
    )
    return out.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "n_near", "dropped")


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with the dropped lines taken out of ``text``; null texts stay null."""
    row, kind, own = fresh(docs, "row", "kind", "own")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")  # written, so numbers stay
    got = kind_decisions(rows, edits, least, doc_id, text).where("size(dropped) > 0 or copies > 1")
    firsts = rows.groupBy(*kind_of(doc_id, text)).agg(F.min(row).alias("first"))
    got = got.join(firsts, KIND).select(F.struct(*KIND).alias(kind), F.struct("first", "dropped", "lines").alias(own))
    got = saved(got, "line-decisions")
    gone = F.when(F.col(own)["first"] == F.col(row), F.col(own)["dropped"]).otherwise(F.col(own)["lines"])
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    joined = among(rows.withColumn(kind, F.struct(*kind_of(doc_id, text))), got, kind, "left")
    return joined.withColumn(text, F.when(F.col(own).isNull(), F.col(text)).otherwise(kept)).select(docs.columns)
