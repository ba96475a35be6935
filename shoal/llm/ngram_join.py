"""N-gram Jaccard self-join by a token-group matrix, down to connected components.

A document is its set of distinct word shingles. Sets that are equal collapse first. The matrix's tokens are
*bands*: for each slot of set sizes the shingle space is cut into so many parts that two sets of the needed
similarity differ in fewer parts than each has filled ones; what is left over, ``need`` parts, they hold alike.
A band is everything a document has in a part, so a shared passage alone makes few.

Bands of more than ``COMMON`` documents are common. A document with fewer common bands than it needs shares an
uncommon one with each partner and leaves its common ones out; only the others, such as members of large families
of near copies, meet over common bands.

1. Documents that share enough bands with the least document of these bands are checked against it: a star, not
   all pairs. The checked links' components are the groups of similar documents.
2. What still meets in a band across components is dealt into groups of similar documents, and the matrix holds
   each group's union of bands. A document's overlap with the union bounds its equal bands with each member: only
   groups where it reaches ``need`` are opened. In an opened group the union of the members' shingles bounds the
   overlap once more before the members are compared.

Both rounds compare whole texts, exactly. No link between different texts is lost; links
inside a group that is connected already aren't needed and aren't looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import among, saved, ship, slices
from shoal.llm.hashing import P, Q, lowered, mixed, word_hashes

#: Size classes widen by this; parts are so many times the differences, so that partners share a good part of them.
WIDEN, SPARE = 1.38, 1.35
#: A band of more documents than this is common. It is used only between documents that have too many common ones.
COMMON = 32
#: Documents in a group of the matrix, and documents that one task looks up in a group.
GROUP, ASKING = 256, 512
#: Bytes of the members' texts of a group, beyond one member, and of those that one task looks up in it.
BYTES = 64_000_000


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one after the other, and where each text's begin.

    Words are lower-cased in A-Z only. With fewer words than ``width`` the whole sequence is the one shingle.
    """
    n_docs = len(texts)
    word, doc = word_hashes(lowered(texts))
    if not len(word):
        return np.empty(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    with np.errstate(over="ignore"):
        count = np.bincount(doc, minlength=n_docs)
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        place = np.arange(len(word)) - first[doc]
        h = np.zeros(len(word), np.uint64)
        reach = np.minimum(width, count)[doc]  # shorter texts: all words
        for i in range(width):
            moved = np.zeros_like(word)
            moved[: len(word) - i] = word[i:]
            h = np.where(i < reach, mixed(h * Q + moved + np.uint64(i + 1)), h)
        valid = place <= count[doc] - reach
    h, doc = h[valid], doc[valid]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs))))


def class_bounds(most: int, widen: float = WIDEN) -> list[int]:
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(int(bounds[-1] * widen), bounds[-1]) + 1)
    return bounds


class Slots:
    """Which slots a set size belongs to, and each slot's parts.

    Slot j serves pairs of class j, and of classes j-1 and j. Sizes may differ by at most 1/0.85, classes are wider,
    so partners lie in the same class or the next. ``differ`` is the most elements in which a pair of the slot with
    num/den similarity can differ: |A|+|B|-2I with den*I >= num*U, so (den-num)/(den+num) of |A|+|B|.
    """

    def __init__(self, num: int, den: int, most: int):
        self.num, self.den = num, den
        self.bounds = class_bounds(most, max(WIDEN, 1.02 * den / num))

    def differ(self, slot: int) -> int:
        top = self.bounds[slot + 1] - 1
        return (self.den - self.num) * 2 * top // (self.den + self.num)

    def parts(self, slot: int) -> int:
        d = self.differ(slot)
        return 1 if not d else max(d + 1, int(d * SPARE) + 2)

    def of(self, n: int) -> list[int]:
        j = int(np.searchsorted(self.bounds, n, "right")) - 1
        own = [j]
        # in the next slot only if a set of the next class can be similar enough
        if j + 1 < len(self.bounds) - 1 and n * self.den >= self.num * self.bounds[j + 1]:
            own.append(j + 1)
        return own


def bands(h: np.ndarray, slots: Slots) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Per slot of the set: the band tokens of its filled parts, and (slot, how many equal ones a partner must have).

    Where empty parts are so many that a partner might share no filled one, the set is *poor* in that slot: a partner
    that isn't poor still shares one of its own bands, so only poor pairs could be missed. Poor sets therefore also
    give, in a space of their own, the tokens of their prefix in hash order, the usual exact filter.
    """
    out, needs = [], []
    n = len(h)
    for slot in slots.of(n):
        k, d = slots.parts(slot), slots.differ(slot)
        salt = np.uint64(slot * 2 + 1)
        if k == 1:
            continue  # only equal sets are similar enough, and those have collapsed
        with np.errstate(over="ignore"):
            x = mixed(h * Q + salt)
            part = ((x >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            total = np.zeros(k, np.uint64)
            np.add.at(total, part, mixed(x + P))
            size = np.bincount(part, minlength=k)
            filled = np.flatnonzero(size)
            token = mixed(mixed(total[filled] + size[filled].astype(np.uint64) * P) + filled.astype(np.uint64) * Q + salt)
        need = len(filled) - d
        if need < 1:
            with np.errstate(over="ignore"):
                prefix = np.sort(mixed(x))[: n - -(-slots.num * n // slots.den) + 1]
                token = np.concatenate((token, mixed(prefix + Q * salt)))
        out.append(token)
        needs.append((slot, max(1, need)))
    return out, needs


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                h, at = shingle_sets(part["text"].to_pylist(), width)
                own = [h[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
                with np.errstate(over="ignore"):
                    sums = [(int(x.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(x + Q)).view(np.int64)) if len(x) else 0) for x in own]
                yield pa.record_batch(
                    [part["doc_id"], pa.array(np.diff(at), pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())],
                    names=["doc_id", "n_shingles", "s1", "s2"],
                )

    return run


def _band_rows(width: int, num: int, den: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(num, den, most)
        for b in batches:
            for part in slices(b, "text"):
                h, at = shingle_sets(part["text"].to_pylist(), width)
                ids = part["doc_id"].to_numpy(zero_copy_only=False)
                tokens, docs, need = [], [], []
                for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if e > s:
                        for t, (_, least) in zip(*bands(h[s:e], slots), strict=True):
                            tokens.append(t)
                            docs.append(np.full(len(t), ids[k], np.int64))
                            need.append(np.full(len(t), least, np.int32))
                if tokens:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(need))],
                        names=["token", "doc", "need"],
                    )

    return run


def _check_pairs(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text_a", "text_b"):
                (ha, aa), (hb, ab) = (shingle_sets(part[c].to_pylist(), width) for c in ("text_a", "text_b"))
                ok = [similar(ha[aa[k] : aa[k + 1]], hb[ab[k] : ab[k + 1]], num, den) for k in range(part.num_rows)]
                keep = pa.array(ok, pa.bool_())
                yield pa.record_batch([part["a"].filter(keep), part["b"].filter(keep)], names=["a", "b"])

    return run


def checked(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough. Texts travel to the pairs; hot ids can be split."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_check_pairs(width, num, den), "a long, b long")


def grouped(named: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, comp, gid): groups of about ``GROUP`` documents or ``BYTES`` that share bands and, as far as it goes, a
    component. ``sizes`` has the bytes of each (doc_id)."""
    own = named.groupBy("doc").agg(F.first("comp").alias("comp"), F.min("lead").alias("family"))
    own = saved(own.join(sizes.select(F.col("doc_id").alias("doc"), "bytes"), "doc"), "families")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("bytes") / BYTES))
    sized = own.join(own.groupBy("comp").agg(parts.alias("comp_n")), "comp").join(own.groupBy("family").agg(parts.alias("family_n")), "family")
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n))
    gid = F.when(F.col("comp_n") > 1, F.xxhash64(F.lit("c"), "comp", part("doc", "comp_n"))).otherwise(F.xxhash64(F.lit("f"), "family", part("comp", "family_n")))
    return saved(sized.select("doc", "comp", gid.alias("gid")), "groups")


def qualifying(named: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, comp, gid) of the groups to open for each document, and the members of all groups."""
    members = grouped(named, sizes)
    rows = named.select("token", "doc", "need", "comp").join(members.select("doc", "gid"), "doc")
    matrix = rows.select("token", "gid").distinct()
    whole = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    met = rows.drop("gid").join(matrix, "token").groupBy("doc", "need", "comp", "gid").agg(F.count(F.lit(1)).alias("overlap")).where("overlap >= need")
    # A group that is all of the document's own component has nothing new for it.
    met = met.join(whole, "gid").where("not (lo = hi and lo = comp)").select("doc", "comp", "gid").distinct()
    return saved(met, "opened"), members


def _search(width: int, num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        member = np.asarray(group["member"].to_numpy(zero_copy_only=False), bool)
        docs, comps, texts = group["doc"].to_numpy(), group["comp"].to_numpy(), group["text"].to_pylist()
        h, at = shingle_sets(texts, width)
        size = np.diff(at)
        inside, asking = np.flatnonzero(member), np.flatnonzero(~member)
        # The union of the members' shingles, and each shingle's members.
        owner = np.repeat(np.arange(len(inside)), size[inside])
        own = np.concatenate([h[at[i] : at[i + 1]] for i in inside]) if len(inside) else h[:0]
        order = np.argsort(own, kind="stable")
        own, owner = own[order], owner[order]
        a, b = [], []
        up: dict[int, int] = {}  # components that this task has connected

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for q in asking:
            mine = h[at[q] : at[q + 1]]
            lo, hi = np.searchsorted(own, mine), np.searchsorted(own, mine, "right")
            if den * int((hi > lo).sum()) < num * len(mine):  # the bound: no member can have more of it than the union
                continue
            n = hi - lo
            spots = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[spots], minlength=len(inside))
            ok = (den * both >= num * (len(mine) + size[inside] - both)) & (both > 0) & (comps[inside] != comps[q])
            for c, first in zip(*np.unique(comps[inside[ok]], return_index=True), strict=True):  # one link to each component
                x, y = top(int(c)), top(int(comps[q]))
                if x != y:  # and none to what is connected already
                    up[max(x, y)] = min(x, y)
                    a.append(docs[q])
                    b.append(docs[inside[ok][first]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def searched(opened: DataFrame, members: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between documents and members of the groups opened for them, of each task as many as it takes to
    connect what it finds linked: less than one a document and task.

    A task has one group and at most about ``ASKING`` of the documents that ask for it, or ``BYTES`` of their texts.
    """
    text = texts.select(F.col("doc_id").alias("doc"), "text")
    size = text.groupBy("doc").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sums = opened.join(size, "doc").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    asked = sums.select("gid", F.greatest(F.ceil(F.col("n") / ASKING), F.ceil(F.col("bytes") / BYTES)).cast("int").alias("parts"))
    own = members.join(asked, "gid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("gid", "part", "doc", "comp", F.lit(True).alias("member"))
    asking = opened.join(asked, "gid").select("gid", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), "doc", "comp", F.lit(False).alias("member"))
    rows = own.unionByName(asking).join(text, "doc")
    return rows.groupBy("gid", "part").applyInArrow(_search(width, num, den), "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node that isn't a root itself: alternating large and small stars.

    Each round is two aggregations and joins on the links; the links are written between rounds.
    """
    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        same = new.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(new, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise ValueError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def ngram_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; links are pairs with den * intersection >= num * union.

    Null, empty and wordless texts have an empty set, link with nothing and are their own component. Rows that
    repeat an id are one node. Rows with a null id are compared with nothing and have a null component. Very long texts
    are compared whole, few at a time in a task. An empty table gives no rows. Other columns, whatever their names, are
    not read. Integer ids only.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = saved(source.mapInArrow(_describe(width), "doc_id long, n_shingles long, s1 long, s2 long"), "sets")
    equal = sets.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    equal = saved(equal, "equal-sets")
    most = equal.agg(F.max("n_shingles")).first()[0]
    if most is None:
        return sets.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # One text for each distinct set goes on.
    reps = among(source, saved(equal.select(F.col("rep").alias("doc_id")).distinct(), "reps"), "doc_id")
    rows = reps.mapInArrow(_band_rows(width, num, den, most), "token long, doc long, need int")
    bucket = Window.partitionBy("token")
    rows = saved(rows.withColumn("size", F.count(F.lit(1)).over(bucket)).where("size > 1"), "bands")
    # How many of its bands in a slot are common, and what a partner must then share of those that are used.
    each = rows.groupBy("doc", "need").agg(F.count_if(F.col("size") > COMMON).alias("common")).where("common > 0")
    rows = rows.join(each, ["doc", "need"], "left").na.fill(0, ["common"])
    busy = F.col("common") >= F.col("need")
    rows = rows.where((F.col("size") <= COMMON) | busy).select("token", "doc", F.when(busy, F.col("need")).otherwise(F.col("need") - F.col("common")).alias("need"))
    rows = rows.withColumn("least", F.min("doc").over(bucket)).withColumn("last", F.max("doc").over(bucket)).where("least < last")
    rows = saved(rows.select("token", "doc", "need", "least"), "used-bands")
    star = rows.where("doc > least").groupBy("doc", "need", "least").agg(F.count(F.lit(1)).alias("n")).where("n >= need")
    star = saved(star.select(F.col("doc").alias("a"), F.col("least").alias("b")).distinct(), "star-pairs")
    wanted = saved(among(reps, saved(ends(star), "candidates"), "doc_id"), "star-texts")
    links = saved(checked(star, wanted, width, num, den), "star-links")
    group = components(links)

    # Bands in which documents of two components meet; the rest has nothing left to find.
    named = rows.select("token", "doc", "need").join(group.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
    named = named.withColumn("lo", F.min("comp").over(bucket)).withColumn("hi", F.max("comp").over(bucket)).where("lo < hi")
    named = saved(named.select("token", "doc", "need", "comp", F.min("doc").over(bucket).alias("lead")), "cross-bands")
    if not named.isEmpty():
        crossing = saved(named.select(F.col("doc").alias("doc_id")).distinct(), "cross-candidates")
        wanted = saved(among(reps, crossing, "doc_id"), "cross-texts")
        opened, members = qualifying(named, wanted.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes")))
        links = links.unionByName(saved(searched(opened, members, wanted, width, num, den), "cross-links"))
        group = components(links, "all-components")
    copies = sets.where("doc_id is not null and n_shingles > 0").join(equal.drop("copies"), ["n_shingles", "s1", "s2"])
    # Rows that repeat an id with other texts tie their sets together.
    twice = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    if not twice.isEmpty():
        group = components(links.unionByName(twice), "tied-components")
    final = saved(equal.join(group.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "s1", "s2", F.coalesce("root", "rep").alias("component_id")), "set-components")
    out = sets.join(final, ["n_shingles", "s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
