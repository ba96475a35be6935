"""Benchmark decontamination by template canonicalisation.

Words with digits, units and names become typed placeholders, so a question with other figures or people keeps its
template; a word is typed by its own letters, wherever it stands. Windows of template words are hash-joined with the
benchmark's; a document that covers an item, or holds a long run of it, is a candidate, and the values that fill the
placeholders of an occurrence, which is where the item begins in the document, must be consistent: each value of the
item stands for one value there, wherever it recurs (two of the item may become one). Other occurrences don't count, but
those that hold enough of the item's own words do. A copy all in capitals or small letters is met by an item's form
without names. Items of too few windows are looked for as a whole, by their own words. In scripts without spaces every
character is a word, and a run must be twice as long. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import MOST_KEYS, among, fresh, saved, text_or_empty

#: Words a window, the part of an item's windows that makes a leak, the words in a row that do, and the least
#: literal words of a window that counts: windows of figures and names alone would match any table.
WINDOW, COVERAGE, RUN, LITERAL = 5, 0.8, 13, 3
#: Items of fewer windows are found whole: one window less would be less than COVERAGE. Their first so many words are
#: joined, the others compared.
FEW, ANCHOR = 5, 8
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
NAME, NUMBER, UNIT, MARK = "\x01", "\x02", "\x03", "\x04"
#: Unit words, in order of kind.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons cup cups "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degrees celsius fahrenheit "
    "w kw watt watts v volt volts hz khz mhz ghz kb mb gb tb mph kmh"
).split()


def spaced(text: Column) -> Column:
    """The text with spaces around every character of scripts without spaces; all of those lie beyond U+0E00."""
    return F.when(text.rlike(r"[\x{E00}-\x{10FFFF}]"), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)


def template(text: Column) -> Column:
    """The spaced text with each word typed or reduced to its lower-cased letters; words stay words, one for one."""
    t = F.regexp_replace(spaced(text), r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?!\p{L})", NAME)
    t = F.regexp_replace(F.lower(t), r"(?<!\S)[^\s\d]*+\d\S*", NUMBER)
    t = F.regexp_replace(t, rf"(?<!\S)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)
    t = F.regexp_replace(t, r"(?<!\S)[^\p{L}\p{N}\s\x01-\x03]++(?!\S)", MARK)
    return F.regexp_replace(t, r"[^\p{L}\p{N}\s\x01-\x04]++", "")


def words(text: Column) -> Column:
    """Its words in order; none for a text of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def plain(text: Column) -> Column:
    """Its words without case and marks, every character of scripts without spaces apart."""
    return words(F.regexp_replace(spaced(F.lower(text)), r"[^\p{L}\p{M}\p{N}\s]++", ""))


def paired(a: Column, b: Column, ahead: int) -> Column:
    """Hashes of a[i] with b[i + ahead], as far as both go."""
    n = F.greatest(F.lit(0), F.size(b) - ahead)
    return F.zip_with(F.slice(a, 1, n), F.slice(b, ahead + 1, n), lambda x, y: F.xxhash64(x, y))


def windows(ws: DataFrame, column: str, width: int) -> DataFrame:
    """``ws`` with ``h``: the hash of each window of ``width`` words of ``column``, by doubling."""
    parts, have, done, name = [], 1, 0, f"{column}_1"
    ws = ws.withColumn(name, F.transform(column, lambda w: F.xxhash64(w)))
    left = width
    while True:
        if left & 1:
            parts.append((name, have))
        left >>= 1
        if not left:
            break
        ws = ws.withColumn(f"{column}_{have * 2}", paired(F.col(name), F.col(name), have))
        have *= 2
        name = f"{column}_{have}"
    (first, done), *rest = parts[::-1]
    h = F.col(first)
    for name, size in rest:
        h = paired(h, F.col(name), done)
        done += size
    return ws.withColumn("h", h)


def longest_run(places: Column) -> Column:
    """The length of the longest run of consecutive integers in an ascending array."""
    zero = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, p: Column) -> Column:
        now = F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(places, zero, step, lambda acc: acc["best"])


def long_enough(typed: Column) -> Column:
    """The words in a row that make a leak of an item with these words: more where they are single characters."""
    single = F.filter(typed, lambda w: w.rlike(f"^{UNSPACED}$"))
    return F.when(F.size(single) * 2 > F.size(typed), F.lit(2 * RUN)).otherwise(F.lit(RUN))


def reached(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """row, item, coverage, run where the places of all rows of ``runs`` make a leak of the item."""
    each = runs.groupBy("row", "item").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("got"), F.max("run").alias("run"))
    found = each.join(totals, "item").withColumn("coverage", F.size("got") / F.col("windows")).where((F.col("coverage") >= COVERAGE) | (F.col("run") >= F.col("reach")))
    return found.select("row", "item", "coverage", "run")


def whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, item, run where a document holds an item's words in a row: of (row, d_text) and (item, b_text).

    Items without a letter are left out: they would match any table of figures.
    """
    items = items.where(F.col("b_text").rlike(r"\p{L}")).select("item", plain(F.col("b_text")).alias("ws")).where(F.size("ws") > 0)
    items = saved(items, "few-windows").withColumn("size", F.least(F.size("ws"), F.lit(ANCHOR)))
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    keys = items.select("item", "size", "ws", F.xxhash64(F.get("ws", F.lit(0))).alias("first"), F.xxhash64("size", hashes(F.slice("ws", 1, F.col("size")))).alias("h"))
    keys = saved(keys, "item-anchors")
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())  # at most ANCHOR
    kinds = {f.name: f.dataType for f in [*docs.schema, *keys.schema]}
    if not sizes:
        return docs.select("row", F.lit(None).cast(kinds["item"]).alias("item"), F.lit(0).alias("run")).where("false")
    # Only places where some item's first word stands go on, each with the words from there on, not the text's.
    longest = keys.agg(F.max(F.size("ws"))).first()[0]
    own = docs.select("row", plain(text_or_empty("d_text")).alias("own"))
    places = own.select("row", "own", F.posexplode_outer(hashes("own")).alias("at", "first"))
    places = among(places, saved(keys.select("first").distinct(), "first-words"), "first").select("row", F.slice("own", F.col("at") + 1, longest).alias("here"))
    anchors = F.array(*[F.when(F.size("here") >= n, F.xxhash64(F.lit(n), hashes(F.slice("here", 1, n)))) for n in sizes])
    spots = places.select("row", "here", F.explode_outer(anchors).alias("h"))
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    hits = spots.join(F.broadcast(keys) if few else keys, "h").where(F.slice("here", 1, F.size("ws")) == F.col("ws"))
    return hits.groupBy("row", "item").agg(F.max(F.size("ws")).alias("run"))


def row_kind(key: str, text: str) -> Column:
    """What tells rows apart, without nulls: a null key, the key, and the text's hash."""
    return F.struct(F.col(key).isNull().alias("anon"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"))


def leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """row, item, coverage, run, n_slots, n_changed: rows of documents as ``row_kind``, and so items, with their form."""
    # Names are known by their capitals, so an item has a second form without them: a copy in one case shows none.
    b = benchmark.select(row_kind(item_id, item_text).alias("item"), F.col(item_text).alias("b_text"))
    forms = F.array_distinct(F.array(words(template(text_or_empty("b_text"))), words(template(F.lower(text_or_empty("b_text"))))))
    b = b.select("item", "b_text", F.posexplode(forms).alias("form", "typed"))
    typed = windows(b.select(F.struct("item.*", "form").alias("item"), "b_text", "typed", words(spaced(text_or_empty("b_text"))).alias("raw")), "typed", width)
    b = saved(typed.select("item", "b_text", "typed", "raw", "h").dropDuplicates(["item"]), "items")
    literal = F.size(F.filter(F.slice("typed", F.col("at") + 1, width), lambda w: ~w.rlike("^[\x01-\x04]$")))
    keys = b.select("item", "typed", F.posexplode("h").alias("at", "h")).where(literal >= min(LITERAL, width)).select("h", "item", F.col("at").alias("item_at"))
    keys = saved(keys, "item-windows")
    reach = b.select("item", long_enough(F.col("typed")).alias("reach"))
    totals = saved(keys.groupBy("item").agg(F.count(F.lit(1)).alias("windows")).join(reach, "item"), "item-totals")
    d = docs.select(row_kind(doc_id, text).alias("row"), F.col(text).alias("d_text"))
    own = windows(d.select("row", words(template(text_or_empty("d_text"))).alias("typed")), "typed", width)
    # Outer: the plain form would also filter on the array's size and so evaluate all of the above once more.
    own = own.select("row", F.posexplode_outer("h").alias("at", "h"))
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    hits = own.join(F.broadcast(keys) if few else keys, "h").select("row", "item", "item_at", (F.col("at") - F.col("item_at")).alias("shift"))
    # One row a document, item and shift, with at most an item's places in it.
    runs = hits.groupBy("row", "item", "shift").agg(F.array_sort(F.collect_set("item_at")).alias("places"))
    runs = saved(runs.withColumn("run", longest_run(F.col("places")) + (width - 1)), "runs")
    found = saved(reached(runs, totals), "candidates")

    # What fills the placeholders, for candidates only.
    wanted = saved(found.select("row").distinct(), "candidate-docs")
    texts = among(d, wanted, "row").dropDuplicates(["row"]).select("row", words(spaced(text_or_empty("d_text"))).alias("d_raw"))
    long = runs.join(found.select("row", "item"), ["row", "item"], "left_semi").where("run >= %d" % (width + 2))
    bare = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    long = saved(long.join(b.select("item", "raw", "typed"), "item").join(texts, "row").select("row", "item", "shift", "places", "raw", "typed", F.transform("raw", lambda w, i: bare(F.get("d_raw", i + F.col("shift").cast("int")))).alias("here")), "occurrences")
    # An occurrence's own words, by place; they decide alone where they are enough.
    same = F.transform("raw", lambda w, i: F.coalesce(bare(w) == F.get("here", i), F.lit(False)))
    own = F.filter(F.transform("same", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    alike = long.withColumn("same", same).where((F.size(own) >= COVERAGE * F.size("same")) | (longest_run(own) >= long_enough(F.col("typed")))).select("row", "item", "shift")
    cover = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (width - 1)))))
    slot = F.transform(cover, lambda p: F.struct(F.get("typed", p).alias("typed"), bare(F.get("raw", p)).alias("was"), F.get("here", p).alias("is")))
    filled = long.select("row", "item", "shift", F.explode(F.filter(slot, lambda x: x["typed"].rlike("^[\x01-\x03]$"))).alias("s")).select("row", "item", "shift", "s.was", "s.is")
    images = filled.groupBy("row", "item", "shift", "was").agg(F.countDistinct("is").alias("images"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("was").eqNullSafe(F.col("is"))).alias("changed"))
    judged = saved(images.groupBy("row", "item", "shift").agg(F.max("images").alias("images"), F.sum("n").alias("n_slots"), F.sum("changed").alias("n_changed")), "judged")
    wrong = saved(judged.where("images > 1").join(alike, ["row", "item", "shift"], "left_anti").select("row", "item", "shift"), "inconsistent")
    right = reached(runs.join(found.select("row", "item"), ["row", "item"], "left_semi").join(wrong, ["row", "item", "shift"], "left_anti"), totals)
    counts = judged.join(wrong, ["row", "item", "shift"], "left_anti").groupBy("row", "item").agg(F.sum("n_slots").alias("n_slots"), F.sum("n_changed").alias("n_changed"))
    out = right.join(counts, ["row", "item"], "left").na.fill(0, ["n_slots", "n_changed"]).select("row", "item", "coverage", F.col("run").cast("int"), "n_slots", "n_changed")
    scarce = saved(b.where("item.form = 0").select("item", text_or_empty("b_text").alias("b_text")).join(totals.where(F.col("windows") >= FEW), "item", "left_anti"), "scarce")
    if scarce.isEmpty():
        return out
    more = whole(d, scarce).select("row", "item", F.lit(1.0).alias("coverage"), F.col("run").cast("int"), F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed"))
    both = out.unionByName(more).groupBy("row", "item")
    return both.agg(*[F.max(c).alias(c) for c in ("coverage", "run", "n_slots", "n_changed")])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id, item_id, coverage, run, n_slots, n_changed: one row for each document and item that it leaks.

    Null and empty texts leak nothing; so do items without a letter whose windows have too few literal words. Items of
    fewer than ``FEW`` windows that count are also found by all of their words in a row, unchanged. Every row is judged by
    its own text, also where ids repeat or are null; what rows of one id leak is reported once, with the most of each
    figure, and so are items of one id. Ties don't arise. Very long texts are taken whole. Empty tables give no rows.
    Other columns, whatever their names, are not read.
    """
    got = leaking(docs, benchmark, doc_id, text, item_id, item_text, width).groupBy(F.col("row.id").alias("doc_id"), F.col("item.id").alias("item_id"))
    return got.agg(*[F.max(c).alias(c) for c in ("coverage", "run", "n_slots", "n_changed")])


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, whose own text leaks no item."""
    (row,) = fresh(docs, "row")
    bad = saved(leaking(docs, benchmark, doc_id, text).select(F.col("row").alias(row)).distinct(), "leaking")
    return among(docs.withColumn(row, row_kind(doc_id, text)), bad, row, "left_anti").drop(row)
