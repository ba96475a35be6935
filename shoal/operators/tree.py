"""Binary layout trees as path tables: tab, path, id, direction, size0, size1.

A path is ``r`` followed by 0s and 1s; leaves have an id, splits a direction and two sizes. Reading order is path
order. Edits come as tables with at most one edit a tab, so that all tabs are edited in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 0.1
FIELDS = ("path", "id", "direction", "size0", "size1")


def row(path: Column, id_: Column, direction: Column, size0: Column, size1: Column) -> Column:
    return F.struct(path.alias("path"), id_.cast("string").alias("id"), direction.cast("string").alias("direction"), size0.cast("double").alias("size0"), size1.cast("double").alias("size1"))


def leaf(df: DataFrame, tab: str, id_: str) -> DataFrame:
    """One-leaf trees."""
    return df.select(F.col(tab).alias("tab"), F.inline(F.array(row(F.lit("r"), F.col(id_), F.lit(None), F.lit(None), F.lit(None)))))


def split_leaves(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: tab, target, new_id, direction. The target leaf becomes a half-and-half split of itself and the new
    leaf; a direction other than row and column is row, an absent target changes nothing, and a tab without a tree
    gets one of the new leaf."""
    none = F.lit(None)
    e = edits.select(F.col("tab").alias("_tab"), "target", "new_id", F.col("direction").alias("_dir"))
    j = tree.join(e, (F.col("tab") == F.col("_tab")) & (F.col("id") == F.col("target")), "left")
    way = F.when(F.col("_dir") == "column", "column").otherwise("row")
    p = F.col("path")
    three = F.array(row(p, none, way, F.lit(0.5), F.lit(0.5)), row(F.concat(p, F.lit("0")), F.col("id"), none, none, none), row(F.concat(p, F.lit("1")), F.col("new_id"), none, none, none))
    own = F.array(row(p, F.col("id"), F.col("direction"), F.col("size0"), F.col("size1")))
    edited = j.select("tab", F.inline(F.when(F.col("_tab").isNotNull(), three).otherwise(own)))
    return edited.unionByName(leaf(edits.join(tree.select("tab").distinct(), "tab", "left_anti"), "tab", "new_id"))


def remove_leaves(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: tab, target. The target goes and its sibling takes their parent's place; a last leaf leaves no rows."""
    at = tree.join(edits.select("tab", F.col("target").alias("id")), ["tab", "id"]).select(F.col("tab").alias("_tab"), F.col("path").alias("_p"))
    j = tree.join(at, F.col("tab") == F.col("_tab"), "left")
    p, q = F.col("_p"), F.expr("substring(_p, 1, length(_p) - 1)")
    sibling = F.concat(q, F.when(p.endswith("0"), "1").otherwise("0"))
    gone = F.coalesce((F.col("path") == p) | (F.col("path") == q), F.lit(False))
    moved = F.when(F.coalesce(F.col("path").startswith(sibling), F.lit(False)), F.concat(q, F.substr(F.col("path"), F.length(p) + 1))).otherwise(F.col("path"))
    return j.where(~gone).select("tab", moved.alias("path"), *FIELDS[1:])


def resize(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: tab, path, ratio. Clamped to [0.1, 0.9] and rounded to 4 places; leaves and unknown paths stay."""
    j = tree.join(edits.select("tab", "path", "ratio"), ["tab", "path"], "left")
    r = F.floor(F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), "ratio")) * 10000 + 0.5) / 10000
    hit = F.col("ratio").isNotNull() & F.col("id").isNull()
    other = F.floor((1 - r) * 10000 + 0.5) / 10000
    return j.select("tab", "path", "id", "direction", F.when(hit, r).otherwise(F.col("size0")).alias("size0"), F.when(hit, other).otherwise(F.col("size1")).alias("size1"))


def leaves(tree: DataFrame) -> DataFrame:
    """tab, id, ordinal: leaves in reading order."""
    w = Window.partitionBy("tab").orderBy("path")
    return tree.where("id is not null").select("tab", "id", (F.row_number().over(w) - 1).alias("ordinal"))


def leaf_counts(tree: DataFrame) -> DataFrame:
    """tab, n_leaves, many: whether a tab has more than one leaf."""
    n = tree.groupBy("tab").agg(F.count_if(F.col("id").isNotNull()).alias("n_leaves"))
    return n.withColumn("many", F.col("n_leaves") > 1)


def first_leaf(tree: DataFrame) -> DataFrame:
    return tree.where("id is not null").groupBy("tab").agg(F.min_by("id", "path").alias("id"))


def contains(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of (tab, id) that are leaves of the tree."""
    return wanted.join(tree.where("id is not null").select("tab", "id"), ["tab", "id"], "left_semi")


def neighbour_of(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """tab, id, neighbour for the (tab, id) asked for that exist."""
    w = Window.partitionBy("tab").orderBy("path")
    near = F.coalesce(F.lead("id").over(w), F.lag("id").over(w)).alias("neighbour")
    return tree.where("id is not null").select("tab", "id", near).join(wanted.select("tab", "id"), ["tab", "id"])


def rectangles(tree: DataFrame) -> DataFrame:
    """tab, id, x, y, width, height of each leaf in the unit square: ratios multiplied along its path.

    Each leaf meets its own ancestors only: their paths are the prefixes of its path.
    """
    lf = tree.where("id is not null").select("tab", "id", F.col("path").alias("leaf"))
    steps = lf.withColumn("n", F.explode_outer(F.when(F.length("leaf") > 1, F.sequence(F.lit(1), F.length("leaf") - 1)))).withColumn("path", F.expr("substring(leaf, 1, n)"))
    s = tree.where("id is null").select("tab", "path", "direction", "size0", "size1")
    j = steps.join(s, ["tab", "path"], "left")
    second = F.expr("substring(leaf, n + 1, 1) = '1'")
    step = F.struct(F.col("n"), (F.col("direction") == "row").alias("row"), second.alias("second"), F.col("size0").alias("a"), F.col("size1").alias("b"))
    path = F.array_sort(F.collect_list(F.when(F.col("direction").isNotNull(), step)))
    zero = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in (("x", 0), ("y", 0), ("width", 1), ("height", 1))])

    def fold(acc: Column, s: Column) -> Column:
        own = F.when(s["second"], s["b"]).otherwise(s["a"]) / (s["a"] + s["b"])
        skip = F.when(s["second"], s["a"] / (s["a"] + s["b"])).otherwise(F.lit(0.0))
        return F.struct(
            F.when(s["row"], acc["x"] + acc["width"] * skip).otherwise(acc["x"]).alias("x"),
            F.when(s["row"], acc["y"]).otherwise(acc["y"] + acc["height"] * skip).alias("y"),
            F.when(s["row"], acc["width"] * own).otherwise(acc["width"]).alias("width"),
            F.when(s["row"], acc["height"]).otherwise(acc["height"] * own).alias("height"),
        )

    return j.groupBy("tab", "id").agg(path.alias("steps")).select("tab", "id", F.aggregate("steps", zero, fold).alias("box")).select("tab", "id", "box.*")


def from_nested(layouts: DataFrame, tab: str, layout: str) -> DataFrame:
    """Path tables from nested layouts as JSON texts: ``{"type": "leaf", "id": …}`` or ``{"type": "split", "direction": …,
    "children": [a, b], "sizes": [x, y]}``.

    A text is parsed once, and its tree is opened level by level within its row, without a shuffle or a job a level. A node
    that is neither is left out with all below it; so is a text that isn't JSON, and a null. Sizes that are missing are null.
    """
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    child = lambda n, i: node(F.concat(n["path"], F.lit(str(i))), at(n["v"], f"$.children[{i}]", "variant"))
    good = lambda n: F.coalesce(F.when(at(n["v"], "$.type", "string") == "leaf", at(n["v"], "$.id", "string").isNotNull()).when(at(n["v"], "$.type", "string") == "split", F.size(at(n["v"], "$.children", "array<variant>")) == 2), F.lit(False))
    split = lambda n: at(n["v"], "$.type", "string") == "split"

    def deeper(acc: Column, _: Column) -> Column:
        below = F.filter(F.flatten(F.transform(F.filter(acc["open"], split), lambda n: F.array(child(n, 0), child(n, 1)))), good)
        return F.struct(F.concat(acc["done"], acc["open"]).alias("done"), below.alias("open"))

    root = layouts.select(F.col(tab).alias("tab"), F.try_parse_json(layout).alias("v"), F.col(layout).alias("raw"))
    first = F.filter(F.array(node(F.lit("r"), F.col("v"))), good)
    none = F.filter(first, lambda n: F.lit(False))
    most = F.size(F.split("raw", '"children"'))  # a tree isn't deeper than it has splits
    opened = root.where("v is not null").select("tab", F.aggregate(F.sequence(F.lit(1), most), F.struct(none.alias("done"), first.alias("open")), deeper)["done"].alias("nodes"))
    n = opened.select("tab", F.explode("nodes").alias("n"))
    v, inner = F.col("n.v"), at(F.col("n.v"), "$.type", "string") == "split"
    size = lambda i: F.when(inner, at(v, f"$.sizes[{i}]", "double"))
    way = F.when(inner, F.when(at(v, "$.direction", "string") == "column", "column").otherwise("row"))
    return n.select("tab", F.col("n.path").alias("path"), F.when(~inner, at(v, "$.id", "string")).alias("id"), way.alias("direction"), size(0).alias("size0"), size(1).alias("size1"))


def nested(tree: DataFrame) -> DataFrame:
    """tab, layout: each tree as one JSON text, which ``from_nested`` reads. A tree's nodes are folded from its last path to
    its first, so that both children are there when their split is reached."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", "$1")

    def add(held: Column, n: Column) -> Column:
        a, b = F.element_at(held, -1), F.element_at(held, -2)
        sizes = F.concat(F.lit('],"sizes":['), n["size0"].cast("string"), F.lit(","), n["size1"].cast("string"), F.lit("]}"))
        whole = F.concat(F.lit('{"type":"split","direction":"'), n["direction"], F.lit('","children":['), a, F.lit(","), b, sizes)
        own = F.concat(F.lit('{"type":"leaf","id":'), n["quoted"], F.lit("}"))
        return F.when(n["id"].isNotNull(), F.array_append(held, own)).otherwise(F.array_append(F.slice(held, F.lit(1), F.size(held) - 2), whole))

    nodes = F.reverse(F.array_sort(F.collect_list(F.struct("path", "id", "direction", "size0", "size1", "quoted"))))
    rows = tree.withColumn("quoted", quoted(F.col("id"))).groupBy("tab").agg(nodes.alias("nodes"))
    return rows.select("tab", F.get(F.aggregate("nodes", F.array().cast("array<string>"), add), F.lit(0)).alias("layout"))
