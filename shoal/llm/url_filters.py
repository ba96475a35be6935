"""URL filters: the longest of nested host and path rules, found by a sort-merge range join.

A host is keyed by its labels in reverse, so that a rule's host is a prefix of its subdomains' keys, and under one host a
rule's path is a prefix of the paths it fits: each rule is an interval of sorted (host key, path) pairs, and intervals
are disjoint or nested. Rules and URLs are sorted together over range partitions; a sweep keeps the stack of rules that are
open at each URL and gives it the top one. What is open where a partition begins comes from the partitions before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import among, ascii_lower, saved, ship

RULE = "struct<node:string,path:string,rule:string,verdict:string>"
SWEPT = f"part int, host string, path string, node string, rule string, verdict string, open array<{RULE}>, last_node string, last_path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased, and from there up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def host_key(host: Column, labels: Column | None = None) -> Column:
    """``www.example.com`` as ``com.example.www``; with ``labels``, of that many of its last labels."""
    reverse = F.reverse(F.split(host, r"\."))
    return F.array_join(reverse if labels is None else F.slice(reverse, F.lit(1), labels), ".")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (node, path, host, rule, verdict), rules before equal URLs: each URL with the top of the stack, and
    at the end one row of what is still open and where the partition ended."""
    part, stack, end = TaskContext.get().partitionId(), [], None
    names = [f.split(" ")[0] for f in SWEPT.split(", ")]
    kind = pa.struct([(n, pa.string()) for n in ("node", "path", "rule", "verdict")])
    kinds = [pa.int32(), *[pa.string()] * 5, pa.list_(kind), pa.string(), pa.string()]
    table = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for b in batches:
        out = []
        for node, path, host, rule, verdict in zip(*(b[c].to_pylist() for c in ("node", "path", "host", "rule", "verdict")), strict=True):
            while stack and not (stack[-1]["node"] == node and path.startswith(stack[-1]["path"])):
                stack.pop()
            if rule is not None:
                stack.append({"node": node, "path": path, "rule": rule, "verdict": verdict})
            else:
                top = stack[-1] if stack else {}
                out.append((part, host, path, node, top.get("rule"), top.get("verdict"), None, None, None))
            end = node, path
        if out:
            yield table(out)
    if end:
        yield table([(part, None, None, None, None, None, stack, *end)])


def carried(ends: DataFrame) -> DataFrame:
    """part, before: the rules that are open where each range partition begins. One row a partition and at most as many
    rules in it as one key has prefixes, so they are few enough for the driver."""
    open_, rows = [], []
    for r in ends.orderBy("part").collect():
        rows.append((r.part, open_))
        still = [x for x in open_ if x["node"] == r.last_node and r.last_path.startswith(x["path"])]
        open_ = still + [x.asDict() for x in r.open]
    return ends.sparkSession.createDataFrame(rows, f"part int, before array<{RULE}>")


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the (host, path) pairs that a rule fits."""
    spark = ship(urls.sparkSession)
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = saved(rules.select(host_key(F.col("host")).alias("node"), "path", F.concat("host", "path").alias("rule"), "verdict"), "url-rules")
    deepest = own.agg(F.max(F.size(F.split("node", r"\.")))).first()[0]
    if deepest is None:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    labels = F.size(F.split("host", r"\."))
    nodes = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(deepest))), lambda i: host_key(F.col("host"), i))
    asked = urls.select("host", "path", F.explode(nodes).alias("node"))
    asked = among(asked, saved(own.select("node").distinct(), "url-rule-hosts"), "node")
    none = F.lit(None).cast("string")
    both = own.select("node", "path", none.alias("host"), "rule", "verdict").unionByName(asked.select("node", "path", "host", none.alias("rule"), none.alias("verdict")))
    order = ["node", "path", "host"]  # null hosts, the rules, come first
    swept = saved(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT), "url-sweep")
    before = carried(swept.where("open is not null").select("part", "open", "last_node", "last_path"))
    fits = F.filter("before", lambda r: (r["node"] == F.col("node")) & F.startswith(F.col("path"), r["path"]))
    found = swept.where("open is null").join(F.broadcast(before), "part").withColumn("outer", F.try_element_at(fits, F.lit(-1)))
    found = found.select("host", "path", F.coalesce("rule", "outer.rule").alias("rule"), F.coalesce("verdict", "outer.verdict").alias("verdict"), F.length("node").alias("depth"))
    best = F.max(F.struct(F.length("rule").alias("size"), "depth", "rule", "verdict")).alias("best")
    return found.where("rule is not null").groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def url_filters(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``, by ``rules`` of (host, path, verdict).

    A rule fits its host and all subdomains of it where the URL's path starts with the rule's; of those that fit, the
    one of most characters counts, of two equally long ones that of the longer host, and of equal rules with different
    verdicts the last by name (block). Where none fits, rule is null and the verdict is ``default``. A null URL and one
    without ``://`` have an empty host and path, as an empty table has no rows; repeated rows and rows without an id
    are judged like others. Hosts are compared as they stand, ports and final dots included. Other columns aren't read.

    Rows a URL: one for each of its host's last labels, as far as rules go, that has a rule; hot URLs collapse first.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    best = saved(longest_rules(rows.select("host", "path").distinct(), rules), "url-verdicts")
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
