"""URL filters from path-template trees, on DataFrame functions alone.

Each host is a tree of path templates.  Digits in a segment become ``#``; of a
node with more than ``branches`` children, those with too few labels to tell, or
whose share of bad ones the two-proportion test can't tell from their siblings',
are generalised to ``*``; the others keep templates of their own at any fan-out.
The tree is made level by level, over all segments, until no node has children.
Going down from the root, the branches of a node that the test can't tell from
their siblings are merged: they are judged by their labels together.  A branch's
labelled purity (its share of bad labels) is smoothed towards its parent's; a
branch that doesn't differ from its parent takes its purity.
Templates whose purity reaches the limit are rejected.  Explicit rules on (host
suffix, path prefix) go before all that, the longest first.

Pages are aggregated to templates at once, so a hot host is combined before any
shuffle; only templates are joined, then the rejected ones with the pages.  A
level takes a few jobs and only paths below labelled nodes go on to the next.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged as such; without labels nothing is rejected but by rules; a label with a
null is no label; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.scratch import materialize

#: Labels that a child of a wide node needs to keep its own template.
SUPPORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def rule_match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    """The path's segments with digits generalised, joined by slashes; empty segments are left out."""
    parts = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    return F.array_join(F.filter(parts, lambda x: x != ""), "/")


def _differs(labelled: Column, bad: Column, share: Column, critical: float) -> Column:
    gap = F.abs(bad - share * labelled)
    return gap * gap > critical * critical * share * (1 - share) * labelled


def _stands(l: Column, b: Column, all_l: Column, all_b: Column, critical: float) -> Column:
    """Whether a branch with ``SUPPORT`` labels differs from its siblings, by a two-proportion test."""
    share, others = all_b / all_l, all_l - l
    gap = b * others.cast("double") - (all_b - b) * l.cast("double")  # the two shares' difference, times both counts
    return F.coalesce((l >= SUPPORT) & (others > 0) & (gap * gap > critical * critical * share * (1 - share) * l * others * all_l), F.lit(False))


def _purity(l: Column, b: Column, parent_l: Column, parent_b: Column, parent: Column, smoothing: float, critical: float) -> Column:
    """The smoothed purity of a branch, or its parent's if it doesn't differ."""
    return F.when(_differs(l, b, parent_b / F.greatest(parent_l, F.lit(1)), critical), (b + smoothing * parent) / (l + smoothing)).otherwise(parent)


def _children(leaves: DataFrame, branches: int, critical: float) -> DataFrame:
    """(node, child, l, b, name, ml, mb): the children of the open nodes, the name each has in the template, and the labels it is judged by.

    Children that differ from their siblings stand for themselves, however many
    they are.  The others are one branch by their labels, ``ml`` of which ``mb``
    are bad; below a wide node they are one by name, too.
    """
    each = leaves.groupBy("node", "child").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    node = each.groupBy("node").agg(F.count("*").alias("_n"), F.sum("l").alias("_l"), F.sum("b").alias("_b"))
    told = each.join(node, "node").withColumn("stands", _stands(F.col("l"), F.col("b"), F.col("_l"), F.col("_b"), critical))
    rest = told.filter("not stands").groupBy("node").agg(F.sum("l").alias("_rl"), F.sum("b").alias("_rb"))
    name = F.when((F.col("_n") > branches) & ~F.col("stands"), "*").otherwise(F.col("child"))
    merged = [F.when(F.col("stands"), F.col(own)).otherwise(F.col(of)).alias(to) for own, of, to in (("l", "_rl", "ml"), ("b", "_rb", "mb"))]
    return told.join(rest, "node", "left").select("node", "child", "l", "b", name.alias("name"), *merged)


def _descend(leaves: DataFrame, depth: int, branches: int, smoothing: float, critical: float) -> DataFrame:
    """The leaves one level further down: their node, its labels and its purity; ``open`` while there is more to tell.

    A path that has ended has the empty child.  Below a node without labels every
    purity is that node's, so its leaves are done.
    """
    parts = F.split("shape", "/")
    leaves = leaves.withColumn("child", F.coalesce(F.get(parts, F.lit(depth)), F.lit("")))
    children = _children(leaves, branches, critical)
    nodes = leaves.groupBy("node").agg(F.first("pl").alias("pl"), F.first("pb").alias("pb"), F.first("purity").alias("purity"))
    named = children.groupBy("node", "name").agg(*(F.sum(c).alias(c) for c in "lb"), *(F.first(c).alias(c) for c in ("ml", "mb"))).join(nodes, "node")
    purity = _purity(*map(F.col, ("ml", "mb", "pl", "pb", "purity")), smoothing, critical)
    known = named.select("node", "name", F.col("l").alias("pl"), F.col("b").alias("pb"), purity.alias("purity"))
    told = children.select("node", "child", "name").join(known, ["node", "name"])
    below = leaves.drop("pl", "pb", "purity").join(told, ["node", "child"])
    return below.select(
        "host", "shape", F.concat_ws("/", "node", "name").alias("node"), "labelled", "bad", "pl", "pb", "purity", ((F.col("child") != "") & (F.col("pl") > 0)).alias("open")
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[Rule],
    limit: float = 0.5,
    smoothing: float = 4.0,
    critical: float = 1.96,
    branches: int = 64,
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str = "doc_id",
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every page; labels mark pages by id as good, or not (quality 0 or toxic 1)."""
    host, path = split_url(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    shaped = cut.select("_id", "host", "path", shape(F.col("path")).alias("shape"))
    marks = (
        labels.select(F.col(label_col).alias("_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long").alias("bad"))
        .dropna().groupBy("_id").agg(F.max("bad").alias("bad"))
    )
    counted = shaped.select("host", "shape").distinct()
    seen = shaped.select("_id", "host", "shape").join(marks, "_id").groupBy("host", "shape").agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
    leaves = materialize(counted.join(seen, ["host", "shape"], "left").fillna(0, ["labelled", "bad"]), "leaves")

    total, bad = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()  # the root, one row
    purity = F.lit(bad / (total + 1.0))  # without labels nothing is bad
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = hosts.withColumn("stands", _stands(F.col("l"), F.col("b"), F.lit(total), F.lit(bad), critical) if total else F.lit(False))
    rest = hosts.filter("not stands").agg(F.coalesce(F.sum("l"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    merged = [F.when(F.col("stands"), F.col(c)).otherwise(F.lit(r)) for c, r in zip("lb", rest, strict=True)]
    known = hosts.select("host", F.col("l").alias("pl"), F.col("b").alias("pb"), _purity(*merged, F.lit(total), F.lit(bad), purity, smoothing, critical).alias("purity"))
    level = materialize(leaves.join(known, "host").select("*", F.col("host").alias("node"), (F.col("pl") > 0).alias("open")), "level")
    rejected, depth = None, 0
    while True:
        done = level.filter(~F.col("open") & (F.col("purity") >= limit)).select("host", "shape")
        rejected = done if rejected is None else rejected.union(done)
        if level.filter("open").isEmpty():
            break
        level = materialize(_descend(level.filter("open"), depth, branches, smoothing, critical), "level")
        depth += 1
    told = shaped.join(materialize(rejected.withColumn("_method", F.lit("block")), "rejected"), ["host", "shape"], "left")
    text, verdict = rule_match(F.col("host"), F.col("path"), rules)
    return told.select(F.col("_id").alias(id_col), "host", "path", text.alias("rule"), F.coalesce(verdict, F.col("_method"), F.lit("allow")).alias("verdict"))
