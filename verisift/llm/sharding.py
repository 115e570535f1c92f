"""Sharding by extendible hashing.

A row's place is the prefix of a 60-bit hash.  The directory starts with one
bucket; a bucket over the byte limit, and no other, is split on the next bit,
until all fit.  Sizes are aggregated once, by a prefix long enough for the
whole directory, and every level is a roll-up of that table, so splitting never
reads the data again.  The directory has a row for each shard; rows find theirs
by an equi-join on the prefix.

The hash is of the id and the text, so copies of a text spread.  Only rows that
are equal in both can't be told apart by bits; such a bucket overflows into
pages of as many rows as fit, dealt in order of arrival within each task and
counted beforehand, so no task holds the bucket.

Defined results: a null text has no bytes; a null id is hashed as such; one row
over the limit is a shard of its own, marked ``fits`` = false; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.scratch import materialize

BITS = 60


def place(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of id and text."""
    told = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def _prefix(column: str, depth) -> Column:
    return F.expr(f"shiftright({column}, {BITS} - {depth})") if not isinstance(depth, str) else F.expr(f"shiftright({column}, cast({BITS} - {depth} as int))")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """``(depth, prefix, bytes, n_rows)`` of every shard, from ``sizes`` (place, bytes)."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    deep = min(BITS, math.ceil(math.log2(max(2, total / limit))) + 6)
    found, rest, start = None, sizes, 0
    while True:
        bins = materialize(rest.groupBy(_prefix("place", deep).alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows")), "bins")
        levels = bins.select("*", F.explode(F.sequence(F.lit(start), F.lit(deep))).alias("depth"))
        sums = levels.groupBy("depth", F.expr(f"shiftright(bin, {deep} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        sums = materialize(sums, "levels")
        over = sums.filter(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fit = sums.filter(F.col("bytes") <= limit).withColumn("up", F.expr("shiftright(prefix, 1)"))
        leaf = fit.join(over, ["depth", "up"]).drop("up")
        if start == 0:
            leaf = leaf.union(fit.filter("depth = 0").drop("up"))
        large = sums.filter((F.col("bytes") > limit) & (F.col("depth") == deep))
        if deep < BITS and not large.isEmpty():  # buckets that more bits may still part: only they are looked at again
            found = leaf if found is None else found.union(leaf)
            keys = large.select(F.col("prefix").alias("_bin"))
            rest = rest.join(keys, _prefix("place", deep) == F.col("_bin"), "left_semi")
            start, deep = deep, min(BITS, deep + 12)
            continue
        leaf = leaf.union(large.select(leaf.columns))
        return leaf if found is None else found.union(leaf)


def _rows(docs: DataFrame, kept: Column, id_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    return docs.select(kept.alias("_kept"), place(id_col, text_col).alias("place"), size.alias("bytes"))


def _located(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """``(_kept, shard, n_bytes, fits)`` of each of ``rows`` (_kept, place, bytes); each row finds its shard by its own place."""
    shards = materialize(directory(sizes, limit), "directory")
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # BITS + 1 at most
    name = F.when(F.col("depth") == 0, "root").otherwise(F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')"))
    shards = shards.select("depth", "prefix", name.alias("shard"), (F.col("bytes") <= limit).alias("fits"))
    tried = rows.withColumn("depth", F.explode(F.array(*map(F.lit, sorted(depths))))) if depths else rows.withColumn("depth", F.lit(0))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(place, {BITS} - depth)"))
    told = tried.join(shards, ["depth", "prefix"]).select("_kept", "shard", F.col("bytes").alias("n_bytes"), "fits", "place")
    if not shards.filter("not fits").isEmpty():
        told = _paged(told, limit)
    return told.drop("place")


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, shard, n_bytes, fits)`` for every row; a shard is named by the bits of its prefix, and ``+page`` if it overflows."""
    rows = materialize(_rows(docs, F.col(id_col), id_col, text_col), "places")
    return _located(rows, rows.select("place", "bytes"), limit).withColumnRenamed("_kept", id_col)


def _paged(told: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for rows that no bit parts: equal rows, numbered within their task and offset by the tasks before."""
    from pyspark.sql import Window as W

    over = materialize(told.filter("not fits").withColumn("task", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()), "overflow")
    tasks = over.groupBy("place", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("place").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("place", "task", before.alias("before"))
    number = F.row_number().over(W.partitionBy("place", "task").orderBy("_n")) - 1
    each = over.withColumn("number", number).join(tasks, ["place", "task"])
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    page = F.floor((F.col("before") + F.col("number")) / fit)
    paged = each.select("_kept", F.concat("shard", F.lit("+"), page.cast("string")).alias("shard"), "n_bytes", (F.col("n_bytes") <= limit).alias("fits"), "place")
    return told.filter("fits").union(paged)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Write ``docs`` as Parquet, a folder with one file for each shard; every row once, whatever ids repeat."""
    if shard_col in docs.columns:
        raise ValueError(f"docs has a column {shard_col!r}; name another by shard_col")
    rows = _rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), id_col, text_col)
    sizes = materialize(rows.select("place", "bytes"), "places")
    told = _located(rows, sizes, limit).select("_kept.*", F.col("shard").alias(shard_col))
    told.repartition(shard_col).write.partitionBy(shard_col).parquet(path)  # a task's shard fits the limit
