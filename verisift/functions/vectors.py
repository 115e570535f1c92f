"""Vectors in array columns; sums run in double precision, in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    parts = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def gumbel_softmax(a: Column, noise: Column, heat: float = 1.0) -> Column:
    """Softmax of an array of logits with Gumbel noise from an array of numbers between 0 and 1."""
    return softmax(F.zip_with(a, noise, lambda x, u: (x - F.log(-F.log(u))) / heat))


def ring_cosine(df: DataFrame, keys: list[str], order: str, vector: str = "embedding") -> DataFrame:
    """``(keys, cosine)``: the mean cosine of each vector of a group and the next one by ``order``, the first after the last."""
    w = W.partitionBy(*keys).orderBy(order)
    after = F.coalesce(F.lead(vector).over(w), F.first(vector).over(w))
    return df.withColumn("_c", cosine(F.col(vector), after)).groupBy(*keys).agg(F.avg("_c").alias("cosine"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The mean vector of each group; combined before the shuffle, whatever the group's size."""
    each = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = each.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return packed.select(*keys, F.transform("_v", lambda s: s["_x"]).alias(out))


def hashed_embedding(text: Column, size: int = 64, n: int = 3) -> Column:
    """A unit vector of hashed character n-grams; null for an empty text. Stands in where no model is given."""
    plain = F.regexp_replace(F.lower(text), r"[^\w\s]", "")
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(n))), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double"))
    total = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.trim(plain) != "", F.transform(counts, lambda x: (x / total).cast("float")))
