"""Profiles of columns and sources; each is one aggregation over the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import is_null, parse_time


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: counts, and the shares that parse as numbers and as times."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column_name", "value")
    value = F.when(~is_null(F.col("value")), F.col("value"))
    each = long.groupBy("column_name", value.alias("value")).agg(F.count("*").alias("n"))  # parsed once a distinct value
    value, rows = F.col("value"), lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    return each.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        rows(value.isNotNull()).alias("n_values"),
        rows(value.try_cast("double").isNotNull()).alias("n_numeric"),
        rows(parse_time(value).isNotNull()).alias("n_dates"),
        F.count(value).alias("n_distinct"),
        F.countDistinct(F.length(value)).alias("n_lengths"),
        F.coalesce(F.bool_and(F.regexp_like(value, F.lit("^[A-Za-z0-9]+$"))), F.lit(False)).alias("alnum"),
    )


def infer_types(profile: DataFrame, numeric_share: float = 0.99, date_share: float = 0.9, expected: dict[str, str] | None = None) -> DataFrame:
    """(column_name, property) by the profile; ``expected`` overrides."""
    n = F.greatest("n_values", F.lit(1))
    found = (
        F.when((F.col("n_values") > 0) & (F.col("n_numeric") / n >= numeric_share), "numeric")
        .when((F.col("n_distinct") < 10) & (F.col("n_rows") > 100), "special")
        .when((F.col("n_lengths") == 1) & F.col("alnum"), "primary_noEmd")
        .when(F.col("n_dates") / n > date_share, "general_noEmd")
        .otherwise("general_noEmd")
    )
    for name, kind in (expected or {}).items():
        found = F.when(F.col("column_name") == name, kind).otherwise(found)
    return profile.select("column_name", found.alias("property"))


def inconsistent_columns(types: DataFrame) -> DataFrame:
    """Columns that sources type differently; ``types``: (source_id, column_name, property)."""
    return types.groupBy("column_name").agg(F.countDistinct("property").alias("n_types"), F.count("*").alias("n_sources")).filter("n_types > 1")


def first_invalid(df: DataFrame, column: str, valid: Column, row_id: str) -> DataFrame:
    """The first row whose value isn't null and not valid."""
    bad = df.filter(~is_null(F.col(column)) & ~valid)
    return bad.agg(F.min(row_id).alias(row_id), F.min_by(F.col(column).cast("string"), row_id).alias("value"), F.count("*").alias("n_invalid"))


def embedding_faults(df: DataFrame, value: str, vector: str) -> DataFrame:
    zero = F.forall(vector, lambda x: x == 0)
    return df.filter(is_null(F.col(value)) != F.coalesce(zero, F.lit(True)))


def source_quality(df: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """Per source and column: rows, values, share of nulls, and the smallest values as samples."""
    long = df.select(source, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot([source], columns, "column_name", "value")
    value = F.when(~is_null(F.col("value")), F.col("value"))
    return long.groupBy(source, "column_name").agg(
        F.count("*").alias("n_rows"), F.count(value).alias("n_values"), F.round(1 - F.count(value) / F.count("*"), 6).alias("null_ratio"), F.min(value).alias("sample")
    )


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one reader that the other lacks."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("first"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("second"))
    return left.union(right)


def unclean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that cleaning would still change."""
    bad = [F.col(c).isNotNull() & (F.regexp_like(F.col(c), F.lit(r'["\x00-\x1f\x7f]|\s\s|^\s|\s$')) | (F.lower(c) != F.col(c))) for c in columns]
    return df.filter(reduce(lambda x, y: x | y, bad))
