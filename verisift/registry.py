"""The registry of queries and of the SQL each is held against, and the claims that they are about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flag_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_partkey").alias("entity"), F.lit("returnflag").alias("attribute"), (F.col("l_suppkey") % 10).cast("string").alias("source_id"),
        F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("value"),
    )


def two_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag", "l_linestatus")
    long = items.unpivot(["l_partkey", "l_suppkey", "l_orderkey"], ["l_returnflag", "l_linestatus"], "attribute", "value")
    return long.select(F.col("l_partkey").alias("entity"), "attribute", (F.col("l_suppkey") % 10).cast("string").alias("source_id"), F.col("l_orderkey").alias("row_id"), "value")


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("entity"), (F.hour("ts") % 4).cast("string").alias("source_id"), F.col("event_type").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("batch"))
