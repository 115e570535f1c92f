"""Reading and writing sources, queries, logs and results."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = "struct<IntermediateResult:int,condition_attribute:string,condition_value:string,operator:string,target_attribute:string,target_value:string>"
VIEW = "map<string,struct<true_answer:map<string,array<bigint>>,false_answer:map<string,array<bigint>>>>"
QUERY_SCHEMA = f"questionId bigint, qid bigint, question string, answers array<string>, subquery array<{STEP}>, answer_view {VIEW}"
EVENT_SCHEMA = "type string, sid bigint, data map<string,string>, timestamp bigint, log_time string"
COLUMN_SCHEMA = "column_name string, properties string, embedding string, key_attributes string, special_values string"


def _source_id(pattern: str):
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def read_sources(spark: SparkSession, path: str, form: str = "parquet", sep: str = ",") -> DataFrame:
    """All sources of a folder as one table, with ``source_id`` from the file name; empty texts are null, names lower case."""
    reader = spark.read
    df = reader.parquet(path) if form == "parquet" else reader.option("header", True).option("sep", sep).csv(path)
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    cols = [(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in texts else F.col(f"`{c}`")).alias(c.lower()) for c in df.columns]
    return df.select(_source_id(r"_(\d+)(?:_[a-z_]+)?\.[a-z]+").alias("source_id"), *cols)


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of source columns: name, property, embedding, key flag, domain of special values."""
    df = spark.read.option("header", True).schema(COLUMN_SCHEMA).csv(path)
    vector = F.transform(F.split(F.trim(F.regexp_replace("embedding", r"[\[\],]", " ")), r"\s+"), lambda x: x.try_cast("float"))
    return df.select(
        _source_id(r"_(\d+)_columns\.").alias("source_id"), F.lower("column_name").alias("column_name"), F.col("properties").alias("property"),
        F.when(F.trim("embedding") != "", vector).alias("embedding"), (F.lower("key_attributes") == "true").alias("is_key"),
        F.split("special_values", r"\|").alias("special_values"),
    )


def parse_vectors(df: DataFrame, suffix: str = "_emd") -> DataFrame:
    """Columns of space-separated numbers to arrays of floats; null where there are none."""
    out = df
    for c in df.columns:
        if c.endswith(suffix):
            out = out.withColumn(c, F.when(F.trim(F.col(c)) != "", F.transform(F.split(F.trim(F.regexp_replace(c, r"[\[\],]", " ")), r"\s+"), lambda x: x.try_cast("float"))))
    return out


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, drop: tuple[str, ...] = ("source", "timestamp")) -> DataFrame:
    """Tab-separated sources, with a header or with the columns given."""
    reader = spark.read.option("sep", "\t")
    df = reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else reader.option("header", True).csv(path)
    kept = [c for c in df.columns if c.lower() not in drop]
    return df.select(_source_id(r"_(\d+)\.txt$").alias("source_id"), *(F.col(f"`{c}`").alias(c.lower()) for c in kept))


def read_lines(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Lines with their 0-based numbers in each file, of the given keys (first fields) alone; a large file is read in splits, whose lines are counted first."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # in order within a split of a file
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy("file", "start").orderBy("at")) - 1
    told = lines.withColumn("number", number).join(splits.withColumn("before", before).drop("n"), ["file", "start"])
    told = told.select(F.regexp_extract("file", r"_(\d+)\.[a-z]+$", 1).alias("source_id"), (F.col("before") + F.col("number")).alias("line_number"), F.regexp_replace("value", "\r$", "").alias("line"))
    kept = told.filter("line <> ''")
    return kept if keys is None else kept.filter(F.lower(F.trim(F.split("line", "\t")[0])).isin([k.lower() for k in keys]))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_SCHEMA).option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", True).json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim(F.split("value", "\t")[0]).alias("entity"))


def read_rules(spark: SparkSession, path: str) -> list[list[dict]]:
    """The rules of a library, one JSON array a line, in order; a library is a driver's object, read as a whole."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value").collect()
    return [json.loads(r.value) for r in lines]


def write_rules(spark: SparkSession, rules: list[list[dict]], path: str) -> None:
    """Add rules to a library; a rule that stands there is not written again."""
    try:
        known = {json.dumps(r, sort_keys=True) for r in read_rules(spark, path)}
    except AnalysisException:
        known = set()
    fresh = [(json.dumps(r),) for r in rules if json.dumps(r, sort_keys=True) not in known]
    if fresh:
        spark.createDataFrame(fresh, "value string").coalesce(1).write.mode("append").text(path)


def read_confidence(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("file_name string, source_name string, confidence_level int, total_records bigint").option("multiLine", True).json(path)
    return raw.select(F.regexp_extract("file_name", r"_(\d+)\.", 1).alias("source_id"), "confidence_level")


def write_results(df: DataFrame, path: str) -> None:
    """A folder for each batch, JSON; vectors are left out."""
    df.drop("embedding").write.mode("append").partitionBy("batch_ts").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def append_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def enrich(df: DataFrame, columns: list[str], embed: Callable[[Column], Column], suffix: str = "_emd") -> DataFrame:
    """Each column's vectors beside it; ``embed`` makes a vector of a column, and null where the value is blank."""
    return df.withColumns({f"{c}{suffix}": F.when(F.trim(F.col(c).cast("string")) != "", embed(F.col(c).cast("string"))) for c in columns})


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    spark.read.option("header", True).csv(source).write.mode("overwrite").option("compression", "snappy").parquet(target)


def claims(records: DataFrame, key: str, attributes: list[str], row_id: str = "row_id") -> DataFrame:
    """Wide records to one row a value: (entity, attribute, source_id, row_id, value)."""
    long = records.unpivot(["source_id", row_id, key], attributes, "attribute", "value")
    return long.select(F.col(key).cast("string").alias("entity"), "attribute", "source_id", F.col(row_id).alias("row_id"), F.col("value").cast("string").alias("value"))
