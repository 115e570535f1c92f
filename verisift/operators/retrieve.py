"""Retrieval of rows by value or vector, and the joins between steps of a query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from verisift.functions.vectors import dot

COMPARE = {"=": "__eq__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}
#: Thresholds (fixed values): column binding, value retrieval, its fallback, fused filter, entity resolution, source alias.
BIND, VALUE, FALLBACK, FUSED, ENTITY, ALIAS = 0.90, 0.95, 0.80, 0.80, 0.98, 0.99
#: Query vectors broadcast for one pass, and scored at once.
SLICE, STRIP = 8192, 256


def compare(c: Column, op: str | None, value) -> Column:
    return getattr(c, COMPARE[op or "="])(value)


def any_of(c: Column, op: str | None, values: list) -> Column:
    """True where any of the values compares; equality becomes a set test, which reaches the scan."""
    if (op or "=") == "=":
        return c.isin(*values)
    out = F.lit(False)
    for v in values:
        out = out | compare(c, op, v)
    return out


def retrieve(records: DataFrame, column: str, values: list, op: str | None = None) -> DataFrame:
    return records.filter(any_of(F.col(column), op, values)).withColumn("score", F.lit(1.0))


def retrieve_by_view(records: DataFrame, column: str, view: DataFrame, view_column: str, op: str | None = None) -> DataFrame:
    """Rows whose value compares with any of a view's: a semi-join for equality, a bound for the order."""
    if (op or "=") == "=":
        return records.join(view.select(F.col(view_column).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_semi")
    bound = view.agg((F.min if op in (">", ">=") else F.max)(view_column)).first()[0]  # a literal reaches the scan
    return records.filter(F.lit(False) if bound is None else compare(F.col(column), op, F.lit(bound)))


def _slices(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the queries, ``SLICE`` at a time; all vectors have the length of the first."""
    kind, ids, vectors = to_arrow_type(queries.schema[0].dataType), [], []
    for r in queries.filter(F.col("_q").isNotNull()).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == SLICE:
            yield pa.array(ids, kind), np.asarray(vectors, float)
            ids, vectors = [], []
    if ids:
        yield pa.array(ids, kind), np.asarray(vectors, float)


def _scorer(shared, top: int, least: float, fallback: float | None, by: str):
    """The candidates of each Arrow batch of vectors for a slice of queries, from products of matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), asked.shape[1]), False))
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for a in range(0, len(asked), STRIP):
                q = asked[a : a + STRIP]
                score = q @ x.T
                if by != "dot":
                    score = np.minimum(2 * score - (x * x).sum(axis=1) - (q * q).sum(axis=1)[:, None], 0.0)
                keep = np.isfinite(score)
                score = np.where(keep, score, -np.inf)
                if score.shape[1] > top:
                    keep &= score >= np.partition(score, -top, axis=1)[:, [-top]]
                if by == "dot":
                    near = score >= least
                    keep &= near if fallback is None else near | ((score > fallback) & (score == score.max(axis=1, keepdims=True)))
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + a)), batch.column(0).take(pa.array(j)), pa.array(score[i, j])], ["_qid", "_vid", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, top: int = 100, least: float = VALUE, fallback: float | None = FALLBACK, by: str = "dot") -> DataFrame:
    """``(query_id, vector_id, score)``: the best ``top`` by inner product at ``least`` or more, else the best one above ``fallback``.

    The queries are a stated set, asked ``SLICE`` at a time in a pass over the
    vectors.  Each batch of vectors keeps its own best of each query, so only
    candidates are rows, and the rank is pushed below the shuffle again.
    """
    asked = queries.select(F.col(query_id).alias("_qid"), F.col("embedding").alias("_q"))
    every = vectors.select(F.col(vector_id).alias("_vid"), F.col("embedding").alias("_x"))
    schema = StructType([StructField("_qid", asked.schema[0].dataType), StructField("_vid", every.schema[0].dataType), StructField("score", DoubleType())])
    context = vectors.sparkSession.sparkContext
    parts = [every.mapInArrow(_scorer(context.broadcast(s), top, least, fallback, by), schema) for s in _slices(asked)]
    found = reduce(DataFrame.union, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    ranked = found.withColumn("_rank", F.row_number().over(W.partitionBy("_qid").orderBy(F.desc("score"), "_vid"))).filter(F.col("_rank") <= top)
    if by == "dot":
        keep = F.col("score") >= least
        if fallback is not None:  # the first is below the bound only if all are
            keep = keep | ((F.col("_rank") == 1) & (F.col("score") > fallback))
        ranked = ranked.filter(keep)
    return ranked.select(F.col("_qid").alias(query_id), F.col("_vid").alias(vector_id), "score")


def bind_columns(attribute: DataFrame, columns: DataFrame, least: float = BIND) -> DataFrame:
    """The best column of each source for an attribute's embedding; sources without one above the bound give none."""
    asked = attribute.select("embedding").first()
    wanted = F.array(*(F.lit(float(x)) for x in asked[0])) if asked and asked[0] else F.lit(None).cast("array<double>")
    scored = columns.withColumn("score", dot(wanted, F.col("embedding")))
    return scored.filter(F.col("score") > least).groupBy("source_id").agg(F.max_by("column_name", "score").alias("column_name"), F.max("score").alias("score"))


def filter_fused(view: DataFrame, values: list, op: str | None = None, column: str = "value") -> DataFrame:
    """Rows of a fused view that compare with any of the values, as numbers if both are."""
    c = F.col(column)
    if op in (">", "<", ">=", "<="):
        return view.filter(any_of(c.try_cast("double"), op, [float(v) for v in values]))
    return view.filter(any_of(c, op, [str(v) for v in values]))


def filter_fused_vectors(view: DataFrame, targets: DataFrame, least: float = FUSED, row_id: str = "row_id", target_id: str = "target_id") -> DataFrame:
    """Rows of a fused view whose vector is near any target's; targets (target_id, embedding) are a stated set, asked in slices."""
    keys = view.select(F.struct("source_id", row_id).alias("_row"), "embedding") if "source_id" in view.columns else view.select(F.col(row_id).alias("_row"), "embedding")
    plain = keys.withColumn("_row", F.to_json("_row") if "source_id" in view.columns else F.col("_row").cast("string"))
    near = nearest(targets, plain, target_id, "_row", 2**31 - 1, least, None).select("_row").distinct()
    mark = F.to_json(F.struct("source_id", row_id)) if "source_id" in view.columns else F.col(row_id).cast("string")
    return view.withColumn("_row", mark).join(near, "_row", "left_semi").drop("_row")


def select_rows(rows: DataFrame, base: DataFrame, keys: tuple[str, ...] = ("source_id", "row_id")) -> DataFrame:
    return rows.join(base.select(*keys).distinct(), list(keys), "left_semi")


def best_entity(matches: DataFrame) -> DataFrame:
    """The entity of the best-scored row, ties to the smallest source and entity, and its rows in every source."""
    best = matches.orderBy(F.desc("score"), "source_id", "entity").limit(1).select("entity")
    return matches.join(F.broadcast(best), "entity", "left_semi")


def prune_sources(matches: DataFrame, share: float = ALIAS) -> DataFrame:
    """Rows of sources whose best score is above a share of the best of all."""
    per = matches.groupBy("source_id").agg(F.max("score").alias("_s"))  # a row for each source
    kept = per.withColumn("_top", F.max("_s").over(W.partitionBy(F.lit(0)))).filter(F.col("_s") > share * F.col("_top"))
    return matches.join(kept.select("source_id"), "source_id", "left_semi")


def aggregate_view(view: DataFrame, function: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Function_MIN and Function_MAX give the row that has it (ties: smallest value text and source), Function_AVG the mean alone."""
    number = F.col("value").try_cast("double")
    name = function.removeprefix("Function_").upper()
    if name == "AVG":
        return view.groupBy(*by).agg(F.avg(number).alias("value"))
    rest = [c for c in view.columns if c not in by]
    sign = 1 if name == "MIN" else -1
    picked = view.filter(number.isNotNull()).groupBy(*by).agg(F.min(F.struct((sign * number).alias("_n"), *rest)).alias("_r"))
    return picked.select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))
