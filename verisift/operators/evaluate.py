"""Scores of answers against gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import token_key, token_set_ratio


def confusion(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``predicted``: keys, is_true; ``gold``: keys, label. Predicted rows without a label count as wrong if positive; gold rows never retrieved don't count."""
    both = predicted.select(*keys, F.col("is_true")).join(gold.select(*keys, F.col("label")), keys, "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    label = F.coalesce("label", F.lit(False))
    return both.agg(
        one(F.col("is_true") & label).alias("tp"), one(F.col("is_true") & ~label).alias("fp"),
        one(~F.col("is_true") & label).alias("fn"), one(~F.col("is_true") & F.col("label").isNotNull() & ~label).alias("tn"),
    )


def metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.when(b > 0, 100 * a / b).otherwise(0.0)
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.select(
        "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1.0))).alias("f1"),
        part(tp + tn, tp + tn + fp + fn).alias("accuracy"), part(tn, tn + fp).alias("specificity"), part(tn, tn + fn).alias("npv"),
        part(fp, fp + tn).alias("fpr"), part(fn, fn + tp).alias("fnr"), F.when(spread > 0, (tp * tn - fp * fn) / F.sqrt(spread)).otherwise(0.0).alias("mcc"),
    )


def source_accuracy(view: DataFrame) -> DataFrame:
    out = view.groupBy("source_id").agg(F.count("*").alias("n_total"), F.sum(F.col("is_true").cast("long")).alias("n_true"))
    return out.select("source_id", "n_true", (F.col("n_total") - F.col("n_true")).alias("n_false"), "n_total", F.round(F.col("n_true") / F.col("n_total"), 6).alias("ratio"))


def propagate_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of values, by lower case, to all rows of the value."""
    told = labels.select("query_id", F.lower("value").alias("_v"), "label").groupBy("query_id", "_v").agg(F.max("label").alias("label"))
    return rows.withColumn("_v", F.lower("value")).join(told, ["query_id", "_v"], "left").drop("_v")


def evaluate_values(predicted: DataFrame, gold: DataFrame, least: float = 95.0) -> DataFrame:
    """Per query how many predicted values are a gold one, by word sets or a token-set ratio above ``least``; gold values are few for a query.

    ``predicted``, ``gold``: (query_id, value).  Exact matches are an equi-join;
    only what is left is compared with the gold values of its own query.
    """
    p = predicted.select("query_id", "value", F.lower(token_key(F.col("value"))).alias("_k")).distinct()
    g = gold.select("query_id", F.col("value").alias("_g"), F.lower(token_key(F.col("value"))).alias("_k")).distinct()
    exact = p.join(g.select("query_id", "_k").distinct(), ["query_id", "_k"], "left_semi").select("query_id", "value")
    rest = p.join(exact, ["query_id", "value"], "left_anti")
    fuzzy = rest.join(g.select("query_id", "_g"), "query_id").filter(token_set_ratio(F.col("value"), F.col("_g")) >= least).select("query_id", "value").distinct()
    hit = exact.union(fuzzy).withColumn("_hit", F.lit(1))
    told = p.select("query_id", "value").join(hit, ["query_id", "value"], "left")
    return told.groupBy("query_id").agg(F.count("*").alias("n_predicted"), F.count("_hit").alias("n_correct"))


def distinct_values(rows: DataFrame, key: str = "query_id", value: str = "value") -> DataFrame:
    """``(key, n_values, values)``: the distinct values of each query, in order."""
    each = rows.filter(F.col(value).isNotNull()).select(key, value).distinct()
    return each.groupBy(key).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(value)).alias("values"))


def key_index(rows: DataFrame, key: str = "entity", row_id: str = "row_id") -> DataFrame:
    """``(key, source_id, n_rows, rows)``: where each key stands in each source; rows in order."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key, "source_id").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(row_id)).alias("rows"))


def answers_at(view: DataFrame, key: str = "entity") -> DataFrame:
    """``(key, timestamp, source_id, true_rows, false_rows)``: after each timestamp at which a key gets rows, all its rows so far, by label.

    ``view``: (key, timestamp, source_id, row_id, is_true).  The list of a key
    and source is bounded by its own rows, as the answer itself is.
    """
    times = view.select(key, F.col("timestamp").alias("_now")).distinct()
    known = times.join(view, key).filter(F.col("timestamp") <= F.col("_now"))
    side = lambda label: F.array_sort(F.collect_list(F.when(F.col("is_true") == label, F.col("row_id"))))
    return known.groupBy(key, F.col("_now").alias("timestamp"), "source_id").agg(side(True).alias("true_rows"), side(False).alias("false_rows"))


def time_statistics(times: DataFrame) -> DataFrame:
    return times.groupBy("method").agg(F.avg("seconds").alias("mean_s"), F.sum("seconds").alias("sum_s"), F.max("seconds").alias("max_s"), F.min("seconds").alias("min_s"))
