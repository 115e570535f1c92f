"""Registered queries of the fusion engine, and the SQL each is held against.

Claims are views over the driver's tables: parts with suppliers as sources that
disagree about the return flag or status, users whose events disagree by hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.functions import text, vectors
from verisift.operators import entities, evaluate, fusion, models, retrieve
from verisift.plans.query import Engine, Query, Step
from verisift.registry import ORACLES, QUERIES, event_claims, flag_claims, register, table, two_attributes
from verisift.sources import profile
from verisift.streaming import incremental

CLAIMS = "claims AS (SELECT l_partkey AS entity, CAST(l_suppkey % 10 AS VARCHAR) AS source_id, l_returnflag AS value FROM lineitem)"
VOTED = """votes AS (SELECT entity, value, COUNT(*) AS n_rows, MIN(source_id) AS first_source FROM claims GROUP BY entity, value),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY n_rows DESC, first_source, value) AS rk FROM votes)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fuse_single_truth"](spark, sf_dir)


@register(f"WITH {CLAIMS}, {VOTED} SELECT entity, value, n_rows, CAST(n_rows AS DOUBLE) AS score, rk = 1 AS is_true FROM ranked")
def fuse_single_truth(spark, sf_dir):
    merged = fusion.merge_sources(fusion.group_by_source(flag_claims(spark, sf_dir)), penalise=False)
    return fusion.single_truth(merged).select("entity", "value", "n_rows", "score", "is_true")


@register(f"""WITH {CLAIMS}, {VOTED} SELECT c.source_id, COUNT(*) AS n_total, CAST(SUM(CASE WHEN r.rk = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_wrong
FROM claims c JOIN ranked r ON c.entity = r.entity AND c.value = r.value GROUP BY c.source_id""")
def truth_error_views(spark, sf_dir):
    return fusion.source_counts(fusion.fuse(flag_claims(spark, sf_dir), penalise=False))


@register("""WITH g AS (SELECT l_partkey AS entity, CAST(l_suppkey % 10 AS VARCHAR) AS source_id, l_returnflag AS value, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3)
SELECT entity, source_id, value, n_rows, CAST(n_rows AS DOUBLE) AS score FROM g""")
def group_claims_by_source(spark, sf_dir):
    return fusion.group_by_source(flag_claims(spark, sf_dir)).select("entity", "source_id", "value", "n_rows", "score")


@register("""WITH g AS (SELECT l_partkey AS entity, l_suppkey % 10 AS s, l_returnflag AS value, CAST(COUNT(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2, 3),
own AS (SELECT entity, value, SUM(w) AS weight, SUM(w * w) AS sq, COUNT(*) AS n FROM g GROUP BY 1, 2),
cr AS (SELECT a.entity, a.value, SUM(a.w * b.w) AS cross_w FROM g a JOIN g b ON a.entity = b.entity AND a.value = b.value AND a.s < b.s GROUP BY 1, 2)
SELECT own.entity, own.value, ROUND(CASE WHEN n = 1 THEN weight ELSE weight * sq / (sq + 2 * (0.1 / 5.1) * COALESCE(cross_w, 0) + 1e-9) END, 6) AS score
FROM own LEFT JOIN cr ON own.entity = cr.entity AND own.value = cr.value""")
def fuse_with_copy_penalty(spark, sf_dir):
    merged = fusion.merge_sources(fusion.group_by_source(flag_claims(spark, sf_dir)))
    return merged.select("entity", "value", F.round("score", 6).alias("score"))


@register("""WITH d AS (SELECT DISTINCT l_partkey AS e, l_suppkey % 10 AS s, l_returnflag AS v FROM lineitem)
SELECT CAST(a.s AS VARCHAR) AS s, CAST(b.s AS VARCHAR) AS t, COUNT(*) AS n_shared FROM d a JOIN d b ON a.e = b.e AND a.v = b.v AND a.s < b.s GROUP BY 1, 2""")
def copy_detection(spark, sf_dir):
    groups = fusion.group_by_source(flag_claims(spark, sf_dir)).withColumn("n_rows", F.lit(1)).withColumn("score", F.lit(1.0))
    decided = fusion.merge_sources(groups, penalise=False).withColumn("is_true", F.lit(False))
    return fusion.copy_evidence(groups, decided).select("s", "t", F.round("alpha").cast("long").alias("n_shared"))


@register("""WITH v AS (SELECT l_partkey AS entity, l_returnflag AS value, COUNT(*) AS votes FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY entity ORDER BY votes DESC, value) AS INTEGER) AS "rank" FROM v) SELECT * FROM r WHERE "rank" <= 2""")
def majority_vote(spark, sf_dir):
    return fusion.majority_vote(flag_claims(spark, sf_dir), 2).select("entity", "value", "votes", "rank")


@register("""WITH said AS (SELECT DISTINCT l_partkey AS entity, l_suppkey % 10 AS s, l_returnflag AS value FROM lineitem),
s1 AS (SELECT entity, value, 1 / (1 + EXP(-0.3 * SUM(-LN(1 - 0.9)))) AS ver FROM said GROUP BY 1, 2),
t1 AS (SELECT x.entity, x.s, AVG(ver) AS t FROM said x JOIN s1 ON x.entity = s1.entity AND x.value = s1.value GROUP BY 1, 2),
s2 AS (SELECT x.entity, x.value, 1 / (1 + EXP(-0.3 * SUM(-LN(1 - t)))) AS ver FROM said x JOIN t1 ON x.entity = t1.entity AND x.s = t1.s GROUP BY 1, 2)
SELECT entity, value, ROUND(ver, 6) AS score FROM s2""")
def truth_finder_rounds(spark, sf_dir):
    return models.truth_finder_sql(flag_claims(spark, sf_dir), 2).select("entity", "value", F.round("score", 6).alias("score"))


def _model(name: str):
    def query(spark, sf_dir):
        return models.run_model(flag_claims(spark, sf_dir), name).select("entity", "value", F.round("score", 6).alias("score"))

    query.__name__ = f"model_{name}"
    return register()(query)


for _name in ("dart", "truth_finder", "ltm", "em", "case"):
    _model(_name)


@register()
def fuse_multi_truth(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    claims = part.select(
        F.col("p_size").alias("entity"), F.lit("name").alias("attribute"), (F.col("p_partkey") % 5).cast("string").alias("source_id"), F.col("p_partkey").alias("row_id"), F.col("p_name").alias("value")
    )
    return fusion.fuse(claims, multiple=True).select("entity", "row_id", "value", F.round("score", 6).alias("score"), "is_true")


@register("""WITH v AS (SELECT l_suppkey % 10 AS s, COUNT(*) AS total, SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS correct FROM lineitem GROUP BY 1),
a AS (SELECT SUM(total) AS n FROM v)
SELECT CAST(s AS VARCHAR) AS source_id, ROUND((0.79 * GREATEST(0.1 * n, 10) + correct) / (GREATEST(0.1 * n, 10) + total), 6) AS confidence FROM v, a""")
def source_confidence(spark, sf_dir):
    claims = flag_claims(spark, sf_dir)
    per = claims.groupBy("source_id").agg(F.count("*").alias("total"), F.sum((F.col("value") == "N").cast("long")).alias("correct"))
    per = per.withColumn("n", F.sum("total").over(W.partitionBy(F.lit(0))))  # a row for each source
    conf = fusion.updated_confidence(fusion.prior_confidence(F.lit(2)), F.col("correct"), F.col("total"), F.col("n"))
    return per.select("source_id", F.round(conf, 6).alias("confidence"))


@register("SELECT l_orderkey, l_partkey, l_quantity, CAST(1.0 AS DOUBLE) AS score FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 45")
def retrieve_by_value(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    return retrieve.retrieve(retrieve.retrieve(rows, "l_returnflag", ["A", "R"]).drop("score"), "l_quantity", [45.0], ">=").drop("l_returnflag")


@register("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, vec_id, ROUND(score, 6) AS score FROM r WHERE rk <= 100 AND score >= 0.4""")
def retrieve_by_vector(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = every.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieve.nearest(asked, every, "query_id", "vec_id", 100, 0.4, None).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register("""WITH p AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, AVG(x) AS x FROM p GROUP BY 1, 2) SELECT label, ROUND(SUM(x * x), 6) AS square FROM m GROUP BY label""")
def vector_centroids(spark, sf_dir):
    means = vectors.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.round(vectors.dot(F.col("centroid"), F.col("centroid")), 6).alias("square"))


@register()
def entity_clusters(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return entities.clusters(every, least=0.4, bits=2, tables=8)


@register("""SELECT md5(text) AS text_key, COUNT(DISTINCT source) AS n_sources, COUNT(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def exact_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_key"), F.col("source").alias("source_id"))
    return entities.exact_entities(docs, "text_key")


TOKEN_KEY = "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(p_name || ', ' || p_type, '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> ''))), ' ')"


@register(f"SELECT {TOKEN_KEY} AS token_key, COUNT(*) AS n FROM part GROUP BY 1")
def value_token_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(text.token_key(F.concat("p_name", F.lit(", "), "p_type")).alias("token_key"))
    return part.groupBy("token_key").agg(F.count("*").alias("n"))


@register("""SELECT CAST(ROUND(l_discount * 100) AS BIGINT) AS cents, COUNT(*) AS n FROM lineitem GROUP BY 1""")
def value_number_keys(spark, sf_dir):
    shown = F.concat(F.lit("$ "), F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit(".00"))
    keyed = table(spark, sf_dir, "lineitem").select(text.number_key(shown).cast("long").alias("cents"))
    return keyed.groupBy("cents").agg(F.count("*").alias("n"))


@register("""SELECT regexp_replace(p_brand, '[a-zA-Z0-9]', 'X', 'g') AS pattern, COUNT(*) AS n FROM part GROUP BY 1""")
def value_format_patterns(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(text.format_key(F.col("p_brand")).alias("pattern")).agg(F.count("*").alias("n"))


@register("""SELECT regexp_replace(replace(p_type, 'STEEL', 'IRON'), '\\s+', ' ', 'g') AS value, COUNT(*) AS n FROM part GROUP BY 1""")
def value_rules(spark, sf_dir):
    rule = [{"op": "replace", "args": ["STEEL", "IRON"]}, {"op": "remove_words", "args": ["nothinglikeit"]}]
    return table(spark, sf_dir, "part").groupBy(text.apply_rule(F.col("p_type"), rule).alias("value")).agg(F.count("*").alias("n"))


@register("""SELECT 'p_brand' AS column_name, COUNT(*) AS n_rows, COUNT(p_brand) AS n_values, COUNT(DISTINCT p_brand) AS n_distinct, COUNT(DISTINCT length(p_brand)) AS n_lengths FROM part
UNION ALL SELECT 'p_name', COUNT(*), COUNT(p_name), COUNT(DISTINCT p_name), COUNT(DISTINCT length(p_name)) FROM part
UNION ALL SELECT 'p_size', COUNT(*), COUNT(p_size), COUNT(DISTINCT p_size), COUNT(DISTINCT length(CAST(p_size AS VARCHAR))) FROM part""")
def profile_columns(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "part"), ["p_brand", "p_name", "p_size"]).select("column_name", "n_rows", "n_values", "n_distinct", "n_lengths")


@register("""WITH d AS (SELECT source, NULLIF(trim(text), '') AS text FROM documents)
SELECT source AS source_id, COUNT(*) AS n_rows, COUNT(text) AS n_values, ROUND(1 - COUNT(text) * 1.0 / COUNT(*), 6) AS null_ratio FROM d GROUP BY source""")
def profile_all_sources(spark, sf_dir):
    """Quality of each source over all rows; a blank text counts as a null."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), "text")
    return profile.source_quality(docs, "source_id", ["text"]).select("source_id", "n_rows", "n_values", "null_ratio")


@register("""WITH g AS (SELECT l_partkey AS entity, l_returnflag AS v, COUNT(*) AS n, MIN(CAST(l_suppkey % 10 AS VARCHAR)) AS fs FROM lineitem GROUP BY 1, 2),
t AS (SELECT entity, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY n DESC, fs, v) AS rk FROM g) z WHERE rk = 1 AND v = 'R'),
h AS (SELECT l.l_partkey AS entity, l.l_linestatus AS value, COUNT(*) AS n, MIN(CAST(l.l_suppkey % 10 AS VARCHAR)) AS fs FROM lineitem l JOIN t ON t.entity = l.l_partkey GROUP BY 1, 2)
SELECT entity, value, n AS n_rows FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY n DESC, fs, value) AS rk FROM h) z WHERE rk = 1""")
def two_step_query(spark, sf_dir):
    """Entities whose fused flag is R, then their fused status."""
    claims = two_attributes(spark, sf_dir)
    flag = fusion.fuse(claims.filter("attribute = 'l_returnflag'"), penalise=False)
    base = retrieve.filter_fused(flag.filter("is_true"), ["R"]).select("entity").distinct()
    status = fusion.fuse(claims.filter("attribute = 'l_linestatus'").join(base, "entity", "left_semi"), penalise=False)
    return status.filter("is_true").groupBy("entity", "value").agg(F.count("*").alias("n_rows"))


@register(ORACLES["two_step_query"])
def planned_query(spark, sf_dir):
    """The question of :func:`two_step_query`, over all entities, as the engine plans it."""
    engine = Engine(two_attributes(spark, sf_dir), penalise=False)
    steps = (Step("l_returnflag", "l_returnflag", ("R",)), Step("l_linestatus", base=0))
    return engine.run(Query("1", steps)).filter("is_true").groupBy("entity", "value").agg(F.count("*").alias("n_rows"))


@register("""WITH b AS (SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS batch, event_type AS value, COUNT(*) AS n FROM events GROUP BY 1, 2, 3),
tch AS (SELECT entity, batch, COUNT(*) OVER (PARTITION BY entity ORDER BY batch DESC) - 1 AS later FROM (SELECT DISTINCT entity, batch FROM b) z)
SELECT b.entity, b.value, ROUND(SUM(n * POW(0.9048374180359595, later)), 6) AS score FROM b JOIN tch ON b.entity = tch.entity AND b.batch = tch.batch GROUP BY 1, 2""")
def incremental_scores(spark, sf_dir):
    return incremental.decayed_scores(event_claims(spark, sf_dir)).select("entity", "value", F.round("score", 6).alias("score"))


@register("""WITH p AS (SELECT user_id AS entity, CAST(hour(ts) % 4 AS VARCHAR) AS source_id, strftime(ts, '%Y-%m-%d') AS "timestamp", COUNT(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT entity, source_id, "timestamp", CAST(SUM(n) OVER (PARTITION BY entity, source_id ORDER BY "timestamp") AS BIGINT) AS n_rows FROM p""")
def temporal_snapshots(spark, sf_dir):
    return incremental.snapshots(event_claims(spark, sf_dir).withColumnRenamed("batch", "timestamp"))


@register("""SELECT CAST(SUM(CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
CAST(SUM(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM labels""")
def confusion_matrix(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    predicted = labels.select("doc_id", (F.col("toxic") == 0).alias("is_true"))
    return evaluate.confusion(predicted, labels.select("doc_id", (F.col("quality") == 1).alias("label")), ["doc_id"])


@register(f"""WITH {CLAIMS}, {VOTED} SELECT c.source_id, CAST(SUM(CASE WHEN r.rk = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_true, CAST(SUM(CASE WHEN r.rk = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_false,
COUNT(*) AS n_total FROM claims c JOIN ranked r ON c.entity = r.entity AND c.value = r.value GROUP BY 1""")
def source_accuracy(spark, sf_dir):
    return evaluate.source_accuracy(fusion.fuse(flag_claims(spark, sf_dir), penalise=False)).drop("ratio")


@register("SELECT l_returnflag AS flag, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def aggregate_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"))
    low = retrieve.aggregate_view(rows, "Function_MIN", ("flag",)).withColumnRenamed("value", "low")
    return low.join(retrieve.aggregate_view(rows, "Function_MAX", ("flag",)).withColumnRenamed("value", "high"), "flag")


from verisift import inventory  # noqa: E402, F401 (adds its queries)
