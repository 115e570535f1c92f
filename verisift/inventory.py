"""Further registered queries: each runs an operator over a whole table and is held against SQL.

:mod:`verisift.catalog` has the claims these start from and adds them to its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions import text, vectors
from verisift.operators import entities, evaluate, fusion, models, retrieve
from verisift.plans.query import Engine, Query, Step
from verisift.registry import event_claims, flag_claims, register, table
from verisift.sources import profile, tables
from verisift.streaming import incremental

VEC = "CAST({0}.embedding AS DOUBLE[])"
GROUPS = """g AS (SELECT l_partkey AS e, CAST(l_suppkey % 10 AS VARCHAR) AS s, l_returnflag AS v, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT e, v, SUM(n) AS n, MIN(s) AS fs FROM g GROUP BY 1, 2), d AS (SELECT e, v, ROW_NUMBER() OVER (PARTITION BY e ORDER BY n DESC, fs, v) = 1 AS is_true FROM m)"""


# ---- alignment -----------------------------------------------------------------------------------------------------


def worded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose odd sources say the flag in words."""
    claims = flag_claims(spark, sf_dir)
    odd = F.col("source_id").cast("int") % 2 == 1
    return claims.withColumn("value", F.when(odd, F.concat(F.lit("returned, flag: "), "value")).otherwise(F.col("value")))


WORD_RULES = [[{"op": "remove_words", "args": [["returned", "flag"]]}, {"op": "trim"}]]


@register(f"""WITH {GROUPS}, c AS (SELECT l_partkey AS entity, CASE WHEN l_suppkey % 2 = 1 THEN 'returned, flag: ' || l_returnflag ELSE l_returnflag END AS value, l_returnflag AS v FROM lineitem)
SELECT c.entity, c.value, CAST(COUNT(*) AS BIGINT) AS n_rows, d.is_true FROM c JOIN d ON c.entity = d.e AND c.v = d.v GROUP BY 1, 2, 4""")
def fuse_with_rules(spark, sf_dir):
    view = fusion.fuse_aligned(worded_claims(spark, sf_dir), rules=WORD_RULES, penalise=False)
    return view.groupBy("entity", "value", "is_true").agg(F.count("*").alias("n_rows")).select("entity", "value", "n_rows", "is_true")


@register("""WITH c AS (SELECT l_partkey AS entity, CAST(l_suppkey % 10 AS VARCHAR) AS s, date_trunc('month', l_shipdate) AS month, CASE WHEN l_orderkey % 4 < 2 THEN 0 ELSE 5 END AS run FROM lineitem),
m AS (SELECT entity, month, run, COUNT(*) AS n, MIN(s) AS fs FROM c GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY n DESC, fs, month, run) AS rk FROM m)
SELECT entity, strftime(month, '%Y-%m') AS month, CAST(run AS INTEGER) AS run, n AS n_rows FROM r WHERE rk = 1""")
def fuse_dates(spark, sf_dir):
    """Times in two formats; minutes 0 and 1 are one value, and 5 and 6."""
    items = table(spark, sf_dir, "lineitem")
    minute = F.element_at(F.array(*map(F.lit, (0, 1, 5, 6))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    at = F.make_timestamp(F.year("l_shipdate"), F.month("l_shipdate"), F.lit(1), F.lit(9), minute, F.lit(0))
    source = (F.col("l_suppkey") % 10).cast("string")
    shown = F.when(F.col("l_suppkey") % 2 == 0, F.date_format(at, "yyyy-MM-dd hh:mm a")).otherwise(F.date_format(at, "M/d/yyyy h:mm a"))
    claims = items.select(F.col("l_partkey").alias("entity"), F.lit("shipped").alias("attribute"), source.alias("source_id"), F.col("l_orderkey").alias("row_id"), shown.alias("value"))
    view = fusion.fuse_aligned(claims, "date_string", penalise=False).filter("is_true")
    seen = view.withColumn("at", text.parse_time(F.col("value")))
    run = F.when(F.minute("at") < 2, 0).otherwise(5)
    return seen.groupBy("entity", F.date_format("at", "yyyy-MM").alias("month"), run.alias("run")).agg(F.count("*").alias("n_rows"))


@register("""SELECT (l_shipdate - INTERVAL 0 DAY) = l_shipdate AS same, CAST(l_orderkey % 3 AS INTEGER) AS gap, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def value_times_equal(spark, sf_dir):
    """Times a format and 0, 1 or 2 minutes apart: equal within a minute."""
    gap = (F.col("l_orderkey") % 3).cast("int")
    a, b = F.date_format("l_shipdate", "yyyy-MM-dd hh:mm a"), F.date_format(F.timestamp_seconds(F.unix_timestamp("l_shipdate") + 60 * gap), "M/d/yyyy h:mm a")
    told = table(spark, sf_dir, "lineitem").select((text.values_equal(a, b, "date_string") == (gap < 2)).alias("same"), gap.alias("gap"))
    return told.groupBy("same", "gap").agg(F.count("*").alias("n"))


@register("""SELECT replace(p_name, ' ', ' ') AS split, regexp_extract(p_brand, '[0-9]+', 0) AS extract, left(p_name, 1) || '. ' || split_part(p_name, ' ', 2) AS abbreviate,
split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS reorder, split_part(p_name, ' ', 2) AS removed, p_brand AS trimmed, COUNT(*) AS n FROM part WHERE p_name LIKE 'small %' GROUP BY ALL""")
def value_rule_operations(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter("p_name like 'small %'")
    rule = lambda c, *steps: text.apply_rule(c, [{"op": op, "args": args} for op, args in steps])
    name, brand = F.col("p_name"), F.col("p_brand")
    return part.groupBy(
        rule(F.replace(name, F.lit(" "), F.lit(";")), ("split", [";"])).alias("split"), rule(brand, ("extract", ["[0-9]+"])).alias("extract"), rule(name, ("abbreviate", [["small"]])).alias("abbreviate"),
        rule(name, ("reorder_words", [[1, 0]])).alias("reorder"), rule(name, ("remove_words", [["small"]])).alias("removed"), rule(F.concat(F.lit(" "), brand, F.lit("  ")), ("trim", [])).alias("trimmed"),
    ).agg(F.count("*").alias("n"))


@register("""SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS iso, COUNT(*) AS n FROM lineitem GROUP BY 1""")
def value_parse_dates(spark, sf_dir):
    shown = F.concat(F.lit("  "), F.date_format("l_shipdate", "MM/dd/yyyy"), F.lit("  (UTC)"))
    cleaned = text.apply_rule(text.clean_time(shown), [{"op": "parse_date", "args": ["MM/dd/yyyy"]}])
    return table(spark, sf_dir, "lineitem").groupBy(cleaned.alias("iso")).agg(F.count("*").alias("n"))


@register("""WITH v AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'Yes' WHEN p_partkey % 4 = 1 THEN CAST(p_retailprice AS VARCHAR) WHEN p_partkey % 4 = 2 THEN '2001-02-03 04:05' ELSE p_name END AS x, p_partkey % 4 AS k FROM part)
SELECT CASE k WHEN 0 THEN 'boolean' WHEN 1 THEN 'numeric' WHEN 2 THEN 'date' ELSE 'text' END AS kind, array_to_string(regexp_extract_all(x, '[^a-zA-Z0-9]+'), '|') AS separators, COUNT(*) AS n FROM v GROUP BY 1, 2""")
def value_format_probes(spark, sf_dir):
    k = F.col("p_partkey") % 4
    x = F.when(k == 0, "Yes").when(k == 1, F.col("p_retailprice").cast("string")).when(k == 2, "2001-02-03 04:05").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(x.alias("x")).groupBy(text.format_kind(F.col("x")).alias("kind"), text.separators(F.col("x")).alias("separators")).agg(F.count("*").alias("n"))


# ---- strings and vectors -------------------------------------------------------------------------------------------


@register("""WITH a AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a, y.a AS b FROM a x JOIN a y ON split_part(x.a, ' ', 2) = split_part(y.a, ' ', 2)),
l AS (SELECT a, b, string_split(a, '') AS ca, string_split(b, '') AS cb FROM p)
SELECT a, b, ROUND(1 - levenshtein(a, b)::DOUBLE / GREATEST(length(a), length(b)), 6) AS edit,
ROUND(len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) AS jaccard,
ROUND(2 * list_sum(list_transform(list_distinct(ca), lambda c: LEAST(len(list_filter(ca, lambda x: x = c)), len(list_filter(cb, lambda x: x = c)))))::DOUBLE / (length(a) + length(b)), 6) AS dice FROM l""")
def value_similarities(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("w", F.split("a", " ")[1])
    pairs = names.join(names.withColumnRenamed("a", "b"), "w")
    return pairs.select(
        "a", "b", F.round(text.edit_similarity(F.col("a"), F.col("b")), 6).alias("edit"), F.round(text.jaccard(F.split("a", " "), F.split("b", " ")), 6).alias("jaccard"),
        F.round(text.dice(F.col("a"), F.col("b")), 6).alias("dice"),
    )


@register("""WITH a AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a, y.a AS b, split_part(x.a, ' ', 1) AS xa, split_part(y.a, ' ', 1) AS ya, split_part(x.a, ' ', 2) AS w FROM a x JOIN a y ON split_part(x.a, ' ', 2) = split_part(y.a, ' ', 2))
SELECT a, b, CAST(100 AS DOUBLE) AS ratio FROM p WHERE w <> ''""")
def value_token_set_ratio(spark, sf_dir):
    """Names against their words turned round and with more words: the ratio is 100."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("w", F.split("a", " ")[1])
    pairs = names.join(names.withColumnRenamed("a", "b"), "w").filter("w <> ''")
    return pairs.select("a", "b", text.token_set_ratio(F.col("a"), F.concat_ws(", ", F.reverse(F.split("a", " ")).getItem(0), F.col("a"), F.col("b"))).alias("ratio"))


@register("""WITH p AS (SELECT p_partkey, lower(regexp_replace(p_name || '; ' || p_type || ' and ' || p_brand, '[,.]', ' ', 'g')) AS t FROM part),
n AS (SELECT p_partkey, unnest(string_split_regex(t, '[;\\\\&]| and ')) AS name, generate_subscripts(string_split_regex(t, '[;\\\\&]| and '), 1) AS i FROM p)
SELECT p_partkey, CAST(COUNT(*) AS INTEGER) AS n_names, string_agg(trim(regexp_replace(name, '[^a-z0-9\\s]', '', 'g')), '|' ORDER BY i) AS names FROM n GROUP BY 1""")
def value_name_tokens(spark, sf_dir):
    shown = text.tokens(F.concat("p_name", F.lit("; "), "p_type", F.lit(" and "), "p_brand"))
    part = table(spark, sf_dir, "part").select("p_partkey", shown.alias("t"))
    return part.select("p_partkey", F.size("t").alias("n_names"), F.array_join(F.transform("t", lambda n: F.array_join(n, " ")), "|").alias("names"))


@register("""SELECT c_custkey, lower(regexp_replace(c_name, '#', '_')) AS file, c_name AS cleaned, 'x ' || lower(c_mktsegment) AS field, c_mktsegment AS plain FROM customer""")
def value_cleaning(spark, sf_dir):
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower(text.file_name(F.col("c_name"))).alias("file"), text.key_text(F.concat(F.lit(' "'), "c_name", F.lit('" '))).alias("cleaned"),
        text.clean_field(F.concat(F.lit('x\t "'), seg, F.lit('"  '))).alias("field"), text.strip_tags(F.concat(F.lit("<b class=x>"), seg, F.lit("</b> "))).alias("plain"),
    )


@register("""SELECT p_partkey, p_name AS a, p_brand AS b, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS c FROM part""")
def ragged_rows(spark, sf_dir):
    """Rows of two or four fields as three."""
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("\t", "p_name", "p_brand")).otherwise(F.concat_ws("\t", "p_name", "p_brand", "p_type", F.lit("more")))
    fields = table(spark, sf_dir, "part").select("p_partkey", text.repair_row(line, 3).alias("f"))
    return fields.select("p_partkey", *(F.col("f")[i].alias(c) for i, c in enumerate("abc")))


@register(f"""WITH q AS (SELECT {VEC.format("e")} AS q FROM embeddings e WHERE vec_id = 0)
SELECT vec_id, ROUND(list_inner_product({VEC.format("e")}, q), 6) AS dot, ROUND(list_cosine_similarity({VEC.format("e")}, q), 6) AS cosine, ROUND(POW(list_distance({VEC.format("e")}, q), 2), 6) AS distance,
ROUND(1 / (1 + EXP(-list_inner_product({VEC.format("e")}, q))), 6) AS sigmoid,
ROUND(EXP(CAST(e.embedding[1] AS DOUBLE)) / list_sum(list_transform({VEC.format("e")}, lambda x: EXP(x))), 6) AS softmax FROM embeddings e, q""")
def vector_functions(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings")
    first = every.filter("vec_id = 0").first()["embedding"]
    q, x = F.array(*(F.lit(float(v)) for v in first)), F.col("embedding")
    return every.select(
        "vec_id", F.round(vectors.dot(x, q), 6).alias("dot"), F.round(vectors.cosine(x, q), 6).alias("cosine"), F.round(vectors.squared_distance(x, q), 6).alias("distance"),
        F.round(vectors.sigmoid(vectors.dot(x, q)), 6).alias("sigmoid"), F.round(vectors.softmax(F.transform(x, lambda v: v.cast("double")))[0], 6).alias("softmax"),
    )


@register(f"""WITH n AS (SELECT label, {VEC.format("e")} AS x, COALESCE(LEAD({VEC.format("e")}) OVER w, FIRST_VALUE({VEC.format("e")}) OVER w) AS y FROM embeddings e WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, ROUND(AVG(list_cosine_similarity(x, y)), 6) AS cosine FROM n GROUP BY 1""")
def ring_cosines(spark, sf_dir):
    return vectors.ring_cosine(table(spark, sf_dir, "embeddings"), ["label"], "vec_id").select("label", F.round("cosine", 6).alias("cosine"))


MEANS = """p AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, AVG(x) AS x FROM p GROUP BY 1, 2) z GROUP BY 1)"""


@register(f"""WITH {MEANS}, s AS (SELECT e.label, vec_id, ROUND(list_cosine_similarity({VEC.format("e")}, mean), 6) AS score FROM embeddings e JOIN m ON e.label = m.label)
SELECT label AS entity, vec_id AS row_id, score, score > 0.8 * MAX(score) OVER (PARTITION BY label) AS many, score = MAX(score) OVER (PARTITION BY label) AS one FROM s""")
def batch_answers(spark, sf_dir):
    """Claims scored by the cosine to their mean; several truths by a share of the best, one without the tie-in of a batch."""
    claims = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("entity"), F.lit("vector").alias("attribute"), F.lit("1").alias("source_id"), F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("value"), "embedding"
    )
    scored = fusion.cosine_scores(claims).withColumn("score", F.round("score", 6)).drop("embedding")
    many = fusion.extract_answers(scored, True).withColumnRenamed("is_true", "many")
    return fusion.extract_answers(many, False, tie_in=False).select("entity", "row_id", "score", "many", F.col("is_true").alias("one"))


# ---- retrieval -----------------------------------------------------------------------------------------------------


@register(f"""WITH q AS (SELECT {VEC.format("e")} AS q FROM embeddings e WHERE vec_id = 0), s AS (SELECT vec_id, CAST(vec_id % 10 AS VARCHAR) AS source_id, list_inner_product({VEC.format("e")}, q) AS score FROM embeddings e, q),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY score DESC) AS rk FROM s WHERE score > 0.2) SELECT source_id, 'c' || vec_id AS column_name, ROUND(score, 6) AS score FROM r WHERE rk = 1""")
def bind_columns(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings")
    columns = every.select((F.col("vec_id") % 10).cast("string").alias("source_id"), F.concat(F.lit("c"), "vec_id").alias("column_name"), "embedding")
    return retrieve.bind_columns(every.filter("vec_id = 0"), columns, 0.2).select("source_id", "column_name", F.round("score", 6).alias("score"))


@register(f"""SELECT DISTINCT v.vec_id AS row_id FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND list_inner_product({VEC.format("v")}, {VEC.format("q")}) >= 0.4""")
def filter_by_vectors(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings")
    view = every.select(F.col("vec_id").alias("row_id"), "embedding")
    asked = every.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("target_id"), "embedding")  # the stated query set
    return retrieve.filter_fused_vectors(view, asked, 0.4).select("row_id")


@register(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, -POW(list_distance({VEC.format("q")}, {VEC.format("v")}), 2) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(score, 9) DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, ROUND(score, 5) + 0.0 AS score FROM r WHERE rk <= 5""")
def nearest_by_distance(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = every.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = retrieve.nearest(asked, every, "query_id", "vec_id", 5, by="distance")
    return found.select("query_id", "vec_id", (F.round("score", 5) + 0.0).alias("score"))


@register("""SELECT l_orderkey, l_partkey, CAST(1.0 AS DOUBLE) AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 11)""")
def retrieve_by_view(spark, sf_dir):
    view = table(spark, sf_dir, "part").filter("p_size = 11")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return retrieve.retrieve_by_view(rows, "l_partkey", view, "p_partkey").withColumn("score", F.lit(1.0))


@register("""SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice > (SELECT MIN(p_retailprice) FROM part WHERE p_size = 11) * 1""")
def retrieve_above_view(spark, sf_dir):
    view = table(spark, sf_dir, "part").filter("p_size = 11")
    return retrieve.retrieve_by_view(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice", view, "p_retailprice", ">")


@register("""SELECT o_orderkey AS row_id, CAST(o_custkey % 10 AS VARCHAR) AS source_id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus = 'F'""")
def intersect_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 10).cast("string").alias("source_id"), "o_totalprice", "o_orderstatus")
    flagged = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("row_id"))
    base = retrieve.select_rows(rows.filter("o_orderstatus = 'F'"), flagged, ("row_id",)).select("source_id", "row_id")
    return retrieve.select_rows(rows, base).drop("o_orderstatus")


MATCHES = "x AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS source_id, l_partkey AS entity, l_orderkey AS row_id, l_linenumber, l_extendedprice AS score FROM lineitem)"


@register(f"""WITH {MATCHES}, b AS (SELECT entity FROM x ORDER BY score DESC, source_id, entity LIMIT 1) SELECT source_id, entity, row_id, score FROM x WHERE entity = (SELECT entity FROM b)""")
def anchor_on_best_source(spark, sf_dir):
    return retrieve.best_entity(_matches(spark, sf_dir))


@register(f"""WITH {MATCHES}, s AS (SELECT source_id, MAX(score) AS m FROM x GROUP BY 1) SELECT source_id, COUNT(*) AS n_rows FROM x WHERE source_id IN (SELECT source_id FROM s WHERE m > 0.99 * (SELECT MAX(m) FROM s)) GROUP BY 1""")
def prune_sources(spark, sf_dir):
    return retrieve.prune_sources(_matches(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("n_rows"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).cast("string").alias("source_id"), F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("score")
    )


@register("SELECT l_returnflag AS flag, ROUND(AVG(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
def aggregate_average(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("string").alias("value"))
    return retrieve.aggregate_view(rows, "Function_AVG", ("flag",)).select("flag", F.round("value", 4).alias("value"))


# ---- fusion --------------------------------------------------------------------------------------------------------


@register(f"""WITH {GROUPS}, t AS (SELECT g.*, is_true FROM g JOIN d ON g.e = d.e AND g.v = d.v),
sh AS (SELECT a.e, a.s AS s, b.s AS t, SUM(LEAST(a.n, b.n) * CASE WHEN a.is_true THEN 0.2 ELSE 1.0 END) AS w, COUNT(*) AS k FROM t a JOIN t b ON a.e = b.e AND a.v = b.v AND a.s < b.s GROUP BY 1, 2, 3),
c AS (SELECT e, s, COUNT(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT x.e, x.s AS s, y.s AS t, x.n AS nx, y.n AS ny FROM c x JOIN c y ON x.e = y.e AND x.s < y.s),
j AS (SELECT b.s, b.t, COALESCE(w, 0) AS w, CASE WHEN nx > COALESCE(k, 0) AND ny > COALESCE(k, 0) THEN 1.0 ELSE 0.0 END AS alone FROM b LEFT JOIN sh ON b.e = sh.e AND b.s = sh.s AND b.t = sh.t)
SELECT s, t, ROUND((0.1 + SUM(w)) * 0.98, 6) AS alpha, ROUND((5 + SUM(alone)) * 0.98, 6) AS beta, ROUND((0.1 + SUM(w)) / (5.1 + SUM(w) + SUM(alone)), 6) AS c FROM j GROUP BY 1, 2""")
def copy_statistics(spark, sf_dir):
    """Evidence of copying of one batch, with the decided truths, decayed, and the probability that follows."""
    groups = fusion.group_by_source(flag_claims(spark, sf_dir))
    decided = fusion.single_truth(fusion.merge_sources(groups, penalise=False))
    stats = fusion.update_copying(None, fusion.copy_evidence(groups, decided))
    told = stats.join(fusion.copy_probability(stats), ["attribute", "s", "t"])
    return told.select("s", "t", *(F.round(c, 6).alias(c) for c in ("alpha", "beta", "c")))


@register(f"""WITH {GROUPS}, c AS (SELECT CAST(l.l_suppkey % 10 AS VARCHAR) AS s, COUNT(*) AS total, SUM(CASE WHEN is_true THEN 1 ELSE 0 END) AS correct FROM lineitem l JOIN d ON l.l_partkey = d.e AND l.l_returnflag = d.v GROUP BY 1),
z AS (SELECT GREATEST(0.1 * SUM(total), 10) AS n0 FROM c)
SELECT s AS source_id, 'partkey' AS condition, 'returnflag' AS attribute, ROUND((CASE WHEN CAST(s AS INT) = 9 THEN 1.0 ELSE GREATEST(0.99 - CAST(s AS INT) % 5 * 0.2, 0.001) END * n0 + correct) / (n0 + total), 6) AS confidence FROM c, z""")
def learned_confidence(spark, sf_dir):
    """Confidences by source and pair of attributes from fused truths; the last source has no level."""
    claims = flag_claims(spark, sf_dir)
    stats = fusion.confidence_statistics(fusion.fuse(claims, penalise=False), "partkey")
    levels = spark.createDataFrame([(str(i), i % 5 + 1) for i in range(9)], "source_id string, confidence_level int")
    told = fusion.learned_confidence(stats, levels, claims.count())
    return told.withColumn("confidence", F.round("confidence", 6))


@register(f"""WITH g AS (SELECT l_partkey AS e, CAST(l_suppkey % 10 AS VARCHAR) AS s, l_returnflag AS v, COUNT(*) * GREATEST(0.99 - l_suppkey % 10 % 5 * 0.2, 0.001) AS w FROM lineitem GROUP BY 1, 2, l_suppkey % 10, 3)
SELECT e AS entity, v AS value, ROUND(SUM(w), 6) AS score FROM g GROUP BY 1, 2""")
def fuse_with_confidence(spark, sf_dir):
    levels = spark.createDataFrame([(str(i), i % 5 + 1) for i in range(10)], "source_id string, level int")
    confidence = levels.select("source_id", fusion.prior_confidence(F.col("level")).alias("confidence"))
    merged = fusion.merge_sources(fusion.group_by_source(flag_claims(spark, sf_dir), confidence), penalise=False)
    return merged.select("entity", "value", F.round("score", 6).alias("score"))


@register("""WITH c AS (SELECT l_partkey AS entity, l_suppkey % 10 AS s, l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN ' ' WHEN l_orderkey % 7 = 2 THEN 'nan' ELSE l_returnflag END AS value FROM lineitem),
m AS (SELECT entity, value, COUNT(*) AS n, MIN(CAST(s AS VARCHAR)) AS fs FROM c WHERE l_orderkey % 7 > 2 GROUP BY 1, 2), d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY n DESC, fs, value) = 1 AS ok FROM m)
SELECT c.entity, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN d.value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_nulls, CAST(SUM(CASE WHEN COALESCE(ok, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_true, ROUND(SUM(COALESCE(n, 0)), 6)::DOUBLE AS score
FROM c LEFT JOIN d ON c.entity = d.entity AND c.value = d.value GROUP BY 1""")
def null_claims(spark, sf_dir):
    """Nulls, blanks and not-a-numbers are false with score 0, whatever the others say."""
    k = F.col("row_id") % 7
    claims = flag_claims(spark, sf_dir).withColumn("value", F.when(k == 1, " ").when(k == 2, "nan").when(k > 2, F.col("value")))
    view = fusion.fuse(claims, penalise=False)
    return view.groupBy("entity").agg(
        F.count("*").alias("n_rows"), F.sum(text.is_null(F.col("value")).cast("long")).alias("n_nulls"), F.sum(F.col("is_true").cast("long")).alias("n_true"), F.round(F.sum("score"), 6).alias("score")
    )


@register("""WITH v AS (SELECT l_partkey AS e, l_returnflag AS v, COUNT(*)::DOUBLE AS score FROM lineitem GROUP BY 1, 2), w AS (SELECT *, MAX(score) OVER (PARTITION BY e) AS top, FIRST_VALUE(v) OVER (PARTITION BY e ORDER BY score DESC, v) AS best FROM v)
SELECT e AS entity, v AS value, score, score > 0.8 * top AS many, score = top OR v = best AS one FROM w""")
def baseline_answers(spark, sf_dir):
    votes = fusion.majority_vote(flag_claims(spark, sf_dir), 10).withColumn("score", F.col("votes").cast("double"))
    many = fusion.extract_answers(votes, True).withColumnRenamed("is_true", "many")
    return fusion.extract_answers(many, False).select("entity", "value", "score", "many", F.col("is_true").alias("one"))


@register("SELECT l_partkey AS entity, COUNT(*) AS n_rows, CAST(COUNT(*) AS DOUBLE) AS score FROM lineitem GROUP BY 1")
def decomposed_answers(spark, sf_dir):
    """The mode that doesn't fuse: every claim is true with score 1."""
    engine = Engine(flag_claims(spark, sf_dir), mode="decompose")
    view = engine.run(Query("1", (Step("returnflag"),))).filter("is_true")
    return view.groupBy("entity").agg(F.count("*").alias("n_rows"), F.sum("score").alias("score"))


@register("""WITH v AS (SELECT l_partkey AS e, l_returnflag AS v, COUNT(DISTINCT l_suppkey % 10)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT e, v, n / SUM(n) OVER (PARTITION BY e) AS score FROM v)
SELECT e AS entity, v AS value, ROUND(score, 6) AS score, score = MAX(score) OVER (PARTITION BY e) AS is_true FROM s""")
def batch_mode(spark, sf_dir):
    """All entities are fused by a baseline model first, as a batch; answers have no tie-in."""
    engine = Engine(flag_claims(spark, sf_dir).withColumn("entity", F.col("entity").cast("string")), mode="batch", model="majority")
    view = engine.run(Query("1", (Step("returnflag"),)))
    return view.select(F.col("entity").cast("long").alias("entity"), "value", F.round("score", 6).alias("score"), "is_true").distinct()


DART = """said AS (SELECT DISTINCT l_partkey AS e, l_suppkey % 10 AS s, l_returnflag AS v FROM lineitem), vals AS (SELECT DISTINCT e, v FROM said), srcs AS (SELECT e, s, COUNT(*)::DOUBLE AS p FROM said GROUP BY 1, 2),
nv AS (SELECT e, COUNT(*)::DOUBLE AS n FROM vals GROUP BY 1), grid AS (SELECT vals.e, v, srcs.s, p, n, EXISTS (SELECT 1 FROM said x WHERE x.e = vals.e AND x.s = srcs.s AND x.v = vals.v) AS has FROM vals JOIN srcs ON vals.e = srcs.e JOIN nv ON nv.e = vals.e),
g AS (SELECT *, CASE WHEN has THEN (1 - (n - p) / (n * n)) / p ELSE 1 / (n * n) END AS conf FROM grid)"""


def _dart_round(k: int) -> str:
    rec, sp = ("0.8", "0.9") if k == 1 else ("rec", "sp")
    own = "g" if k == 1 else f"(SELECT g.*, t{k - 1}.rec, t{k - 1}.sp FROM g JOIN t{k - 1} ON g.e = t{k - 1}.e AND g.s = t{k - 1}.s)"
    before = "0.9" if k == 1 else "ANY_VALUE(q.sp)"
    join = "" if k == 1 else f" JOIN t{k - 1} q ON q.e = g.e AND q.s = g.s"
    return f"""r{k} AS (SELECT e, v, 1 / (1 + ((1 - 0.5) / (0.5 + 1e-10)) * EXP(SUM(CASE WHEN has THEN conf * LN(1 - {rec} + 1e-10) ELSE conf * LN(LEAST(GREATEST({sp}, 1e-10), 1)) END)
 - SUM(CASE WHEN has THEN conf * LN(LEAST(GREATEST({rec}, 1e-10), 1)) ELSE conf * LN(1 - {sp} + 1e-10) END))) AS ver FROM {own} o GROUP BY 1, 2),
t{k} AS (SELECT g.e, g.s, SUM(CASE WHEN has THEN ver ELSE 0 END) / ANY_VALUE(p) AS rec, CASE WHEN SUM(CASE WHEN has THEN 0 ELSE 1 END) > 0 THEN SUM(CASE WHEN has THEN 0 ELSE 1 - ver END) / SUM(CASE WHEN has THEN 0 ELSE 1 END) ELSE {before} END AS sp
 FROM g JOIN r{k} ON g.e = r{k}.e AND g.v = r{k}.v{join} GROUP BY 1, 2)"""


@register(f"WITH {DART}, {', '.join(map(_dart_round, (1, 2, 3)))} SELECT CAST(e AS VARCHAR) AS entity, v AS value, ROUND(ver, 5) AS score FROM r3")
def model_dart_rounds(spark, sf_dir):
    return models.run_model(flag_claims(spark, sf_dir), "dart", iterations=3).select("entity", "value", F.round("score", 5).alias("score"))


@register("""WITH said AS (SELECT DISTINCT l_partkey AS e, l_suppkey % 10 AS s, l_returnflag AS v FROM lineitem), s1 AS (SELECT e, v, COUNT(*) * -LN(1 - 0.9) AS sig FROM said GROUP BY 1, 2),
v1 AS (SELECT a.e, a.v, 1 / (1 + EXP(-0.3 * (a.sig + 0.5 * COALESCE((SELECT SUM(b.sig) FROM s1 b WHERE b.e = a.e AND b.v <> a.v), 0) * -0.6))) AS ver FROM s1 a),
t1 AS (SELECT x.e, x.s, AVG(ver) AS t FROM said x JOIN v1 ON x.e = v1.e AND x.v = v1.v GROUP BY 1, 2), s2 AS (SELECT x.e, x.v, SUM(-LN(1 - t)) AS sig FROM said x JOIN t1 ON x.e = t1.e AND x.s = t1.s GROUP BY 1, 2)
SELECT CAST(a.e AS VARCHAR) AS entity, a.v AS value, ROUND(1 / (1 + EXP(-0.3 * (a.sig + 0.5 * COALESCE((SELECT SUM(b.sig) FROM s2 b WHERE b.e = a.e AND b.v <> a.v), 0) * -0.6))), 5) AS score FROM s2 a""")
def model_truth_finder_rounds(spark, sf_dir):
    """Two rounds with implication between values: flags share no letters, so each speaks against the others."""
    return models.run_model(flag_claims(spark, sf_dir), "truth_finder", iterations=2, tolerance=-1.0).select("entity", "value", F.round("score", 5).alias("score"))


@register(f"""WITH {GROUPS}, t AS (SELECT e, s, MIN(g.v) AS tv FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.e = g.e AND d.v = g.v AND is_true) GROUP BY 1, 2), x AS (SELECT e, s, v FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.e = g.e AND d.v = g.v AND NOT is_true)),
p AS (SELECT DISTINCT t.s AS true_source, x.s AS error_source, tv AS true_value, v AS error_value FROM t JOIN x ON t.e = x.e)
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY true_source, error_source ORDER BY true_value, error_value) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def alignment_failures(spark, sf_dir):
    return fusion.alignment_failures(fusion.fuse(flag_claims(spark, sf_dir), penalise=False)).drop("attribute")


@register("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part WHERE p_size = 11 UNION SELECT DISTINCT p_type, p_brand FROM part WHERE p_size = 11),
r AS (SELECT a, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a), k AS (SELECT a, MIN(c) AS c FROM r GROUP BY 1)
SELECT 'type' AS attribute, c AS component, string_agg(a, '|' ORDER BY a) AS vals FROM k GROUP BY 2""")
def failure_classes(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter("p_size = 11")
    pairs = part.select(F.lit("type").alias("attribute"), F.col("p_brand").alias("true_value"), F.col("p_type").alias("error_value")).distinct()
    return fusion.failure_classes(pairs).select("attribute", "component", F.array_join("values", "|").alias("vals"))


@register("""WITH h AS (SELECT l_partkey AS e, l_returnflag AS v, COUNT(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), f AS (SELECT l_partkey AS e, l_returnflag AS v, COUNT(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2)
SELECT COALESCE(h.e, f.e) AS entity, COALESCE(h.v, f.v) AS value, ROUND(COALESCE(h.n, 0) * CASE WHEN COALESCE(h.e, f.e) IN (SELECT e FROM f) THEN 0.9048374180359595 ELSE 1 END + COALESCE(f.n, 0), 6) AS score, COALESCE(h.n, 0) + COALESCE(f.n, 0) AS n_rows
FROM h FULL JOIN f ON h.e = f.e AND h.v = f.v""")
def merge_history(spark, sf_dir):
    """Groups of the first lines of orders as history, of the others as the batch after it."""
    items = table(spark, sf_dir, "lineitem")
    claims = items.select(F.col("l_partkey").alias("entity"), F.lit("returnflag").alias("attribute"), (F.col("l_suppkey") % 10).cast("string").alias("source_id"), F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("line"))
    part = lambda rows: fusion.merge_sources(fusion.group_by_source(rows.drop("line")), penalise=False)
    merged = fusion.merge_history(part(claims.filter("line <= 3")), part(claims.filter("line > 3")))
    return merged.select("entity", "value", F.round("score", 6).alias("score"), "n_rows")


# ---- profiles ------------------------------------------------------------------------------------------------------


@register("""SELECT column_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric, CAST(SUM(CASE WHEN column_name = 'l_shipdate' THEN 1 ELSE 0 END) AS BIGINT) AS n_dates,
BOOL_AND(regexp_full_match(v, '[A-Za-z0-9]+')) AS alnum FROM (SELECT 'l_quantity' AS column_name, CAST(l_quantity AS VARCHAR) AS v FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem UNION ALL SELECT 'l_shipdate', CAST(l_shipdate AS VARCHAR) FROM lineitem) z GROUP BY 1""")
def profile_parses(spark, sf_dir):
    found = profile.column_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_shipdate"])
    return found.select("column_name", "n_rows", "n_numeric", "n_dates", "alnum")


@register("""SELECT * FROM (VALUES ('l_quantity', 'numeric'), ('l_returnflag', 'special'), ('l_shipdate', 'general_noEmd'), ('l_orderkey', 'primary_noEmd')) t(column_name, property)""")
def inferred_types(spark, sf_dir):
    """By rule; the key is declared."""
    found = profile.column_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_shipdate", "l_orderkey"])
    return profile.infer_types(found, expected={"l_orderkey": "primary_noEmd"})


@register("""SELECT * FROM (VALUES ('flag', CAST(2 AS BIGINT), CAST(2 AS BIGINT))) t(column_name, n_types, n_sources)""")
def inconsistent_types(spark, sf_dir):
    """A column that one source has as words and another as numbers."""
    items = table(spark, sf_dir, "lineitem")
    types = None
    for source, flag in (("1", F.col("l_returnflag")), ("2", F.col("l_linenumber"))):
        found = profile.infer_types(profile.column_profile(items.select(flag.alias("flag"), "l_quantity"), ["flag", "l_quantity"])).withColumn("source_id", F.lit(source))
        types = found if types is None else types.union(found)
    return profile.inconsistent_columns(types)


@register("""WITH b AS (SELECT l_orderkey, l_returnflag AS v FROM lineitem WHERE l_returnflag <> 'N') SELECT MIN(l_orderkey) AS l_orderkey, COUNT(*) AS n_invalid FROM b""")
def first_invalid_row(spark, sf_dir):
    return profile.first_invalid(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_returnflag") == "N", "l_orderkey").select("l_orderkey", "n_invalid")


@register("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0 OR vec_id % 50 = 1")
def embedding_faults(spark, sf_dir):
    """Values without a vector, and vectors without a value."""
    k = F.col("vec_id") % 50
    zero = F.transform("embedding", lambda x: x * 0)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(k != 0, F.col("label").cast("string")).alias("value"), F.when(k == 1, zero).otherwise(F.col("embedding")).alias("embedding"))
    return profile.embedding_faults(rows, "value", "embedding").select("vec_id")


@register("""SELECT p_partkey, 'first' AS side FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT DISTINCT l_partkey, 'second' FROM lineitem WHERE l_partkey % 10 = 7""")
def reader_difference(spark, sf_dir):
    """Two readings of the parts, each without a tenth of the keys."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).filter("p_partkey % 10 <> 3")
    return profile.key_difference(table(spark, sf_dir, "part").filter("p_partkey % 10 <> 7"), items, "p_partkey")


@register("""SELECT c_custkey FROM customer WHERE c_mktsegment <> lower(c_mktsegment) AND c_custkey % 3 > 0""")
def unclean_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return profile.unclean(rows, ["segment"]).select("c_custkey")


@register("""SELECT p_partkey AS entity, a.k AS attribute, CAST(p_size % 3 AS VARCHAR) AS source_id, p_partkey AS row_id, CASE a.k WHEN 'p_name' THEN p_name ELSE p_brand END AS value FROM part, (VALUES ('p_name'), ('p_brand')) a(k)""")
def claims_of_records(spark, sf_dir):
    """Wide records as claims, a row a value."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_size") % 3).cast("string").alias("source_id"), F.col("p_partkey").alias("row_id"))
    return tables.claims(part, "p_partkey", ["p_name", "p_brand"]).withColumn("entity", F.col("entity").cast("long"))


# ---- entities, increments, evaluation ------------------------------------------------------------------------------


@register("""SELECT p_name AS entity, CAST(p_size % 3 AS VARCHAR) AS source_id, COUNT(*) AS n_rows, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY p_partkey) AS rows FROM part GROUP BY 1, 2""")
def key_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity"), (F.col("p_size") % 3).cast("string").alias("source_id"), F.col("p_partkey").alias("row_id"))
    return evaluate.key_index(part).select("entity", "source_id", "n_rows", F.array_join("rows", "|").alias("rows"))


@register("""SELECT p_brand AS query_id, COUNT(DISTINCT p_name) AS n_values, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS vals FROM part GROUP BY 1""")
def distinct_query_values(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_name").alias("value"))
    return evaluate.distinct_values(rows).select("query_id", "n_values", F.array_join("values", "|").alias("vals"))


@register("""WITH p AS (SELECT DISTINCT p_brand AS q, p_name AS v FROM part), g AS (SELECT DISTINCT p_brand AS q, p_name AS v FROM part WHERE p_size > 25)
SELECT p.q AS query_id, COUNT(*) AS n_predicted, COUNT(g.v) AS n_correct FROM p LEFT JOIN g ON p.q = g.q AND p.v = g.v GROUP BY 1""")
def value_evaluation(spark, sf_dir):
    """Predicted values in capitals and turned round, against gold ones."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_name").alias("value"), "p_size")
    turned = F.upper(F.concat_ws(", ", F.split("value", " ")[1], F.split("value", " ")[0]))
    return evaluate.evaluate_values(part.select("query_id", turned.alias("value")), part.filter("p_size > 25").select("query_id", "value"), 99.9)


@register("""WITH c AS (SELECT CAST(SUM(CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(SUM(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
CAST(SUM(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(SUM(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM labels),
r AS (SELECT *, COALESCE(100 * tp / NULLIF(tp + fp, 0), 0) AS p, COALESCE(100 * tp / NULLIF(tp + fn, 0), 0) AS r FROM c)
SELECT ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(2 * p * r / GREATEST(p + r, 1), 6) AS f1, ROUND(100 * (tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, ROUND(COALESCE(100 * tn / NULLIF(tn + fp, 0), 0), 6) AS specificity,
ROUND(COALESCE(100 * tn / NULLIF(tn + fn, 0), 0), 6) AS npv, ROUND(COALESCE(100 * fp / NULLIF(fp + tn, 0), 0), 6) AS fpr, ROUND(COALESCE(100 * fn / NULLIF(fn + tp, 0), 0), 6) AS fnr,
ROUND(COALESCE((tp * tn - fp * fn) / NULLIF(SQRT((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM r""")
def metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    counts = evaluate.confusion(labels.select("doc_id", (F.col("toxic") == 0).alias("is_true")), labels.select("doc_id", (F.col("quality") == 1).alias("label")), ["doc_id"])
    told = evaluate.metrics(counts).drop("tp", "fp", "fn", "tn")
    return told.select(*(F.round(c, 6).alias(c) for c in told.columns))


@register("""WITH l AS (SELECT DISTINCT p_brand AS q, lower(p_name) AS v, p_name LIKE 'small%' AS label FROM part WHERE p_size > 25)
SELECT p_partkey, COALESCE(CAST(l.label AS VARCHAR), 'none') AS label FROM part p LEFT JOIN l ON p.p_brand = l.q AND lower(p.p_name) = l.v""")
def propagated_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("query_id"), F.col("p_name").alias("value"), "p_size")
    labels = part.filter("p_size > 25").select("query_id", F.upper("value").alias("value"), F.startswith("value", F.lit("small")).alias("label"))
    return evaluate.propagate_labels(part.drop("p_size"), labels).select("p_partkey", F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"))


@register("SELECT event_type AS method, ROUND(AVG(value), 6) AS mean_s, ROUND(SUM(value), 4) AS sum_s, MAX(value) AS max_s, MIN(value) AS min_s FROM events GROUP BY 1")
def time_statistics(spark, sf_dir):
    found = evaluate.time_statistics(table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.col("value").alias("seconds")))
    return found.select("method", F.round("mean_s", 6).alias("mean_s"), F.round("sum_s", 4).alias("sum_s"), "max_s", "min_s")


@register("""WITH v AS (SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) % 4 AS VARCHAR) AS source_id, event_id AS row_id, event_type <> 'error' AS ok FROM events), t AS (SELECT DISTINCT entity, day AS now FROM v)
SELECT t.entity, now AS "timestamp", source_id, COALESCE(string_agg(CAST(row_id AS VARCHAR), '|' ORDER BY row_id) FILTER (WHERE ok), '') AS true_rows, COALESCE(string_agg(CAST(row_id AS VARCHAR), '|' ORDER BY row_id) FILTER (WHERE NOT ok), '') AS false_rows
FROM t JOIN v ON t.entity = v.entity AND day <= now GROUP BY 1, 2, 3""")
def temporal_answers(spark, sf_dir):
    """The true and false rows of each user known after each day."""
    e = table(spark, sf_dir, "events")
    view = e.select(F.col("user_id").alias("entity"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), (F.hour("ts") % 4).cast("string").alias("source_id"), F.col("event_id").alias("row_id"), (F.col("event_type") != "error").alias("is_true"))
    found = evaluate.answers_at(view)
    return found.select("entity", "timestamp", "source_id", *(F.array_join(c, "|").alias(c) for c in ("true_rows", "false_rows")))


@register("""SELECT user_id AS entity, CAST(hour(ts) % 4 AS VARCHAR) AS source_id, event_type AS value, strftime(ts, '%Y-%m-%d') AS batch_ts, COUNT(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') > '2024-01-15' AND user_id % 2 = 0 GROUP BY ALL""")
def delta_rows(spark, sf_dir):
    """What came after the day that the queries about even users have seen."""
    claims = event_claims(spark, sf_dir).withColumnRenamed("batch", "batch_ts")
    last = claims.select("entity").distinct().filter("entity % 2 = 0").withColumn("query_id", F.lit("1")).withColumn("batch_ts", F.lit("2024-01-15"))
    return incremental.delta(claims, last).groupBy("entity", "source_id", "value", "batch_ts").agg(F.count("*").alias("n"))


@register("""WITH n AS (SELECT CAST(l_suppkey AS VARCHAR) AS source_id, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT source_id, n AS n_rows FROM n""")
def largest_sources(spark, sf_dir):
    """The log of the ten largest sources: all their rows, some in the initial state and some in batches."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"), F.struct("l_orderkey", "l_linenumber").alias("id"))
    log = incremental.generate_log(items, "id", start=0, sources=10)
    return log.filter("timestamp between 0 and 100").groupBy("source_id").agg(F.count("*").alias("n_rows"))


@register("""WITH RECURSIVE n AS (SELECT vec_id AS id, label FROM embeddings) SELECT id, MIN(id) OVER (PARTITION BY label) AS entity FROM n""")
def merged_entities(spark, sf_dir):
    """Vectors of one direction for each label, from three sources: members of a source are clusters, and clusters of sources meet by their centroids."""
    every = table(spark, sf_dir, "embeddings")
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0) + F.when(i == F.col("vec_id") % 3 + 40, 0.01).otherwise(0.0))
    unit = every.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("string").alias("source_id"), F.col("label"), one.alias("embedding"))
    first = unit.groupBy("source_id", "label").agg(F.min("id").alias("entity"))
    members = unit.join(first, ["source_id", "label"]).select("id", "source_id", "entity", "embedding")
    found = entities.merge_across_sources(members)
    return found.select("id", "entity")

