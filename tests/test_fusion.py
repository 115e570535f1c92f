import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verisift.functions import text
from verisift.operators import evaluate, fusion, models, retrieve
from verisift.operators.components import connected_components
from verisift.plans.query import Engine, Query, Step, levels, merge_queries
from verisift.streaming.incremental import Fusion, generate_log, replay

CLAIMS = "entity string, attribute string, source_id string, row_id long, value string"


def claims(spark, rows):
    return spark.createDataFrame([(e, "a", s, r, v) for e, s, r, v in rows], CLAIMS)


def test_views_route_nulls_to_errors(spark):
    c = claims(spark, [("e1", "1", 0, "a"), ("e1", "2", 0, "a"), ("e1", "3", 0, "b"), ("e1", "3", 1, None)])
    got = {(r.source_id, r.row_id): (r.is_true, r.score) for r in fusion.fuse(c, penalise=False).collect()}
    assert got == {("1", 0): (True, 2.0), ("2", 0): (True, 2.0), ("3", 0): (False, 1.0), ("3", 1): (False, 0.0)}


def test_order_of_rows_plays_no_part(spark):
    rows = [("e", str(s), s, v) for s, v in enumerate(["x", "y", "y", "x", "z"])]
    one, two = (sorted(map(tuple, fusion.fuse(claims(spark, r)).collect())) for r in (rows, rows[::-1]))
    assert one == two


def test_copy_penalty_formula(spark):
    c = claims(spark, [("e", "1", 0, "a"), ("e", "2", 0, "a"), ("e", "2", 1, "a")])
    merged = fusion.merge_sources(fusion.group_by_source(c)).first()
    p = 0.1 / 5.1
    assert merged.score == pytest.approx(3 * 5 / (5 + 2 * p * 2 + 1e-9))


def test_names_contain_and_conflict():
    names = [[["john", "smith"]], [["john", "r", "smith"]], [["jane", "smith"]]]
    assert fusion.resolve(names, [1.0, 3.0, 1.0]) == [True, True, False]
    assert fusion.resolve([], []) == []


def test_confidence(spark):
    row = spark.range(1).select(fusion.prior_confidence(F.lit(1)).alias("p"), fusion.updated_confidence(F.lit(0.5), F.lit(10), F.lit(10), F.lit(50)).alias("c")).first()
    assert row.p == pytest.approx(0.99) and row.c == pytest.approx(0.75)


def _frame():
    return pd.DataFrame({"entity": "e", "attribute": "a", "source_id": ["1", "2", "3", "4"], "value": ["x", "x", "x", "y"]})


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_models_prefer_the_majority(name):
    found = models.MODELS[name](_frame(), seed=1)
    assert set(found) == {"x", "y"} and found["x"] > found["y"]


def test_truth_finder_by_hand():
    found = models.truth_finder(_frame(), implication=False, iterations=1)
    tau = -np.log(0.1)
    assert found["x"] == pytest.approx(1 / (1 + np.exp(-0.3 * 3 * tau))) and found["y"] == pytest.approx(1 / (1 + np.exp(-0.3 * tau)))


def test_model_by_group(spark):
    c = claims(spark, [("e", "1", 0, "x"), ("e", "2", 0, "x"), ("f", "1", 0, "z"), ("f", "1", 1, None)])
    got = {(r.entity, r.value) for r in models.run_model(c, "dart").collect()}
    assert got == {("e", "x"), ("f", "z")}


@pytest.mark.parametrize(
    "a,b,equal",
    [
        ("2011-12-01 08:51 AM", "2011-12-01 08:51AM EST", True),
        ("2011-12-01 08:51 AM", "2011-12-01 09:51 AM", False),
        ("2011-12-01 08:52 AM", "12/1/11 8:54 AM", False),
        ("8:31 Dec 1", "Dec 01 - 8:30am", True),
        ("nothing", "else", False),
        ("same", "same", True),
    ],
)
def test_times(spark, a, b, equal):
    assert spark.range(1).select(text.time_equal(F.lit(a), F.lit(b))).first()[0] is equal


def test_numbers_and_tokens(spark):
    row = spark.range(1).select(
        (text.number_key(F.lit("$ 335.95")) == text.number_key(F.lit("335.950"))).alias("same"),
        (text.number_key(F.lit("-1.5")) == text.number_key(F.lit("1.5"))).alias("sign"),
        text.token_key(F.lit("Smith, John")).alias("key"),
        text.token_set_ratio(F.lit("john smith"), F.lit("smith john r")).alias("ratio"),
        text.apply_rule(F.lit("b a"), [{"op": "reorder_words", "args": [[1, 0]]}, {"op": "abbreviate", "args": [["a"]]}]).alias("rule"),
    ).first()
    assert (row.same, row.sign, row.key, row.ratio, row.rule) == (True, False, "John Smith", 100.0, "a. b")


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_vector_fallback(spark):
    every = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.43589])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.98, 0.198997])], "query_id long, embedding array<double>")
    got = [(r.vec_id,) for r in retrieve.nearest(asked, every, "query_id", "vec_id", 5, 0.99, 0.8).collect()]
    assert got == [(1,)]


def test_planner(spark):
    rows = [("e1", "flag", "1", 1, "R"), ("e1", "status", "1", 1, "O"), ("e2", "flag", "1", 2, "A"), ("e2", "status", "1", 2, "F")]
    engine = Engine(spark.createDataFrame(rows, CLAIMS))
    by_condition = engine.run(Query("1", (Step("status", "flag", ("R",)),))).collect()
    assert [(r.entity, r.value, r.is_true) for r in by_condition] == [("e1", "O", True)]
    chained = engine.run(Query("2", (Step("flag", "entity", ("e1",)), Step("status", "flag", ("id-0",)))))
    assert [r.value for r in chained.collect()] == ["O"]
    assert levels((Step("a"), Step("b", base=0), Step("c", "x", ("id-1",)))) == [[0], [1], [2]]


def test_merged_queries_reject_shared_rows():
    q = lambda i, rows: {"questionId": i, "subquery": [{"condition_attribute": "k", "condition_value": i, "target_attribute": "t"}], "answer_view": {"1": {"true_answer": {"1": rows}, "false_answer": {}}}}
    assert merge_queries(q(1, [1]), q(2, [2]))["answer_view"]["1"]["true_answer"] == {"1": [1, 2]}
    with pytest.raises(ValueError):
        merge_queries(q(1, [1]), q(2, [1]))


def test_one_batch_equals_batch_fusion(spark):
    rows = [("e1", "1", 0, "a"), ("e1", "2", 1, "a"), ("e1", "3", 2, "b"), ("e2", "1", 3, "c")]
    c = claims(spark, rows)
    state = Fusion(spark, learn_copying=False)
    got = {(r.entity, r.value, r.is_true) for r in state.add(c, 1).collect()}
    whole = fusion.single_truth(fusion.merge_sources(fusion.group_by_source(c)))
    assert got == {(r.entity, r.value, r.is_true) for r in whole.collect()}
    assert {(r.entity, r.value, r.is_true) for r in state.add(c, 1).collect()} == got  # a batch that came twice


def test_replay_fades_history(spark):
    events = claims(spark, [("e", "1", 0, "a"), ("e", "2", 1, "b")]).withColumn("timestamp", F.col("row_id"))
    scores = {r.value: r.score for r in replay(events, Fusion(spark)).state.collect()}
    assert scores["a"] == pytest.approx(np.exp(-0.1)) and scores["b"] == pytest.approx(1.0)


def test_metrics(spark):
    predicted = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "k long, is_true boolean")
    gold = spark.createDataFrame([(1, True), (3, True), (4, False), (5, True)], "k long, label boolean")
    m = evaluate.metrics(evaluate.confusion(predicted, gold, ["k"])).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (1, 1, 1, 1, 50.0, 50.0)


def test_log_generation(spark):
    log = generate_log(spark.range(1000).withColumn("source_id", F.lit("1")), "id", start=0)
    assert 400 < log.filter("timestamp = 0").count() < 600 and log.agg(F.max("timestamp")).first()[0] <= 100
