"""Sources and sinks, alignment through fusion, the engine's hooks, and incremental state over restarts."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from verisift.functions import text, vectors
from verisift.operators import fusion
from verisift.plans.query import Engine, Query, Step
from verisift.scratch import materialize
from verisift.sources import profile, tables
from verisift.streaming.incremental import Fusion, QueryCache, delta, replay, stream

CLAIMS = "entity string, attribute string, source_id string, row_id long, value string"


def claims(spark, rows):
    return spark.createDataFrame([(e, "a", s, r, v) for e, s, r, v in rows], CLAIMS)


def test_tsv_lines_and_golden_keys(spark, tmp_path):
    body = "Title\tSource\tYear\r\n" + "".join(f"Film {i}\ts\t{1900 + i}\r\n" for i in range(50)) + "\r\nlast\ts\t1\r\n"
    (tmp_path / "movie_7.txt").write_text(body)
    rows = tables.read_tsv(spark, f"file://{tmp_path}/movie_7.txt").collect()
    assert rows[0].asDict() == {"source_id": "7", "title": "Film 0", "year": "1900"} and len(rows) == 51
    bare = tables.read_tsv(spark, f"file://{tmp_path}/movie_7.txt", ["a", "b", "c"])
    assert bare.count() == 52 and bare.columns == ["source_id", "a", "b", "c"]
    lines = {r.line_number: r.line for r in tables.read_lines(spark, f"file://{tmp_path}/movie_7.txt").collect()}
    assert lines[0].startswith("Title") and lines[50].startswith("Film 49") and 51 not in lines and lines[52].startswith("last")
    assert [r.line_number for r in tables.read_lines(spark, f"file://{tmp_path}/movie_7.txt", ["FILM 3", "last"]).orderBy("line_number").collect()] == [4, 52]
    assert {r.entity for r in tables.read_golden(spark, f"file://{tmp_path}/movie_7.txt").collect()} >= {"Film 0", "last"}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "big_1.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tables.read_lines(spark, f"file://{tmp_path}/big_1.txt")
        assert got.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_number").cast("string"))).count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_sources_columns_and_vectors(spark, tmp_path):
    (tmp_path / "book_3.csv").write_text('Title,ISBN,title_emd\n"A, b", ,0.5 1\n')
    row = tables.parse_vectors(tables.read_sources(spark, f"file://{tmp_path}/book_3.csv", "csv")).first()
    assert (row.source_id, row.title, row.isbn, list(row.title_emd)) == ("3", "A, b", None, [0.5, 1.0])
    (tmp_path / "book_3_columns.csv").write_text('column_name,properties,embedding,key_attributes,special_values\nISBN,primary_noEmd,"[0.1, 0.2]",True,a|b\n')
    got = tables.read_columns(spark, f"file://{tmp_path}/book_3_columns.csv").first()
    assert (got.column_name, got.is_key, list(got.special_values)) == ("isbn", True, ["a", "b"]) and got.embedding == pytest.approx([0.1, 0.2])
    tables.csv_to_parquet(spark, f"file://{tmp_path}/book_3.csv", f"file://{tmp_path}/p")
    assert profile.key_difference(spark.read.option("header", True).csv(f"file://{tmp_path}/book_3.csv"), spark.read.parquet(f"file://{tmp_path}/p"), "Title").count() == 0
    enriched = tables.enrich(spark.createDataFrame([("ab",), (" ",)], "t string"), ["t"], vectors.hashed_embedding).collect()
    assert len(enriched[0].t_emd) == 64 and enriched[1].t_emd is None


def test_queries_events_and_confidence(spark, tmp_path):
    query = {"questionId": 1, "question": "q", "subquery": [{"IntermediateResult": -1, "condition_attribute": "k", "condition_value": ["x", "y"], "target_attribute": "t", "target_value": "Function_MIN"}]}
    (tmp_path / "q.json").write_text(json.dumps([query]))
    row = tables.read_queries(spark, f"file://{tmp_path}/q.json").first()
    step = Query.read(row.asDict(True)).steps[0]
    assert (step.values, step.function, step.base) == (("x", "y"), "Function_MIN", -1)
    (tmp_path / "log.json").write_text(json.dumps([{"type": "insert", "sid": 1, "data": {"k": "v"}, "timestamp": 5, "log_time": "t"}, {"type": "query loop", "timestamp": 6}]))
    assert [(r.type, r.timestamp) for r in tables.read_events(spark, f"file://{tmp_path}/log.json").collect()] == [("insert", 5), ("query loop", 6)]
    (tmp_path / "c.json").write_text(json.dumps([{"file_name": "a_4.txt", "source_name": "a", "confidence_level": 2, "total_records": 9}]))
    assert tuple(tables.read_confidence(spark, f"file://{tmp_path}/c.json").first()) == ("4", 2)


def test_rules_results_and_metrics_come_back(spark, tmp_path):
    rules = [[{"op": "remove_words", "args": [["the", "a"]]}, {"op": "reorder_words", "args": [[1, 0]]}], [{"op": "trim"}]]
    path = f"file://{tmp_path}/rules"
    tables.write_rules(spark, rules, path)
    tables.write_rules(spark, rules[:1], path)  # known already
    back = tables.read_rules(spark, path)
    assert back == rules
    assert spark.range(1).select(text.apply_rule(F.lit("the b c"), back[0])).first()[0] == "c b"
    view = spark.createDataFrame([("e", 1, [0.1], "x"), ("e", 2, [0.2], "y")], "entity string, batch_ts long, embedding array<double>, value string")
    tables.write_results(view, f"file://{tmp_path}/out")
    got = spark.read.json(f"file://{tmp_path}/out")
    assert got.count() == 2 and "embedding" not in got.columns
    for _ in range(2):
        tables.write_metrics(spark.createDataFrame([(1, 2.5)], "timestamp long, f1 double"), f"file://{tmp_path}/m")
        tables.append_tsv(spark.createDataFrame([("a", "b")], "x string, y string"), f"file://{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/m").count() == 2 == spark.read.option("header", True).option("sep", "\t").csv(f"file://{tmp_path}/t").count()


@pytest.mark.parametrize(
    "kind,values,groups",
    [
        ("date_string", ["2011-12-01 08:51 AM", "2011-12-01 08:51AM EST", "12/1/11 8:51 AM"], 1),
        ("date_string", ["2011-12-01 08:51 AM", "2011-12-01 09:51 AM"], 2),
        ("date_string", ["2011-12-01 08:52 AM", "12/1/11 8:54 AM"], 2),
        ("date_string", ["8:31 Dec 1", "Dec 01 - 8:30am", "not a time"], 2),
        ("numeric_string", ["$ 335.95", "335.950"], 1),
        ("numeric_string", ["$ 335.95", "335.94"], 2),
        ("general", ["Smith, John", "John Smith"], 1),
    ],
)
def test_equal_values_are_one_group(spark, kind, values, groups):
    c = claims(spark, [("e", str(i), i, v) for i, v in enumerate(values)])
    view = fusion.fuse_aligned(c, kind, penalise=False)
    assert view.select("score").distinct().count() <= groups and view.filter("is_true").count() == len(values) - groups + 1
    assert fusion.aligned_keys(c, kind).select("key").distinct().count() == groups


def test_rules_align_on_either_side_and_through_others(spark):
    rules = [[{"op": "replace", "args": ["Rd.", "Road"]}], [{"op": "abbreviate", "args": [["Road"]]}]]
    c = claims(spark, [("e", "1", 0, "Elm Rd."), ("e", "2", 1, "Elm Road"), ("e", "3", 2, "Elm R."), ("e", "4", 3, "Oak Road"), ("f", "1", 4, "Elm R."), ("f", "2", 5, None)])
    keyed = {(r.entity, r.value): r.key for r in fusion.aligned_keys(c, rules=rules).collect()}
    assert len({keyed["e", v] for v in ("Elm Rd.", "Elm Road", "Elm R.")}) == 1 and keyed["e", "Oak Road"] != keyed["e", "Elm R."] and ("f", None) not in keyed
    view = {(r.entity, r.source_id): r.is_true for r in fusion.fuse_aligned(c, rules=rules, penalise=False).collect()}
    assert view == {("e", "1"): True, ("e", "2"): True, ("e", "3"): True, ("e", "4"): False, ("f", "1"): True, ("f", "2"): False}


def test_engine_learns_rules_binds_columns_and_parses(spark):
    rows = [("e1", "name", "1", 1, "J. Doe"), ("e1", "name", "2", 2, "Jane Doe"), ("e1", "naam", "3", 3, "Jane Doe"), ("e1", "name", "4", 4, "J. Doe")]
    seen = []

    def propose(classes):
        seen.extend(classes)
        return [[{"op": "abbreviate", "args": [["Jane"]]}]]

    engine = Engine(spark.createDataFrame(rows, CLAIMS), propose=propose, parse=lambda q: [{"target_attribute": "name"}])
    assert len({r.value for r in engine.ask("who?").filter("is_true").collect()}) == 1
    engine.learn_rules("name")
    assert seen == [["J. Doe", "Jane Doe"]] and {r.value for r in engine.ask("who?").filter("is_true").collect()} == {"J. Doe", "Jane Doe"}
    engine.propose = lambda classes: [[{"op": "exec", "args": ["x"]}]]
    engine.rules = {}
    with pytest.raises(ValueError):
        engine.learn_rules("name")
    columns = spark.createDataFrame([("1", "name", [1.0, 0.0]), ("3", "naam", [0.98, 0.2]), ("3", "other", [0.0, 1.0])], "source_id string, column_name string, embedding array<double>")
    bound = Engine(spark.createDataFrame(rows, CLAIMS), columns=columns, embed=lambda a: [1.0, 0.0]).run(Query("1", (Step("name"),)))
    assert {(r.source_id, r.attribute) for r in bound.collect()} == {("1", "name"), ("3", "name")}


def test_views_stay_and_state_survives_a_restart(spark, tmp_path):
    one = claims(spark, [("e1", "1", 0, "a"), ("e1", "2", 1, "a"), ("e1", "3", 2, "b")])
    two = claims(spark, [("e1", "1", 3, "b"), ("e2", "1", 4, "c")])
    log, whole = f"file://{tmp_path}/log", Fusion(spark)
    first = Fusion(spark, log=log)
    view = first.add(one, 1)
    before = sorted(map(tuple, view.collect()))
    again = Fusion(spark, log=log)  # as after a restart
    assert again.done == {"1"} and again.copying is not None
    again.add(one, 1)  # taken in already
    again.add(two, 2)
    whole.add(one, 1)
    whole.add(two, 2)
    key = lambda f: sorted((r.entity, r.value, round(r.score, 9)) for r in f.state.collect())
    assert key(again) == key(whole) and sorted(map(tuple, view.collect())) == before


def test_stream_takes_in_each_batch_once(spark, tmp_path):
    rows = [("e1", "a", "1", 0, "x"), ("e1", "a", "2", 1, "x"), ("e2", "a", "1", 2, "y")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], CLAIMS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    source = spark.readStream.schema(CLAIMS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second time there is nothing new
        state = Fusion(spark, learn_copying=False, log=f"file://{tmp_path}/log")
        stream(source, state, f"file://{tmp_path}/checkpoint").awaitTermination(120)
        assert sorted((r.entity, r.value, r.n_rows) for r in state.state.collect()) == [("e1", "x", 2), ("e2", "y", 1)]


def test_replay_reads_batches_in_order(spark):
    events = claims(spark, [("e", "1", i, f"v{i}") for i in range(4)]).withColumn("timestamp", F.col("row_id"))
    seen = []
    replay(events, Fusion(spark), lambda ts, view: seen.append((ts, view.count())))
    assert seen == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_query_cache_reads_what_is_new(spark):
    rows = claims(spark, [("e1", "1", 0, "a"), ("e2", "1", 1, "b"), ("e1", "2", 2, "c"), ("e1", "3", 3, "c")]).withColumn("batch_ts", F.when(F.col("row_id") < 2, 1).otherwise(2))
    asked = []

    def fuse(c, rules):
        asked.append(sorted(r.entity for r in c.select("entity").distinct().collect()))
        return fusion.fuse_aligned(c, rules=rules, penalise=False).select(*rows.columns, "score", "is_true")

    cache = QueryCache()
    cache.answer("q", rows, 1, fuse)
    cache.answer("q", rows, 1, fuse)  # nothing new
    view = cache.answer("q", rows, 2, fuse)
    assert asked == [["e1", "e2"], ["e1"]] and sorted((r.entity, r.value) for r in view.filter("is_true").collect()) == [("e1", "c"), ("e1", "c"), ("e2", "b")]
    cache.rules = [[{"op": "replace", "args": ["a", "c"]}]]  # other rules: all again
    assert cache.answer("q", rows, 2, fuse).filter("is_true").count() == 4 and asked[-1] == ["e1", "e2"]
    last = spark.createDataFrame([("q", "e1", 1)], "query_id string, entity string, batch_ts int")
    assert delta(rows, last).count() == 2


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    from verisift import scratch

    monkeypatch.setattr(scratch, "SETTING", "spark.no.such.setting")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster:7077")
    with pytest.raises(ValueError):
        materialize(spark.range(1), "x")


def test_registry(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 70 and all(sql.values())
