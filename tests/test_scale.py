"""What grows with the input: steps that work in tiles, on distinct values or on many entities at once give what the plain ones give."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verisift.functions import text
from verisift.operators import entities, fusion, models
from verisift.operators.components import connected_components
from verisift.sources import profile


def vectors(spark, n, groups, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, 64))[rng.integers(0, groups, n)] + rng.normal(size=(n, 64)) * 0.9
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)] + [(n, None), (n + 1, [1.0] + [None] * 63), (n + 2, [1.0, 2.0]), (n + 3, [2.0, 1.0])]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.mark.parametrize("tile,least", [(4096, 0.4), (16, 0.4), (16, 0.55)])
def test_clusters_by_tiles_are_those_of_all_pairs(spark, monkeypatch, tile, least):
    monkeypatch.setattr(entities, "TILE", tile)
    v = vectors(spark, 120, 6)
    pairs = connected_components(entities.similar_pairs(v, least=least, bits=2, tables=4), "a", "b")
    got = entities.similar_groups(v, least=least, bits=2, tables=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_a_tile_gives_no_more_edges_than_join_its_groups():
    frame = pd.DataFrame({"id": range(500), "embedding": [np.ones(8)] * 500, "known": [0] * 200 + list(range(300)), "side": 3})
    edges = entities.joining(0.5)(frame)
    assert len(edges) == frame["known"].nunique() - 1


def test_only_formats_of_a_texts_shape_are_tried_and_none_is_lost(spark):
    shown = ["2011-12-01 08:51:09", "2011-12-01 8:51 AM", "2011-12-01 08:51", "12/1/2011 8:51 PM", "12/1/2011 18:51", "12/1/11 8:51 am", "1/2/11 18:51", "2011-12-01", "12/01/2011"]
    shown += ["Dec 1 - 8:30am", "Dec 01 - 8:30 p.m.", "8:31 pm Dec 1", "18:31 Dec 1", "8:30 AM, Dec 01", "-2011-12-01", "2011-12-01 08:51AM EST", "2011-12-01\t08:51", "2011-12-01 24:00", "12-01-2011", "12", "a-b", ""]
    clean = text.clean_time(F.col("v"))
    tries = [F.try_to_timestamp(clean, F.lit(f)) for f in text.TIME_FORMATS]
    tries += [F.try_to_timestamp(F.concat(F.initcap(F.lower(clean)), F.lit(" 2011")), F.lit(f"{f} yyyy")) for f in text.YEARLESS]
    rows = spark.createDataFrame([(v,) for v in shown], "v string").select("v", F.coalesce(*tries).cast("string").alias("all"), text.parse_time(F.col("v")).cast("string").alias("one")).collect()
    assert [r.one for r in rows] == [r["all"] for r in rows] and sum(r.one is not None for r in rows) > 14
    assert [text._shape(f) for f in ("M/d/yy HH:mm", "MMM d")] == [r"^[-+]?\d+[/][-+]?\d+[/][-+]?\d+[ ][-+]?\d+[:][-+]?\d+$", r"^\S+[ ][-+]?\d+$"]


def test_profiles_parse_distinct_values_only(spark):
    rows = [("1", "x-1"), ("1", "x-1"), ("2.5", None), (None, " "), ("nan", "2001-02-03"), ("7", "2001-02-03")]
    found = profile.column_profile(spark.createDataFrame(rows, "a string, b string"), ["a", "b"])
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {"a": (6, 4, 4, 0, 3, 2, False), "b": (6, 4, 0, 2, 2, 2, False)}
    assert "gid" not in found._jdf.queryExecution().optimizedPlan().toString()  # no copy of all rows for each count of distinct ones


def test_profile_of_no_rows(spark):
    assert profile.column_profile(spark.createDataFrame([], "a string"), ["a"]).count() == 0


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_models_over_many_entities_give_what_one_entity_gets(spark, monkeypatch, name):
    rng = np.random.default_rng(1)
    rows = [(f"e{e}", "a", str(rng.integers(0, 6)), None, ["A", "N", "R", "Né"][rng.integers(0, 4 if e % 2 else 2)]) for e in range(60) for _ in range(rng.integers(1, 9))]
    frame = pd.DataFrame(rows, columns=["entity", "attribute", "source_id", "row_id", "value"]).drop_duplicates()
    want = {(e, v): s for e, own in frame.groupby("entity") for v, s in models.MODELS[name](own, seed=zlib.crc32(f"{e}|a".encode())).items()}
    schema = "entity string, attribute string, source_id string, row_id long, value string"
    got = {(r.entity, r.value): r.score for r in models.run_model(spark.createDataFrame(rows, schema), name).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    told = pa.Table.from_pandas(frame.drop(columns="row_id"), preserve_index=False).sort_by([("entity", "ascending")])
    monkeypatch.setattr(models, "ROWS", 50)
    monkeypatch.setattr(models, "ELEMENTS", 2000)
    batches = models._streamed(models.MANY[models.MODELS[name]], {})(told.to_batches(max_chunksize=7))
    assert {(r["entity"], r["value"]): r["score"] for b in batches for r in b.to_pylist()} == pytest.approx(want, abs=1e-9)


def test_a_registered_model_still_runs_by_entity(spark, monkeypatch):
    monkeypatch.setitem(models.MODELS, "own", lambda frame, **_: dict.fromkeys(frame["value"], float(len(frame))))
    rows = [("e", "a", "1", None, "x"), ("e", "a", "2", None, "y"), ("f", "a", "1", None, "x")]
    got = models.run_model(spark.createDataFrame(rows, "entity string, attribute string, source_id string, row_id long, value string"), "own")
    assert sorted((r.entity, r.value, r.score) for r in got.collect()) == [("e", "x", 2.0), ("e", "y", 2.0), ("f", "x", 1.0)]


def test_a_time_is_parsed_once_for_all_entities(spark):
    rows = [(f"e{e}", "a", str(s), s, v) for e in range(20) for s, v in enumerate(["2011-12-01 08:51 AM", "12/1/2011 8:51 AM", "2011-12-01 09:00", None, " "])]
    told = spark.createDataFrame(rows, "entity string, attribute string, source_id string, row_id long, value string")
    assert sorted(r.key for r in fusion.time_keys(told, "date_string").collect()) == ["2011-12-01 08:51", "2011-12-01 08:51", "2011-12-01 09:00"]
    keyed = fusion.aligned_keys(told, "date_string")
    assert keyed.count() == 60 and keyed.select("entity", "key").distinct().count() == 40
