"""Queries against their SQL, sources, sinks and streams."""

from __future__ import annotations

import importlib
import itertools
import json
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from calibra.plans import catalog
from calibra.sources import readings, sinks
from calibra.streaming import replay

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = catalog.queries()[name](spark, DATA), con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_joins_by_page_are_no_nested_loops(spark):
    for name in ("overlap_anti_join", "nearest_owner", "line_support_score"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = catalog.queries()["nearest_owner"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("calibra.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "calibra.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_recognisers_output(spark, tmp_path):
    words = [{"text": "12", "x": 5.0, "y": 6.0, "width": 10.0, "height": 4.0}, {"text": ".5", "x": 16.0, "y": 5.0, "width": 4.0, "height": 6.0}]
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"text_angle": 0.0, "lines": []}, {"text_angle": 90.0, "lines": [{"text": "12 .5", "words": words}]}]}))
    got = readings.ocr_words(spark, str(tmp_path)).drop("file").collect()
    assert [tuple(r) for r in got] == [(1, 0, "12 .5", 90.0, 5.0, 5.0, 20.0, 11.0)]
    quad = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 5.0}, {"x": 0.0, "y": 5.0}]
    raw = spark.createDataFrame([(1, "12", 0.9, quad), (1, "12", 0.2, quad), (1, " ", 0.9, quad), (1, "3", 0.9, quad[:3])], "page_key long, text string, score double, quad array<struct<x:double,y:double>>")
    (row,) = readings.from_quads(raw, 0.42).collect()
    assert (row.x0, row.y1, row.dx, row.dy) == (0.0, 5.0, 1.0, 0.0)
    both = readings.numbered(readings.together(readings.from_quads(raw, 0.42), readings.from_quads(raw, 0.1)))
    assert [r.line_id for r in both.orderBy("line_id").collect()] == [1, 2, 3] and both.where("source_rank = 0").first().line_id == 1


def test_tiles_cover_the_page(spark):
    pages = spark.createDataFrame([(1, 1000.0, 500.0)], "page_key long, page_w double, page_h double")
    got = readings.tiles(pages, 200.0).collect()
    xs = sorted({(r.x0, r.x1) for r in got})
    assert xs[0][0] == 30.0 and xs[-1][1] == pytest.approx(950.0) and all(b[0] <= a[1] for a, b in zip(xs, xs[1:]))


def test_export_keeps_the_source_and_its_pages(spark, tmp_path):
    bands = spark.createDataFrame([(0, 1, "#ffff00")], "page_index int, ordinal int, color string")
    labels = spark.createDataFrame([(0, 0, "±0.1")], "page_index int, ordinal int, text string")
    with pytest.raises(ValueError):
        sinks.export(bands, labels, 1, "/a", "/a/")
    sinks.export(bands, labels, 1, "/a", f"{tmp_path}/out")
    assert [r.is_fill for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [True, False]
    with pytest.raises(Exception, match="a page that isn't there"):
        sinks.export(bands.withColumn("page_index", F.lit(4)), labels, 1, "/a", f"{tmp_path}/bad")


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(k, 1000.0 * k, k % 3, "ab"[k % 2], 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, t double, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = "event_id long, user_id long, event_type string, value double, ts timestamp"
    for name, fold, mode in (("selections", replay.selections, "complete"), ("activity", replay.activity, "complete")):
        replay.start(fold(replay.events(spark, f"{tmp_path}/in", schema)), name, f"{tmp_path}/{name}", mode).awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, fold(df).collect()))


def test_images_that_make_up_just_the_limit_add_up_in_order_of_place(spark):
    shares = [0.21866666666666665, 0.21866666666666673, 0.2826666666666665]  # in this order less than 0.72 by the last bit, in others not
    for order in itertools.permutations(range(3)):
        want = shares[order[0]] + shares[order[1]] + shares[order[2]] >= 0.72
        for rows in itertools.permutations(zip(range(3), (shares[k] for k in order))):
            images = spark.createDataFrame([(1, p, s, 1.0) for p, s in rows], "page_key long, place int, area double, page_area double").coalesce(1)
            assert [tuple(x) for x in readings.full_page_images(images).collect()] == [(1, want)]
