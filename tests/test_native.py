"""Lines and spans that a page holds itself, session states and clusters on literal cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from calibra.operators import consensus, predicates, session
from calibra.operators.consensus import Reading
from calibra.sources import native


def span(text, size, box=(0.0, 0.0, 10.0, 8.0), font="f", color=0, origin=(0.0, 8.0)):
    return {"bbox": list(box), "size": size, "font": font, "color": color, "origin": list(origin), "chars": [{"c": c} for c in text]}


def line(*spans, box=(0.0, 0.0, 10.0, 8.0), way=(2.0, 0.0)):
    return {"bbox": list(box), "dir": list(way), "spans": list(spans)}


def test_lines_of_nested_blocks(spark):
    blocks = [{"lines": [line(span("φ12", 8.0, font="a", color=0xFF8000, origin=(1.0, 7.0)), span("  ", 20.0), span("±0.1", 8.0, font="b")), line(span("x", 5.0), box=(0.0, 0.0, 0.0, 8.0)), line(way=(0.0, 0.0), box=(5.0, 5.0, 9.0, 9.0))]}, {"lines": None}]
    df = spark.createDataFrame([(1, blocks), (2, None), (3, [])], f"page_key long, blocks {native.BLOCKS}")
    one, empty = native.text_lines(df).orderBy("n").collect()
    assert (one.text, one.size, one.raw_size, one.dx, one.dy, one.font, one.origin_x, one.origin_y) == ("φ12  ±0.1", 8.0, 20.0, 1.0, 0.0, "a", 1.0, 7.0)
    assert one.color == pytest.approx([1.0, 128 / 255, 0.0])
    assert (empty.text, empty.size, empty.font, empty.origin_x, empty.origin_y, empty.color) == ("", 0.0, "", 5.0, 9.0, [0.0, 0.0, 0.0])


def test_spans_that_look_like_a_dimension(spark):
    texts = {"φ12±0.1": True, "R 0.2 以下": True, "図12": False, "abc": False, "1" * 25: False, "": False, "12": True}
    blocks = [{"lines": [line(*[span(t, 8.0) for t in texts], span("12", 0.0))]}]
    df = spark.createDataFrame([(1, blocks)], f"page_key long, blocks {native.BLOCKS}")
    assert [r.text for r in native.dimension_spans(df).orderBy("s").collect()] == [t for t, ok in texts.items() if ok]


def test_state_of_a_session(spark):
    items = spark.createDataFrame([(1, "dimension"), (1, "strike"), (2, "dimension"), (1, None)], "page int, kind string")
    candidates = spark.createDataFrame([(True,), (False,), (None,)], "selected boolean")
    state = session.state(items, candidates, F.lit(1))
    assert tuple(state.first()) == (3, 1, 1, 0, 1)
    assert json.loads(session.state_json(state).first().state) == {"candidate_count": 3, "selected_count": 1, "added_count": 1, "replacement_count": 0, "struck_count": 1}
    assert tuple(session.state(items.limit(0), candidates.limit(0), F.lit(1)).first()) == (0, 0, 0, 0, 0)


def test_routes_of_pages(spark):
    pages = spark.createDataFrame([(1, False), (2, False), (3, True), (4, None)], "page_key long, full_page_image boolean")
    words, images = spark.createDataFrame([(1,), (1,), (3,)], "page_key long"), spark.createDataFrame([(2,), (3,)], "page_key long")
    got = {r.page_key: (r.needs_recognition, r.scanned) for r in predicates.page_routes(pages, words, images).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (False, True), 4: (True, False)}
    assert not any(r.needs_recognition for r in predicates.page_routes(pages.drop("full_page_image"), words, images, recogniser=False).collect())


def test_clusters_grow_in_order():
    r = lambda k, *box: Reading(k, "t", k / 10, *map(float, box))
    got = consensus.clusters([r(1, 0, 0, 10, 10), r(2, 200, 0, 210, 10), r(3, 50, 0, 60, 10), r(4, 100, 0, 110, 10)])
    assert [(x.line_id, x.x0, x.x1, x.score, x.agreement) for x in got] == [(1, 0, 110, 0.4, 3), (2, 200, 210, 0.2, 1)]
    kept = consensus.with_scanned([r(1, 0, 0, 10, 10), r(2, 1, 0, 11, 10), r(3, 0, 0, 10, 10), r(4, 50, 0, 60, 10)], lambda x: x.line_id < 3)
    assert [x.line_id for x in kept] == [1, 2, 4]
