from pyspark.sql import functions as F

from sheetmeter.functions import geometry as g
from sheetmeter.functions import text as t
from sheetmeter.operators import items, tags, tiles


def test_tag_readings(spark):
    cases = {"4 NO. A1": ("A1", 4), "3 x SSO": ("SSO", 3), "A1 x2": ("A1", 2), "2SD": ("SD", 2), "a1": ("A1", 1), "13A": None, "20W": None, "2B": None, "": None}
    known = spark.createDataFrame([(x,) for x in ("A1", "SSO", "SD", "A", "W", "B")], "tag string")
    spans = spark.createDataFrame([(k,) for k in cases] + [(None,)], "str string")
    got = {r["str"]: (r["tag"], r["multiplier"]) for r in tags.match_tags(spans, known).collect()}
    assert got == {k: v for k, v in cases.items() if v}


def test_tag_like(spark):
    words = {"A1": True, "FCU-3": True, "AHU01": True, "X": True, "1:100": False, "LEGEND": False, "ADDRESSABLE": False}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", t.is_tag_like("w").alias("is")).collect()
    assert {r["w"]: r["is"] for r in rows} == words


def test_twins(spark):
    rows = [(1, 1, "F", 1, 1, 0.0, 0.0, 2.0, 2.0, 1.6), (1, 1, "F", 2, 1, 1.0, 0.0, 2.0, 2.0, 1.6), (1, 1, "F", 3, 1, 2.0, 0.0, 2.0, 2.0, 1.6), (1, 1, "F", 4, 1, 90.0, 0.0, 2.0, 2.0, 1.6), (1, 1, "B", 5, 1, 0.0, 0.0, 2.0, 2.0, 8.0), (1, 1, "B", 6, 1, 12.0, 0.0, 2.0, 2.0, 8.0)]
    hits = spark.createDataFrame(rows, "drawing_id long, page long, tag string, seq long, multiplier int, x double, y double, w double, h double, font_size double")
    got = sorted((r["tag"], r["seq"]) for r in tags.without_twins(hits).collect())
    assert got == [("B", 5), ("B", 6), ("F", 1), ("F", 4)]


def test_rounding_and_sections(spark):
    r = spark.range(1).select(g.rounded(F.lit(-0.25)).alias("a"), g.rounded(F.lit(0.25)).alias("b"), t.section_of(F.lit("led panel")).alias("s"), t.section_of(F.lit("pump")).alias("o")).first()
    assert tuple(r) == (-0.2, 0.3, "A", "G")


def test_tiling(spark):
    got = spark.createDataFrame([(1000,), (3309,)], "n long").select(tiles.origins(F.col("n")).alias("o")).collect()
    assert got[0]["o"] == [0] and got[1]["o"][-1] == 2285


def sight(seq, x, item="A", tile=0, c=0.9, margin=10.0):
    return {"drawing_id": 1, "page": 1, "seq": seq, "item_id": item, "x": x, "y": 0.0, "w": 10.0, "h": 10.0, "confidence": c, "edge_margin": margin, "tile": tile, "needs_review": False, "review_reason": None}


def test_sightings():
    assert len(tiles.merge_sightings([sight(1, 0), sight(2, 12)])) == 2  # neighbours in one tile
    assert len(tiles.merge_sightings([sight(1, 0), sight(2, 4, tile=1)])) == 1
    [k] = tiles.merge_sightings([sight(1, 0), sight(2, 1, item="B", tile=1, c=0.8)])
    assert k["needs_review"] and k["review_reason"] == "also seen as B (0.80)"
    [k] = tiles.merge_sightings([sight(1, 0, margin=2.0), sight(2, 3, tile=1, c=0.88, margin=9.0)])
    assert k["x"] == 3
    assert tiles.merge_sightings([]) == []


def test_second_look(spark):
    d = spark.createDataFrame([(1, "A", 0.5, True), (2, "A", 0.5, False), (3, "A", 0.5, False), (4, "A", 0.5, False)], "id long, item_id string, confidence double, needs_review boolean")
    a = spark.createDataFrame([(1, "A", 0.95), (2, "none", 0.9), (3, "B", 0.9)], "id long, item string, confidence double")
    got = {r["id"]: (r["item_id"], r["confidence"], r["needs_review"]) for r in tiles.second_look(d, a).collect()}
    assert got == {1: ("A", 0.95, False), 3: ("B", 0.9, True), 4: ("A", 0.5, False)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "item_id string, page long, multiplier long, needs_review boolean, source string")
    i = spark.createDataFrame([("x", None, None)], "item_id string, tag string, description string")
    assert tuple(items.item_counts(i, d).first())[3:6] == (0, 0, "none")
