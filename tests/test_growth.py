"""Queries whose tables grow, on a driver that can broadcast little."""

import contextlib
import math

from sheetmeter.operators import layout, vision


@contextlib.contextmanager
def little_to_broadcast(spark):
    """Tables are taken for small enough to broadcast, as Parquet files of many rows are; the driver has no room for them."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.maxBroadcastTableSize": "16k"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def points(n: int = 600) -> list[tuple[int, int, float, float]]:
    return [(i, i % 3, float(i * 37 % 997), float(i * 61 % 991)) for i in range(n)]


def neighbours(rows, radius: float = 30.0) -> set[tuple[int, int]]:
    return {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius * radius}


def test_pairs_in_radius_without_broadcast(spark):
    rows = points()
    df = spark.createDataFrame(rows, "id long, page long, x double, y double")
    with little_to_broadcast(spark):
        got = [(r["a"], r["b"]) for r in layout.within_radius(df, df, ["page"], 30.0).where("a <> b").collect()]
    assert len(got) == len(set(got)) > 100
    assert set(got) == neighbours(rows)


def test_isolated_without_broadcast(spark):
    rows = points()
    df = spark.createDataFrame(rows, "id long, page long, x double, y double")
    with little_to_broadcast(spark):
        got = [r["id"] for r in layout.isolated(df, ["page"], 30.0).collect()]
    assert sorted(got) == sorted({r[0] for r in rows} - {a for a, _ in neighbours(rows)})
    assert 0 < len(got) < len(rows)


def test_isolated_lists_no_pairs(spark):
    """Many rows of one place: the first neighbour settles each. Rows without a place or key have no neighbour."""
    rows = [(i, 1, 5.0, 5.0) for i in range(2000)] + [(2000, 1, 500.0, 5.0), (2001, None, 5.0, 5.0), (2002, 1, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, page long, x double, y double")
    found = layout.isolated(df, ["page"], 30.0)
    assert sorted(r["id"] for r in found.collect()) == [2000, 2001, 2002]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


SIGHTING = "id long, drawing_id string, page int, x double, y double, w double, h double, confidence double, source string, needs_review boolean"


def sightings(n: int = 600) -> list[tuple]:
    return [(i, str(i % 3), 1, float(i * 37 % 997), float(i * 61 % 991), 6.0 + i % 5 * 9, 8.0, 0.5 if i % 9 == 0 else 0.9, "symbol" if i % 4 == 0 else "vision", i % 20 == 7) for i in range(n)]


def doubted(rows) -> list[int]:
    """Unsure, flagged or alone, by comparing all with all."""
    middle = {r[0]: (r[3] + r[5] / 2, r[4] + r[6] / 2) for r in rows}
    alone = lambda a: not any(a[0] != b[0] and a[1] == b[1] and math.dist(middle[a[0]], middle[b[0]]) < (a[5] + a[6]) / 2 * 6 for b in rows)
    return [r[0] for r in rows if r[8] == "vision" and (r[7] < 0.75 or r[9] or alone(r))]


def test_verify_batches_without_broadcast(spark):
    rows = sightings()
    df = spark.createDataFrame(rows, SIGHTING)
    with little_to_broadcast(spark):
        got = vision.batched(vision.doubtful(df)).collect()
    want = {}
    for drawing in "012":
        for k, i in enumerate(i for i in doubted(rows) if str(i % 3) == drawing):
            want[i] = (drawing, k // 12, k % 12 + 1)
    assert {r["id"]: (r["drawing_id"], r["batch"], r["index"]) for r in got} == want
    assert len(got) == len(want)


def test_doubtful_without_broadcast(spark):
    rows = sightings()
    df = spark.createDataFrame(rows, SIGHTING)
    with little_to_broadcast(spark):
        got = sorted(r["id"] for r in vision.doubtful(df).collect())
    assert got == doubted(rows)
    assert len(got) > sum(r[8] == "vision" and (r[7] < 0.75 or r[9]) for r in rows)  # some are alone


def test_doubtful_lists_no_pairs(spark):
    """Many sightings of one place: the first neighbour settles each."""
    rows = [(i, "d", 1, 5.0, 5.0, 8.0, 8.0, 0.9, "vision", False) for i in range(2000)] + [(2000, "d", 1, 500.0, 5.0, 8.0, 8.0, 0.9, "vision", False)]
    found = vision.doubtful(spark.createDataFrame(rows, SIGHTING))
    assert [r["id"] for r in found.collect()] == [2000]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
