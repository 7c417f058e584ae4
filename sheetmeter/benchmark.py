"""Counts the drawings of benchmark sets and scores them against their truths."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetmeter import engine
from sheetmeter.operators import scoring
from sheetmeter.operators import symbols as sy
from sheetmeter.operators.items import merge_legends
from sheetmeter.sources import drawings, sets
from sheetmeter.tables import written


@dataclass
class Report:
    """items of each set, sets (with error for those that did not run, files, seconds, usage columns), extras, summary (one row), takeoffs."""

    items: DataFrame
    sets: DataFrame
    extras: DataFrame
    summary: DataFrame
    takeoffs: list[engine.Takeoff]


def shared_items(entries: DataFrame, of_set: DataFrame) -> DataFrame:
    """The item list of each drawing: its own merged legend, or, without one, that of all its set's drawings. of_set: set, drawing_id."""
    place = F.dense_rank().over(Window.partitionBy("set").orderBy("drawing_id", "page", "legend"))
    merged = merge_legends(entries.join(of_set, "drawing_id").withColumn("legend_seq", place.cast("long")), ["set"])
    without = of_set.join(entries.select("drawing_id").distinct(), "drawing_id", "left_anti")
    lent = without.join(merged.drop("drawing_id"), "set").select("drawing_id", (F.col("legend_seq") * 10_000 + F.col("item_seq")).alias("item_seq"), F.col("id").alias("item_id"), "tag", "description", "reference", "signature")
    return engine.merged_items(entries).unionByName(lent)


def _usage_columns(usage: dict) -> list:
    return [F.lit(usage[k]).alias(k) for k in ("model", "calls", "cached_calls", "prompt_tokens", "output_tokens", "thought_tokens", "cost_usd")]


def run_bench(spark: SparkSession, folder: str, only: list[str] | None = None, make_vision: Callable[[], engine.VisionPass] | None = None, fallback: str = "auto", symbols: bool = True) -> Report:
    """Without a model all sets are counted together; with one, set by set with a pass of its own, so that its cost is known.

    A set without drawings, with a truth that cannot be read or a drawing that cannot be decoded has an error and fails both rules.
    """
    found = written(sets.discover_sets(spark, folder, only))
    if not found.head(1):
        raise ValueError(f"no benchmark sets under {folder}: expected <set>/ground_truth.json and <set>/drawings/*.pdf")
    truth, bad = sets.read_truth(spark, folder, only)
    truth = written(truth)
    listed = [(r["set"], r["drawings"]) for r in found.sort("set").collect()]  # one row per set of a benchmark
    failures = [spark.createDataFrame([(s, "no drawings") for s, d in listed if not d], "set string, error string"), bad]
    groups = [[x] for x in listed if x[1]] if make_vision else [[x for x in listed if x[1]]]
    scored, extras, takeoffs, ran = [], [], [], []
    for group in groups:
        if not group:
            continue
        began = time.time()
        files = [f for _, d in group for f in d]
        broken = written(drawings.read_failures(spark, files))
        of_set = written(found.where(F.col("set").isin([s for s, _ in group])).select("set", F.explode("drawings").alias("drawing_id")))
        failures.append(broken.join(of_set, "drawing_id").groupBy("set").agg(F.min("error").alias("error")))
        good = [r[0] for r in spark.createDataFrame([(f,) for f in files], "drawing_id string").join(broken, "drawing_id", "left_anti").sort("drawing_id").collect()] if broken.head(1) else files
        if not good:
            continue
        spans, pages, paths = drawings.read_drawings(spark, good)
        paths = paths if symbols else None
        _, structure = engine.structure_of(spans, pages)
        shapes = written(sy.elements(sy.merge_hatch_bands(paths))) if symbols else None
        entries = written(engine.read_entries(spans, pages, structure, shapes))
        vision = make_vision() if make_vision else None
        out = engine.count_drawings(spans, pages, paths, vision=vision, fallback=fallback, entries=entries, items=shared_items(entries, of_set))
        takeoffs.append(out)
        counts = written(out.counts.join(of_set, "drawing_id").join(out.items.select("drawing_id", "item_id", "item_seq"), ["drawing_id", "item_id"]))
        totals = written(scoring.engine_totals(counts))
        resolved = scoring.resolve(truth.join(of_set.select("set").distinct(), "set", "left_semi"), totals)
        items = written(scoring.score_items(resolved, totals))
        scored.append(items)
        extras.append(written(scoring.extras(resolved, totals)))
        names = of_set.groupBy("set").agg(F.array_sort(F.collect_list(F.regexp_extract("drawing_id", "([^/]+)$", 1))).alias("files"))
        ran.append(scoring.score_sets(items).join(names, "set").select("*", F.lit((time.time() - began) / len(group)).alias("seconds"), *_usage_columns(out.usage)))
    errors = failures[0]
    for f in failures[1:]:
        errors = errors.unionByName(f)
    errors = written(errors.groupBy("set").agg(F.min("error").alias("error")))
    known = found.select("set", F.transform("drawings", lambda d: F.regexp_extract(d, "([^/]+)$", 1)).alias("listed")).join(errors.withColumnRenamed("error", "message"), "set", "left")
    done = _all(ran) if ran else spark.createDataFrame([], "set string, items long, strict_pass boolean, truth long, error long, weighted_error double, weighted_pass boolean, files array<string>, seconds double, model string, calls int, cached_calls int, prompt_tokens int, output_tokens int, thought_tokens int, cost_usd double")
    rows = known.join(done.drop("files", "error"), "set", "left")
    failed = F.col("message").isNotNull() | F.col("items").isNull()
    out_sets = written(rows.select("set", F.col("listed").alias("files"), F.when(failed, F.coalesce("message", F.lit("not counted"))).alias("error"), failed.alias("failed"), *[F.when(~failed, F.col(c)).alias(c) for c in ("items", "truth")], *[F.when(failed, F.lit(False)).otherwise(F.col(c)).alias(c) for c in ("strict_pass", "weighted_pass")], F.when(failed, 1.0).otherwise(F.col("weighted_error")).alias("weighted_error"), *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (("seconds", 0.0), ("model", "none"), ("calls", 0), ("cached_calls", 0), ("prompt_tokens", 0), ("output_tokens", 0), ("thought_tokens", 0), ("cost_usd", 0.0))]))
    good_sets = out_sets.where("not failed").select("set")
    empty = lambda schema: spark.createDataFrame([], schema)
    items = (_all(scored) if scored else empty("set string, key_seq int, key string, description string, truth long, predicted long, abs_error long, rel_error double, within boolean, matched boolean, needs_review long, source string")).join(good_sets, "set", "left_semi")
    more = (_all(extras) if extras else empty("set string, key string, count long")).join(good_sets, "set", "left_semi")
    return Report(items, out_sets, more, scoring.summary(out_sets), takeoffs)


def _all(parts: list[DataFrame]) -> DataFrame | None:
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
