"""Scores of counts against ground truth: key resolution, item, set and summary scores, extras, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetmeter.functions import text as t

TOLERANCE = 0.05
# List price in dollars per million tokens, in and out.
PRICE_IN, PRICE_OUT = 1.5, 7.5


def _with(df: DataFrame, **defaults) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def engine_totals(counts: DataFrame) -> DataFrame:
    """counts: set, drawing_id, item_id, tag, description, count (item_seq, needs_review, source where known). Per set and normalised key the
    total, the reviews, the sources, the first description, and where the key was entered first."""
    c = _with(counts, needs_review=F.lit(0).cast("long"), source=F.lit("none"), item_seq=F.lit(0).cast("long"))
    place = F.struct("drawing_id", "item_seq", "item_id")
    return c.groupBy("set", t.normalise(F.coalesce("tag", "item_id")).alias("key")).agg(F.sum("count").cast("long").alias("count"), F.min_by("description", place).alias("description"), F.sum("needs_review").cast("long").alias("needs_review"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(place).alias("entered"))


def resolve(truth: DataFrame, totals: DataFrame) -> DataFrame:
    """truth: set, key, truth, description (mapping: array of keys or descriptions). Adds match_key, one row for each total that a line takes.

    A mapped line takes each of its entries that is a key, or else a description, of a total; no other. Any other line takes its own normalised
    key, else the total whose description equals the line's description, else the one whose description equals the key. Of
    totals with equal descriptions the one entered last counts. A line that takes nothing has one row without a match_key.
    """
    truth = _with(truth, mapping=F.lit(None).cast("array<string>"))
    k = totals.select("set", F.col("key").alias("k1")).distinct()
    by = totals.groupBy("set", t.normalise("description").alias("d")).agg(F.max_by("key", "entered").alias("k2"))
    lines = truth.withColumn("wanted", F.explode(F.when(F.size("mapping") > 0, F.transform("mapping", lambda m: F.struct(t.normalise(m).alias("n"), F.lit(None).cast("string").alias("m"), F.lit(True).alias("mapped")))).otherwise(F.array(F.struct(t.normalise("key").alias("n"), t.normalise("description").alias("m"), F.lit(False).alias("mapped"))))))
    x = lines.withColumns({"n": F.col("wanted.n"), "m": F.col("wanted.m")})
    x = x.join(k, (x["set"] == k["set"]) & (F.col("n") == F.col("k1")), "left").drop(k["set"])
    b1, b2 = by.toDF("s1", "d1", "m1"), by.toDF("s2", "d2", "m2")
    x = x.join(b1, (F.col("set") == F.col("s1")) & (F.col("m") == F.col("d1")), "left").join(b2, (F.col("set") == F.col("s2")) & (F.col("n") == F.col("d2")), "left")
    return x.withColumn("match_key", F.coalesce("k1", "m1", "m2")).select(*truth.columns, "match_key")


def score_items(resolved: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per line of the truth: the sum of what it takes, errors, and whether that is within the tolerance."""
    line = [c for c in ("set", "key_seq", "key", "truth", "description") if c in resolved.columns]
    p = totals.select("set", F.col("key").alias("match_key"), F.col("count").alias("p"), F.col("description").alias("said"), F.col("needs_review").alias("r"), "sources", "entered")
    each = resolved.dropDuplicates([*line, "match_key"]).join(p, ["set", "match_key"], "left")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entered", "said"))), lambda s: s["said"]), " + ")
    x = each.groupBy(*line).agg(F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("predicted"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("needs_review"), F.count("p").alias("_n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))), "+").alias("_s"), said.alias("_said"))
    x = x.withColumn("abs_error", F.abs(F.col("predicted") - F.col("truth"))).withColumn("rel_error", F.when(F.col("truth") != 0, F.col("abs_error") / F.col("truth")))
    within = F.when(F.col("truth") == 0, F.col("predicted") == 0).otherwise(F.col("abs_error") <= TOLERANCE * F.col("truth") + 1e-9)
    more = [F.col("key_seq")] if "key_seq" in line else []
    return x.select("set", *more, "key", F.coalesce("description", F.when(F.col("_n") > 0, F.col("_said"))).alias("description"), "truth", "predicted", "abs_error", "rel_error", within.alias("within"), (F.col("_n") > 0).alias("matched"), "needs_review", F.when(F.col("_n") > 0, F.col("_s")).otherwise("none").alias("source"))


def score_sets(items: DataFrame) -> DataFrame:
    s = items.groupBy("set").agg(F.count("*").alias("items"), F.bool_and("within").alias("strict_pass"), F.sum("truth").cast("long").alias("truth"), F.sum("abs_error").cast("long").alias("error"))
    s = s.withColumn("weighted_error", F.when(F.col("truth") != 0, F.col("error") / F.col("truth")).when(F.col("error") == 0, 0.0).otherwise(1.0))
    return s.withColumn("weighted_pass", F.col("weighted_error") <= TOLERANCE + 1e-9)


def summary(sets: DataFrame) -> DataFrame:
    """sets: set, strict_pass, weighted_pass, weighted_error; failed (true for a set that did not run) where known. Passes are counted over the sets that
    ran, the mean error over all."""
    s = _with(sets, failed=F.lit(False))
    ran = ~F.col("failed")
    return s.agg(F.count("*").alias("sets"), F.count_if(ran & F.col("strict_pass")).alias("strict"), F.count_if(ran & F.col("weighted_pass")).alias("weighted"), F.avg("weighted_error").alias("mean_error"), F.count_if(~ran).alias("failed"))


def extras(resolved: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals above 0 that no truth line used."""
    used = resolved.where("match_key is not null").select("set", F.col("match_key").alias("key")).distinct()
    return totals.where("count > 0").join(used, ["set", "key"], "left_anti").select("set", "key", "count")


def worst_items(items: DataFrame) -> DataFrame:
    """Per set the item with the largest relative error (9 where the truth is 0 and something was found); ties: the first by key."""
    weight = F.coalesce("rel_error", F.when(F.col("abs_error") > 0, 9.0).otherwise(0.0))
    return items.groupBy("set").agg(F.min_by(F.struct(*[c for c in items.columns if c != "set"]), F.struct((-weight).alias("w"), "key")).alias("i")).select("set", "i.*")


def usage(records: DataFrame) -> DataFrame:
    """records: tokens_in, tokens_out, tokens_thought (model, cached, place where known). Sums, cost (of cached calls too), cached calls, and the
    last model that is not `none`."""
    r = _with(records, model=F.lit("none"), cached=F.lit(False), place=F.lit(0))
    s = r.agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tokens_in", "tokens_out", "tokens_thought")], F.count_if("cached").alias("cached_calls"), F.coalesce(F.max_by(F.when(F.col("model") != "none", F.col("model")), F.when(F.col("model") != "none", F.col("place"))), F.lit("none")).alias("model"))
    return s.withColumn("cost_usd", (F.col("tokens_in") * PRICE_IN + (F.col("tokens_out") + F.col("tokens_thought")) * PRICE_OUT) / 1e6)
