"""Results as JSON documents and as lines of text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmeter.benchmark import Report
from sheetmeter.engine import Takeoff
from sheetmeter.operators import scoring

SCHEMA_VERSION = 1


def _box(*fields: str):
    return F.struct(*[F.col(f).alias(f.rpartition(".")[2]) for f in fields])


def result_documents(t: Takeoff) -> DataFrame:
    """drawing_id and json, one document per drawing: pages with title blocks and detections, counted items, warnings, usage. Glyph
    signatures are working data and stay out."""
    keys = ["drawing_id", "page"]
    detection = F.struct("item_id", _box("x", "y", "w", "h").alias("box"), "confidence", "source", "multiplier", "needs_review", "review_reason")
    found = t.detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", detection.alias("d")))).alias("found"))
    pages = t.pages.join(t.title_blocks, keys, "left").join(found, keys, "left")
    page = F.struct("page", "width", "height", F.struct("drawing_number", "title", "scale", F.col("box")).alias("title_block"), F.coalesce(F.transform("found", lambda f: f["d"]), F.array()).alias("detections"))
    out = pages.groupBy("drawing_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    listed = t.items.select("drawing_id", "item_id", "item_seq", "reference").join(t.counts, ["drawing_id", "item_id"])
    item = F.struct("item_seq", F.struct("item_id", "tag", "description", "reference", "count", "needs_review", "source", "per_page").alias("i"))
    out = out.join(listed.groupBy("drawing_id").agg(F.transform(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["item_seq"] < b["item_seq"], -1).when(a["item_seq"] > b["item_seq"], 1).otherwise(0)), lambda x: x["i"]).alias("items")), "drawing_id", "left")
    out = out.join(t.warnings.groupBy("drawing_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings")), "drawing_id", "left")
    fields = [F.lit(SCHEMA_VERSION).alias("schema_version"), F.regexp_extract("drawing_id", "([^/]+)$", 1).alias("file"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), "pages", F.coalesce("items", F.array()).alias("items"), F.coalesce("warnings", F.array()).alias("warnings"), F.struct(*[F.lit(v).alias(k) for k, v in t.usage.items()]).alias("usage")]
    if t.stats is not None:
        stats = F.sort_array(F.collect_list(F.struct("item_id", "reference_elements", "anchor_candidates", "matches", "mean_score")))
        out = out.join(t.stats.groupBy("drawing_id").agg(stats.alias("symbols")), "drawing_id", "left")
        fields.append(F.col("symbols"))
    return out.select("drawing_id", F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def write_results(t: Takeoff, folder: str) -> None:
    """The documents as text files under folder/drawing=<file name>/, written by the executors."""
    docs = result_documents(t).select(F.regexp_extract("drawing_id", "([^/]+)$", 1).alias("drawing"), F.col("json").alias("value"))
    docs.write.mode("overwrite").partitionBy("drawing").text(folder)


def console_lines(t: Takeoff) -> DataFrame:
    """drawing_id, item_seq, line: key, count, source, reviews and description in columns."""
    x = t.counts.join(t.items.select("drawing_id", "item_id", "item_seq"), ["drawing_id", "item_id"])
    key, source = F.coalesce("tag", "item_id"), F.col("source")
    wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    review = F.when(F.col("needs_review") > 0, F.concat(F.lit("review:"), F.col("needs_review").cast("string"), F.lit(" "))).otherwise("")
    return x.select("drawing_id", "item_seq", F.concat(wide(key, 6), F.lit(" "), F.format_string("%5d", "count"), F.lit("  "), wide(source, 6), F.lit(" "), review, "description").alias("line"))


def report_lines(r: Report) -> DataFrame:
    """The report as numbered lines (place, line): a row for each set with its worst item, its misses and extras; headline, cost, note on the cache."""
    percent = lambda c, n=1: F.format_string(f"%.{n}f%%", c * 100)
    worst = scoring.worst_items(r.items)
    of_worst = F.concat("key", F.lit(" "), F.col("predicted").cast("string"), F.lit("/"), F.col("truth").cast("string"), F.when(F.col("rel_error").isNull(), "").otherwise(F.concat(F.lit(" ("), percent(F.col("rel_error")), F.lit(")"))))
    within = r.items.groupBy("set").agg(F.count_if("within").alias("good"))
    s = r.sets.join(worst.select("set", of_worst.alias("worst")), "set", "left").join(within, "set", "left")
    verdict = lambda c: F.when(F.col(c), "PASS").otherwise("FAIL")
    row = F.concat(F.rpad("set", 10, " "), F.lit(" "), verdict("strict_pass"), F.lit(" strict  "), verdict("weighted_pass"), F.lit(" weighted "), F.lpad(percent(F.col("weighted_error")), 6, " "), F.format_string("  items %3d/%3d  worst ", "good", "items"), F.rpad(F.coalesce("worst", F.lit("-")), 24, " "), F.format_string(" $%.3f  %.1fs", "cost_usd", "seconds"))
    failed = F.concat(F.rpad("set", 10, " "), F.lit(" ERROR "), "error")
    heads = s.select("set", F.lit(0).alias("part"), F.lit("").alias("key"), F.when(F.col("failed"), failed).otherwise(row).alias("line"))
    found = F.when(F.col("matched"), F.col("source")).otherwise("not found")
    misses = r.items.where("not within").select("set", F.lit(1).alias("part"), "key", F.concat(F.lit(" " * 13), F.rpad("key", 8, " "), F.format_string(" %5d / %5d  ", "predicted", "truth"), found).alias("line"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "count"))), lambda e: F.concat(e["key"], F.lit("="), e["count"].cast("string"))), ", ")
    more = r.extras.groupBy("set").agg(F.concat(F.lit(" " * 13 + "extra: "), listed).alias("line")).select("set", F.lit(2).alias("part"), F.lit("").alias("key"), "line")
    body = heads.unionByName(misses).unionByName(more)
    m = r.summary.crossJoin(r.sets.agg(F.sum("cost_usd").alias("cost"), F.sum("prompt_tokens").alias("tin"), (F.sum("output_tokens") + F.sum("thought_tokens")).alias("tout"), F.avg("seconds").alias("mean_s"), F.sum("cached_calls").alias("cached")))  # one row by one row
    headline = F.format_string(f"%d of %d sets within ±{TOLERANCE_PERCENT}%% on every item (%d of %d on quantity-weighted error)", "strict", "sets", "weighted", "sets")
    cost = F.format_string("cost: $%.3f total, $%.3f per set; %d in / %d out tokens; %.1f s per set", "cost", F.col("cost") / F.col("sets"), "tin", "tout", "mean_s")
    note = F.when(F.col("cached") > 0, F.format_string("note: %d model call(s) were answered from the local cache, so wall times understate a fresh run", "cached"))
    tail = m.select(F.explode(F.array_compact(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("line")) if v is not note else F.when(F.col("cached") > 0, F.struct(F.lit(k).alias("part"), v.alias("line"))) for k, v in ((3, F.lit("")), (4, headline), (5, cost), (6, note))]))).alias("t")).select(F.lit("￿").alias("set"), "t.part", F.lit("").alias("key"), "t.line")
    return body.unionByName(tail).select("set", "part", "key", "line")


TOLERANCE_PERCENT = f"{scoring.TOLERANCE * 100:g}"


def report_text(r: Report) -> str:
    """The report for the terminal: a few lines for each set."""
    return "\n".join(x["line"] for x in report_lines(r).sort("set", "part", "key").collect())


def report_document(r: Report, folder: str) -> dict:
    """The report as one JSON-able object; a report holds a benchmark's sets and lines, not its detections."""
    items, extras = {}, {}
    for row in r.items.sort("set", "key_seq").collect():
        items.setdefault(row["set"], []).append({k: v for k, v in row.asDict().items() if k not in ("set", "key_seq")})
    for row in r.extras.sort("set", "key").collect():
        extras.setdefault(row["set"], []).append({"key": row["key"], "count": row["count"]})
    sets = [row.asDict() | {"lines": items.get(row["set"], []), "extras": extras.get(row["set"], [])} for row in r.sets.sort("set").collect()]
    return {"schema_version": SCHEMA_VERSION, "folder": folder, "tolerance": scoring.TOLERANCE, "sets": sets, "summary": r.summary.first().asDict()}


def write_report(r: Report, folder: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report_document(r, folder), indent=2) + "\n")
