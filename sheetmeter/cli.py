"""Command line: count drawings, or run a benchmark.

    python -m sheetmeter count DRAWING.pdf [--legend auto] [--out result.json] [--xlsx bill.xlsx] [--overlay marked.pdf] [--no-vision]
    python -m sheetmeter bench FOLDER [--json report.json] [--out-dir results] [--only set-01,set-02] [--no-vision]
"""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sheetmeter import __version__, benchmark, engine
from sheetmeter.operators import legends, vision
from sheetmeter.sinks import overlay, results, workbook
from sheetmeter.sources import drawings
from sheetmeter.workers import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sheetmeter", description="Drawings in, counted quantities and a bill out.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    count = sub.add_parser("count", help="count the legend items of a drawing")
    count.add_argument("pdf", help="a drawing, or a folder or pattern of drawings")
    count.add_argument("--legend", default="auto", help="auto, vector, vision, or a JSON file of {items: [{tag, description}]}")
    count.add_argument("--out", default="result.json", help="the result as JSON (a folder if there are several drawings)")
    count.add_argument("--xlsx", help="also write the bill as a workbook")
    count.add_argument("--overlay", help="also write the drawing with every detection marked")
    count.add_argument("--cross-check", action="store_true", help="ask the model for tagged items too and report disagreements")
    bench = sub.add_parser("bench", help="count the drawings of benchmark sets and score them")
    bench.add_argument("folder", help="a folder of <set>/ground_truth.json and <set>/drawings/*.pdf")
    bench.add_argument("--json", help="the report as JSON")
    bench.add_argument("--out-dir", help="each drawing's result under <out-dir>/<set>/")
    bench.add_argument("--only", help="names of sets, separated by commas")
    for s in (count, bench):
        s.add_argument("--no-vision", dest="vision", action="store_false", help="do without the model")
        s.add_argument("--no-verify", dest="verify", action="store_false", help="do without the second look")
        s.add_argument("--no-symbols", dest="symbols", action="store_false", help="do without symbol matching")
        s.add_argument("--vision-fallback", default="auto", choices=["never", "auto", "always"], help="when the model is asked for items without a count")
        s.add_argument("--client", help="module:function that makes the model client; without one there is no model pass")
        s.add_argument("--images", help="folder of pages rendered as <drawing>/page-<n>-<dpi>.png, which the model pass looks at")
        s.add_argument("--dpi", type=int, default=200, help="resolution of the rendered pages")
        s.add_argument("--tile", type=int, default=1024, help="tile size in pixels")
        s.add_argument("--max-spend", type=float, default=vision.MAX_SPEND, help="dollars from which no more calls are made")
        s.add_argument("--cache", help="folder in which answers of the model are kept")
        s.add_argument("--quiet", action="store_true", help="no progress on stderr")
    return p


def model_pass(spark: SparkSession, o: argparse.Namespace) -> vision.ModelPass | None:
    """The pass that the options ask for: it needs a client, and rendered pages, as nothing here renders them."""
    if not o.vision or not o.client or not o.images:
        return None
    module, _, name = o.client.partition(":")
    client = getattr(importlib.import_module(module), name or "client")()
    settings = vision.Settings(dpi=o.dpi, tile=o.tile, verify=o.verify, max_spend=o.max_spend)
    return vision.ModelPass(client, drawings.read_page_images(spark, o.images), settings, o.cache)


def _say(o: argparse.Namespace, text: str) -> None:
    if not o.quiet:
        print(text, file=sys.stderr)


def count(spark: SparkSession, o: argparse.Namespace) -> int:
    spans, pages, paths = drawings.read_drawings(spark, o.pdf)
    paths = paths if o.symbols else None
    legend = o.legend if o.legend in ("auto", "vector", "vision") else legends.read_legend_file(spark, o.legend)
    takeoff = engine.count_drawings(spans, pages, paths, legend, model_pass(spark, o), o.vision_fallback, o.cross_check)
    docs = results.result_documents(takeoff)
    one = pages.select("drawing_id").distinct().limit(2).count() == 1
    if one:
        Path(o.out).parent.mkdir(parents=True, exist_ok=True)
        Path(o.out).write_text(docs.first()["json"] + "\n")
    else:
        results.write_results(takeoff, o.out)
    if o.xlsx:
        workbook.write_bill(takeoff, o.xlsx)
        _say(o, f"wrote {o.xlsx}")
    if o.overlay:
        marked = overlay.overlays(takeoff, drawings.read_files(spark, o.pdf))
        if one:
            Path(o.overlay).parent.mkdir(parents=True, exist_ok=True)
            Path(o.overlay).write_bytes(bytes(marked.first()["content"]))
        else:
            marked.write.mode("overwrite").parquet(o.overlay)
        _say(o, f"wrote {o.overlay}")
    for r in results.console_lines(takeoff).sort("drawing_id", "item_seq").toLocalIterator():
        print(r["line"])
    for r in takeoff.warnings.sort("drawing_id", "warning").toLocalIterator():
        print(f"warning: {r['warning']}", file=sys.stderr)
    _say(o, f"wrote {o.out}; {takeoff.usage['calls']} model call(s), ${takeoff.usage['cost_usd']:.4f}")
    return 0


def bench(spark: SparkSession, o: argparse.Namespace) -> int:
    make = (lambda: model_pass(spark, o)) if o.vision and o.client and o.images else None
    only = [s.strip() for s in o.only.split(",") if s.strip()] if o.only else None
    report = benchmark.run_bench(spark, o.folder, only, make, o.vision_fallback, o.symbols)
    if o.json:
        results.write_report(report, o.folder, o.json)
    if o.out_dir:
        for t in report.takeoffs:
            for r in results.result_documents(t).toLocalIterator():
                folder, name = r["drawing_id"].split("/")[-3], r["drawing_id"].rpartition("/")[2]
                at = Path(o.out_dir) / folder
                at.mkdir(parents=True, exist_ok=True)
                (at / f"{name}.result.json").write_text(r["json"] + "\n")
    print(results.report_text(report))
    return 2 if report.summary.first()["failed"] else 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    own = spark is None
    if own:
        spark = SparkSession.builder.appName("sheetmeter").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    try:
        return {"count": count, "bench": bench}[o.command](ship(spark), o)
    except Exception as e:  # noqa: BLE001  a command line gives a message, not a trace
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()
