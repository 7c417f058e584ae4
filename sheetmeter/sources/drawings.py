"""Drawing files and page images as DataFrames: pages, spans and paths of PDF files, sizes of PNG files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sheetmeter.operators.symbols import PATHS, SUBPATHS
from sheetmeter.tables import written

from . import pdf

PAGES = "drawing_id string, page int, width double, height double"
SPANS = "drawing_id string, page int, seq long, str string, x double, y double, w double, h double, font_size double"
#: Rows that a batch of decoded rows holds.
BATCH = 4096


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("drawing_id"), "content")


def _decoded(files: DataFrame, schema: str, rows, text: bool, paths: bool, pages: list[int] | None) -> DataFrame:
    """rows(page) of every page of every file; a file is decoded by one task, a page's rows leave it in batches."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for page in pdf.decode(content.as_py() or b"", pages, text, paths):
                    found = rows(page)
                    for k in range(0, len(found), BATCH):
                        yield pa.RecordBatch.from_pylist([{"drawing_id": name, "page": page.number} | r for r in found[k : k + BATCH]], schema=arrow)

    return files.mapInArrow(run, schema)


def read_failures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """drawing_id and error of the files that cannot be decoded. (Files of no bytes are not seen by the file source.)"""

    def run(batches):
        for b in batches:
            bad = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    pdf.decode(content.as_py() or b"")
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its error
                    bad.append((name, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in bad], pa.string()) for k in (0, 1)], ["drawing_id", "error"])

    return read_files(spark, path).mapInArrow(run, "drawing_id string, error string")


def pages_in(files: DataFrame) -> DataFrame:
    """files: drawing_id, content (a batch or a stream). Page from 1, width and height in points as seen."""
    return _decoded(files, PAGES, lambda p: [{"width": p.width, "height": p.height}], False, False, None)


def spans_in(files: DataFrame) -> DataFrame:
    """One row per text run that is not blank, in the order of drawing."""
    return _decoded(files, SPANS, lambda p: p.spans, True, False, None)


def paths_in(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """One row per filled or stroked path, curves cut into straight pieces; clipping paths are left out. pages: only these page numbers."""
    return _decoded(files, PATHS, lambda p: p.paths, False, True, pages)


_ROWS = "drawing_id string, page int, kind string, " + ", ".join(dict.fromkeys(c.strip() for ddl in (PAGES, SPANS) for c in ddl.split(", ")[2:])) + f", index int, subpaths {SUBPATHS}, fill boolean, stroke boolean, line_width double"


def _all_rows(page: pdf.Page) -> list[dict]:
    named = lambda kind, rows: [{"kind": kind} | r for r in rows]
    return named("page", [{"width": page.width, "height": page.height}]) + named("span", page.spans) + named("path", page.paths)


def drawings_in(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, pages and paths of files (drawing_id, content), decoded once into a table of which the three are parts."""
    rows = written(_decoded(files, _ROWS, _all_rows, True, True, None))
    part = lambda kind, ddl: rows.where(F.col("kind") == kind).select(*StructType.fromDDL(ddl).names)
    return part("span", SPANS), part("page", PAGES), part("path", PATHS)


def read_drawings(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    return drawings_in(read_files(spark, path))


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pages_in() of the files at the path; a drawing's id is its file's path."""
    return pages_in(read_files(spark, path))


def read_spans(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spans_in(read_files(spark, path))


def read_paths(spark: SparkSession, path: str | list[str], pages: list[int] | None = None) -> DataFrame:
    return paths_in(read_files(spark, path), pages)


def png_size(content: Column) -> Column:
    """Width and height from the header of a PNG file; null for other content."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 4)) == "89504E47", F.struct(number(17).alias("width"), number(21).alias("height")))


def read_page_images(spark: SparkSession, path: str) -> DataFrame:
    """Pages rendered beforehand as <drawing>/page-<n>-<dpi>.png: drawing, page, dpi, pixel size and content."""
    at = lambda group: F.regexp_extract("path", r"([^/]+)/page-(\d+)-(\d+)\.png$", group)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).where(at(1) != "")
    return files.select(at(1).alias("drawing_id"), at(2).cast("int").alias("page"), at(3).cast("int").alias("dpi"), png_size(F.col("content")).alias("size"), "content").select("drawing_id", "page", "dpi", "size.*", "content")
