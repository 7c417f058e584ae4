"""Counts drawings as they arrive: a stream of files, decoded as it comes, and counted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetmeter import engine
from sheetmeter.sources import drawings

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of drawing_id and content of the PDF files that arrive in the folder, at most per_batch at a time."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_batch)
    return stream.load(folder).select(F.col("path").alias("drawing_id"), "content")


def arriving_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The text spans of arriving drawings, as a stream; nothing is held between batches."""
    return drawings.spans_in(arriving_files(spark, folder))


def count_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 1000, count: Callable[..., engine.Takeoff] = engine.count_drawings) -> StreamingQuery:
    """Starts the counting of arriving drawings; their counts go to out/batch=<n>/, one folder for each batch.

    A drawing is whole in its file, so batches need nothing from each other. A batch that is run again after a failure writes its folder anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        t = count(*drawings.drawings_in(batch))
        t.counts.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return arriving_files(spark, folder, per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
