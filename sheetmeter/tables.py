"""Tables between steps: written as Parquet where all executors can read them, so that plans stay small and lost executors cost little."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error, as
    executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="sheetmeter-")
    return _own["dir"]


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """What is written inside removes its shuffle files when it ends, not when the driver collects its garbage; a plan
    that reads them again would compute them anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. The table goes when the driver's interpreter ends, or with removed()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheetmeter-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing reads it any more."""
    for f in {p.rpartition("/")[0] for p in table.inputFiles()}:
        if "/sheetmeter-" in f:
            _remove(table.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass
