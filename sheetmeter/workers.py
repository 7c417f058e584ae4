"""Makes the package importable in Python workers that were started elsewhere than in the repository."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers once per session, unless PYTHONPATH already leads them to it."""
    on_path = any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    sc = spark.sparkContext
    if on_path or getattr(sc, "_sheetmeter_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="sheetmeter-")) / "sheetmeter.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "sheetmeter").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._sheetmeter_shipped = True
    return spark
