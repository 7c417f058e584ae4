"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmeter.tables import removed as remove_table  # noqa: F401  for the operators
from sheetmeter.tables import written

#: Rows up to which a table of ids or short keys is broadcast (about 16 bytes a row); beyond it a shuffle join runs.
BROADCAST_ROWS = 1_000_000


def materialise(df: DataFrame, *keys: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage, survives lost executors."""
    return written(df.repartition(*keys) if keys else df)


def semi_join(df: DataFrame, ids: DataFrame, key: str | list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids: broadcast when ids is counted at `most` rows or fewer, else by shuffle."""
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def byte_view(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Cuts a batch into runs of rows whose texts hold about most_bytes; one longer text makes a run of its own."""
    _, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: Rows and bytes of the batches that texts are handed to Python workers in: texts are long rows, and a batch is in memory several times.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def texts_of(df: DataFrame) -> DataFrame:
    """df, for a step that hands texts to Python workers. Holds the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; smaller settings and such
    with a unit stand."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def release() -> None:
    """Gives freed memory of this worker back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))
