"""Folds over the rows of one page (or another key): where what was kept decides what comes next."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_key(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """fold(key, rows in order) for each key; its rows, with the key added, make the result.

    One key's rows are in memory at a time; keys are dealt over tasks by hash. A page holds what one sheet of paper
    holds, so its rows are bounded by what can be drawn, not by the number of drawings.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()

        out: list[dict] = []
        for key, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
            named = dict(zip(keys, key, strict=True))
            out += [named | r for r in fold(key, list(group))]
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
