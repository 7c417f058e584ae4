"""Embedding near-duplicates by cross-polytope hashing.

A vector is normalised, padded to a power of two and turned by three rounds of random signs and a fast Hadamard
transform; its hash is the axis, with sign, that the result is nearest to. Two such hashes make the key of a table. Each
vector is stored in each table under its own key and looked up there and, as multiprobe, under the keys with either hash
replaced by the next best axis. Pairs that meet are verified by cosine in double precision, so no link is false; which
links are found is measured against brute force in the tests (at the threshold of 0.98 over 0.99 of them).

Equal vectors of a label are one class, compared once. Vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing; vectors of different lengths are not compared. A vector id in several rows
counts once per row. An empty table gives an empty table. Ties: of axes equally near the first counts, and the smallest id stands for a component. Only
id, vector and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

TABLES, HASHES, ROUNDS = 14, 2, 3
THRESHOLD = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def axes(x: np.ndarray, table: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest signed axis of each rotated row."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for r in range(ROUNDS):
        rng = np.random.Generator(np.random.PCG64([table, part, r, d]))
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    size = np.abs(y)
    first = size.argmax(1)
    rows = np.arange(len(y))
    signed = lambda k: 2 * k + (y[rows, k] < 0)
    one = signed(first)
    size[rows, first] = -1
    return one, signed(size.argmax(1))


def _hashed(classes: DataFrame) -> DataFrame:
    """For each class and table the own key (probe false) and the further ones (probe true)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, size = b.column(0).to_numpy(), np.array([len(v) for v in b.column(1)])
            values = b.column(1).flatten().to_numpy().astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = values[ends[rows][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for t in range(TABLES):
                    found = [axes(x, t, k) for k in range(HASHES)]
                    keys = [[f[0] for f in found]] + [[f[k == j] for k, f in enumerate(found)] for j in range(HASHES)]
                    for p, key in enumerate(keys):
                        code = np.zeros(len(rows), np.int64)
                        for k in key:
                            code = code * (1 << 20) + k
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t * 4096 + int(d) % 4096, np.int64)), pa.array(code), b.column(2).take(pa.array(rows)), pa.array(ids[rows]), pa.array(np.full(n, p > 0))], ["t", "code", "label", "rep", "probe"])

    return classes.select("rep", "v", "label").mapInArrow(run, "t long, code long, label long, rep long, probe boolean")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"), df[label_col].cast("long").alias("label"))
    big = F.array_max(F.transform("v", F.abs))
    # NaN sorts above all numbers, and comparisons with null fail
    fair = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()) & (big > 0) & (big < float("inf")), F.lit(False))
    fit = rows.where(fair)
    classes = materialise(fit.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    keys = materialise(_hashed(classes))
    own = keys.where("not probe").drop("probe").withColumnRenamed("rep", "a")
    pairs = own.join(keys.drop("probe").withColumnRenamed("rep", "b"), ["t", "code", "label"]).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keep = np.zeros(b.num_rows, bool)
            size = [np.diff(b.column(c).offsets.to_numpy()) for c in (2, 3)]
            ends = [np.concatenate([[0], np.cumsum(n)]) for n in size]
            values = [b.column(c).flatten().to_numpy() for c in (2, 3)]
            for d in np.unique(size[0][size[0] == size[1]]):  # vectors of different lengths are not compared
                rows = np.flatnonzero((size[0] == d) & (size[1] == d))
                x, y = (v[e[rows][:, None] + np.arange(d)] for v, e in zip(values, ends, strict=True))
                x, y = (m / np.abs(m).max(1, keepdims=True) for m in (x, y))
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                keep[rows] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    v = classes.select("rep", "v")
    links = materialise(pairs.join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("rep").alias("b"), "many"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("many").alias("others"))
    label = components(links).withColumnRenamed("node", "rep")
    one = classes.join(others, "rep", "left").join(label, "rep", "left").select("rep", "label", "v", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = fit.join(one.drop("rep"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~fair).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
