"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors.

Training counts, per word and per four-letter word beginning, the toxic and clean documents that hold it. A beginning's
log-odds are smoothed by a Dirichlet prior at the class sizes, a word's by one at its beginning's odds; entries whose
log-odds are under Z standard errors away from 0 weigh nothing. A text is the sequence of its words' log-odds, less a
drift; the linear-time algorithm of Ruzzo and Tompa finds all maximal-scoring segments. A segment of score S in
n words has the extreme-value p-value 1 - exp(-K n exp(-S)); K is fitted by maximum likelihood on the best segments of clean documents.
Significant segments are aggregated to -sum(log10 p), and a logistic curve fitted on training documents turns that into
the score.

Null and empty texts have no segment and get the curve's value at 0. Texts are scored whole, in linear time;
repeated rows one by one; without labels, or with one class only, every score is the share of toxic labels (0 without any). A
document labelled more than once counts as toxic if any label says so; of entries with equal scores all are kept, and of equal segments each
counts. An empty table gives an empty table. Only id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Labelled documents to learn from (drawn by a hash of the id beyond it). The entries that weigh are of these documents, so their number is bounded too.
TRAIN_DOCS = 200_000
#: Pseudo-documents of the priors, z from which an entry counts, score lost per ordinary word, p-value of significance.
PRIOR_BEGIN, PRIOR_WORD, Z, DRIFT, SIGNIFICANT = 2.0, 4.0, 2.5, 0.02, 0.05
BEGIN = 4
WORD = re.compile(r"[^\W\d_]+")


class Model:
    def __init__(self, weights: dict[str, float], base: float, k: float = 1.0, curve: tuple[float, float] = (0.0, 0.0)):
        self.weights, self.base, self.k, self.curve = weights, base, k, curve

    def word_scores(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """The number of words, and position and weight of those that weigh."""
        words = WORD.findall(text.lower())
        get, out = self.weights.get, []
        for i, w in enumerate(words):
            s = get(w)
            if s is None:
                s = get("^" + w[:BEGIN])
            if s is not None:
                out.append((i, s))
        return len(words), out

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and (first word, word after the last, score) of each maximal-scoring segment."""
        n, weights = self.word_scores(text)
        return n, maximal_segments(weights)

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        n, found = self.segments(text or "")
        total, kept = 0.0, []
        for a, b, s in found:
            e = self.k * n * math.exp(-s)
            p = -math.expm1(-e)
            if p < SIGNIFICANT:
                total -= math.log10(max(p, 1e-300))
                kept.append((a, b, s))
        return total, kept

    def score(self, evidence: float) -> float:
        if self.curve == (0.0, 0.0):
            return self.base
        x = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def maximal_segments(weights: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's linear-time scan over weighted positions; a position that is not listed weighs -drift."""
    stack: list[list] = []  # first, after, sum before it, sum up to its end, the nearest earlier index with a smaller sum before
    total, at = 0.0, 0
    for i, s in weights:
        before = total - drift * (i - at)
        total, at = before + s - drift, i + 1
        if total <= before:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, r - q) for a, b, q, r, _ in stack]


def _counts(labelled: DataFrame) -> DataFrame:
    """Toxic and clean documents per word and word beginning."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            keys = list(counts[0].keys() | counts[1].keys())
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
            counts[0].clear(), counts[1].clear()
            return b

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                counts[toxic].update(words)
                counts[toxic].update({"^" + w[:BEGIN] for w in words})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    return labelled.select("text", "toxic").mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; others are passed over)."""
    one = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = one.count()
    if n > most_docs:
        one = one.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < F.lit(int(1e6 * 0.98 * most_docs / n)))
    # the labels drawn are bounded by most_docs, so they are broadcast and texts are not shuffled
    labelled = docs.select("doc_id", "text").join(F.broadcast(one.limit(most_docs)), "doc_id")
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, n1 / (n1 + n0) if n1 + n0 else 0.0)
    pi = n1 / (n1 + n0)
    base = math.log(pi / (1 - pi))
    counts = _counts(labelled).where("toxic + clean >= 2")
    word = counts.where("not startswith(entry, '^')").withColumn("begin", F.concat(F.lit("^"), F.substring("entry", 1, BEGIN)))
    begin = counts.where("startswith(entry, '^')").withColumn("q", (F.col("toxic") + PRIOR_BEGIN * pi) / (F.col("toxic") + F.col("clean") + PRIOR_BEGIN))
    logit = lambda q: F.log(q / (1 - q)) - base
    z = lambda s, t, c: F.abs(s) / F.sqrt(1 / t + 1 / c)
    b = begin.select("entry", logit(F.col("q")).alias("s"), z(logit(F.col("q")), F.col("toxic") + PRIOR_BEGIN * pi, F.col("clean") + PRIOR_BEGIN * (1 - pi)).alias("z"))
    w = word.join(begin.select(F.col("entry").alias("begin"), "q"), "begin", "left").withColumn("q", F.coalesce("q", F.lit(pi)))
    w = w.withColumn("t", F.col("toxic") + PRIOR_WORD * F.col("q")).withColumn("c", F.col("clean") + PRIOR_WORD * (1 - F.col("q")))
    w = w.withColumn("s", logit(F.col("t") / (F.col("t") + F.col("c")))).select("entry", "s", z(F.col("s"), F.col("t"), F.col("c")).alias("z"))
    # words that weigh nothing are kept at 0 if their beginning weighs, lest the beginning speak for them
    rows = b.unionByName(w).where(f"z >= {Z} and abs(s) >= 0.5").collect()
    model = Model({r[0]: float(r[1]) for r in rows}, pi)
    _calibrate(model, labelled)
    return model


def _calibrate(model: Model, labelled: DataFrame) -> None:
    """Fits K on the best segments of clean documents, then the curve on the evidence of all labelled ones."""
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def best(batches):
        for b in batches:
            found = [shared.value.segments(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([max((s for _, _, s in k), default=0.0) for _, k in found], pa.float64())], ["n", "s"])

    clean = labelled.where("toxic = 0").select("text").mapInArrow(best, "n long, s double").where("n > 0")
    count, mass = clean.agg(F.count("*"), F.sum(F.col("n") * F.exp(-F.col("s")))).first()
    model.k = max(1e-9, min(1.0, count / mass)) if mass else 1.0
    again = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(math.log1p(again.value.evidence(t)[0]), 6) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["x", "toxic"])

    # two numbers for each training document, of which there are TRAIN_DOCS at most; equal ones are counted first
    rows = labelled.select("text", "toxic").mapInArrow(evidence, "x double, toxic int").groupBy("x", "toxic").count().collect()
    x, y, v = [r["x"] for r in rows], [r["toxic"] for r in rows], [r["count"] for r in rows]
    x, y, v = (np.array(a, float) for a in (x, y, v))
    a, b = math.log(model.base / (1 - model.base)), 0.5
    for _ in range(50):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(v * (p - y)).sum() + 1e-3 * a, (v * (p - y) * x).sum() + 1e-3 * b])
        u = v * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[u.sum() + 1e-3, (u * x).sum()], [(u * x).sum(), (u * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    model.curve = (float(a), float(b))


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the significant segments (in words) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the weights of TRAIN_DOCS documents' words

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.evidence(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(e) for e, _ in found], pa.float64()), pa.array([[{"first": a, "after": z, "score": s} for a, z, s in k] for _, k in found], pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())])))], ["doc_id", "score", "segments"])

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, score double, segments array<struct<first: int, after: int, score: double>>")


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled documents whose crc32 of the id is not 2 modulo 4, and scores all documents."""
    model = train(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text"), labels.where(crc_mod("doc_id", 4) != 2))
    found = score_texts(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "segments")
