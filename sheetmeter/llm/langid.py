"""Language identification: prediction by partial matching with frozen byte statistics.

Each language has a tree of byte contexts up to `order` bytes long. In a context seen n times with q different
successors, a successor seen c times costs -log2(c / (n + q)) bits and an escape to the next shorter context
-log2(q / (n + q)); a context that was never seen is passed at no cost; below order 0 a byte costs 8 bits. The
statistics do not change while scoring, so the code length of a text is an exact sum. The tree is kept as sorted strings, one list for each depth;
the different strings of order + 1 bytes of a block are looked up once in each, longest first. ASCII letters are taken without case and all other
ASCII bytes as spaces. The language with the shortest code wins (ties: the first by name).
The score is that language's share when each language weighs 2^-bits.

Null text, empty text and text without a letter give `und` with score 0. Texts are scored whole, in blocks, so that
memory does not grow with their length. Rows are scored one by one, repeated ones too; columns besides id and text are
not read. An empty table gives an empty table. Without any training row every text is `und`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, crc_mod, release, slices, texts_of

#: Bounds of the training sample: documents and bytes a language (whole documents only; a language without one that fits
#: learns from the first bytes of one). Every language is learned.
TRAIN_DOCS, TRAIN_BYTES = 300, 1_500_000
#: Bytes of context; a string of context and successor has to fit into a 64-bit number.
ORDER = 4
#: Numbers of a block's table of costs (different strings and languages) that are worked out at once.
BLOCK = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
# case and all ASCII besides letters carry no language; 0 stands for what is before a text
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[:128] = [c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)]


def strings(data: np.ndarray, offsets: np.ndarray, order: int, at: int = 0, to: int | None = None) -> np.ndarray:
    """For each of the bytes at to `to` the number that it makes with the `order` bytes before it in its text, oldest first."""
    to = len(data) if to is None else to
    back = max(0, at - order)
    folded = _FOLD[data[back:to]]
    start = np.repeat(offsets[:-1], np.diff(offsets))[at:to]
    place = np.arange(at, to)
    out = np.zeros(to - at, np.uint64)
    for j in range(order, -1, -1):
        before = place - j
        out = (out << np.uint64(8)) | np.where(before >= start, folded[np.maximum(before - back, 0)], np.uint64(0))
    return out


class Tree:
    """One language: per depth m the strings of m + 1 bytes that were seen, sorted, with their bits, and the contexts of m bytes with the bits of
    an escape."""

    def __init__(self, texts: list[bytes], order: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        seen, count = np.unique(strings(data, offsets, order), return_counts=True)
        self.seen, self.bits, self.contexts, self.escape = [], [], [], []
        for m in range(order, -1, -1):
            contexts, at = np.unique(seen >> np.uint64(8), return_inverse=True)
            n, q = np.bincount(at, count, len(contexts)), np.bincount(at, minlength=len(contexts))
            self.seen.append(seen)
            self.bits.append((-np.log2(count / (n + q)[at])).astype(np.float32) if len(seen) else np.zeros(0, np.float32))
            self.contexts.append(contexts)
            self.escape.append((-np.log2(q / (n + q))).astype(np.float32) if len(seen) else np.zeros(0, np.float32))
            if m:  # without the oldest byte
                seen, at = np.unique(seen & np.uint64((1 << 8 * m) - 1), return_inverse=True)
                count = np.bincount(at, count, len(seen)).astype(np.int64)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each string of order + 1 bytes: escapes down to the longest context in which its last byte was seen."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        order = len(self.seen) - 1
        for level in range(order + 1):
            if not len(todo):
                break
            k = keys[todo] & np.uint64((1 << 8 * (order - level + 1)) - 1)
            hit, at = _found(self.seen[level], k)
            out[todo[hit]] += self.bits[level][at[hit]]
            todo, k = todo[~hit], k[~hit]
            known, at = _found(self.contexts[level], k >> np.uint64(8))
            out[todo[known]] += self.escape[level][at[known]]
        out[todo] += 8
        return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys, at


class Model:
    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        if order > 7:
            raise ValueError("a context has seven bytes at most")
        self.langs, self.order = sorted(texts), order
        self.trees = [Tree(texts[lang], order) for lang in self.langs]

    def lengths(self, data: np.ndarray, offsets: np.ndarray, block: int = 1 << 19) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        block = max(1, min(block, (BLOCK * 8) // max(1, len(self.langs))))
        for at in range(0, len(data), block):
            to = min(len(data), at + block)
            first, last = np.searchsorted(offsets, [at, to - 1], side="right") - 1
            own = np.clip(offsets[first : last + 2], at, to)  # the texts of this block
            keys, back = np.unique(self._strings(data, offsets, first, last, at, to), return_inverse=True)
            starts = own[:-1][np.diff(own) > 0] - at
            owner = np.arange(first, last + 1)[np.diff(own) > 0]
            for k, tree in enumerate(self.trees):
                out[owner, k] += np.add.reduceat(tree.cost(keys)[back], starts)
        return out

    def _strings(self, data, offsets, first, last, at, to):
        lo = max(int(offsets[first]), at - self.order)
        own = np.clip(offsets[first : last + 2], lo, to) - lo
        # where the first text began before lo, all bytes that its contexts need are there
        return strings(data[lo:to], own, self.order, at - lo, to - lo)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on a sample of at most `docs` documents and `most_bytes` bytes a language, drawn by a hash of the id."""
    known = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model({}, order)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs / n))])
    # drawn by a hash of id and text: a row that is repeated is drawn or not with all its copies, and then learnt from once
    drawn = known.where(F.pmod(F.xxhash64("id", "text", F.lit("langid")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000).dropDuplicates(["lang", "id", "text"])
    texts: dict[str, list[bytes]] = {k: [] for k in sizes}
    room, cut = dict.fromkeys(sizes, most_bytes), {}
    # about `docs` documents a language; the order and the bound (twice that over all) are those of the hash, not of partitions
    place = [F.xxhash64("id", "text"), "id", "text", "lang"]
    for r in drawn.select("lang", "text", "id").sort(*place).limit(2 * docs * len(sizes)).collect():
        t = r[1].encode()
        if len(t) <= room[r[0]] and len(texts[r[0]]) < docs:
            texts[r[0]].append(t)
            room[r[0]] -= len(t)
        elif len(t) > most_bytes and r[0] not in cut:
            cut[r[0]] = t[:most_bytes]
    for lang, ts in texts.items():
        if not ts and lang in cut:
            ts.append(cut[lang])
    return Model(texts, order)


def _predicted(m: Model, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    data, offsets = byte_view(texts)
    letters = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
    if not m.langs:
        return ["und"] * len(letters), np.zeros(len(letters)), np.zeros(len(letters))
    bits = m.lengths(data, offsets)
    least = bits.min(1)
    score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
    langs = [m.langs[k] if ok else "und" for k, ok in zip(bits.argmin(1), letters, strict=True)]
    return langs, np.where(letters, score, 0.0), least / np.maximum(np.diff(offsets), 1)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # (order + 1) strings of TRAIN_BYTES bytes a language at most, mostly a few MB

    def run(batches):
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                langs, score, bits = _predicted(shared.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "lang_pred", "score", "bits_per_byte"])
        release()

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return texts_of(cols).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def recognised(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose predicted language is one that was learned."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for part in slices(b, text_col, 1 << 20):
                langs, _, _ = _predicted(shared.value, part.column(text_col))
                yield part.filter(pa.array([x != "und" for x in langs], pa.bool_()))
        release()

    return texts_of(df).mapInArrow(run, df.schema)


def identify_held_out(df: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32 of the id is not 1 modulo 3, and predicts all."""
    model = train(df.where(crc_mod("doc_id", 3) != 1))
    found = identify(df, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
