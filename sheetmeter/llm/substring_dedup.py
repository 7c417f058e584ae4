"""Suffix-array dedup: every byte inside a LENGTH-byte string that also starts elsewhere is removed.

Winnowing picks, in each LENGTH-byte string, the GRAM-byte string of the smallest hash; equal strings pick the same. So
only places that share an anchor can share a LENGTH-byte string, and a place's fragment (all LENGTH-byte strings that hold
its anchor) is all that has to be compared. Fragments that are equal, by 128 bits of two hashes, are counted first: two or more are
covered whole, and one of them stands for all. The different fragments of an anchor meet in one collection with those
of other anchors. There the bytes of an anchor are written as a number, one symbol or two, since each LENGTH-byte string of a fragment holds
its anchor whole: a string is LENGTH - GRAM bytes and this number long. The suffixes of the collection are sorted, and its Burrows-Wheeler transform
is extended backward, breadth first: level l of the search marks the borders between suffixes whose common prefix is l symbols long, and the search
stops at that length, so what is left between two marks are the occurrences of one LENGTH-byte string. It starts at level
START with all strings of so many symbols, whose borders the sort has already shown; the sort itself goes on to the length, as the transform of
suffixes that are sorted less far does not map back to itself. An anchor with more than MANY different fragments, which one collection
should not hold, is replaced by two longer ones, one grown to the right and one to the left, such that each LENGTH-byte string around it holds
one of them; their shorter fragments are counted and compared in the same way, at most until an anchor is LENGTH bytes long.

Null text is empty. Texts are taken whole, as UTF-8 bytes, very long ones cut by cut; a text shorter than LENGTH keeps all. Matches never cross
documents. Rows with equal id and text are one document: they do not repeat each other, and each is returned. Rows with equal id and
different texts, and rows without an id, are documents of their own. An empty table gives an empty table. There are no ties: every
place of a repeated string is removed. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, byte_view, materialise, mix, release, remove_table, semi_join, slices

LENGTH, GRAM, START, MANY = 400, 272, 32, 2048
#: Bytes of fragments from which a collection is closed; with one anchor more it stays under 2^_BITS symbols.
COLLECTION, _BITS = 500_000, 21
#: Bytes of texts that are hashed at once.
CUT = 1 << 20
_rng = np.random.Generator(np.random.PCG64(17))
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of the data, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * _powers(_STEP, n)[:n], out=self.sums[1:])
        self.back = _powers(_BACK, n)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each w neighbours, by running values inside blocks."""
    n = len(x)
    y = np.full(-(-n // w) * w, fill, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    head = op.accumulate(y, axis=1).ravel()
    tail = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, first: int = 0, last: int | None = None):
    """Positions of the anchors of all strings that begin in [first, last), the hashes of anchors and fragments, and their texts."""
    none = np.zeros(0, np.int64)
    w = length - gram + 1
    if len(data) < length or not (np.diff(offsets) >= length).any():
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    g = h.of(at, at + gram) | np.uint64(1)
    least = _sliding(g, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    limit = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = at[: len(least)]
    least = np.where((at + length <= limit) & (at >= first) & (at < (len(data) if last is None else last)), least, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    p = np.flatnonzero(_sliding(padded, w, np.maximum, np.uint64(0))[: len(g)] == g)
    doc = np.searchsorted(offsets, p, side="right") - 1
    lo, hi = np.maximum(offsets[doc], p - (length - gram)), np.minimum(offsets[doc + 1], p + length)
    return p, g[p], fragment_hash(h, p, lo, hi), doc


def fragment_hash(h: Hashes, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix(h.of(lo, hi) + (p - lo).astype(np.uint64) * np.uint64(4096) + (hi - lo).astype(np.uint64))


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, cut: int = CUT):
    """anchors() without a text that is longer than `cut` in memory at once: yields positions in the data, hashes and texts."""
    if len(data) <= cut or len(offsets) > 2:
        yield anchors(data, offsets, length, gram)
        return
    done = -1
    for a in range(0, len(data), cut):
        lo = max(0, a - length)
        part = data[lo : a + cut + 2 * length]
        p, g, f, doc = anchors(part, np.array([0, len(part)]), length, gram, a - lo, a - lo + cut)
        new = p + lo > done  # an anchor of strings on both sides of a cut is found twice
        if new.any():
            yield p[new] + lo, g[new], f[new], doc[new]
            done = int(p[-1]) + lo


ROWS = "anchor long, fragment long, id long, h long, pos int, n int, many long"


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for part in slices(b, "text", CUT):
                data, offsets = byte_view(part.column("text"))
                for p, g, f, doc in anchors_of(data, offsets, length, gram):
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(f.view(np.int64)), part.column("id").take(at), part.column("h").take(at), pa.array(p - offsets[doc], pa.int32()), pa.array(np.diff(offsets)[doc], pa.int32()), pa.array(np.ones(len(p), np.int64))], ["anchor", "fragment", "id", "h", "pos", "n", "many"])
        release()

    return docs.select("id", "h", "text").mapInArrow(run, ROWS)


def sorted_rotations(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotations of s sorted by their first `depth` symbols at least, and the class of each in sorted order by the first START."""
    n = len(s)
    wrapped = np.concatenate([s, s[: 8]])if n >= 8 else np.resize(s, n + 8)
    key = np.zeros(n, np.uint64)
    for j in range(4):  # symbols are below 2^9
        key = (key << np.uint64(9)) | wrapped[j : j + n].astype(np.uint64)
    h, start = 4, None
    while True:
        if n <= 1 << _BITS:  # key and place in one number: sorting numbers is several times faster than sorting places
            key = (key << np.uint64(_BITS)) | np.arange(n, dtype=np.uint64)
            key.sort()
            order, k = (key & np.uint64((1 << _BITS) - 1)).astype(np.int64), key >> np.uint64(_BITS)
        else:
            order = np.argsort(key)  # equal keys in any order: only their classes are used
            k = key[order]
        rank_at = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = rank_at
        if h == START:
            start = rank.copy()
        if h >= depth:
            return order, start[order]
        key = (rank * n + np.roll(rank, -h)).astype(np.uint64)  # below n squared
        h *= 2


def marked_borders(s: np.ndarray, order: np.ndarray, first: np.ndarray, length: int, ends: np.ndarray) -> np.ndarray:
    """mark[i]: a border between different strings of `length` symbols lies before the sorted rotation i, or none of it fits there.

    Breadth-first backward extension over the Burrows-Wheeler transform, from level START on. ends[i] is where the fragment of
    rotation i ends: only strings inside a fragment are extended, for no other string of `length` symbols is of use.
    """
    n = len(s)
    bwt = s[order - 1]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    mark = np.zeros(n + 1, bool)
    mark[0] = mark[n] = True
    mark[1:n] = first[1:] != first[:-1]
    edges = np.flatnonzero(mark).astype(np.int32)
    lb, rb = edges[:-1], edges[1:]
    inside = (order + START <= ends)[lb]
    lb, rb = lb[inside], rb[inside]
    for _ in range(START, length):
        if not len(lb):
            break
        # one symbol precedes the whole interval if it stands at both ends and the mapping keeps the width
        l1, last = lf[lb], lf[rb - 1]
        c = bwt[lb]
        plain = (bwt[rb - 1] == c) & (last - l1 == rb - 1 - lb)
        mixed = np.flatnonzero(~plain)
        plain &= c != 0
        l1, r1 = l1[plain], last[plain] + 1
        if len(mixed):
            lm, size = lb[mixed], (rb - lb)[mixed].astype(np.int64)
            owner = np.repeat(np.arange(len(lm)), size)
            where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lm, size)
            to, c = lf[where], bwt[where]
            inner = c != 0
            group, to = (owner * 512 + c)[inner], to[inner]
            ordered = np.argsort(group)
            group, to = group[ordered], to[ordered]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            if len(heads):  # within a group the targets are consecutive
                l2 = np.minimum.reduceat(to, heads)
                l1, r1 = np.concatenate([l1, l2]), np.concatenate([r1, l2 + np.diff(np.append(heads, len(group))).astype(np.int32)])
        new = ~mark[r1]  # intervals of a level are disjoint, so no border comes twice
        lb, rb = l1[new], r1[new]
        mark[rb] = True
    return mark


def symbols(fragments: list[bytes], at: np.ndarray, core: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The fragments as symbols below 2^9, where each begins and how many it has, and how many stand for its anchor, `least` or more.

    A byte is one symbol from 1 to 256, 0 follows each fragment. The `core` bytes of the anchor, from at[i] on, are a number written in symbols
    from 257 on, the same for equal bytes only. Strings that hold an anchor whole are equal if and only if their symbols are.
    """
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(f[a : a + core], len(number)) for f, a in zip(fragments, at.tolist(), strict=True)], np.int64)
    digits = 1
    while 255**digits < len(number):
        digits += 1
    wide = max(digits, least)
    size = np.array([len(f) for f in fragments], np.int64) - core + wide
    begin = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()), np.uint16)
    inner = np.ones(len(s), bool)
    inner[begin + size] = False
    anchor = (begin + at)[:, None] + np.arange(wide)
    inner[anchor] = False
    s[inner] = np.frombuffer(b"".join([f[:a] + f[a + core :] for f, a in zip(fragments, at.tolist(), strict=True)]), np.uint8).astype(np.uint16) + 1
    s[anchor] = 257 + (ids[:, None] // 255 ** np.arange(digits) % 255)[:, np.arange(wide) % digits]
    return s, begin, size, wide


def repeats(fragments: list[bytes], docs: np.ndarray, los: np.ndarray, at: np.ndarray, length: int, core: int) -> list[tuple[int, int, int]]:
    """(document, begin, end) of all stretches of the fragments that are covered by repeated strings.

    fragments: bytes of document docs[i] from los[i] on, with an anchor of `core` bytes at[i] bytes further, which each string of `length` bytes in them holds.
    """
    s, begin, size, wide = symbols(fragments, at, core, START - (length - core))
    span = length - core + wide  # a string of `length` bytes, in symbols: START or more
    depth = START
    while depth < span + 1:
        depth *= 2
    order, first = sorted_rotations(s, depth)
    owner = np.repeat(np.arange(len(size)), size + 1)[order]
    ends = (begin + size)[owner]
    mark = marked_borders(s, order, first, span, ends)
    fits = order + span <= ends
    run = (np.cumsum(mark[:-1]) - 1)[fits]
    owner = owner[fits]
    pos = los[owner] + order[fits] - begin[owner]  # it begins before the anchor or with it, where symbols are bytes
    doc = docs[owner]
    several = np.bincount(run)[run] > 1
    run, doc, pos = run[several], doc[several], pos[several]
    # the same place may stand in several fragments
    o = np.lexsort((pos, doc, run))
    run, doc, pos = run[o], doc[o], pos[o]
    if not len(run):
        return []
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
    run, doc, pos = run[new], doc[new], pos[new]
    many = np.bincount(run)[run] > 1
    doc, pos = doc[many], pos[many]
    o = np.lexsort((pos, doc))
    doc, pos = doc[o], pos[o]
    if not len(doc):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + length)]))
    ends = np.concatenate([cut[1:], [len(doc)]]) - 1
    return list(zip(doc[cut].tolist(), pos[cut].tolist(), (pos[ends] + length).tolist(), strict=True))


def _texts_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: anchor, id, h, pos, many. The texts of these documents with the list of what is wanted of each."""
    lists = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "pos", "many")).alias("of"))  # a list is a few times as long as its text
    return semi_join(docs, wanted.select("id", "h").distinct(), ["id", "h"]).join(lists, ["id", "h"]).select("id", "h", "text", "of")


def _fragments(docs: DataFrame, wanted: DataFrame, length: int, core: int) -> DataFrame:
    """The bytes of the fragments around anchors of `core` bytes."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text, of = b.column(2)[i].as_buffer(), b.column(3)[i].values
                raw, pos = text.to_pybytes() if text else b"", of.field("pos").to_numpy()
                lo = np.maximum(0, pos - (length - core))
                n = len(pos)
                yield pa.RecordBatch.from_arrays([of.field("anchor"), pa.array(np.full(n, b.column(0)[i].as_py())), pa.array(np.full(n, b.column(1)[i].as_py())), pa.array(lo, pa.int32()), pa.array(pos - lo, pa.int32()), pa.array([raw[x : y + length] for x, y in zip(lo.tolist(), pos.tolist(), strict=True)], pa.binary())], ["anchor", "id", "h", "lo", "at", "bytes"])

    return _texts_with(docs, wanted).mapInArrow(run, "anchor long, id long, h long, lo int, at int, bytes binary")


def _refined(docs: DataFrame, wanted: DataFrame, length: int, core: int) -> tuple[DataFrame, int]:
    """Rows like those of _anchor_rows() for two longer anchors in place of each, and their length. A string of `length` bytes that
    begins i bytes before an anchor holds the one grown to the right if i <= slack - step, the one grown to the left if i >= step."""
    step = (length - core + 1) // 2
    slack = length - core - step

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text, of = b.column(2)[i].as_buffer(), b.column(3)[i].values
                data = np.frombuffer(text or b"", np.uint8)
                h = Hashes(data)
                old, pos, many = (of.field(c).to_numpy() for c in ("anchor", "pos", "many"))
                for side in (0, 1):
                    p = pos.astype(np.int64) - side * step
                    fits = (p >= 0) & (p + core + step <= len(data))
                    p, was, m = p[fits], old[fits], many[fits]
                    g = mix(h.of(p, p + core + step) + mix(was.view(np.uint64) + np.uint64(side)))  # one place has a grown anchor once
                    f = fragment_hash(h, p, np.maximum(0, p - slack), np.minimum(len(data), p + length))
                    k = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.full(k, b.column(0)[i].as_py())), pa.array(np.full(k, b.column(1)[i].as_py())), pa.array(p, pa.int32()), pa.array(np.full(k, len(data)), pa.int32()), pa.array(m, pa.int64())], ["anchor", "fragment", "id", "h", "pos", "n", "many"])

    return _texts_with(docs, wanted).mapInArrow(run, ROWS), core + step


SPANS = "id long, h long, a int, b int"


def _by_transform(fragments: DataFrame, length: int, core: int, rows: int) -> DataFrame:
    """rows: the number of fragments. Their bytes set the number of tasks, as they are work, not size: a few MB keep a core busy for seconds."""

    def run(batches):
        held: list = []
        size = 0

        def settled():
            docs = list(dict.fromkeys((h[1], h[2]) for h in held))
            number = {d: i for i, d in enumerate(docs)}
            found = repeats([h[5] for h in held], np.array([number[h[1], h[2]] for h in held], np.int64), *(np.array([h[k] for h in held], np.int64) for k in (3, 4)), length, core)
            cols = [[docs[d][0] for d, _, _ in found], [docs[d][1] for d, _, _ in found], [a for _, a, _ in found], [z for _, _, z in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "h", "a", "b"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if size > COLLECTION and row[0] != held[-1][0]:
                    yield settled()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield settled()
        held = []
        release()

    tasks = 1 + rows * 2 * length // (8 * COLLECTION)
    return fragments.repartition(tasks, "anchor").sortWithinPartitions("anchor").select("anchor", "id", "h", "lo", "at", "bytes").mapInArrow(run, SPANS)


def _united(spans: DataFrame) -> DataFrame:
    """Spans of one document that follow each other in a task and overlap become one, which saves most of what is shuffled next."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            i, h, a, z = (b.column(k).to_numpy() for k in range(4))
            order = np.lexsort((a, h, i))
            i, h, a, z = i[order], h[order], a[order].astype(np.int64), z[order].astype(np.int64)
            doc = np.cumsum(np.concatenate([[0], (i[1:] != i[:-1]) | (h[1:] != h[:-1])]))
            far = np.maximum.accumulate(z + doc * (1 << 33)) - doc * (1 << 33)  # the farthest end so far in this document
            cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(i[cut]), pa.array(h[cut]), pa.array(a[cut], pa.int32()), pa.array(far[np.append(cut[1:], len(a)) - 1], pa.int32())], ["id", "h", "a", "b"])

    return spans.select("id", "h", "a", "b").mapInArrow(run, SPANS)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the key id, h, which is equal for rows of equal id and text only (as far as 64 bits tell texts of one id apart)."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, h (see _keyed) and spans (begin, end in bytes, some overlapping) of every document with a repeated string."""
    docs = _keyed(df, id_col, text_col).where("text is not null")
    twins = docs.groupBy("id", "h").count().where("count > 1").select("id", "h")
    once = docs
    if twins.head(1):
        twins = materialise(twins)
        once = docs.join(twins, ["id", "h"], "left_anti").unionByName(semi_join(docs, twins, ["id", "h"]).dropDuplicates(["id", "h"]))
    rows, core, found = materialise(_anchor_rows(once, length, gram)), gram, []
    while True:
        lo, hi = F.greatest(F.lit(0), F.col("pos") - (length - core)).alias("a"), F.least(F.col("n"), F.col("pos") + length).alias("b")
        # (first of all columns is of one row, as they are taken together)
        kinds = materialise(rows.groupBy("anchor", "fragment").agg(F.sum("many").alias("many"), *[F.first(c).alias(c) for c in ("id", "h", "pos", "n")]))
        found.append(materialise(_united(semi_join(rows, kinds.where("many > 1").select("anchor", "fragment"), ["anchor", "fragment"]).select("id", "h", lo, hi))))
        remove_table(rows)
        several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("many").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds")
        wanted = materialise(semi_join(kinds, several.select("anchor"), "anchor").join(several, "anchor").select("anchor", "id", "h", "pos", "many", "kinds"))
        remove_table(kinds)
        few = wanted.where(f"kinds <= {MANY}")
        found.append(materialise(_by_transform(_fragments(docs, few, length, core), length, core, few.count())))
        large = wanted.where(f"kinds > {MANY}")
        if core >= length or not large.head(1):
            remove_table(wanted)
            break
        rows, core = _refined(docs, large, length, core)
        rows = materialise(rows)
        remove_table(wanted)
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    out = materialise(spans.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    for x in found:
        remove_table(x)
    return out


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row."""
    docs = _keyed(df, id_col, text_col)
    spans = repeated_spans(df, id_col, text_col, length)
    ids = spans.select("id", "h")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # texts without a span are not shuffled
        ids = F.broadcast(ids)
        rest = docs.join(ids, ["id", "h"], "left_anti").withColumn("spans", F.lit(None).cast("array<struct<a: int, b: int>>"))
        both = docs.join(ids, ["id", "h"], "left_semi").join(spans, ["id", "h"]).unionByName(rest)
    else:
        both = docs.join(spans, ["id", "h"], "left")

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = (text or "").encode()
                runs: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in found or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([*x])
                kept, at = hashlib.sha256(), 0
                for a, z in runs:
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                rows.append((doc, len(raw), sum(z - a for a, z in runs), len(runs), kept.hexdigest(), [{"a": a, "b": z} for a, z in runs]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a: bigint, b: bigint>>")
