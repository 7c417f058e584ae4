"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct word shingles. K minimum hashes of BITS bits form its signature. Two documents may be linked
if at most T of the K values differ. The values are split into M chunks; T = 2 M - 1 errors leave, by the pigeonhole
principle, a chunk with at most one error, and enumerating which value of a chunk is passed over makes the two
documents equal in one key. So the join on the keys meets every pair within T; at a similarity of just 0.8 one pair in about
10,000 lies beyond T, fewer above it. Every link is confirmed on the full sets.

Documents with equal sets are one class, joined to its smallest id before anything is compared. Within a key only
neighbours by set size are compared first; what they link is united; then all rows of a key that are in different
components are compared, in place: a pair is passed on only if its signatures are within T and its sets' bitmaps allow the similarity (the
bits that only one of two sets has count elements that the other lacks, so no link is lost). Runs of a key with over RUN rows are dealt over
tasks, the rows of the largest component against the groups of all others and these against each other, so that a group of
thousands of near copies neither meets in one task nor gives all its pairs.

Null and empty texts, and texts of white space, have no shingles and link with nothing. A text with fewer words than a shingle
has one shingle, the whole sequence. Texts are taken whole, very long ones cut at white space while they are hashed. A document that occurs in
several rows is returned as often; rows of one id with different texts are linked by what each holds, and rows without an id link with nothing.
An empty table gives an empty table. Ties: the smallest id stands for a component. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_view, materialise, mix, release, remove_table, semi_join, slices, texts_of
from .components import components

CHUNKS, CHUNK, BITS = 14, 5, 16
K, T = CHUNKS * CHUNK, 2 * CHUNKS - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 3) ^ np.uint64(4)
_TURN = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows of a key that are compared with each other as one group; a longer run is split. Bytes of text hashed at once; of sets held in a block.
RUN, CUT, BLOCK = 4096, 1 << 20, 16 << 20
#: Bits of the bitmap of a set: 16 times its size or more, within these bounds.
LEAST_BITS, MOST_BITS = 256, 4096


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = _STEP
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, cut: int = CUT) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case) of all texts, and where each text's words begin."""
    if len(data) <= cut or len(offsets) > 2:
        return _word_hashes(data, offsets)
    parts, at = [], 0
    while at < len(data):  # one long text, cut behind white space
        to = at + cut
        while to < len(data) and not _SPACE[data[to - 1]]:
            more = np.flatnonzero(_SPACE[data[to : to + cut]])
            to = to + int(more[0]) + 1 if len(more) else to + cut
        parts.append(_word_hashes(data[at:to], np.array([0, len(data[at:to])]))[0])
        at = to
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inner = ~_SPACE[data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    cuts = offsets[:-1][(np.diff(offsets) > 0)]
    begins[cuts] = inner[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | begins[1:]
    size = np.flatnonzero(ends) - starts + 1
    # the polynomial over a word's letters, highest power first: one term at a time for all words that long
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    power = _powers(int(size.max()))
    at = np.minimum(at, len(power) - 1)
    term = np.where(inner, _LETTER[data] * power[at], np.uint64(0))
    h = mix(np.add.reduceat(term, starts) + size.astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = word_hashes(data, offsets)
    if len(h) >= words:
        s = h[: len(h) - words + 1].copy()
        for j in range(1, words):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - words + 1 + j])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for v in h[a:b]:
                x = mix((x * np.uint64(0x9E3779B97F4A7C15) + v + np.uint64(1)).reshape(1))[0] if isinstance(x, np.ndarray) else mix(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v + np.uint64(1))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """K values of BITS bits: middle bits of the minimum of each multiplicative hash."""
    least = np.full(K, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 4096):
        least = np.minimum(least, (s[a : a + 4096, None] * _TURN[None, :]).min(axis=0))
    return (mix(least) >> np.uint64(24)).astype(np.uint16)


def bitmap(s: np.ndarray) -> bytes:
    """The set's bits; that of a narrower map are those of a wider one folded upon itself."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, maps: list[bytes], similarity: int) -> np.ndarray:
    """Whether the bitmaps of the rows x[i] and y[i] allow their sets the similarity."""
    size = np.array([len(m) for m in maps])
    width = np.minimum(size[x], size[y])
    only = np.zeros((2, len(x)), np.int64)
    for w in np.unique(width).tolist():
        these = np.flatnonzero(width == w)
        rows = np.unique(np.concatenate([x[these], y[these]]))
        folded = np.zeros((len(rows), w // 8), np.uint64)
        for k in np.unique(size[rows]).tolist():
            of = np.flatnonzero(size[rows] == k)
            raw = np.frombuffer(b"".join([maps[i] for i in rows[of].tolist()]), np.uint64).reshape(len(of), k // w, w // 8)
            folded[of] = np.bitwise_or.reduce(raw, axis=1)
        for at in range(0, len(these), 65536):
            part = these[at : at + 65536]
            p, q = folded[np.searchsorted(rows, x[part])], folded[np.searchsorted(rows, y[part])]
            only[0, part] = np.bitwise_count(p & ~q).sum(1)
            only[1, part] = np.bitwise_count(q & ~p).sum(1)
    common = np.minimum(n[x] - only[0], n[y] - only[1])
    return (100 + similarity) * common >= similarity * (n[x] + n[y])


def signatures(df: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), two hashes of the set, its signature and its bitmap."""

    def run(batches):
        for b in batches:
            for part in slices(b, "text", CUT):
                sets = shingle_sets(*byte_view(part.column(1)), words)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                h2 = np.array([int(s.sum()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                bits = [bitmap(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "h1", "h2", "sig", "bits"])
        release()

    return texts_of(df).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary, bits binary")


def _keys(classes: DataFrame) -> DataFrame:
    """The K keys of each class: chunk and value passed over, with the other values of the chunk."""
    salt = mix(np.arange(1, K + 1, dtype=np.uint64))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            out = np.empty((len(sig), K), np.uint64)
            for c in range(CHUNKS):
                for p in range(CHUNK):
                    key = np.zeros(len(sig), np.uint64)
                    for j in range(CHUNK):
                        if j != p:
                            key = (key << np.uint64(16)) | sig[:, c, j]
                    out[:, c * CHUNK + p] = mix(key ^ salt[c * CHUNK + p])
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), K)), pa.array(np.repeat(b.column(1).to_numpy(), K)), pa.array(np.tile(np.arange(K, dtype=np.int32), len(sig)))], ["key", "rep", "n", "slot"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "key long, rep long, n long, slot int")


def _within(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most T values."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, K) for k in (2, 3))
                keep = (x != y).sum(1) <= T
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    s = classes.select("rep", "sig")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int, blocks: int) -> DataFrame:
    """The pairs whose full sets reach the similarity (in hundredths). A set is sent once to each pair of blocks that needs it."""
    block = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(blocks))
    p = pairs.withColumn("g", F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b")))
    need = p.select(F.explode(F.array("a", "b")).alias("rep"), F.col("g").alias("h")).distinct().join(sets, "rep")

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int((y[at] == x).sum())
        return 100 * common >= similarity * (len(x) + len(y) - common)

    def run(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        of: dict = {}
        for r, x in zip(s["rep"], s["items"], strict=True):
            of.setdefault(r, []).append(np.frombuffer(x, np.uint64))
        keep = [any(similar(x, y) for x in of[a] for y in of[b] if len(x) and len(y)) for a, b in zip(p["a"], p["b"], strict=True)]
        out = p.loc[keep, ["a", "b"]]
        del of, s
        release()
        return out

    return p.groupBy("g").cogroup(need.groupBy("h")).applyInPandas(run, "a long, b long")


def _sets(df: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for part in slices(b, "text", CUT):
                sets = shingle_sets(*byte_view(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "items"])
        release()

    return texts_of(df).mapInArrow(run, "rep long, items binary")


def _across(rows: DataFrame, similarity: int) -> DataFrame:
    """Pairs of rows of one run (key, task) that are in different components, may reach the similarity by size and by bitmap, and whose
    signatures differ in at most T places; each pair only in the first key that it shares. rows: key, task, slot, side, rep,
    n, label, sig, bits. Rows of one side are not compared, except those of side 0."""

    def first_slot(same: np.ndarray) -> np.ndarray:
        chunks = same.reshape(-1, CHUNKS, CHUNK)
        alike = chunks.sum(2) >= CHUNK - 1
        c = alike.argmax(1)
        own = chunks[np.arange(len(c)), c]
        return c * CHUNK + np.where(own.all(1), 0, own.argmin(1))

    def pairs(t: pa.Table):
        key, task, slot, side, rep, n, label = (t[c].to_numpy(zero_copy_only=False) for c in ("key", "task", "slot", "side", "rep", "n", "label"))
        sig, maps = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, K), t["bits"].to_pylist()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (task[1:] != task[:-1])])
        run = np.cumsum(new)
        i = np.arange(len(key))
        lag = 1
        while True:
            i = i[i + lag < len(key)]
            i = i[run[i] == run[i + lag]]
            if not len(i):
                return
            j = i + lag
            ok = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            x, y = i[ok], j[ok]
            same = sig[x] == sig[y]
            near = same.sum(1) >= K - T
            x, y, same = x[near], y[near], same[near]
            first = first_slot(same) == slot[x]
            x, y = x[first], y[first]
            if len(x):
                fits = may_reach(x, y, n, maps, similarity)
                x, y = x[fits], y[fits]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], ["a", "b"])
            lag += 1

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            key, task = held["key"].to_numpy(), held["task"].to_numpy()
            last = np.flatnonzero((key != key[-1]) | (task != task[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield from pairs(held.combine_chunks())
        held = None
        release()

    return rows.repartition("key", "task").sortWithinPartitions("key", "task", "rep").select("key", "task", "slot", "side", "rep", "n", "label", "sig", "bits").mapInArrow(run, "a long, b long")


def _dealt(at: DataFrame) -> DataFrame:
    """at: key, rep, n, slot, label. Adds task and side to the rows of keys with several labels: the groups that are compared.

    A key of up to RUN rows is one task. Of a longer one the rows of the commonest label are dealt over groups, and all others over groups; there is
    a task for each group of the former with each of the latter, and one for each two groups of the latter.
    """
    by = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("many")).where("x != y").select("key", "many")
    at = at.join(by, "key")
    most = at.where(F.col("many") > RUN).groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("top"), F.col("m.c").alias("main"))
    at = at.join(most, "key", "left")
    groups = lambda c: F.greatest(F.lit(1), F.ceil(c / RUN)).cast("int")
    of = lambda size: F.pmod(F.xxhash64("rep", F.lit("group")), size).cast("int")
    s, g = groups(F.col("main")), groups(F.col("many") - F.col("main"))
    at = at.withColumns({"s": s, "g": g, "is_main": F.col("label") == F.col("top")}).withColumn("own", F.when(F.col("is_main"), of(F.col("s"))).otherwise(of(F.col("g"))))
    each = lambda size: F.sequence(F.lit(0), size - 1)
    task = lambda number, side: F.struct(number.cast("int").alias("task"), side.cast("int").alias("side"))
    main = F.transform(each(F.col("g")), lambda j: task(F.col("own") * F.col("g") + j, F.lit(1)))
    with_main = F.transform(each(F.col("s")), lambda i: task(i * F.col("g") + F.col("own"), F.lit(2)))
    low, high = lambda k: F.least(k, F.col("own")), lambda k: F.greatest(k, F.col("own"))
    others = F.transform(each(F.col("g")), lambda k: task((F.col("s") + low(k)) * F.col("g") + high(k), F.when(k == F.col("own"), 0).when(k > F.col("own"), 3).otherwise(4)))
    tasks = F.when(F.col("top").isNull(), F.array(task(F.lit(0), F.lit(0)))).when(F.col("is_main"), main).otherwise(F.concat(with_main, others))
    return at.withColumn("t", F.explode(tasks)).select("key", "rep", "n", "slot", "label", "t.task", "t.side")


def _wanted(docs: DataFrame, pairs: DataFrame, words: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The sets of the documents in pairs, other than the known ones, and the ids of these documents."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if known is not None:
        ids = ids.join(known, "doc_id", "left_anti")
    ids = materialise(ids)
    # an id with several texts has several sets
    return materialise(_sets(semi_join(docs, ids, "doc_id"), words).withColumn("hash", F.xxhash64("items")).dropDuplicates(["rep", "hash"]).drop("hash")), ids


def _blocks(sets: DataFrame) -> int:
    """So many that a block's sets have BLOCK bytes."""
    return 1 + (sets.agg(F.sum(F.length("items"))).first()[0] or 0) // BLOCK


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included) of every row."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    sigs = materialise(signatures(docs, words))
    classes = materialise(sigs.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bits").alias("bits")))
    keys = _keys(classes)
    # a key that very many classes share is dealt over parts; which neighbours meet first changes no result
    hot = materialise(keys.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > RUN).select("key", F.ceil(F.col("many") / RUN).cast("int").alias("parts")))
    if hot.head(1):
        keys = keys.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.lit(-1)))
    else:
        keys = keys.withColumn("part", F.lit(-1))
    w = Window.partitionBy("key", "part").orderBy("n", "rep")
    rows = keys.select("key", "rep", "n", "slot", "part", F.lag("rep").over(w).alias("prev"), F.lag("n").over(w).alias("prev_n"), F.lead("rep").over(w).alias("next"))
    rows = materialise(rows.where("prev is not null or next is not null or part >= 0").drop("next", "part"))
    first = rows.where(f"prev is not null and 100 * prev_n >= {similarity} * n").select(F.least("rep", "prev").alias("a"), F.greatest("rep", "prev").alias("b")).distinct()
    first = materialise(_within(first, classes))
    sets, known = _wanted(docs, first, words, None)
    links = materialise(_confirmed(first, sets, similarity, _blocks(sets)))
    label = materialise(components(links))
    # what is still apart: all pairs of a key that are in different components
    at = rows.select("key", "rep", "n", "slot").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "slot", F.coalesce("component", "rep").alias("label"))
    at = materialise(_dealt(at))
    remove_table(rows)
    pairs = materialise(_across(at.join(classes.select("rep", "sig", "bits"), "rep"), similarity).join(first, ["a", "b"], "left_anti"))
    remove_table(at)
    if pairs.head(1):
        more, others = _wanted(docs, pairs, words, known)
        both = sets.unionByName(more)
        found = materialise(_confirmed(pairs, both, similarity, _blocks(both)))
        for x in (label, more, others):
            remove_table(x)
        label = materialise(components(links.unionByName(found)))
        remove_table(found)
    for x in (hot, first, sets, known, links, pairs):
        remove_table(x)
    member = sigs.select("doc_id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"], "left")
    member = member.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")), F.col("doc_id")).alias("component_id"))
