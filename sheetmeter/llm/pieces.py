"""SentencePiece encoding and decoding by suffix-array matching.

The words of a slice of the batch (a space mark and what follows up to the next) that were not met before are concatenated
and indexed block by block: all suffixes are ranked by 8, 16 and then 32 bytes, every piece's occurrences are the range that binary
searches over these ranks find, and the occurrences are the edges of a lattice. Sorted by where they end, the
edges are relaxed: an edge extends the encoding of the text before it if the last piece of that encoding and the edge's
piece encode to just these two, which is told by undoing their merges step by step. By the prefix property of byte-pair merging exactly one edge
holds at each position, so walking back from the end of a word gives its encoding, the same as merging pairs by score gives. Characters
outside the vocabulary become byte pieces. Runs of spaces, whose pieces merge after all others, are merged by themselves.

Null and empty texts have no pieces and decode to empty text. Texts are encoded whole; a batch is worked off in slices
of about 1 MB, and words in blocks of BLOCK bytes: a longer word runs through several blocks, so that no index grows with it.
Time grows in proportion to the text, also within one word. Equal rows get equal rows; ties do not occur, as exactly one edge holds. An empty
table gives an empty table. A literal U+2581 is read as a space, as the model does; otherwise decoding
gives the text back. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_view, release, slices, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words a task remembers before it learns them anew, several times the different words of a slice (some 57,000); bytes of words that are
#: indexed at once; bytes from which a word is relaxed edge by edge, as few words are that long; slots of the table of known pairs (a power of two).
MEMO_WORDS, BLOCK, LONG, SLOTS = 200_000, 1 << 16, 256, 1 << 19


def load(path: str = MODEL) -> list[tuple[str, float, int]]:
    """The (piece, score, type) rows of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or not m.normalizer_spec.add_dummy_prefix or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only byte-pair models with a dummy prefix and no normalisation are read")
    return [(p.piece, p.score, p.type) for p in m.pieces]


class Codec:
    def __init__(self, rows: list[tuple[str, float, int]]):
        self.rows = rows
        self.bytes_of = np.zeros(256, np.int32)
        self.score = {p: s for p, s, t in rows if t in (1, 4)}
        self.id = {p: i for i, (p, _, t) in enumerate(rows) if t in (1, 4)}
        out = []
        for i, (p, _, t) in enumerate(rows):
            if t == 6:
                self.bytes_of[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(p.replace(MARK, " ").encode() if t in (1, 4) else b" \xe2\x81\x87 " if t == 2 else b"")
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        inner = [p for p in self.id if p.strip(MARK)]
        if any(MARK in p[1:] for p in inner):
            raise ValueError("a piece holds a space mark behind its first character")
        self._merges(inner)
        single = [p for p in inner if len(p) == 1 or self.left[self.id[p]] >= 0]
        single += [MARK] if MARK in self.id else []
        self.pieces = sorted(single, key=lambda p: p.encode())
        raw = [p.encode() for p in self.pieces]
        self.width = max((len(x) for x in raw), default=1)
        if self.width > 32:
            raise ValueError("a piece is longer than 32 bytes")
        self.size = np.array([len(x) for x in raw], np.int32)
        self.ids = np.array([self.id[p] for p in self.pieces], np.int32)
        # the first and the last string that begin with a piece, as four numbers of eight bytes each; equal numbers are searched once
        ends = np.frombuffer(b"".join(x.ljust(32, c) for c in (b"\0", b"\xff") for x in raw), ">u8").astype(np.uint64)
        self.cuts, self.cut_of = np.unique(ends, return_inverse=True)
        self.known, self.holds = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.runs: dict[int, list[int]] = {}
        self.whole_of: dict[int, int] | None = None
        self._forget()

    def _merges(self, inner: list[str]) -> None:
        """The rank of each piece (better scores first), the two pieces it is merged from last, and all pairs that give a piece."""
        n = len(self.rows)
        order = sorted((i for p, i in self.id.items()), key=lambda i: (-self.rows[i][1], i))
        self.rank = np.full(n, n, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        pairs, whole = [], []
        for p in inner:
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    whole.append(self.rank[self.id[p]])
        by = np.argsort(pairs) if pairs else np.zeros(0, np.int64)
        self.pairs, self.whole = np.array(pairs, np.int64)[by], np.array(whole, np.int64)[by]
        for p in sorted(inner, key=len):  # a piece that does not encode to itself never stands in an encoding
            if len(p) > 1:
                parts = self.merged(list(p), stop=p)
                if len(parts) == 2:
                    self.left[self.id[p]], self.right[self.id[p]] = self.id[parts[0]], self.id[parts[1]]

    def _forget(self) -> None:
        """Words that were encoded before are not indexed again; the memory of them is bounded by MEMO_WORDS."""
        self.memo: dict[str, int] = {}
        self.store, self.store_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged(self, parts: list[str], stop: str | None = None) -> list[str]:
        """Merges the pair of the best score, the leftmost first, until none is left or the next merge would give `stop`."""
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None or parts[at] + parts[at + 1] == stop:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def marks(self, n: int) -> list[int]:
        """Pieces of a run of n space marks: pairs of equal score merge from the left, within the longest piece's length at a time."""
        if n not in self.runs:
            if n <= 64:
                self.runs[n] = [self.id[p] for p in self.merged([MARK] * n)]
            else:  # a filled piece never merges again, so the run repeats
                head = self.runs.get(64) or self.marks(64)
                size = len(self.rows[head[0]][0])
                rest, out = n, []
                while rest > 64:
                    out.append(head[0])
                    rest -= size
                return out + self.marks(rest)
        return self.runs[n]

    def _valid(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the two pieces of each pair encode to themselves when joined; known pairs are looked up."""
        pair = first.astype(np.int64) * len(self.rows) + second
        slot = (pair * 0x9E3779B97F4A7C1 >> 20) & (SLOTS - 1)
        out = self.holds[slot]
        new = np.flatnonzero(self.known[slot] != pair)
        if len(new):
            out[new] = self._apart(first[new], second[new])
            self.known[slot[new]], self.holds[slot[new]] = pair[new], out[new]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the later merge of the two sides, step by step: the pair stands if no pair of neighbours met on the way
        would have merged before that."""
        n = len(self.rows)
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), n + 1, np.int64)  # the rank of the earliest merge undone so far; one more if it was on the right side
        while len(todo) and len(self.pairs):
            at = np.searchsorted(self.pairs, a * n + b)
            at[at == len(self.pairs)] = 0
            clash = (self.pairs[at] == a * n + b) & (self.whole[at] < limit)
            ok[todo[clash]] = False
            # what is left of a pair is its inner sides: the right part of the first piece, the left part of the second
            ra = np.where(self.left[a] >= 0, self.rank[a], -1)
            rb = np.where(self.left[b] >= 0, self.rank[b], -1)
            go = ~clash & ((ra >= 0) | (rb >= 0))
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            # the left side is merged first among equal ranks, so the right one is undone first
            of_a = ra > rb
            limit = np.where(of_a, ra, rb + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return ok

    def _ranges(self, block: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the first n bytes of the block in the order of the 32 bytes from there on (beyond the block: 255), and for each
        piece the range of places that begin with it."""
        padded = np.concatenate([block, np.full(40, 255, np.uint8)])
        key = np.zeros(len(block) + 32, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + len(key)]
        u1, r1 = np.unique(key, return_inverse=True)
        pair = lambda r, step: (r[: len(r) - step].astype(np.uint64) << np.uint64(32)) | r[step:].astype(np.uint64)
        u2, r2 = np.unique(pair(r1, 8), return_inverse=True)
        k4 = pair(r2, 16)[:n]
        order = np.argsort(k4, kind="stable")
        u4 = k4[order]
        least, after = (np.searchsorted(u1, self.cuts, side).astype(np.uint64)[self.cut_of].reshape(2, -1, 4) for side in ("left", "right"))

        def half(string: int, k: int, upper: bool) -> np.ndarray:
            """How many of u2 stand before the numbers k and k + 1 of the first (0) or last (1) strings, or not behind them."""
            low, high = least[string, :, k], after[string, :, k]
            second = (after if upper else least)[string, :, k + 1]
            return np.searchsorted(u2, (low << np.uint64(32)) + np.where(high > low, second, np.uint64(0)), "left").astype(np.uint64)

        def bound(string: int) -> np.ndarray:
            first, last = half(string, 0, False), half(string, 0, True)
            return np.searchsorted(u4, (first << np.uint64(32)) + np.where(last > first, half(string, 2, string == 1), np.uint64(0)), "left")

        return order, bound(0), bound(1)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encodes each word with a space mark before it: piece ids, and where each word's begin."""
        texts = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        data, offsets = byte_view(texts)
        lens = np.diff(offsets)
        n = len(data) + len(lens)
        buf = np.full(n + 8, 255, np.uint8)  # a word, then a byte that no piece holds
        starts = offsets[:-1] + np.arange(len(lens))
        inside = np.ones(n, bool)
        inside[starts + lens] = False
        buf[:n][inside] = data
        text = buf.copy()
        buf[buf == 0] = 255
        last = np.full(n + 40, -2, np.int32)  # the last piece of the encoding up to here; -1 for a character outside
        back = np.zeros(n + 40, np.int8)
        last[starts] = -1
        at = 0
        while at < n:
            self._block(buf, inside, starts, lens, at, min(n, at + BLOCK), last, back)
            at += BLOCK
        # walk back from the ends of all words at once
        here, alive, found = starts + lens, np.flatnonzero(lens > 0), []
        while len(alive) > 64:
            place = here[alive]
            found.append((alive, place, last[place]))
            here[alive] = place - back[place]
            alive = alive[here[alive] > starts[alive]]
        for k in alive.tolist():  # the few long ones
            p, first, places = int(here[k]), int(starts[k]), []
            while p > first:
                places.append(p)
                p -= int(back[p])
            place = np.array(places, np.int64)
            found.append((np.full(len(place), k), place, last[place]))
        owner = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        where = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        token = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int32)
        by = np.argsort(where, kind="stable")
        owner, where, token = owner[by], where[by], token[by]
        many = np.where(token < 0, back[where] if len(where) else 0, 1).astype(np.int64)
        ids = np.repeat(token, many)
        out = np.flatnonzero(ids < 0)
        if len(out):
            nth = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
            source = np.repeat(where - back[where], many) + nth
            ids[out] = self.bytes_of[text[source[out]]]
        counts = np.bincount(owner, weights=many, minlength=len(lens)).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def _block(self, buf, inside, starts, lens, a: int, z: int, last: np.ndarray, back: np.ndarray) -> None:
        """Relaxes all edges that begin in the bytes a to z; what reaches beyond z is there when the next block begins."""
        block = buf[a : min(len(buf), z + 32)]
        order, lo, hi = self._ranges(block, z - a)
        count = hi - lo
        which = np.flatnonzero(count)
        count = count[which]
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[which], count)
        begin, piece, size = order[rank], np.repeat(self.ids[which], count), np.repeat(self.size[which], count)
        # edges for characters outside the vocabulary, which nothing merges with
        head = np.flatnonzero(inside[a:z] & ((block[: z - a] & 0xC0) != 0x80))
        width = np.ones(len(head), np.int32)
        lead = block[head]
        for bits, w in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            width[(lead >= bits) & (lead < 255)] = w
        one = np.zeros(z - a + 1, np.int32)
        one[head] = width
        covered = np.zeros(z - a, bool)
        covered[begin[size == one[begin]]] = True
        head, width = head[~covered[head]], width[~covered[head]]
        begin, piece, size = np.concatenate([begin, head]) + a, np.concatenate([piece, np.full(len(head), -1, np.int32)]), np.concatenate([size, width])
        owner = np.searchsorted(starts, begin, side="right") - 1
        long = lens[owner] > LONG
        end = begin + size
        if long.any():
            by = np.flatnonzero(long)
            self._one_by_one(*(x[by[np.argsort(end[by], kind="stable")]] for x in (begin, piece, size)), last, back)
            begin, piece, size, end, owner = (x[~long] for x in (begin, piece, size, end, owner))
        depth = end - starts[owner]
        by = np.argsort(depth.astype(np.int16), kind="stable")  # a short word's depth is below 300
        begin, piece, size, depth = begin[by], piece[by], size[by], depth[by]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for i, j in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(depth)]]).tolist(), strict=True):
            if i == j:
                continue
            s, p, w = begin[i:j], piece[i:j], size[i:j]
            before = last[s]
            ok = before >= -1
            test = np.flatnonzero(ok & (before >= 0) & (p >= 0))
            if len(test):
                ok[test] = self._valid(before[test], p[test])
            e = s[ok] + w[ok]
            last[e] = p[ok]
            back[e] = w[ok]

    def _one_by_one(self, begin, piece, size, last: np.ndarray, back: np.ndarray) -> None:
        """The same for long words, whose edges are sorted by their ends."""
        n, known = len(self.rows), {}
        for s, p, w in zip(begin.tolist(), piece.tolist(), size.tolist(), strict=True):
            before = int(last[s])
            if before < -1:
                continue
            if before >= 0 and p >= 0:
                ok = known.get(before * n + p)
                if ok is None:
                    ok = known[before * n + p] = self._pair_apart(before, p)
                if not ok:
                    continue
            last[s + w], back[s + w] = p, w

    def _pair_apart(self, a: int, b: int) -> bool:
        """_apart() for one pair."""
        n = len(self.rows)
        limit = n + 1
        if self.whole_of is None:  # most texts hold no long word
            self.whole_of = dict(zip(self.pairs.tolist(), self.whole.tolist(), strict=True))
        while True:
            whole = self.whole_of.get(a * n + b)
            if whole is not None and whole < limit:
                return False
            ra = int(self.rank[a]) if self.left[a] >= 0 else -1
            rb = int(self.rank[b]) if self.left[b] >= 0 else -1
            if ra > rb:
                limit, a = ra, int(self.right[a])
            elif rb >= 0:
                limit, b = rb + 1, int(self.left[b])
            else:
                return True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and where each text's begin."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        parts = pc.split_pattern(texts, " ")
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        names = coded.dictionary.to_pylist()
        known = np.array([self.memo.get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            more, ends = self.encode_words(coded.dictionary.take(pa.array(new)))
            known[new] = len(self.memo) + np.arange(len(new))
            self.memo.update((names[i], k) for i, k in zip(new.tolist(), known[new].tolist(), strict=True))
            self.store = np.concatenate([self.store, more])
            self.store_at = np.concatenate([self.store_at, self.store_at[-1] + ends[1:]])
        ids, at = self.store, self.store_at
        word = known[coded.indices.to_numpy()]
        size = np.diff(at)
        empty_id = self.memo.get("", -1)
        n = size[word]
        if empty_id >= 0 and (word == empty_id).any():
            return self._with_runs(word, edges, empty_id, ids, at)
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[word], n)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids[flat], ends[edges]

    def _with_runs(self, word, edges, empty_id, ids, at):
        out, ends = [], [0]
        none = word == empty_id
        mark = self.id.get(MARK, -5)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            total = 0
            if b - a == 1 and none[a]:
                ends.append(ends[-1])
                continue
            if not none[a:b].any():
                w = word[a:b]
                n = at[w + 1] - at[w]
                flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[w], n)
                out.append(ids[flat])
                total = len(flat)
            else:
                run = 0
                for w in word[a:b].tolist():
                    if w == empty_id:
                        run += 1
                        continue
                    core = ids[at[w] : at[w + 1]]
                    if run and len(core) and core[0] == mark:
                        core = np.concatenate([np.array(self.marks(run + 1), np.int32), core[1:]])
                    elif run:
                        core = np.concatenate([np.array(self.marks(run), np.int32), core])
                    out.append(core)
                    total += len(core)
                    run = 0
                if run:
                    out.append(np.array(self.marks(run), np.int32))
                    total += len(out[-1])
            ends.append(ends[-1] + total)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(ends)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the decoded texts and where each begins; the space that the mark before the first word gives is left out."""
        n = self.out_at[ids + 1] - self.out_at[ids]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.out_at[ids], n)
        data = self.out[flat]
        ends = np.concatenate([[0], np.cumsum(n)])[edges]
        lead = ends[:-1][np.diff(ends) > 0]
        lead = lead[data[lead] == 32]
        drop = np.zeros(len(data) + 1, np.int64)
        drop[lead + 1] = 1
        gone = np.cumsum(drop)
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], ends - gone[ends]


_codecs: dict[str, Codec] = {}


def encode_documents(df: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, for every row; with_text adds the decoded text."""
    with open(path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary, fixed by the model file

    def run(batches):
        if name not in _codecs:
            _codecs.clear()  # a worker holds one model at a time
            _codecs[name] = Codec(shared.value)
        codec = _codecs[name]
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                ids, edges = codec.encode(part.column(1))
                data, at = codec.decode(ids, edges)
                raw, offsets = byte_view(part.column(1))
                if len(raw) == len(data) and (raw == data).all() and (at == offsets).all():
                    same = np.ones(part.num_rows, bool)
                else:
                    same = np.array([bytes(raw[offsets[i] : offsets[i + 1]]) == bytes(data[at[i] : at[i + 1]]) for i in range(part.num_rows)])
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(edges), pa.int64()), pa.array(same)]
                names = ["doc_id", "ids", "n_tokens", "round_trip"]
                if with_text:
                    cols.append(pa.array([bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace") for i in range(part.num_rows)], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names)
            release()
        codec._forget()
        release()

    cols = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return texts_of(cols).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean" + ", text string" * with_text)
