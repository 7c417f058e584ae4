"""Secret scans: sliding-window Shannon entropy per character class over candidate strings.

Three base patterns (assignments, access keys, hex runs) are joined by spans that the entropy method adds.
A candidate is a maximal run of key characters; a window slides over it, its entropy kept by
incremental counts, and every window whose entropy reaches the threshold of the window's class marks its characters. The class
is hex or the mix of lower case, upper case and digits; a window that holds one of + / _ = - has to hold all three, as paths,
slugs and dates do not, and a hex one needs a digit and a letter. An allow list drops marked runs that look random but are no secrets. What is left is
extended over its candidate, up to an = that a value follows, so that no part of a key stays.

Null text counts as empty; empty text has no span; very long texts are scanned whole, in linear time;
repeated rows are scanned one by one; an empty table gives an empty table. Spans of equal start stand in the order of their kinds. Only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
VALUE = re.compile(r"=(?=[^=])")
KINDS = ("assign", "access", "hex", "entropy")

#: Window length, and bits of entropy from which a window of each class counts (the most for 20 characters is 4.32; hex has 16 letters).
#: Of random windows 97 % reach 3.5 with lower case and digits, 95 % with upper case and digits; of letters 38 % of one case reach 3.75, 72 % of both 3.9
#: (of 40 random letters some window: 84 % and 99 %): lower ones would mark long words.
WINDOW = 20
THRESHOLDS = {"hex": 3.1, "alnum": 3.75, "base64": 3.75, "lower+digit": 3.5, "upper+digit": 3.5, "letters": 3.9, "one case": 3.75}

#: Marked runs, as they are or with the pieces they cut, that are dropped: UUIDs, numbers alone, documented examples (the word within a piece, not a piece of its own).
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]+(?:[-_/=+][0-9]*)*"),
    re.compile(r".*(?:[A-Za-z0-9](?:EXAMPLE|example|placeholder)|(?:EXAMPLE|example|placeholder)[A-Za-z0-9]|xxxxxxxx|XXXXXXXX).*"),
)

_HEX, _LETTERS = set("0123456789abcdefABCDEF"), set("+/_=-")
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, 1025)]


def entropy_runs(s: str, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Maximal runs of s that are covered by windows of high entropy for their class, by incremental counts."""
    thresholds = THRESHOLDS | (thresholds or {})
    n = len(s)
    if n < window:
        return []
    counts: dict[str, int] = {}
    total, other, marks, digits, uppers, lowers, runs = 0.0, 0, 0, 0, 0, 0, []

    def turn(ch: str, by: int) -> None:
        nonlocal total, other, marks, digits, uppers, lowers
        c = counts.get(ch, 0)
        total += _CLOG[c + by] - _CLOG[c]
        counts[ch] = c + by
        other += by * (ch not in _HEX)
        marks += by * (ch in _LETTERS)
        digits += by * ch.isdigit()
        uppers += by * ch.isupper()
        lowers += by * ch.islower()

    base = math.log2(window)
    for i, ch in enumerate(s):
        turn(ch, 1)
        if i >= window:
            turn(s[i - window], -1)
        if i >= window - 1:
            if not other:
                kind, fair = "hex", bool(digits) and bool(uppers or lowers)
            elif marks or digits and uppers and lowers:
                kind, fair = "base64" if marks else "alnum", digits > 0 and uppers > 0 and lowers > 0
            elif digits:
                kind, fair = "lower+digit" if lowers else "upper+digit", True
            else:
                kind, fair = "letters" if uppers and lowers else "one case", True
            if fair and base - total / window >= thresholds[kind]:
                start = i - window + 1
                if runs and start <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + 1)
                else:
                    runs.append((start, i + 1))
    return runs


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the three base patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if low and ("password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def added_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        s, at = m[0], 0
        for a, b in entropy_runs(s, window, thresholds):
            left, right = a, b  # to the ends of the pieces that the run cuts
            while left and s[left - 1] not in _LETTERS:
                left -= 1
            while right < len(s) and s[right] not in _LETTERS:
                right += 1
            if a < at or any(x.fullmatch(s, a, b) or x.fullmatch(s, left, right) for x in ALLOW):
                continue
            cut = VALUE.search(s, b - 1)
            first, at = max((x.end() for x in VALUE.finditer(s, at, a)), default=at), cut.start() if cut else len(s)
            found.append((m.start() + first, 3, m.start() + at))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row with the counts of base spans, their digest, and all spans."""

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(t := t or "")
                kinds = [k for _, k, _ in base]
                rows.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added_spans(t, window))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts_of(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span, overlaps united, replaced by the mark."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in sorted(base_spans(text) + added_spans(text)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of df, with secrets in text_col replaced and length_col counted anew."""

    names, at = df.columns, df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [redact(t) for t in b.column(at).to_pylist()]
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            if length_col in names:
                k = names.index(length_col)
                old = arrays[k].to_pylist()
                arrays[k] = pa.array([o if t is None else len(t) for t, o in zip(texts, old, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)
        release()

    return texts_of(df).mapInArrow(run, df.schema)
