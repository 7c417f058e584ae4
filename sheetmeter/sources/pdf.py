"""PDF drawings: a decoder for text spans and painted paths, and a writer for simple pages, with the standard library only.

Read are classic and compressed object tables (objects are found by scanning, so damaged cross-references do no harm), Flate streams with
PNG predictors, inherited page attributes, page rotation, graphics state, form objects, all path construction and painting operators,
and text in simple fonts with /Widths or standard metrics. Not read are encrypted files, other filters, images and composite
fonts' own code maps (their text is read through /ToUnicode where there is one). Coordinates are points from the top left, y downwards.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

# Advance widths of the two standard faces in thousandths, from the space (32) to the tilde (126).
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
HELVETICA_BOLD = [278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584]
# Straight pieces that a cubic and a quadratic curve are cut into.
CUBIC_STEPS, QUADRATIC_STEPS = 6, 4

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def compose(first: Matrix, then: Matrix) -> Matrix:
    """The matrix that applies `first` and then `then`."""
    a, b, c, d, e, f = first
    p, q, r, s, t, u = then
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def mapped(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def scale_of(m: Matrix) -> float:
    return math.sqrt(abs(m[0] * m[3] - m[1] * m[2])) or 1.0


def bounds(subpaths: list[dict]) -> tuple[float, float, float, float]:
    """x, y, w, h of all points; zeros if there are none."""
    points = [p for s in subpaths for p in s["points"]]
    if not points:
        return 0.0, 0.0, 0.0, 0.0
    x, y = min(p["x"] for p in points), min(p["y"] for p in points)
    return x, y, max(p["x"] for p in points) - x, max(p["y"] for p in points) - y


class Outline:
    """A path under construction: subpaths of points that are mapped to the page as they come."""

    def __init__(self) -> None:
        self.subpaths: list[dict] = []
        self.at = self.start = (0.0, 0.0)

    def move(self, x: float, y: float, m: Matrix) -> None:
        self.at = self.start = (x, y)
        self.subpaths.append({"points": [], "closed": False, "curves": 0})
        self._add(x, y, m)

    def _add(self, x: float, y: float, m: Matrix) -> None:
        if not self.subpaths:
            self.subpaths.append({"points": [], "closed": False, "curves": 0})
        px, py = mapped(m, x, y)
        self.subpaths[-1]["points"].append({"x": px, "y": py})

    def line(self, x: float, y: float, m: Matrix) -> None:
        self._add(x, y, m)
        self.at = (x, y)

    def curve(self, control: list[float], m: Matrix) -> None:
        """A Bezier curve from here through its control points, by de Casteljau's construction at even steps."""
        points = [self.at, *zip(control[::2], control[1::2], strict=True)]
        steps = CUBIC_STEPS if len(points) == 4 else QUADRATIC_STEPS
        for k in range(1, steps + 1):
            t, level = k / steps, points
            while len(level) > 1:
                level = [(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t) for a, b in zip(level, level[1:], strict=False)]
            self._add(*(points[-1] if k == steps else level[0]), m)
        self.subpaths[-1]["curves"] += 1
        self.at = points[-1]

    def close(self) -> None:
        if self.subpaths:
            self.subpaths[-1]["closed"] = True
        self.at = self.start


# ---- objects

class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes


_SPACE = b"\x00\t\n\x0c\r "
_ENDS = _SPACE + b"()<>[]{}/%"
_REF = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])")
_PLAIN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")


class Lexer:
    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 37:  # a comment
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next object or operator (operators are bytes); None at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        c = data[at : at + 1]
        if c == b"/":
            m = _PLAIN.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[0] if m else b"").decode("latin-1"))
        if data.startswith(b"<<", at):
            self.at += 2
            out: dict = {}
            while True:
                key = self.next()
                if key is None or key == b">>":
                    return out
                out[str(key)] = self.next()
        if data.startswith(b">>", at):
            self.at += 2
            return b">>"
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytearray(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        if c == b"(":
            return self._string()
        if c == b"[":
            self.at += 1
            items: list = []
            while True:
                x = self.next()
                if x is None or x == b"]":
                    return items
                items.append(x)
        if c in (b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return c
        m = _PLAIN.match(data, at)
        self.at = m.end()
        word = m[0]
        if word[:1] in b"+-.0123456789":
            try:
                number = float(word)
            except ValueError:
                return word
            if self.refs and word.isdigit() and (r := _REF.match(data, self.at)):
                self.at = r.end()
                return Ref(int(word))
            return int(number) if number.is_integer() and b"." not in word else number
        return {b"true": True, b"false": False}.get(word, word)

    def _string(self) -> bytearray:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at]
            if c == 92:
                at += 1
                e = data[at : at + 1]
                if e in b"01234567" and e:
                    m = re.compile(rb"[0-7]{1,3}").match(data, at)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                if e == b"\r" and data[at + 1 : at + 2] == b"\n":
                    at += 1
                elif e not in (b"\r", b"\n"):
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
            elif c == 40:
                depth += 1
                out.append(c)
            elif c == 41:
                depth -= 1
                if not depth:
                    at += 1
                    break
                out.append(c)
            else:
                out.append(c)
            at += 1
        self.at = at
        return out


def _unpredicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 10:
        return data
    wide = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    row = (parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) + 7) // 8
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        how, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            a, b, c = (line[i - wide] if i >= wide else 0), above[i], (above[i - wide] if i >= wide else 0)
            if how == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[how] if how < 4 else 0
            line[i] = (line[i] + guess) & 255
        out += line
        above = line
    return bytes(out)


class Document:
    """The objects of a file; the last of a number stands."""

    def __init__(self, data: bytes):
        if b"/Encrypt" in data[-2048:]:
            raise ValueError("encrypted files are not read")
        self.objects: dict[int, object] = {}
        at = 0
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            if m.start() < at:
                continue  # inside a stream
            lexer = Lexer(data, m.end())
            x = lexer.next()
            lexer.skip()
            if isinstance(x, dict) and data.startswith(b"stream", lexer.at):
                begin = lexer.at + 6
                begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
                size = x.get("Length")
                end = begin + size if isinstance(size, int) and data[begin + size : begin + size + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", begin)
                end = len(data) if end < 0 else end
                x, at = Stream(x, data[begin:end]), end
            self.objects[int(m[1])] = x
        for x in list(self.objects.values()):
            if isinstance(x, Stream) and x.info.get("Type") == "ObjStm":
                raw = self.content(x)
                head = Lexer(raw)
                for number, where in [(head.next(), head.next()) for _ in range(self.of(x.info["N"]))]:
                    self.objects.setdefault(number, Lexer(raw, self.of(x.info["First"]) + where).next())
        if not self.objects:
            raise ValueError("not a PDF file")

    def of(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return x

    def content(self, stream: Stream) -> bytes:
        data = stream.raw
        filters, parms = self.of(stream.info.get("Filter")) or [], self.of(stream.info.get("DecodeParms")) or {}
        filters, parms = (filters if isinstance(filters, list) else [filters]), (parms if isinstance(parms, list) else [parms])
        for k, name in enumerate(filters):
            if self.of(name) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name} is not read")
            data = zlib.decompressobj().decompress(data)
            data = _unpredicted(data, (self.of(parms[k]) or {}) if k < len(parms) else {})
        return data

    def pages(self) -> list[dict]:
        """The page dictionaries in order, with what they inherit."""
        root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("the file has no catalogue")
        out: list[dict] = []
        todo, seen = [(self.of(root.get("Pages")), {})], 0
        while todo and seen < 1_000_000:
            node, given = todo.pop()
            seen += 1
            if not isinstance(node, dict):
                continue
            own = given | {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "CropBox", "Rotate")}
            if "Kids" in node:
                todo += [(self.of(k), own) for k in reversed(self.of(node["Kids"]))]
            else:
                out.append(node | own)
        return out


# ---- pages

@dataclass
class State:
    ctm: Matrix
    line_width: float = 1.0
    font: dict | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


@dataclass
class Page:
    number: int
    width: float
    height: float
    spans: list[dict] = field(default_factory=list)
    paths: list[dict] = field(default_factory=list)


def viewport(box: list[float], turn: int) -> tuple[Matrix, float, float]:
    """The matrix from page space to points from the top left, and the width and height seen."""
    x1, y1, x2, y2 = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
    turn %= 360
    if turn == 90:
        return (0.0, 1.0, 1.0, 0.0, -y1, -x1), y2 - y1, x2 - x1
    if turn == 180:
        return (-1.0, 0.0, 0.0, 1.0, x2, -y1), x2 - x1, y2 - y1
    if turn == 270:
        return (0.0, -1.0, -1.0, 0.0, y2, x2), y2 - y1, x2 - x1
    return (1.0, 0.0, 0.0, -1.0, -x1, y2), x2 - x1, y2 - y1


def to_page_space(m: Matrix, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    """A viewport box in page space: corners mapped back and put in order."""
    det = m[0] * m[3] - m[1] * m[2]
    back = lambda u, v: ((m[3] * (u - m[4]) - m[2] * (v - m[5])) / det, (m[0] * (v - m[5]) - m[1] * (u - m[4])) / det)
    (ax, ay), (bx, by) = back(x, y), back(x + w, y + h)
    return min(ax, bx), min(ay, by), abs(ax - bx), abs(ay - by)


class Fonts:
    """Decodes and measures the strings of a page's fonts."""

    def __init__(self, doc: Document):
        self.doc, self.known = doc, {}

    def of(self, font) -> dict:
        key = font.number if isinstance(font, Ref) else id(font)
        if key not in self.known:
            self.known[key] = self._read(self.doc.of(font) or {})
        return self.known[key]

    def _read(self, font: dict) -> dict:
        base = str(font.get("BaseFont", ""))
        out = {"bytes": 1, "map": {}, "widths": {}, "missing": None, "standard": HELVETICA_BOLD if "Bold" in base else HELVETICA}
        if font.get("Subtype") == "Type0":
            inner = self.doc.of((self.doc.of(font.get("DescendantFonts")) or [{}])[0]) or {}
            out |= {"bytes": 2, "missing": self.doc.of(inner.get("DW")) or 1000}
            w = self.doc.of(inner.get("W")) or []
            k = 0
            while k + 1 < len(w):
                if isinstance(w[k + 1], list):
                    out["widths"] |= {w[k] + i: x for i, x in enumerate(w[k + 1])}
                    k += 2
                else:
                    out["widths"] |= dict.fromkeys(range(w[k], w[k + 1] + 1), w[k + 2] if k + 2 < len(w) else 1000)
                    k += 3
        elif widths := self.doc.of(font.get("Widths")):
            first = self.doc.of(font.get("FirstChar")) or 0
            out["widths"] = {first + i: self.doc.of(x) for i, x in enumerate(widths)}
            out["missing"] = (self.doc.of(font.get("FontDescriptor")) or {}).get("MissingWidth", 0)
        codes = self.doc.of(font.get("ToUnicode"))
        if isinstance(codes, Stream):
            self._to_unicode(self.doc.content(codes), out["map"])
        return out

    @staticmethod
    def _to_unicode(data: bytes, into: dict) -> None:
        text = lambda x: bytes(x).decode("utf-16-be", "replace")
        lexer, held = Lexer(data, refs=False), []
        while (x := lexer.next()) is not None:
            if x == b"endbfchar":
                into |= {int.from_bytes(a, "big"): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
            elif x == b"endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(lo, min(hi, lo + 65535) + 1):
                        into[k] = text(c[k - lo]) if isinstance(c, list) else text(c)[:-1] + chr(ord(text(c)[-1:] or "\0") + k - lo)
            if isinstance(x, bytearray | list):
                held.append(x)
            elif isinstance(x, bytes):
                held = []

    @staticmethod
    def codes(font: dict, raw: bytes) -> list[int]:
        n = font["bytes"]
        return [int.from_bytes(raw[i : i + n], "big") for i in range(0, len(raw), n)]

    @staticmethod
    def width(font: dict, code: int) -> float:
        if code in font["widths"]:
            return font["widths"][code]
        if font["missing"] is not None:
            return font["missing"]
        return font["standard"][code - 32] if 32 <= code < 127 else 556

    @staticmethod
    def text(font: dict, code: int) -> str:
        if code in font["map"]:
            return font["map"][code]
        return bytes([code]).decode("cp1252", "replace") if code < 256 else ""


_FILLS = {b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"}
_STROKES = {b"S", b"s", b"B", b"B*", b"b", b"b*"}
_CLOSES = {b"s", b"b", b"b*"}


class Interpreter:
    """Runs a page's content and collects spans and painted paths."""

    def __init__(self, doc: Document, page: Page, text: bool = True, paths: bool = True):
        self.doc, self.page, self.fonts = doc, page, Fonts(doc)
        self.wants_text, self.wants_paths = text, paths

    def run(self, data: bytes, resources: dict, state: State, depth: int = 0) -> None:
        lexer, args, stack, shape = Lexer(data, refs=False), [], [], Outline()
        tm = line = IDENTITY
        base = state.ctm if depth == 0 else None  # noqa: F841
        while (x := lexer.next()) is not None:
            if not isinstance(x, bytes):
                args.append(x)
                continue
            try:
                if x == b"q":
                    stack.append(State(**vars(state)))
                elif x == b"Q":
                    state = stack.pop() if stack else state
                elif x == b"cm":
                    state.ctm = compose(tuple(args[-6:]), state.ctm)
                elif x == b"w":
                    state.line_width = float(args[-1])
                elif x == b"m":
                    shape.move(*args[-2:], state.ctm)
                elif x == b"l":
                    shape.line(*args[-2:], state.ctm)
                elif x == b"c":
                    shape.curve(args[-6:], state.ctm)
                elif x == b"v":
                    shape.curve([*shape.at, *args[-4:]], state.ctm)
                elif x == b"y":
                    shape.curve([*args[-4:], *args[-2:]], state.ctm)
                elif x == b"h":
                    shape.close()
                elif x == b"re":
                    a, b, w, h = args[-4:]
                    shape.move(a, b, state.ctm)
                    for px, py in ((a + w, b), (a + w, b + h), (a, b + h)):
                        shape.line(px, py, state.ctm)
                    shape.close()
                elif x in _FILLS or x in _STROKES or x == b"n":
                    if x in _CLOSES:
                        shape.close()
                    self._paint(shape, x in _FILLS, x in _STROKES, state)
                    shape = Outline()
                elif x == b"BT":
                    tm = line = IDENTITY
                elif x == b"Tf":
                    fonts = self.doc.of(resources.get("Font")) or {}
                    state.font, state.size = self.fonts.of(fonts.get(args[-2])), float(args[-1])
                elif x in (b"Td", b"TD"):
                    if x == b"TD":
                        state.leading = -args[-1]
                    tm = line = compose((1, 0, 0, 1, *args[-2:]), line)
                elif x == b"Tm":
                    tm = line = tuple(float(v) for v in args[-6:])
                elif x == b"T*":
                    tm = line = compose((1, 0, 0, 1, 0, -state.leading), line)
                elif x in (b"Tc", b"Tw", b"Tz", b"TL", b"Ts"):
                    name = {b"Tc": "char_space", b"Tw": "word_space", b"Tz": "stretch", b"TL": "leading", b"Ts": "rise"}[x]
                    setattr(state, name, args[-1] / 100 if x == b"Tz" else args[-1])
                elif x in (b"Tj", b"TJ", b"'", b'"'):
                    if x in (b"'", b'"'):
                        if x == b'"':
                            state.word_space, state.char_space = args[-3], args[-2]
                        tm = line = compose((1, 0, 0, 1, 0, -state.leading), line)
                    tm = self._show(args[-1] if isinstance(args[-1], list) else [args[-1]], tm, state)
                elif x == b"Do":
                    self._form(args[-1], resources, state, depth)
                elif x == b"BI":  # an inline image: its bytes are no operators
                    end = re.compile(rb"\sEI(?=[\s])").search(data, lexer.at)
                    lexer.at = end.end() if end else len(data)
            except (TypeError, ValueError, IndexError, ZeroDivisionError):
                pass  # an operator with wrong operands is passed over, as viewers do
            args = []

    def _paint(self, shape: Outline, fill: bool, stroke: bool, state: State) -> None:
        subpaths = [s for s in shape.subpaths if s["points"]]
        if not (fill or stroke) or not subpaths or not self.wants_paths:
            return
        x, y, w, h = bounds(subpaths)
        self.page.paths.append({"index": len(self.page.paths), "subpaths": subpaths, "x": x, "y": y, "w": w, "h": h, "fill": fill, "stroke": stroke, "line_width": state.line_width * scale_of(state.ctm)})

    def _show(self, parts: list, tm: Matrix, state: State) -> Matrix:
        font, text, begin, advance = state.font, [], tm, 0.0
        if font is None:
            return tm
        for part in parts:
            if not isinstance(part, bytearray):
                advance -= part / 1000 * state.size * state.stretch
                if part < -200 and text and text[-1] != " ":
                    text.append(" ")
                continue
            for code in Fonts.codes(font, bytes(part)):
                text.append(Fonts.text(font, code))
                space = state.word_space if code == 32 and font["bytes"] == 1 else 0.0
                advance += (Fonts.width(font, code) / 1000 * state.size + state.char_space + space) * state.stretch
        string = "".join(text)
        if self.wants_text and string.strip():
            m = compose((1, 0, 0, 1, 0, state.rise), compose(begin, state.ctm))
            # both corners of the run are mapped: its width along the baseline, its size above it
            (ax, ay), (bx, by) = mapped(m, 0, 0), mapped(m, advance, state.size)
            size = state.size * math.hypot(m[0], m[1])
            self.page.spans.append({"seq": len(self.page.spans), "str": string, "x": min(ax, bx), "y": min(ay, by), "w": abs(bx - ax), "h": abs(by - ay), "font_size": size})
        return compose((1, 0, 0, 1, advance, 0), tm)

    def _form(self, name, resources: dict, state: State, depth: int) -> None:
        form = self.doc.of((self.doc.of(resources.get("XObject")) or {}).get(name))
        if depth < 12 and isinstance(form, Stream) and form.info.get("Subtype") == "Form":
            inner = State(**vars(state))
            if matrix := self.doc.of(form.info.get("Matrix")):
                inner.ctm = compose(tuple(self.doc.of(v) for v in matrix), inner.ctm)
            self.run(self.doc.content(form), self.doc.of(form.info.get("Resources")) or resources, inner, depth + 1)


def decode(data: bytes, pages: list[int] | None = None, text: bool = True, paths: bool = True) -> list[Page]:
    """All pages of a file (or those of the given numbers, from 1) with their spans and painted paths."""
    doc, out = Document(data), []
    for number, info in enumerate(doc.pages(), 1):
        if pages is not None and number not in pages:
            continue
        box = [float(doc.of(v)) for v in doc.of(info.get("CropBox")) or doc.of(info.get("MediaBox")) or [0, 0, 612, 792]]
        ctm, width, height = viewport(box, int(doc.of(info.get("Rotate")) or 0))
        page = Page(number, width, height)
        parts = doc.of(info.get("Contents"))
        streams = [doc.of(p) for p in (parts if isinstance(parts, list) else [parts])]
        raw = b"\n".join(doc.content(s) for s in streams if isinstance(s, Stream))
        Interpreter(doc, page, text, paths).run(raw, doc.of(info.get("Resources")) or {}, State(ctm))
        out.append(page)
    return out


# ---- writing

def escaped(text: str) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252", "replace"))


def write(pages: list[tuple[float, float, bytes]]) -> bytes:
    """A file of pages (width, height, content); contents may use the fonts /F1 (regular) and /F2 (bold)."""
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n)))]
    objects += [b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /BaseFont /%s >>" % f for f in (b"Helvetica", b"Helvetica-Bold")]
    for i, (w, h, content) in enumerate(pages):
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (w, h, 6 + 2 * i))
        packed = zlib.compress(content)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
    out, at = bytearray(b"%PDF-1.7\n"), []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    where = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n%s" % (len(objects) + 1, b"".join(b"%010d 00000 n \n" % a for a in at))
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, where))
