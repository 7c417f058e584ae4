"""Text rules of drawings as column expressions: normalising, tags and multipliers, headings, scales, bill sections."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
# Patterns and word lists that decide what is counted.
TAG = r"\A[A-Z]{1,4}-?[0-9]{0,3}[A-Z]?\z"
MULT_WORD = r"\A(\d{1,3}) ?(?:NO\.?|NR\.?|N°|X|×|OFF) ?([A-Z]{1,4}-?\d{0,3}[A-Z]?)\z"
MULT_BARE = r"\A(\d{1,3})([A-Z]{2,4}-?\d{0,3}[A-Z]?)\z"
MULT_AFTER = r"\A([A-Z]{1,4}-?\d{0,3}[A-Z]?) ?[X×] ?(\d{1,3})\z"
UNITS = ("A", "Luminaires and signs", "W", "M", "MM", "CM", "KW", "KVA", "KV", "HZ", "LM", "LX", "K", "AH", "VA", "MA", "DB", "NO", "NR", "OFF", "DP", "SP", "TP", "TPN", "SPN", "AMP", "AMPS", "DEG", "PA", "KPA", "BAR")
HEADING = r"\A(?:[A-Z&/ ]{0,24}\b)?(?:LEGEND|LEGENDS|SYMBOLS?|KEY TO SYMBOLS|SYMBOL KEY)\b[:.]?\z"
STOP_HEADING = r"\A(?:NOTES?|GENERAL NOTES|ABBREVIATIONS|DRAWING TITLE|DRAWING NO|PROJECT|SCALE|REV(?:ISION)?|STATUS|KEY PLAN|SCHEDULE)\b"
COLUMN = r"\A(?:MANUFACTURERS?'?S?\b|MANUFACTURER'S|CAT(?:ALOGUE)?\.?\s*NO|MOUNTING|HEIGHT|DESCRIPTION|SYMBOL|REMARKS?|QTY|QUANTITY|REF(?:ERENCE)?\.?\z|TYPE\z|MAKE|MODEL)"
SCALE = r"\b1\s*[:/]\s*(\d{1,4})\b"
DRAWING_NO = r"\A(?:DRAWING|DRG|DWG|SHEET)\.? ?(?:NO|NUMBER|N°|#)\.? ?[:.-]? ?(.*)\z"
TITLE = r"\A(?:DRAWING )?TITLE ?[:.-]? ?(.*)\z"
LABELS = r"\A(?:PROJECT|CLIENT|DRAWING TITLE|TITLE|DRAWING NO|DWG NO|DRG NO|SCALE|REV|REVISION|STATUS|DATE|DRAWN|CHECKED|APPROVED|SHEET)\b"
NOTES = r"\A(?:GENERAL\s+)?NOTES?\b[:.]?\z"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"
KEY_SHAPES = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36,}", r"xox[abp]-[0-9A-Za-z-]{10,}", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
#: Bill sections: code, our title, and the words in a description that put it there; the first that matches counts, else G.
SECTIONS = (
    ("A", "Luminaires and signs", "LUMINAIRE|DOWNLIGHT|LIGHT FITTING|PANEL|SPOTLIGHT|FLOODLIGHT|BATTEN|EXIT SIGN|EMERGENCY|LED|LAMP|PENDANT|STRIP LIGHT|LINEAR"),
    ("B", "Power points and switches", "SOCKET|SWITCH|OUTLET|ISOLATOR|SPUR|CONNECTION UNIT|FLOOR BOX|DATA OUTLET|USB"),
    ("C", "Fire alarm devices", "SMOKE|HEAT DETECTOR|DETECTOR|SOUNDER|BEACON|CALL POINT|BREAK GLASS|FIRE ALARM|INTERFACE|BEAM"),
    ("D", "Sprinklers and hose reels", "SPRINKLER|SPRINKLER HEAD|HOSE REEL|EXTINGUISHER|DELUGE"),
    ("E", "Air terminals", "DIFFUSER|GRILLE|LOUVRE|VAV|FCU|FAN COIL|TERMINAL|REGISTER|EXTRACT FAN|DAMPER"),
    ("F", "Sanitary ware", r"\bWC\b|BASIN|SINK|SHOWER|URINAL|CISTERN|TAP|BATH|FLOOR GULLY|DRINKING"),
)


def normalise(s) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.upper(F.trim(F.regexp_replace(s, SPACES, " ")))


def is_tag_like(s) -> Column:
    n = normalise(s)
    return n.rlike(TAG) & (F.length(n) <= 6)


def tag_candidates(n: Column) -> Column:
    """Candidate (tag, multiplier) readings of a normalised span in order of priority; the bare form never takes a unit."""
    none = F.lit(None).cast("struct<tag:string,multiplier:int>")
    read = lambda p, t, m: F.when(n.rlike(p), F.struct(F.regexp_extract(n, p, t).alias("tag"), F.regexp_extract(n, p, m).cast("int").alias("multiplier"))).otherwise(none)
    bare = F.when(F.regexp_extract(n, MULT_BARE, 2).isin(*UNITS), none).otherwise(read(MULT_BARE, 2, 1))
    exact = F.struct(n.alias("tag"), F.lit(1).alias("multiplier"))
    return F.array_compact(F.array(exact, read(MULT_WORD, 2, 1), bare, read(MULT_AFTER, 1, 2)))


def scale_of(s) -> Column:
    found = F.regexp_extract(normalise(s), SCALE, 1)
    return F.when(found != "", found.cast("int"))


def section_of(description) -> Column:
    d = F.upper(description)
    out = F.when(d.rlike(SECTIONS[0][2]), SECTIONS[0][0])
    for code, _, test in SECTIONS[1:]:
        out = out.when(d.rlike(test), code)
    return out.otherwise("G")


def section_title(code) -> Column:
    known = F.create_map(*[F.lit(x) for c, title, _ in (*SECTIONS, ("G", "Other items", "")) for x in (c, title)])
    return F.element_at(known, code)


def bill_text(description, tag) -> Column:
    return F.when(tag.isNotNull(), F.concat(description, F.lit(" (type "), tag, F.lit(")"))).otherwise(description)


def bill_basis(source, needs_review) -> Column:
    """How a count was found, and how many of its detections want a look."""
    words = {"vector": "tag printed on the drawing", "symbol": "glyph geometry matched", "vision": "seen by the model", "mixed": "several methods", "none": "not found"}
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(known, source), source), F.when(needs_review > 0, F.concat(F.lit("; check "), needs_review.cast("string"))).otherwise(""))


def is_heading(n) -> Column:
    return n.rlike(HEADING)


def is_stop_heading(n) -> Column:
    return n.rlike(STOP_HEADING)


def is_column_title(n) -> Column:
    return n.rlike(COLUMN)


def stripped(s) -> Column:
    """Without white space, the Unicode kinds included, at both ends."""
    return F.regexp_replace(s, rf"\A{SPACES}|{SPACES}\z", "")


def model_tag(s) -> Column:
    """A tag as a model wrote it, if it is one to six characters long."""
    n = normalise(s)
    return F.when(F.length(n).between(1, 6), n)


def redacted(message) -> Column:
    """An error message without the project it names, at most 300 characters."""
    return F.left(F.regexp_replace(message, r"projects/[^/\s\"']+", "projects/<redacted>"), F.lit(300))


def model_answer(response) -> Column:
    """The answer text of a model response: the parts that are no thoughts, joined; null if that is empty or nothing can be read."""
    kind = "struct<candidates: array<struct<content: struct<parts: array<struct<text: string, thought: boolean>>>>>>"
    parts = F.get(F.from_json(response, kind)["candidates"], F.lit(0))["content"]["parts"]
    said = F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False)) & p["text"].isNotNull())
    text = F.array_join(F.transform(said, lambda p: p["text"]), "")
    return F.when(F.length(text) > 0, text)


def holds_address(s) -> Column:
    return F.coalesce(F.col(s).rlike(ADDRESS), F.lit(False))


def holds_key(s) -> Column:
    return F.coalesce(F.col(s).rlike("|".join(KEY_SHAPES)), F.lit(False))


def safe_name(s) -> Column:
    return F.right(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_"), F.lit(80))


def request_key(model, payload) -> Column:
    return F.sha2(F.concat(model, payload), 256)


# ---- the same rules for one string, for the readers that go through a page span by span

_SPACES = re.compile(SPACES)


def norm(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ").upper()


def rule(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


_TAG, IS_HEADING, IS_STOP, IS_COLUMN = rule(TAG), rule(HEADING), rule(STOP_HEADING), rule(COLUMN)


def tag_like(s: str) -> bool:
    n = norm(s)
    return len(n) <= 6 and bool(_TAG.match(n))
