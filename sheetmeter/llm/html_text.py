"""HTML extraction by tree scoring.

The page becomes a tree. Boilerplate elements go by their tag or role. They go by a class or id word, too, unless another
one names content or the element holds most of the page's text outside links (beside an article or main element that has text of its own it
goes all the same). A header that names an article's or stands in an article is none, and a word that is bad in part only, such as social-history, marks
no element with sentences outside links. Every paragraph-like block
passes points for its length and its commas to its ancestors, the nearest most, and a container's points are discounted by
the share of its text that stands in links. The best container is kept, or the outermost article or main element around it, then
each parent whose other children are no boilerplate, and of the next parent the children that are none: neither
marked nor, as blocks or runs of loose text, mostly links. Their text is the result: character references decoded run by run, white space inside a
block turned into one space, blocks joined in page order by one space.

Null or empty html, and pages without text outside elements that go by tag or role, give empty text. Broken markup (tags left open, cut tags or references) is
read as far as it goes; very long pages are read whole and in linear time. Repeated rows are extracted one by one; an empty table gives an
empty table. Of containers with equal points the first one is the best. Only
the id, url and html columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas".split())
DROPPED = RAW | frozenset("head title nav footer aside form button select option textarea label fieldset dialog menu audio video".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body html figcaption h1 h2 h3 h4 h5 h6".split())
#: Of these the points go to their parent.
LEAVES = frozenset("p pre blockquote td li dd figcaption h1 h2 h3 h4 h5 h6".split())
#: Class words that tell what stands beside, or does not.
BESIDE = re.compile(r"(?:has|no|with|without|not)[_-]", re.I)
#: What a start tag closes implicitly, and the elements beyond which it does not look.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|masthead|sidebars?|side|widget\w*|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|foot|header|topbar|comments?|commentlist|disqus\w*|replies|respond|cookies?|consent|notices?|gdpr|popup|modal|overlay|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|skip|tags|toolbar|copyright|legal|disclaimer|hidden)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog|hentry)(?:$|[\s_-])", re.I)
#: What a bad word may stand beside in one class name and still be a mark; and the words that name an article.
CHROME = frozenset("area articles bar block body box btn button buttons col column container content counter data desktop entries fixed form full grid group heading holder icon icons image img inline inner item items label large layer layout left line link links list main media mobile module number outer page pane panel posts product products reading region right row section site slot small sticky stories teaser teasers text title toggle top bottom unit widget wrap wrapper".split())
ARTICLE = frozenset("article entry post story hentry".split())
_SPLIT = re.compile(r"[\s_-]+")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "up", "kids", "bad", "weak", "good", "doubt", "within", "chars", "links", "commas", "points")

    def __init__(self, tag: str, up: Node | None, attrs: str = ""):
        self.tag, self.up, self.kids = tag, up, []
        self.chars = self.links = self.commas = 0
        self.points, self.bad, self.weak, self.good, self.doubt = 0.0, tag in DROPPED, False, False, False
        self.within = up is not None and (up.within or up.tag in ("article", "main"))
        if attrs:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            words = f"{found.get('class', '')} {found.get('id', '')}"
            self.good = bool(GOOD.search(words))
            self.bad |= found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found
            marks = [w for w in words.split() if BAD.search(w)] if tag not in ("html", "body", "article", "main") else []
            parts = [p for p in ({x for x in _SPLIT.split(w.lower()) if x} for w in marks if not BESIDE.match(w)) if not ("header" in p and (self.within or p & ARTICLE))]
            self.weak = bool(parts) and not any(GOOD.search(w) for w in words.split() if w not in marks)
            self.doubt = all(any(not BAD.search(x) and not x.isdigit() and x not in CHROME and x not in ARTICLE for x in p) for p in parts)
        if tag == "header" and not self.within:
            self.bad = True

    def prose(self) -> bool:
        """Whether there are sentences, mostly outside links."""
        return 3 * self.links <= self.chars and (self.commas > 0 or self.chars >= 80)


def parse(html: str) -> Node:
    root = node = Node("html", None)
    at, end = 0, len(html)
    # how many elements of a name are open, so that no search for one walks up in vain
    count: dict[str, int] = {"html": 1}

    def leave(to: Node) -> Node:
        """Closes all elements below `to`, which becomes the open one."""
        x = node
        while x is not to:
            count[x.tag] -= 1
            x = x.up
        return to

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            node.kids.append(html[at:])
            break
        if m.start() > at:
            node.kids.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            if count.get(tag):
                up = node
                while up.tag != tag:
                    up = up.up
                if up.up is not None:
                    node = leave(up.up)
            continue
        if tag in ("html", "body") and node.up is None and tag == "html":
            continue
        if (tag in ENDS_P or tag == "p") and count.get("p"):
            up = node
            while up is not None and up.tag not in ("p", "td", "li", "div", "article", "section", "main", "body", "html", "blockquote", "button"):
                up = up.up
            if up is not None and up.tag == "p":
                node = leave(up.up)
        if tag in CLOSES and any(count.get(x) for x in CLOSES[tag][0]):
            shut, bound = CLOSES[tag]
            up, to, left = node, None, sum(count.get(x, 0) for x in shut)
            while left and up.tag not in bound:  # past the last open one there is nothing to close
                if up.tag in shut:
                    to, left = up.up, left - 1
                up = up.up
            node = leave(to) if to is not None else node
        child = Node(tag, node, m[3] or m[6] or "")
        node.kids.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            node = child
            count[tag] = count.get(tag, 0) + 1
    return root


def _order(root: Node) -> list[Node]:
    """All nodes outside dropped ones, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.bad]
    return out


def _measure(nodes: list[Node]) -> dict[int, int]:
    """Counts characters, commas and characters in links of all nodes; gives the characters outside inner blocks by id()."""
    own: dict[int, int] = {}
    for node in reversed(nodes):
        direct = node.chars = node.links = node.commas = 0
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip())
                node.chars += n
                direct += n
                node.commas += k.count(",")
            elif not k.bad:
                node.chars += k.chars
                node.links += k.links
                node.commas += k.commas
                if k.tag not in BLOCKS:
                    direct += own.get(id(k), 0)
        own[id(node)] = direct
        if node.tag == "a":
            node.links = node.chars
    return own


def _drop_marked(nodes: list[Node]) -> bool:
    """Marks the boilerplate by class and id words as bad; whether any is."""
    plain = lambda x: x.chars - x.links
    body: dict[int, int] = {}  # text within article and main elements, by id()
    for node in reversed(nodes):
        body[id(node)] = plain(node) if node.tag in ("article", "main") else sum(body[id(k)] for k in node.kids if not isinstance(k, str) and not k.bad)
    weak = [node for node in nodes if node.weak]
    for node in weak:
        most = 2 * plain(node) > plain(nodes[0])
        node.bad = not (node.doubt and node.prose()) and (not most or body[id(nodes[0])] > body[id(node)] and not node.within)
    return any(node.bad for node in weak)


def _kept(best: Node) -> list:
    """What is kept around the best container."""
    up = best
    while up is not None:
        best, up = up if up.tag in ("article", "main") else best, up.up
    while best.up is not None:
        runs: list[list] = [[]]  # blocks one by one, loose text and inline elements together
        for k in best.up.kids:
            if isinstance(k, str) or k.tag not in BLOCKS and k is not best and not k.bad:
                runs[-1].append(k)
            else:
                runs += [[k], []]
        fine, whole = [], True
        for run in runs:
            chars = sum(len(k.strip()) if isinstance(k, str) else k.chars for k in run)
            links = sum(k.links for k in run if not isinstance(k, str))
            bad = any(not isinstance(k, str) and k.bad for k in run)
            if best in run or not bad and 2 * links <= chars:
                fine += run
            elif chars and not bad or bad and run[0].tag not in RAW and run[0].tag not in ("head", "title"):
                whole = False
        if not whole:
            return fine
        best = best.up
    return [best]


def extract(html: str | None) -> str:
    if not html:
        return ""
    nodes = _order(parse(html))
    own = _measure(nodes)
    if _drop_marked(nodes):
        nodes = _order(nodes[0])
        own = _measure(nodes)
    for node in nodes:
        if node.tag in PARAGRAPHS and own[id(node)]:
            text = own[id(node)]
            share = 1 - node.links / max(1, node.chars)
            points = ((1.0 if text >= 25 else text / 25) + node.commas * text / max(1, node.chars) + min(3.0, text / 100)) * share
            up, level = node.up if node.tag in LEAVES else node, 0
            while up is not None and level < 6:
                up.points += points / (1, 2, 6, 9, 12, 15)[level]
                up, level = up.up, level + 1
    best, most = None, 0.0
    for node in nodes:
        if node.tag in BLOCKS and node.chars:
            node.points *= 1 - node.links / node.chars
            if node.points > 0:
                node.points += 25 * (node.tag in ("article", "main")) + 10 * node.good
            if node.points > most:
                best, most = node, node.points
    parts: list[str] = []
    todo: list = (_kept(best) if best else [nodes[0]])[::-1]  # a page of links only stays whole
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(unescape(x))
        elif x.tag in BLOCKS:
            parts.append("\n")
            todo.append("\n")
            todo += [k for k in reversed(x.kids) if isinstance(k, str) or not k.bad]
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, str) or not k.bad]
    return " ".join("".join(parts).split())


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
