"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score positive and tags negative, with weights learned
from labelled pages by where tokens stand: in a page's content element or outside it. A linear scan finds the
contiguous region with the highest sum; its words, but for those of boilerplate elements inside it, are the text.
A page with content elements has two such regions, one of the words in them and one of the words outside; the
learned weights say which of them it is, since such elements may hold mere teasers. A page without any, as with these tags renamed, has the one.

What is boilerplate inside a region is told by HTML's own elements and by a fixed list of names, since labelled pages show
few of them. A name counts only if all of its parts are on that list or say nothing: "search-box" does, "search-engines" doesn't.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexflow.llm.common import arrow_map, text_slices

#: Labelled pages that weights are learned from, at most.
SAMPLE_ROWS = 1000
#: Least cost of a tag.
LEAST = 0.01
#: A tag may hold < and > in quotes, but what begins like another tag ends a quote that isn't closed.
QUOTED = r"\"(?:[^\"<]|<(?![a-z/!?]))*+\"|'(?:[^'<]|<(?![a-z/!?]))*+'"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[a-z/!?](?:[^<>\"']|(?<==)(?:{QUOTED})|(?<==\s)(?:{QUOTED}))*+>|<[a-z/!?][^<>]*>?|[^<]+|<", re.I | re.S)
#: Elements whose contents are no text of the page: those that can't hold their like, and those that can or that end with their parent.
RAW, NESTING = {"script", "style", "noscript", "iframe", "textarea", "title"}, {"template", "svg", "select", "object"}
ANY_TAG = re.compile(r"<[a-z/!?]", re.I)
NAME = re.compile(r"</?\s*([a-z][a-z0-9-]*)", re.I)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CONTENT = {"article", "main"}
BOILERPLATE = {"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
#: Parts of class names, ids and roles of boilerplate elements.
MARKED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "header", "masthead", "footer", "contentinfo",
    "sidebar", "complementary", "aside", "widget", "related", "recommended", "share", "sharing", "social",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "dialog", "newsletter", "subscribe", "signup", "login", "search", "form",
    "comment", "comments", "reply", "replies", "respond", "disqus",
}
#: Parts of such names that say nothing.
NEUTRAL = {
    "site", "page", "main", "top", "bottom", "left", "right", "inner", "outer", "area", "bar", "panel", "box", "block", "list", "item", "items", "section",
    "wrapper", "wrap", "container", "content", "contents", "group", "column", "col", "row", "slot", "unit", "zone", "text", "body", "link", "links", "button",
    "buttons", "btn", "icon", "icons", "overlay", "message", "thread", "tree", "trail", "count", "title", "label", "primary", "secondary", "global", "user", "users",
    "reader", "readers", "mobile", "sticky", "fixed", "floating", "large", "small", "big", "media", "this", "google", "post", "posts", "article", "articles", "entry", "story", "stories",
}
#: Parts that say that a name only mentions boilerplate, and first parts of names of an article's own parts.
NEGATING, OWN = {"has", "no", "not", "with", "without", "is", "hide", "show", "free", "open", "closed"}, {"article", "entry", "post", "content", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose end tag may be left out: the start tags that end them. The end tag of a block around them does so too.
BLOCKS = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
ROWS = {"tr", "tbody", "thead", "tfoot"}
ENDED_BY = {"p": BLOCKS | {"li", "dt", "dd", "td", "th"} | ROWS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"} | ROWS, "th": {"td", "th"} | ROWS, "tr": ROWS, "tbody": ROWS - {"tr"}, "thead": ROWS - {"tr"}, "tfoot": ROWS - {"tr"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}}
AROUND = BLOCKS - {"p", "hr"} | {"li", "dt", "dd", "td", "th", "body", "html", "datalist", "optgroup"} | ROWS
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}


def is_marked(tag: str) -> bool:
    """Whether a start tag's classes, id or role name boilerplate: all parts of one of the names are listed or say nothing, and one is listed."""
    for m in MARKS.finditer(tag):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in PART.findall(name)]
            own = parts and parts[0] in OWN and parts[-1] == "header"
            if MARKED & {*parts} and MARKED | NEUTRAL >= {*parts} and not own:
                return True
    return False


class Raw:
    """Ends of the elements of a page whose contents are no text."""

    def __init__(self, page: str):
        self.page, self.ends, self.none = page, {}, {}

    def end(self, tag: str, raw: str, begin: int, after: int) -> int:
        """Where the element ends whose start tag stands at [begin, after); one without contents ends there.

        One without an end tag ends at the next tag, whatever that is. A self-closed one has contents only if
        an end tag comes before the next start tag of its kind, and never if it may hold its like.
        """
        if tag in NESTING:
            if raw.endswith("/>"):
                return after
            if tag not in self.ends:
                self.ends[tag] = self.pairs(tag, begin)
            found = self.ends[tag].get(begin)
        else:
            found = None
            if after < self.none.get(tag, len(self.page)):
                m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(self.page, after)
                if not m:
                    self.none[tag] = after
                elif raw.endswith("/>") and re.compile(rf"<{tag}(?=[\s/>])", re.I).search(self.page, after, m.start()):
                    return after
                else:
                    found = m.end()
            if found is None and raw.endswith("/>"):
                return after
        if found is None:
            m = ANY_TAG.search(self.page, after)
            found = m.start() if m else len(self.page)
        return found

    def pairs(self, tag: str, begin: int) -> dict[int, int]:
        """Where elements end, by where they begin."""
        out, open_ = {}, []
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.I).finditer(self.page, begin):
            if not m[1]:
                if not m[0].endswith("/>"):
                    open_.append(m.start())
            elif open_:
                out[open_.pop()] = m.end()
        return out


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(tag name or "" for text, text, inside a content element, kept) of every token in page order.

    Text inside boilerplate elements and whatever is no text is not kept. A boilerplate element that
    isn't closed ends where a content element begins or ends, and where its end tag may be left out, there.
    """
    out: list[tuple[str, str, bool, bool]] = []
    depth, skip, nested, at = 0, "", 0, 0
    within: list[str] = []  # the open elements from a skipped one on whose end tag may be left out
    hidden = Raw(page)
    while m := TOKEN.match(page, at):
        raw, at = m[0], m.end()
        named = NAME.match(raw) if raw[0] == "<" else None
        if not named:
            if raw[0] != "<" or raw == "<":
                out.append(("", raw, depth > 0, not skip))
            continue
        tag, closing = named[1].lower(), raw[1] == "/"
        if not closing and (tag in RAW or tag in NESTING):
            at = hidden.end(tag, raw, m.start(), at)
            continue
        if tag in CONTENT and not (skip and tag == skip):
            if closing or not is_marked(raw):
                skip, nested = "", 0
                depth = max(0, depth - 1) if closing else depth + 1
                out.append((tag, "", depth > 0, True))
                continue
        single = tag in VOID or raw.endswith("/>")
        if skip in ENDED_BY:
            if not closing:
                while (i := next((i for i in reversed(range(len(within))) if within[i] not in INLINE), -1)) >= 0 and tag in ENDED_BY.get(within[i], ()):
                    del within[i:]
                if within and not single:
                    within.append(tag)
            elif tag in within:
                while within.pop() != tag:
                    pass
                if not within:  # its own end tag
                    skip = ""
                    out.append((tag, "", depth > 0, True))
                    continue
            elif tag in AROUND:
                within = []
            if not within:
                skip = ""
        elif skip:
            if tag == skip and not single:
                nested += -1 if closing else 1
                if not nested:
                    skip = ""
            out.append((tag, "", depth > 0, not skip))
            continue
        if not skip and not closing and not single:
            if tag in BOILERPLATE or tag not in ("html", "body") and is_marked(raw):
                skip, nested, within = tag, 1, [tag]
        out.append((tag, "", depth > 0, not skip))
    return out


def count(page: str, seen: Counter) -> None:
    """Add what is kept of a page to the numbers of tags, and of words under "", inside and outside content elements."""
    for tag, text, inside, kept in tokens(page):
        if kept:
            seen[tag, inside] += 1 if tag else len(text.split())


def learn(seen: Counter) -> dict[str, float]:
    """Costs of tags from pages that mark their content: the log-odds of standing outside; under "" what it adds to a region to lie in a content element, the log-odds of a word standing in one."""
    cost = lambda no, yes: min(8.0, max(LEAST, math.log((no + 0.5) / (yes + 0.5))))
    return {t: cost(seen[t, not t], seen[t, bool(t)]) for t in {"", *(t for t, _ in seen)}}


def region(worth: list[float]) -> tuple[float, int, int]:
    """The highest sum of a contiguous part, and where the part begins and ends; of equal ones the first."""
    total = best = 0.0
    start = lo = hi = 0
    for i, w in enumerate(worth):
        total += w
        if total > best:
            best, lo, hi = total, start, i + 1
        elif total < 0:
            total, start = 0.0, i + 1
    return best, lo, hi


def extract(page: str | None, costs: dict[str, float]) -> str:
    """The main text of a page, its blocks joined by line breaks; empty if there is none.

    Words and learned costs of tags score the best region of any one content element and the best region outside of them.
    If the former and what lying in an element adds reach the latter, the region is the best that words in any content elements make.
    Tags that no labelled page shows cost 1, in content elements next to nothing.
    """
    parts = tokens(page) if page else []
    words = [0 if tag or not kept else len(text.split()) for tag, text, _, kept in parts]
    cost = [-costs.get(tag, LEAST if inside else 1.0) if tag else 0.0 for tag, _, inside, _ in parts]
    score, lo, hi = region([c - n if inside else c + n for (_, _, inside, _), n, c in zip(parts, words, cost, strict=True)])
    if any(n and inside for (_, _, inside, _), n in zip(parts, words, strict=True)):
        own, _, _ = region([c + n if inside else -math.inf for (_, _, inside, _), n, c in zip(parts, words, cost, strict=True)])
        gain = costs.get("", 1.0)
        if own + gain >= score:
            _, lo, hi = region([c + n if inside else c - min(1.0, gain) * n for (_, _, inside, _), n, c in zip(parts, words, cost, strict=True)])
    blocks: list[list[str]] = [[]]
    for tag, text, _, kept in parts[lo:hi]:
        if tag and tag not in INLINE:
            blocks.append([])
        elif not tag and kept:
            blocks[-1].append(text)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, *, html_col: str = "html", sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Costs of tags from about ``sample_rows`` pages that mark their content, picked by a hash of the page; fixed costs apply where there are none.

    Pages are counted on the executors; the driver gets the sums only. Copies of a page are picked together or not at all.
    """
    rows = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    share = min(1.0, sample_rows / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count(page, seen)
        made = [(t, i, n) for (t, i), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in made], k) for j, k in enumerate((pa.string(), pa.bool_(), pa.int64()))], ["tag", "inside", "n"])

    picked = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = picked.transform(arrow_map, run, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    found = Counter({(r["tag"], r["inside"]): r["n"] for r in counts.collect()})
    return learn(found) if found else {}


def main_text(pages: DataFrame, costs: dict[str, float], *, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with the main text of every whole page in ``text_col``.

    Null and empty pages, and pages without main text, have an empty text. Repeated rows are kept; a column named ``text_col`` is replaced.
    """
    kept = [c for c in (keep or pages.columns) if c.lower() != text_col.lower()]
    out = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(len(kept))):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([extract(p, costs) for p in part.column(len(kept)).to_pylist()], pa.string())], [*kept, text_col])

    return pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html_col).cast("string").alias("__html")).transform(arrow_map, run, out)
