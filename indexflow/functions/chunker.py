"""Recursive text splitting: cut a text at separators of falling rank, then merge the pieces at least cost.

The merge is a shortest path over the pieces. Sizes are UTF-8 bytes, positions characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed costs: a gap between syntax levels, a line-break level, a missing overlap, a chunk that is too small.
SYNTAX_GAP, BREAK_GAP, NO_OVERLAP, TOO_SMALL = 512, 64, 512, 1 << 20
#: Fixed default separators.
DEFAULT = (r"\n\n+", r"\n", r"\s+")
#: Approximations for grammars: a parser can't be had here, so languages split at these patterns.
LANGUAGES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "markdown": (("md", "mdx"), (r"\n# ", r"\n## ", r"\n### ", r"\n#### ", r"\n\n+", r"\n", r"\. ", r"\s+")),
    "html": (("htm", "xhtml"), (r"<h1[^>]*>", r"<(?:section|article|div)[^>]*>", r"<(?:p|li|tr|h[2-6])[^>]*>", r"\n", r"\s+")),
    "python": (("py", "pyi"), (r"\n(?:class|async def|def) ", r"\n+(?:    |\t)(?:async def|def|class) ", r"\n\n+", r"\n", r"\s+")),
    "rust": (("rs",), (r"\n(?:pub |fn |impl |mod |struct |enum |trait )", r"\n\n+", r"\n", r"[;{}]\s*", r"\s+")),
    "javascript": (("js", "jsx", "mjs", "typescript", "ts", "tsx"), (r"\n(?:export |function |class |const |let )", r"\n\n+", r"\n", r"[;{}]\s*", r"\s+")),
    "c": (("h", "cpp", "c++", "cc", "cxx", "hpp", "hxx", "hh", "csharp", "cs", "c#", "java", "kotlin", "kt", "scala", "swift", "go", "golang", "php", "solidity", "sol"), (r"\n\}\s*\n", r"\n\n+", r"\n", r"[;{}]\s*", r"\s+")),
    "ruby": (("rb", "r", "fortran", "f", "f90", "f95", "f03", "pascal", "pas", "dpr", "delphi"), (r"\n(?:def|class|module|function|subroutine|procedure)\b", r"\n\n+", r"\n", r"\s+")),
    "sql": ((), (r";\s*\n", r"\n\n+", r"\n", r",\s*", r"\s+")),
    "data": (("json", "yaml", "yml", "toml", "xml", "dtd", "css", "scss"), (r"\n\n+", r"\n(?=\S)", r"\n", r"[,;}\]]\s*", r"\s+")),
}


@dataclass(frozen=True)
class CustomLanguage:
    language_name: str
    separators_regex: tuple[str, ...]
    aliases: tuple[str, ...] = ()


@dataclass
class Atom:
    start: int
    end: int
    level: int  # syntax level of the boundary before it
    break_before: int
    breaks_inside: int


@lru_cache
def compiled(patterns: tuple[str, ...]) -> tuple[regex.Pattern, ...]:
    for p in patterns:
        if regex.search(r"\(\?<?[=!]", p) and p not in {x for _, ps in LANGUAGES.values() for x in ps}:
            raise ValueError(f"look-around is not supported in separator {p!r}")
    return tuple(regex.compile(p) for p in patterns)


def separators(language: str | None, custom: tuple[CustomLanguage, ...] = ()) -> tuple[str, ...]:
    """The separators for a language, its alias or a file extension, in any case; the default for unknown ones."""
    own: dict[str, tuple[str, ...]] = {}
    for c in custom:
        for name in dict.fromkeys(x.lower() for x in (c.language_name, *c.aliases)):
            if name in own:
                raise ValueError(f"language name or alias {name!r} is given twice")
            own[name] = tuple(c.separators_regex)
    want = (language or "").lower().removeprefix(".")
    if want in own:
        return own[want]
    return next((seps for name, (aliases, seps) in LANGUAGES.items() if want == name or want in aliases), DEFAULT)


def break_level(text: str) -> int:
    """0 without a line break, 2 where a run of line-break characters repeats its first one, else 1."""
    if "\n" not in text and "\r" not in text:
        return 0
    runs = regex.findall(r"[\n\r]+", text)
    return 1 + any(r[0] in r[1:] for r in runs)


def atoms(text: str, size_at: np.ndarray | None, patterns: tuple[regex.Pattern, ...], least: int) -> list[Atom]:
    """The pieces of a text that merging starts from, and a last empty one at its end."""
    found: list[Atom] = []
    depth = low = 0
    last_end = 0
    size = (lambda a, b: b - a) if size_at is None else (lambda a, b: int(size_at[b] - size_at[a]))

    def add(start: int, end: int) -> None:
        nonlocal low, last_end
        while end > start and text[end - 1].isspace():
            end -= 1
        while start < end and text[start].isspace():
            start += 1
        if start == end:
            return
        before = break_level(text[last_end:start])
        inside = break_level(text[start:end])
        if before:
            while start > last_end and text[start - 1] in " \t":
                start -= 1
        found.append(Atom(start, end, low, before, inside))
        low, last_end = depth, end

    def pieces(start: int, end: int, pattern: regex.Pattern) -> Iterator[tuple[int, int]]:
        at = start
        for m in pattern.finditer(text, start, end):
            yield at, m.start()
            at = m.end()
        if at < end:
            yield at, end

    stack: list[tuple[Iterator[tuple[int, int]], int]] = []
    if patterns:
        stack.append((pieces(0, len(text), patterns[0]), 1))
        depth = 1
    else:
        add(0, len(text))
    while stack:
        todo, level = stack[-1]
        piece = next(todo, None)
        if piece is None:
            stack.pop()
            depth -= 1
            low = min(low, depth)
        elif level >= len(patterns) or size(*piece) <= least:
            add(*piece)
        else:
            stack.append((pieces(*piece, patterns[level]), level + 1))
            depth += 1
    found.append(Atom(len(text), len(text), low, 2, 0))
    return found


@lru_cache(64)
def level_costs(most: int) -> np.ndarray:
    """The cost of a gap of 0, 1, 2 ... syntax levels."""
    return np.concatenate(([0], np.cumsum(SYNTAX_GAP // np.arange(1, most + 1))))


def split(text: str, chunk_size: int, min_chunk_size: int | None = None, chunk_overlap: int = 0, language: str | None = None, custom: tuple[CustomLanguage, ...] = ()) -> list[tuple[int, int]]:
    """Character ranges of the chunks of a text, in order; none for a blank text."""
    least = chunk_size // 2 if min_chunk_size is None else min_chunk_size
    size_at = None
    if not text.isascii():
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size_at = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
    parts = atoms(text, size_at, compiled(separators(language, custom)), least)
    n = len(parts) - 1
    if n < 1:
        return []
    bytes_at = np.arange(len(text) + 1) if size_at is None else size_at
    begin, end = bytes_at[[p.start for p in parts]], bytes_at[[p.end for p in parts]]
    level, before, inside = (np.array([getattr(p, f) for p in parts]) for f in ("level", "break_before", "breaks_inside"))
    any_break = bool(inside.any())
    gaps = level_costs(int(level.max()) + 1)
    owed = (bytes_at[-1] - begin) * NO_OVERLAP // chunk_overlap if chunk_overlap else np.zeros(n + 1, dtype=np.int64)
    # cost[i]: of the cheapest way to cover the first i atoms; first[i]: the first atom of its last chunk; back[i]: the way before that chunk
    cost, due = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    first, back = [0] * (n + 1), [0] * (n + 1)
    due[0] = bytes_at[-1] * NO_OVERLAP // chunk_overlap if chunk_overlap else 0
    # best[s]: the way before a chunk that begins at atom s, among those that overlap it no more than allowed
    best, worth = np.arange(n + 1), np.full(n + 1, np.iinfo(np.int64).max)
    fits = np.maximum(np.searchsorted(begin, end - chunk_size), 0)
    laps = np.searchsorted(begin, end - chunk_overlap)
    for i in range(n):
        if chunk_overlap:
            v = cost[i] + due[i]
            s = min(int(laps[i]), i)
            won = worth[s : i + 1] >= v
            won[-1] = True
            best[s : i + 1][won], worth[s : i + 1][won] = i, v
        lo = min(int(fits[i]), i)
        inner = np.minimum.accumulate(level[lo + 1 : i + 1][::-1])
        now = np.where(end[i] - begin[lo : i + 1][::-1] < least, TOO_SMALL, 0)
        now[1:] += gaps[np.maximum(level[lo:i][::-1] - inner, 0)] + gaps[np.maximum(level[i + 1] - inner, 0)]
        if any_break:
            broken = np.maximum.accumulate(inside[lo + 1 : i + 1][::-1])
            now[1:] += BREAK_GAP * (np.maximum(broken - before[lo:i][::-1], 0) + np.maximum(broken - before[i + 1], 0))
        if end[i] - begin[i] > chunk_size:  # one atom that is too large is a chunk of its own
            way, total = np.array([i]), now[:1] + cost[i]
        elif chunk_overlap:
            way = best[lo : i + 1][::-1]
            total = now + cost[way] + NO_OVERLAP + np.minimum(due[way] - owed[lo : i + 1][::-1], 0)
        else:
            way = np.arange(i, lo - 1, -1)
            total = now + cost[lo : i + 1][::-1] + NO_OVERLAP // 2
        k = int(total.argmin())
        cost[i + 1], first[i + 1], back[i + 1] = total[k], i - k, int(way[k])
        due[i + 1] = (bytes_at[-1] - end[i]) * NO_OVERLAP // chunk_overlap if chunk_overlap else 0
    out, at = [], n
    while at:
        out.append((parts[first[at]].start, parts[at - 1].end))
        at = back[at]
    return out[::-1]


#: Texts that are merged together, and rows of their windows that are kept.
TOGETHER, KEPT_ROWS = 1024, 1024
_TOO_LARGE, _S_BITS = 1 << 40, 20


@dataclass
class Pieces:
    """The atoms of a text as arrays; all but the last row are pieces, which is the text's end."""

    start: np.ndarray
    end: np.ndarray
    level: np.ndarray
    begin_at: np.ndarray  # the same ends in bytes
    end_at: np.ndarray
    total: int


def plain_pieces(text: str, least: int) -> Pieces | None:
    """The atoms by the default separators for a text with spaces and line feeds alone between words; None for other texts, and for those with line breaks inside atoms."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    feed = code == 10
    blank = feed | (code == 32)
    if np.count_nonzero(blank) != len(text) - len("".join(text.split())) or not len(text):
        return None
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return None
    at = np.arange(len(text) + 1) if text.isascii() else np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
    feeds, pairs = np.flatnonzero(feed), np.flatnonzero(feed[1:] & feed[:-1])
    n_feeds = np.searchsorted(feeds, begin)
    n_pairs = np.searchsorted(pairs, begin)
    gap = np.zeros(len(begin), dtype=np.int8)
    gap[1:] = (n_feeds[1:] > n_feeds[:-1]).astype(np.int8) + (n_pairs[1:] > n_pairs[:-1])
    gap[0] = (n_feeds[0] > 0) + (n_pairs[0] > 0)
    head = gap.copy()
    head[0] = 2

    def small(first: np.ndarray, marks: np.ndarray, n_before: np.ndarray, behind: int) -> np.ndarray:
        """By word, whether the paragraph or line around it is no larger than the least size."""
        ahead = np.concatenate(([0], marks + behind))[n_before[first]]
        last = np.concatenate((first[1:], [len(begin)])) - 1
        after = np.concatenate((marks, [len(text)]))[np.searchsorted(marks, end[last])]
        return np.repeat(at[after] - at[ahead] <= least, last - first + 1)

    paragraph, line = np.flatnonzero(head == 2), np.flatnonzero(head >= 1)
    in_paragraph, in_line = small(paragraph, pairs, n_pairs, 2), small(line, feeds, n_feeds, 1)
    first = np.flatnonzero(np.where(in_paragraph, head == 2, ~in_line | (head >= 1)))
    begin, end = begin[first], end[np.concatenate((first[1:], [len(end)])) - 1]
    if len(begin) > 1 and np.any(np.searchsorted(feeds, end) > n_feeds[first]):
        return None
    level = np.concatenate((3 - gap[first], [0])).astype(np.int8)
    level[0] = 0
    broken = gap[first] > 0
    begin = np.where(broken, np.concatenate(([0], feeds + 1))[n_feeds[first]], begin)
    begin, end = np.append(begin, len(text)), np.append(end, len(text))
    return Pieces(begin, end, level, at[begin], at[end], int(at[-1]))


def merge_together(made: list[Pieces], chunk_size: int, least: int, overlap: int) -> list[list[tuple[int, int]]]:
    """What split() does after atoms(), for several texts without line breaks inside atoms at once, atom by atom.

    Arrays have a column for each text, those with most atoms first, and a row for each atom at which the chunk under way
    may begin. ``held`` is what a chunk from there costs so far, with its number reversed in the low bits, so that the least is the latest of the cheapest.
    """
    order = sorted(range(len(made)), key=lambda j: -len(made[j].level))
    sizes = np.array([len(made[j].level) - 1 for j in order])
    steps, wide = int(sizes[0]), len(order)
    active = wide - np.searchsorted(sizes[::-1], np.arange(1, steps + 2))
    off = np.concatenate(([0], np.cumsum(active)))
    begin, end, level, following, back_to, laps_to = (np.zeros(off[-1], dtype=d) for d in (np.int64, np.int64, np.int8, np.int8, np.int64, np.int64))
    for column, j in enumerate(order):
        x, at = made[j], off[: sizes[column]] + column
        begin[at], end[at], level[at], following[at] = x.begin_at[:-1], x.end_at[:-1], x.level[:-1], x.level[1:]
        laps_to[at] = np.searchsorted(x.begin_at, x.end_at[:-1] - overlap)
        back_to[at] = np.minimum(np.searchsorted(x.begin_at, x.end_at[:-1] - chunk_size), np.arange(sizes[column]))
    total = np.array([made[j].total for j in order])
    gaps, top = level_costs(4), 3
    first, back = np.zeros(off[-1], dtype=np.int32), np.zeros(off[-1], dtype=np.int32)
    low = (1 << _S_BITS) - 1
    room = KEPT_ROWS
    while room < 4 * (int((np.repeat(np.arange(steps + 1), active)[: len(back_to)] - back_to).max()) + 2):
        room *= 2
    w_begin, w_held, w_worth = (np.zeros((room, wide), dtype=np.int64) for _ in range(3))
    w_way, w_level, w_inner = np.zeros((room, wide), dtype=np.int32), np.zeros((room, wide), dtype=np.int8), np.zeros((room, wide), dtype=np.int8)
    cost = np.zeros(wide, dtype=np.int64)
    due = total * NO_OVERLAP // overlap if overlap else np.zeros(wide, dtype=np.int64)
    shift = 0  # the row of atom i is i - shift
    for i in range(steps):
        a = int(active[i])
        here = slice(int(off[i]), int(off[i]) + a)
        b, e, lev, nxt = begin[here], end[here], level[here], following[here]
        lo = int(back_to[here].min())
        if i - shift == room:
            keep = i - lo
            for x in (w_begin, w_held, w_worth, w_way, w_level, w_inner):
                x[:keep] = x[room - keep :]
            shift = lo
        row, r0 = i - shift, lo - shift
        cost, due, total = cost[:a], due[:a], total[:a]
        # the gap's cost of the atom before, and of those whose least level inside falls
        if i > lo:
            w_inner[row - 1, :a] = lev
            w_held[row - 1, :a] += (gaps[np.maximum(w_level[row - 1, :a] - lev, 0)] + gaps[top - lev]) << _S_BITS
        fell = np.flatnonzero(lev < top)
        if len(fell) and row - 1 > r0:
            old, own = w_inner[r0 : row - 1, fell], w_level[r0 : row - 1, fell]
            new = np.minimum(old, lev[fell])
            w_held[r0 : row - 1, fell] += (gaps[np.maximum(own - new, 0)] - gaps[np.maximum(own - old, 0)] + gaps[top - new] - gaps[top - old]) << _S_BITS
            w_inner[r0 : row - 1, fell] = new
        w_begin[row, :a], w_level[row, :a], w_inner[row, :a], w_way[row, :a] = b, lev, top, i
        if overlap:
            v = cost + due
            owed = (total - b) * NO_OVERLAP // overlap
            w_held[row, :a] = (cost + NO_OVERLAP + np.minimum(due - owed, 0) << _S_BITS) + (low - i)
            w_worth[row, :a] = v
            # a way that is no worse takes the place of the one before chunks that it overlaps no more than allowed
            q0 = max(r0, min(row, int(laps_to[here].min()) - shift))
            if q0 < row:
                won = (w_begin[q0:row, :a] >= e - overlap) & (w_worth[q0:row, :a] >= v)
                y, x = np.nonzero(won)
                if len(y):
                    y += q0
                    s_owed = (total[x] - w_begin[y, x]) * NO_OVERLAP // overlap
                    s, inner = y + shift, w_inner[y, x]
                    gap = np.where(y == row, 0, gaps[np.maximum(w_level[y, x] - inner, 0)] + gaps[top - inner])
                    w_held[y, x] = (cost[x] + NO_OVERLAP + np.minimum(due[x] - s_owed, 0) + gap << _S_BITS) + (low - s)
                    w_worth[y, x], w_way[y, x] = v[x], i
        else:
            w_held[row, :a] = (cost + NO_OVERLAP // 2 << _S_BITS) + (low - i)
        size = e - w_begin[r0 : row + 1, :a]
        cheap = w_held[r0 : row + 1, :a].copy()
        np.add(cheap, TOO_SMALL << _S_BITS, out=cheap, where=size < least)
        np.add(cheap, _TOO_LARGE << _S_BITS, out=cheap, where=size > chunk_size)
        # what follows may lie on another level than the deepest
        less = np.flatnonzero(nxt < top)
        if len(less) and row > r0:
            inner = w_inner[r0:row, less]
            cheap[:-1, less] += (gaps[np.maximum(nxt[less] - inner, 0)] - gaps[top - inner]) << _S_BITS
        got = cheap.min(0)
        s = low - (got & low)
        now = got >> _S_BITS
        way = w_way[s - shift, np.arange(a)]
        alone = np.flatnonzero(e - b > chunk_size)
        if len(alone):
            s[alone], way[alone], now[alone] = i, i, cost[alone] + (e[alone] - b[alone] < least) * TOO_SMALL
        first[here], back[here], cost = s, way, now
        due = (total - e) * NO_OVERLAP // overlap if overlap else due
    out: list[list[tuple[int, int]]] = [[] for _ in made]
    for column, j in enumerate(order):
        x, at = made[j], off[: sizes[column]] + column
        firsts, backs, starts, ends = first[at].tolist(), back[at].tolist(), x.start.tolist(), x.end.tolist()
        n, found = int(sizes[column]), out[j]
        while n:
            found.append((starts[firsts[n - 1]], ends[n - 1]))
            n = backs[n - 1]
        found.reverse()
    return out


def split_all(texts: list[str], chunk_size: int, min_chunk_size: int | None = None, chunk_overlap: int = 0, language: str | None = None, custom: tuple[CustomLanguage, ...] = ()) -> list[list[tuple[int, int]]]:
    """split() for several texts; those with plain white space and default separators are merged together."""
    least = chunk_size // 2 if min_chunk_size is None else min_chunk_size
    plain = separators(language, custom) == DEFAULT
    out: list[list[tuple[int, int]] | None] = [None] * len(texts)
    made: dict[int, Pieces] = {}

    def merge() -> None:
        for j, found in zip(made, merge_together([*made.values()], chunk_size, least, chunk_overlap) if made else [], strict=True):
            out[j] = found
        made.clear()

    for j in sorted(range(len(texts)), key=lambda j: -len(texts[j])) if plain else range(len(texts)):
        got = plain_pieces(texts[j], least) if plain else None
        if got is None or len(got.level) >= 1 << _S_BITS:
            out[j] = split(texts[j], chunk_size, min_chunk_size, chunk_overlap, language, custom)
        elif len(got.level) == 2:
            out[j] = [(int(got.start[0]), int(got.end[0]))]
        else:
            made[j] = got
            if len(made) == TOGETHER:
                merge()
    merge()
    return out


POSITION = T.StructType([T.StructField("offset", T.LongType(), False), T.StructField("line", T.LongType(), False), T.StructField("column", T.LongType(), False)])
CHUNK = T.StructType([T.StructField("location", T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False), T.StructField("text", T.StringType(), False), T.StructField("start", POSITION, False), T.StructField("end", POSITION, False)])


def chunk_rows(text: str | None, *args, **kwargs) -> list[dict] | None:
    """Chunks as rows: location, text, and the offset, line and column of both ends; lines and columns count from 1."""
    return None if text is None else as_rows(text, split(text, *args, **kwargs))


def as_rows(text: str, found: list[tuple[int, int]]) -> list[dict]:
    ranges = sorted(set(found))
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10) if ranges else np.empty(0, dtype=np.int64)
    ends = np.array(ranges, dtype=np.int64).ravel()
    lines = np.searchsorted(breaks, ends)
    columns = ends - np.concatenate(([-1], breaks))[lines]
    at = [{"offset": o, "line": n + 1, "column": c} for o, n, c in zip(ends.tolist(), lines.tolist(), columns.tolist(), strict=True)]
    return [{"location": {"start": a, "end": b}, "text": text[a:b], "start": s, "end": e} for (a, b), s, e in zip(ranges, at[::2], at[1::2], strict=True)]


def split_column(text, chunk_size, min_chunk_size=None, chunk_overlap=None, language=None, custom: tuple[CustomLanguage, ...] = ()):
    """A Column of chunks; arguments are Columns or constants. One Arrow batch at a time, texts with the same arguments together."""
    as_col = lambda x: x if hasattr(x, "_jc") or hasattr(x, "isNull") else F.lit(x)

    @F.pandas_udf(T.ArrayType(CHUNK, False))
    def run(t: pd.Series, size: pd.Series, least: pd.Series, overlap: pd.Series, lang: pd.Series) -> pd.Series:
        none = lambda x: None if x is None or x != x else x
        alike: dict[tuple, list[int]] = {}
        for i, (a, b, c, d, e) in enumerate(zip(t, size, least, overlap, lang, strict=True)):
            if none(a) is not None:
                c, d = none(c), none(d)
                alike.setdefault((int(b), None if c is None else int(c), int(d or 0), none(e)), []).append(i)
        out, texts = [None] * len(t), list(t)
        for args, rows in alike.items():
            for i, found in zip(rows, split_all([texts[i] for i in rows], *args, custom), strict=True):
                out[i] = as_rows(texts[i], found)
        return pd.Series(out, dtype=object)

    return run(as_col(text), as_col(chunk_size).cast("long"), as_col(min_chunk_size).cast("long"), as_col(chunk_overlap).cast("long"), as_col(language).cast("string"))
