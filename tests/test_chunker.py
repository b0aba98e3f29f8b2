import random

import pytest

from indexflow.functions import chunker
from indexflow.functions.chunker import CustomLanguage, atoms, break_level, chunk_rows, compiled, plain_pieces, separators, split, split_all


def plain_split(text, chunk_size, least, overlap, language=None):
    """The same merge by the definition: all starts and all ways before them, one by one."""
    size_at = [0]
    for c in text:
        size_at.append(size_at[-1] + len(c.encode()))
    import numpy as np

    parts = atoms(text, np.array(size_at), compiled(separators(language)), least)
    n = len(parts) - 1
    begin, end, total = [size_at[p.start] for p in parts], [size_at[p.end] for p in parts], size_at[-1]
    owed = lambda at: (total - at) * 512 // overlap if overlap else 0
    gap = lambda a, b: sum(512 // j for j in range(1, a - b + 1))
    ways = [(0, 0, 0, owed(0))]
    for i in range(n):
        found = None
        for s in range(i, -1, -1):
            inside = parts[s + 1 : i + 1]
            size = end[i] - begin[s]
            cost = (1 << 20) * (size < least)
            if inside:
                low, high = min(p.level for p in inside), max(p.breaks_inside for p in inside)
                cost += gap(parts[s].level, low) + gap(parts[i + 1].level, low) + 64 * (max(0, high - parts[s].break_before) + max(0, high - parts[i + 1].break_before))
            if size > chunk_size:
                found = found or (cost + ways[s][0], s, s)
                break
            options = [s] + [p for p in range(s + 1, i + 1) if overlap and end[p] - begin[s] <= overlap]
            way = min(options, key=lambda p: (ways[p][0] + ways[p][3], -p)) if overlap else s
            cost += ways[way][0] + (512 + min(0, ways[way][3] - owed(begin[s])) if overlap else 256)
            if found is None or cost < found[0]:
                found = (cost, s, way)
        ways.append((*found, owed(end[i])))
    out, at = [], n
    while at:
        out.append((parts[ways[at][1]].start, parts[at - 1].end))
        at = ways[at][2]
    return out[::-1]


@pytest.mark.parametrize("language", [None, "markdown"])
@pytest.mark.parametrize("sizes", [(40, 10, 0), (60, 30, 20), (10, 3, 4), (7, 7, 7), (40, 5, 39), (100, 0, 10)])
def test_array_merge_equals_the_plain_one(sizes, language):
    rng = random.Random(str(sizes))
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb ", "\n", "\n\n", "é", " ", ". ", "\n# ", "xyz", "\r\n", "\t", "😀"]) for _ in range(rng.randint(0, 80)))
        assert split(text, *sizes, language) == plain_split(text, *sizes, language)


@pytest.mark.parametrize(
    ("text", "sizes", "chunks"),
    [
        ("Linea 1.\nLinea 2.\n\nLinea 3.", (15, 5, 0), [(0, 8), (9, 17), (19, 27)]),
        ("  \n First chunk. \n\n  Second chunk with spaces at the end.   \n", (30, 10, 0), [(3, 16), (19, 45), (46, 57)]),
        ("   \n ", (10, 5, 0), []),
        ("", (10, 5, 0), []),
        ("x" * 50, (10, 5, 0), [(0, 50)]),
    ],
)
def test_golden_chunks(text, sizes, chunks):
    assert split(text, *sizes) == chunks


def test_long_texts_are_split_near_the_size():
    text = "A very very long text that needs to be split."
    found = [text[a:b] for a, b in split(text, 20, 12)]
    assert found[0] == "A very very long" and all(len(c) <= 20 for c in found)
    text = "This is a test text that is a bit longer to see how the overlap works."
    found = split(text, 20, 10, 5)
    assert len(found) > 1 and found[0][1] <= 25


def test_positions_are_characters_lines_and_columns():
    (row,) = chunk_rows("abc😄def", 100)
    assert row["start"] == {"offset": 0, "line": 1, "column": 1} and row["end"] == {"offset": 7, "line": 1, "column": 8}
    assert [r["start"]["line"] for r in chunk_rows("a\nb\n\nc", 1, 0)] == [1, 2, 4]
    assert chunk_rows(None, 5) is None


def test_break_levels():
    assert [break_level(t) for t in ("ab", "a\nb", "a\r\nb", "\n \n", "\n\n", "\r\n\r\n", "\n\r\n")] == [0, 1, 1, 1, 2, 2, 2]


def test_languages_by_name_alias_and_extension():
    own = (CustomLanguage("Abstract", (r"[.?!]+\s+", r"[:;]\s+"), ("abs",)),)
    assert separators("ABS", own) == own[0].separators_regex
    assert separators(".md") == separators("Markdown") and separators("nothing") == chunker.DEFAULT
    with pytest.raises(ValueError):
        separators("x", (*own, CustomLanguage("abs", ("a",))))
    with pytest.raises(ValueError):
        split("a b", 1, 0, 0, "l", (CustomLanguage("l", ("(?=a)",)),))


@pytest.mark.parametrize("sizes", [(40, 10, 0), (60, 30, 20), (10, 3, 4), (7, 7, 7), (40, 5, 39), (30, 40, 5), (50, None, 10)])
def test_texts_merged_together_equal_each_alone(sizes, monkeypatch):
    monkeypatch.setattr(chunker, "TOGETHER", 16)
    monkeypatch.setattr(chunker, "KEPT_ROWS", 8)
    rng = random.Random(str(sizes))
    texts = ["".join(rng.choice(["a", "bb ", "\n", "\n\n", "é", " ", ". ", "xyz", "  ", "\n ", "😀", "word ", "\r\n" if i % 9 == 0 else "c "]) for _ in range(rng.choice([0, 3, 20, 200, 700]))) for i in range(60)]
    assert split_all(texts, *sizes) == [split(t, *sizes) for t in texts]
    assert sum(plain_pieces(t, sizes[1] or sizes[0] // 2) is not None for t in texts) > 5
