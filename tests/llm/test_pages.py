import io
import random
import re
import zlib
from collections import Counter

import pytest

from indexflow.llm import html, queries, urls, warc
from indexflow.llm.common import Workspace

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_verdicts_equal_plain_rules(spark):
    given = [None, "", "no scheme", "http://", "http://Example.COM/en/x?q=/es/#f", "https://www.example.com/en/", "https://a.www.example.com/en/y", "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "ftp://com", "http://com?x", "http://badexample.com/en/", "http://example.com:80/en/", "a://b://c.com/z", "http://x.com/a\nb", "http://.com/", "http://É.com/Ä", "http://x.com/" + "p" * 50000, "http://x.com/en", "http://x.com/en"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = urls.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: plain_verdict(u) for i, u in enumerate(given)}
    assert urls.judge(df.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
    nothing = urls.judge(df, spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string")).collect()
    assert {(r["rule"], r["verdict"]) for r in nothing} == {(None, "allow")} and len(nothing) == len(given)


def test_many_rules_go_through_the_filter(spark):
    rules = spark.createDataFrame([(f"h{i}.org", f"/p{i % 7}/", "block") for i in range(3000)], "host string, path string, verdict string")
    asked = spark.createDataFrame([(i, f"http://a.h{i}.org/p{i % 5}/x") for i in range(4000)], "page_id long, url string")
    blocked = {r["page_id"] for r in urls.judge(asked, rules).where("verdict = 'block'").collect()}
    assert blocked == {i for i in range(3000) if i % 7 == i % 5}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home of all</a></li></ul></nav><div class="ad">Buy this now</div>
<article><h1>Head &lt;1&gt;</h1><p><b>First  &amp;\n one.<br><p>Sec<i>ond</i>.</p><aside>related things here</aside><div class="comments"><p>a comment</p></div><p>x</p></article><footer>&copy; me and all of us</footer></body></html>"""


def learned(*pages):
    seen = Counter()
    for p in pages:
        html.count(p, seen)
    return html.learn(seen)


def test_main_text():
    costs = learned(PAGE)
    assert html.extract(PAGE, costs) == "Head <1>\nFirst & one.\nSecond.\nx"
    assert html.extract("<body><div>menu a b</div><article><p>only</p>", costs) == "only"
    assert html.extract("<nav>never closed<article>in</article>", costs) == "in"
    assert html.extract("<article><div>a</div><span>b</span>c</article>", {}) == "a\nbc"
    assert html.extract("<p>plain &amp text</p>", {}) == "plain & text"
    for nothing in (None, "", "<article></article>", "<script>x</script>", "<!-- c -->"):
        assert html.extract(nothing, costs) == ""
    assert html.extract("<article>" + "<p>w w</p>" * 20000 + "</article>", costs).count("\n") == 19999
    assert html.extract("a < b and c > d", {}) == "a < b and c > d"


@pytest.mark.parametrize(
    ("name", "marked"),
    [("ad", True), ("site-header", True), ("leftSidebar", True), ("cookie_notice big", True), ("comment-body", True), ("related", True), ("post has-comments", False), ("ad-free", False), ("entry-header", False), ("post-comments", True), ("adaptive", False), ("shadow", False), ("no-sidebar", False), ("search-engines", False), ("share-price", False), ("form-factor", False), ("comment-policy", False), ("search-box-2", True), ("share-buttons", True), ("readerComments", True), ("related-articles", True)],
)
def test_names_of_boilerplate(name, marked):
    assert html.is_marked(f'<div class="{name}">') is marked is html.is_marked(f"<p id='{name}' x=1>")
    text = html.extract(f'<article class="{name}"><p>one two</p></article><div class="{name}">three</div>', {})
    assert ("one" in text) is not marked


def test_body_outside_the_content_elements():
    """Teasers in content elements don't outweigh a body that stands in a div, nor does a list inside an article cut it."""
    costs = learned(*[PAGE] * 20)
    teaser = "<article><h2>Other page</h2><p>five more words of teaser</p></article>"
    body = "<p>one two three four five six seven</p>" * 9
    want = "\n".join(["one two three four five six seven"] * 9)
    assert html.extract(f"<body>{teaser}<div>{body}</div>{teaser * 5}</body>", costs) == want
    assert html.extract(f"<body><div>some words beside it</div><article>{body}</article></body>", costs) == want
    listed = "<ul>" + "<li><a href=x>w</a></li>" * 30 + "</ul>"
    assert html.extract(f"<article>{body}{listed}{body}</article>", costs) == "\n".join([want, *["w"] * 30, want])


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('a<svg class="i"/>b<p>c</p><svg><text>x</text></svg>d', "ab\nc\nd"),
        ("a<svg><svg>x</svg>y</svg>b", "ab"),
        ("<select-box>a</select-box><object-viewer>b</object-viewer><p>c", "a\nb\nc"),
        ("<p>a</p><svg class=i><path d=z><p>b</p>", "a\nb"),
        ('<img alt="x > y">more <a title="5 > 3" href=u>link</a>', "more link"),
        ("<a title='it is < 3 > 2' id = \"q>r\">b</a><p>don't</p>", "b\ndon't"),
        ('<p title="never closed>a</p><p>b "c" d</p>', 'a\nb "c" d'),
        ("<p title=don't>a</p><p>b</p>", "a\nb"),
        ("<p>a</p><script>var x = 1;<p>b</p>", "a\nb"),
        ("<script src=x/>var x;</script>a<script src='y'/>b<script>z</script>c", "abc"),
        ("<title/>a<p>b", "a\nb"),
        ('<p class="ad">Buy<p>Real one</p><p>Real two</p>', "Real one\nReal two"),
        ('<p class="ad">Buy</p><p>one</p>', "one"),
        ('<p class="ad"><b>Buy<p>one</p>', "one"),
        ('<div><p class="ad">Buy</div>one', "one"),
        ('<div><p class="ad">Buy <b>x</b></i> now<div>one</div></div>', "one"),
        ('<ul><li class="ad">Buy<ul><li>x<li>y</ul>z<li>one<li class="ad">Buy</ul><p>two', "one\ntwo"),
        ('<dl><dt class="ad">Buy<dd>one<dt>two</dl>three', "one\ntwo\nthree"),
        ('<table><tr><td class="ad">Buy<table><tr><td>x</table>y<td>one<tr class="ad"><td>Buy<tr><td>two</table>three', "one\ntwo\nthree"),
    ],
)
def test_nothing_else_is_dropped(inner, text):
    assert html.extract(f"<article>{inner}</article>", {}) == text


def test_pages_without_their_content_tags(spark, sf_dir):
    """With article and main renamed to div, the method finds what the elements held; the weights come from other pages."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    costs = learned(*(r["html"] for r in rows if r["page_id"] % 2))
    some = [r["html"] for r in rows if r["page_id"] % 2 == 0]
    renamed = [re.sub(r"(</?)(?:article|main)\b", r"\1div", p) for p in some]
    same = [html.extract(a, costs) == html.extract(b, costs) for a, b in zip(some, renamed, strict=True)]
    assert sum(same) >= 0.95 * len(same)


def test_regions_equal_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        worth = [rng.choice([-8.0, -1.0, -0.5, 1.0, 2.0, 5.0]) for _ in range(rng.randint(0, 14))]
        best = max([0.0, *(sum(worth[i:j]) for i in range(len(worth)) for j in range(i + 1, len(worth) + 1))])
        score, lo, hi = html.region(worth)
        assert score == best == sum(worth[lo:hi])


def test_unclosed_elements_take_linear_time():
    page = "<article>" + "<svg><title><script/><p class=ad>x<p>w" * 20000 + "</article>"
    assert html.extract(page, {}).count("w") == 20000


def test_the_best_region_is_the_maximum_subsequence():
    costs = {"td": 3.0, "tr": 3.0, "p": 0.01}
    page = "<tr><td>a</td><td>b c</td></tr><p>one two three four five</p><p>six seven</p><tr><td>z</td></tr>"
    parts = html.tokens(page)
    worth = [-costs.get(t, 1.0) if t else len(x.split()) for t, x, _, _ in parts]
    best = max((sum(worth[i:j]), -i, i, j) for i in range(len(worth)) for j in range(i, len(worth) + 1))
    want = " ".join(x for t, x, _, _ in parts[best[2] : best[3]] if not t)
    assert html.extract(page, costs).split() == want.split()


def test_pages_table(spark):
    df = spark.createDataFrame([(1, PAGE, "u"), (2, None, "u"), (3, "", None), (3, "", None)], "page_id long, html string, text string")
    got = html.main_text(df, html.train(df)).collect()
    assert [len(r["text"]) > 0 for r in sorted(got, key=lambda r: r["page_id"])] == [True, False, False, False]
    assert html.main_text(df.limit(0), html.train(df.limit(0))).count() == 0


def test_archives_round_trip(spark):
    rows = [(3, "http://a/", "héllo"), (1, "http://b/ x\n", "héllo"), (2, None, None), (7, "u", ""), (8, "u", "x" * 3_000_00), (9, "u", "héllo"), (9, "u", "héllo")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    ws = Workspace(spark, "warc-test")
    archives = warc.write(df, f"{ws.path}/out", ws=ws, roll_bytes=500)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"") if r["record_type"] == "response" else None) for r in warc.read(archives).where("gap is null").collect())
    assert got == sorted([(1, 6, "response", None, "héllo".encode()), (3, 6, "revisit", 1, None), (9, 6, "revisit", 1, None), (9, 6, "revisit", 1, None), (2, 0, "response", None, b""), (7, 0, "revisit", 2, None), (8, 300000, "response", None, b"x" * 300000)], key=lambda t: (t[0], t[1], t[2], t[3] or 0))
    big = warc.write(df, f"{ws.path}/big", min_bytes=7, ws=ws)
    assert warc.read(big).where("record_type = 'revisit'").count() == 0
    assert warc.read(warc.write(df.limit(0), f"{ws.path}/none", ws=ws)).count() == 0


def member(i, body=b"payload"):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(warc.record("response", i, "u", body, None, "2024-01-01T00:00:00Z")) + z.flush()


def found(data):
    return [(x.start, x.end, None if x.head is None else x.head["warc-record-id"]) for x in warc.salvage(io.BytesIO(data))]


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_skips_damage_and_logs_gaps(plain):
    make = (lambda i: warc.record("response", i, "u", b"payload %d" % i, None, "d")) if plain else member
    parts = [make(i) for i in range(4)]
    at = [sum(map(len, parts[:i])) for i in range(5)]
    ids = [f"<urn:page:{i}>" for i in range(4)]
    whole = b"".join(parts)
    assert found(whole) == [(at[i], at[i + 1], ids[i]) for i in range(4)]
    broken = bytearray(whole)
    broken[at[1] + len(parts[1]) // 2] ^= 0xFF
    assert found(bytes(broken)) == [(0, at[1], ids[0]), (at[1], at[2], None), (at[2], at[3], ids[2]), (at[3], at[4], ids[3])]
    assert found(whole[: at[3] + 9]) == [(at[i], at[i + 1], ids[i]) for i in range(3)] + [(at[3], at[3] + 9, None)]
    assert found(b"junk" + whole)[0] == (0, 4, None) and len(found(b"junk" + whole)) == 5
    cut = whole[: at[1] + 20] + whole[at[2] :]
    assert [x[2] for x in found(cut)] == [ids[0], None, ids[2], ids[3]]
    assert found(b"") == [] and found(b"\x00" * 600_000) == [(0, 600_000, None)]
    assert [x[2] for x in found(parts[0] + warc.record("response", 9, "u", b"p", None, "d") + member(5))] == [ids[0], "<urn:page:9>", "<urn:page:5>"]


URLS = ["https://example.com/WARC/1.1/spec", "https://example.com/WARC/1.1", "WARC/1.0", "https://example.com/?" + "q" * 600_000, "https://example.com/WARC/1.1\r\nWARC-Type: x"]


@pytest.mark.parametrize("packed", [False, True])
def test_any_url_is_read_again(packed):
    whole = [warc.record("response", i, u, b"p%d" % i, None, "d") for i, u in enumerate(URLS)]
    data = b"".join(zlib.compress(x, wbits=31) for x in whole) if packed else b"".join(whole)
    got = list(warc.salvage(io.BytesIO(data)))
    assert [x.head and x.head["warc-target-uri"] for x in got] == [*URLS[:4], "https://example.com/WARC/1.1%0D%0AWARC-Type:%20x"]


@pytest.mark.parametrize("at", [9, 10, 12, 21, 25, 33, 70, 100, 130, 200])
def test_cut_heads_are_gaps(at):
    a, b = (warc.record("response", i, "http://u/x", b"p", None, "2024-01-01T00:00:00Z") for i in range(2))
    assert found(a[:at] + b) == [(0, at, None), (at, at + len(b), "<urn:page:1>")]


def test_op7_keeps_pages_with_any_url(spark, tmp_path):
    rows = [(i, u, "same" if i % 2 else f"page {i}") for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in queries.op7_warc(spark, str(tmp_path)).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None)}


def ids(data):
    return [x.head and int(x.head["warc-record-id"][10:-1]) for x in warc.salvage(io.BytesIO(data))]


@pytest.mark.parametrize("level", [0, 6])
def test_members_of_several_records(level, monkeypatch):
    rng = random.Random(4)
    whole = [warc.record("response", i, "u", rng.randbytes(3000), None, "d") for i in range(5)]
    pack = lambda parts: zlib.compress(b"".join(parts), level, wbits=31)
    assert ids(pack(whole)) == [0, 1, 2, 3, 4] and ids(pack(whole) + pack(whole[:2])) == [0, 1, 2, 3, 4, 0, 1]
    bad = bytearray(whole[2])
    bad[-100] ^= 1
    assert ids(pack([*whole[:2], bytes(bad), *whole[3:]])) == [0, 1, None, 3, 4]
    assert ids(pack([*whole[:2], whole[2][:900], *whole[3:]])) == [0, 1, None, 3, 4]
    assert ids(pack([b"junk", *whole])) == [None, 0, 1, 2, 3, 4] and ids(pack([*whole, b"junk"])) == [0, 1, 2, 3, 4, None]
    assert ids(pack(whole)[:-3000] + member(7)) == [0, 1, 2, 3, None, 7]
    assert ids(pack(whole)[:-3000]) == [0, 1, 2, 3, None]
    cut = bytearray(pack(whole))
    cut[7000:7040] = bytes(40)
    assert ids(bytes(cut) + member(7))[:2] == [0, 1] and ids(bytes(cut) + member(7))[-1] == 7
    # the bound holds for a record, not for the member
    monkeypatch.setattr(warc, "LARGEST", 5000)
    assert ids(pack(whole)) == [0, 1, 2, 3, 4]
    assert ids(pack([whole[0], warc.record("response", 8, "u", bytes(6000), None, "d"), whole[1]])) == [0, None, 1]


def test_a_lone_record_counts_only_if_its_member_checks():
    whole = member(1)
    assert ids(whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:] + member(2)) == [None, 2]
    assert ids(whole[:-30] + member(2)) == [None, 2]


def test_hosts_of_very_many_labels_and_full_filters(spark, monkeypatch):
    urls_ = [(1, "http://" + "a." * 50_000 + "EXAMPLE.com/en/x"), (2, "http://" + "b." * 50_000 + "net/fr/" + "p" * 50_000), (3, None), (4, "mailto:x"), (5, "http:///en/"), (6, "://net/es/"), (7, "http://xnet/es/"), (8, "http://a.b.c/deep/er"), (9, "http://b.c/deep/er")]
    df = spark.createDataFrame(urls_, "page_id long, url string")
    rules = spark.createDataFrame([*queries.URL_RULES, ("a.b.c", "/deep/", "block"), *((f"h{i}.org", f"/{'x' * (i % 7)}", "block") for i in range(300))], "host string, path string, verdict string")
    want = {1: ("example.com/en/", "block"), 2: ("net/fr/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("net/es/", "block"), 7: (None, "allow"), 8: ("a.b.c/deep/", "block"), 9: (None, "allow")}
    for most in (1 << 16, 1):  # a filter with room, and one that passes nearly everything
        monkeypatch.setattr(urls, "MOST_BLOCKS", most)
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()} == want


def test_any_page_is_written_and_read_back(spark, tmp_path):
    """With joins by shuffles too: long addresses, those that look like heads, one payload in very many rows."""
    pages = [(1, "http://a.com/docs/WARC/1.1/x", "a"), (2, "http://b.com/" + "u" * 300_000, "b"), (3, "http://c.com/\r\nWARC/1.0\r\n", "a"), (4, None, None), (5, "WARC/1.1\r\n", ""), (6, "http://d.com", "\r\n\r\nWARC/1.1\r\n" * 3)]
    pages += [(100 + i, f"http://e.com/{i}", "hot" * 1000) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    first, want = {}, {}
    for i, _, h in pages:
        first.setdefault(h or "", i)
        want[i] = ("response", None) if first[h or ""] == i else ("revisit", first[h or ""])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = warc.read(warc.write(df, f"file://{tmp_path}/w{threshold}")).collect()
            assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(pages)
            assert all(r["gap"] is None for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
