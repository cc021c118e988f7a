import json
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from condensa.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def page(body, k=0):
    return (
        f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no</p>";x({k})</script></head><body class="post ad">'
        f'<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->'
        f'<div class="ad">Buy {k}</div><article><h1>Title {k}</h1>{body}<aside>Also {k}</aside><div id="comments"><p>First!</p></div></article>'
        f'<form><p>Your name</p><input></form><div class="sidebar"><p>Links</p></div><footer>&copy; me</footer></body></html>'
    )


CASES = [
    ("<p>One &amp; two\n  three</p><p>&#233;&nbsp;x</p>", "One & two three\né x"),
    ("<p><b>Bold.<br><p>Next <i>it</i>al</p>", "Bold.\nNext ital"),
    ("<ul><li>a<li>b</ul>loose<p>", "a\nb\nloose"),
    ("", ""),
    ("<p>a &lt;b&gt; c</p>" * 3, "\n".join(["a <b> c"] * 3)),
    ('<p title="x > y">attr</p><script>if (a<b) {}</script><header><h2>Sub</h2></header>', "attr\nSub"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p>unclosed", "unclosed"),
]


def test_articles_come_out_whole_and_alone(spark):
    rows = [(i * 10 + k, f"https://Host{k % 3}.example.com/{i}", page(body, i)) for k in range(5) for i, (body, _) in enumerate(CASES)]
    rows += [(900, None, None), (901, "::bad[", ""), (902, "http://host1.example.com", "just text"), (902, "http://host1.example.com", "just text"), (903, None, "<p>" + "long " * 100_000)]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 900:
            i = r.page_id // 10
            assert r.text == f"Title {i}" + ("\n" + CASES[i][1] if CASES[i][1] else ""), CASES[i]
        assert r.n_chars == len(r.text)
    rest = {r.page_id: r.text for r in got if r.page_id >= 900}
    assert rest == {900: "", 901: "", 902: "just text", 903: ("long " * 100_000).strip()}


def test_text_of_the_template_is_left_out_where_nothing_names_the_article(spark):
    rows = [(i, "http://plain.org/x", f"<div><div>All rights reserved</div><div><p>Story {i}</p></div></div>".replace("<div>All", "<div><span>All")) for i in range(5)]
    rows = [(i, u, h.replace("<div><span>All rights reserved</div>", "<table><tr><td>All rights reserved</table>")) for i, u, h in rows]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Story {i}" for i in range(5)}


def test_wrappers_are_union_free_and_match_all_their_pages():
    bodies = ["<p>a</p>" * k + ("<ul><li>x</li><li>y</li></ul>" if k % 2 else "") + ("<blockquote>q</blockquote>" if k % 3 == 0 else "") for k in range(8)]
    streams = [H.stream(H.blocks(page(b, k))) for k, b in enumerate(bodies)]
    wrapper = None
    for s in streams:
        one = H.fold(H._tree(s))
        wrapper = one if wrapper is None else H.fold(H.align(wrapper, one))
    regex = re.compile(H.pattern(wrapper))
    assert all(regex.fullmatch("".join(f"{t}\n" for t in s)) for s in streams) and "|" not in regex.pattern.replace("\\|", "")
    assert not regex.fullmatch("table{\n#\n}\n")


@pytest.mark.parametrize("items", [["a"] * 5, ["a", "b"] * 3, ["x", "a", "b", "c", "a", "b", "c"]])
def test_folding_finds_tandem_repeats(items):
    assert any(isinstance(x, list) and x[0] == "+" for x in H.fold(items))


def test_slots_of_the_wrapper_decide(spark):
    """The same path holds a page's own paragraph and one that every page repeats; only the wrapper tells them apart."""
    rows = [(i, "http://w.org/x", f"<div><p>Own {i}</p><ul><li>Item {i}</li></ul><p>Read more on our site</p></div>") for i in range(6)]
    rows += [(6, "http://w.org/y", "<div><p>Own 6</p></div>"), (7, "http://copies.org", "<div><p>Same</p></div>")]
    rows += [(8 + k, "http://copies.org", "<div><p>Same</p></div>") for k in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in H.extract(frame).collect()}
    assert got == {**{i: f"Own {i}\nItem {i}" for i in range(6)}, 6: "Own 6", **dict.fromkeys(range(7, 11), "Same")}
    assert {i: H.Extractor()(html) for i, _, html in rows} != got  # a page alone keeps what the host repeats


@pytest.mark.parametrize("number", [2, 3, 40])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_mirrored_pages_keep_all_of_their_text(spark, number, outer):
    body = "".join(f"<p>{' '.join([w] * 40)}</p>" for w in ("first", "second", "third"))
    rows = [(i, f"http://mirror.org/{i}", f"<nav>Home</nav><{outer}><h1>Title {i}</h1>{body}</{outer}><footer>us</footer>") for i in range(number)]
    want = "\n".join(" ".join([w] * 40) for w in ("first", "second", "third"))
    assert {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {i: f"Title {i}\n{want}" for i in range(number)}


@pytest.mark.parametrize("page, text", [
    ("<article><p>a</p>" + "<div>" * 100_000 + "<p>x</p>" + "</div>" * 100_000 + "<p>b</p></article>", "a\nx\nb"),
    ("<article>" + "<div>" * 1200 + "deep<aside>" + "<div>" * 500 + "no" + "</div>" * 500 + "</aside></article>", "deep"),
    ("<article><p>x</p>" + "<a b " * 200_000, "x\n" + ("<a b " * 200_000).strip()), ("<article><p>x</p>" + '<a b="c ' * 130_000 + "><p>tail", "x\ntail"),
    ("<article>" + "<div>" * 50_000 + "</x>" * 50_000 + "y", "y"), ("<article><ul>" + "<div>" * 40_000 + "<li>a" * 40_000, "\n".join("a" * 40_000)), ("<p>" + "<" * 200_000 + "z", "<" * 200_000 + "z"),
], ids=["deep", "deep aside", "unclosed tags", "unclosed quotes", "closers", "list items", "signs"])
def test_hard_pages_take_linear_time(spark, page, text):
    begin = time.perf_counter()
    assert H.Extractor()(page) == text
    assert time.perf_counter() - begin < 10


def test_hard_pages_do_not_stop_a_host(spark):
    rows = [(0, "http://h.org/0", "<div>" * 3000 + "<p>x</p>"), (1, "http://h.org/1", "<div>" * 3000 + "<p>y</p><p>z</p>"), (2, "http://h.org/2", "<p>" + "</p><p>".join(map(str, range(9000))))]
    rows += [(3, "http://h.org/3", "".join(f"<section class='c{i}'>{i}</section>" for i in range(4000))), (4, "http://h.org/4", "".join(f"<section class='c{i}'>{i}</section>" for i in range(4000, 0, -1)))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "x", 1: "y\nz", 2: "\n".join(map(str, range(9000))), 3: "\n".join(map(str, range(4000))), 4: "\n".join(map(str, range(4000, 0, -1)))}


@pytest.mark.parametrize("inner, text", [
    ('<div class="header"><h1>T</h1></div><p>x</p>', "T\nx"), ('<p>x</p><section id="discussion"><p>y</p></section>', "x\ny"), ('<div class="widget"><p>x</p></div>', "x"),
    ('<div class="search">x</div>', "x"), ('<p class="alert">x</p>', "x"), ('<div class="related">x</div><div id="comments">no</div><div class="ad">no</div><nav>no</nav>', "x"),
])
@pytest.mark.parametrize("outer", ["article", "main", 'div class="story"'])
def test_names_of_an_articles_own_parts_say_nothing(inner, text, outer):
    assert H.Extractor()(f"<{outer}>{inner}</{outer.split()[0]}>") == text


@pytest.mark.parametrize("seed", range(4))
def test_alignments_of_long_lists_cover_both(monkeypatch, seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(60)] for _ in range(2))
    exact = len(H._common(a, b))
    for table in (0, 40):
        monkeypatch.setattr(H, "TABLE", table)
        pairs = H._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and len(pairs) <= exact
        covers = re.compile(H.pattern(H.align(a, b)))
        assert all(covers.fullmatch("".join(f"{t}\n" for t in x)) for x in (a, b))


def test_rules_beyond_the_broadcast_meet_their_pages(spark, monkeypatch):
    rows = [(100 * h + i, f"http://h{h}.org/x", f"<div><p>Welcome {h}</p><p>Story {h} {i}</p><p>Bye</p></div>") for h in range(5) for i in range(30 if h else 90)] + [(9007, None, None), (9008, "http://one.org", "<p>x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    small = rows_of(H.extract(frame))
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(H, "PIECE", 20)
    assert rows_of(H.extract(frame)) == small and small[0].text == "Story 0 0"


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r.page_id)


def test_parse_obeys_the_pattern():
    bodies = ["<p>a</p>" * k + ("<ul><li>x</li><li>y</li></ul>" if k % 2 else "") + ("<blockquote>q</blockquote>" if k % 3 == 0 else "") for k in range(8)]
    streams = [H.stream(H.blocks(page(b, k))) for k, b in enumerate(bodies)]
    for taken in (streams[:1], streams[:3], streams):
        wrapper = None
        for s in taken:
            wrapper = H.fold(H._tree(s)) if wrapper is None else H.fold(H.align(wrapper, H.fold(H._tree(s))))
        regex = re.compile(H.pattern(wrapper))
        for s in streams + [s[:-1] for s in streams] + [[], ["}"]]:
            filled = H.parse(wrapper, s)
            assert (filled is not None) == bool(regex.fullmatch("".join(f"{t}\n" for t in s)))
            assert filled is None or len(filled) == sum(t.endswith("#") for t in s)


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'title="The hidden truth"', 'data-id="share"', 'data-role="search"', 'class="overflow-hidden"', 'class="content no-sidebar"', 'class="elementor-widget-container"', 'aria-hidden="false"', "data-class='ad' alt=\"id='menu'\""],
)
def test_containers_that_only_look_away_keep_their_text(attributes):
    for page in (f"<div {attributes}><article><p>Text</p></article></div>", f"<article><div {attributes}><p>Text</p></div></article>", f"<div {attributes}><p>Text</p></div>"):
        assert H.Extractor()(page) == "Text", page


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', 'aria-hidden="true"', 'class="big ad"', "id=comments", 'role="navigation"', "class='x.y sidebar'"])
def test_containers_that_are_away_lose_it(attributes):
    assert H.Extractor()(f"<article><p>Text</p><div {attributes}><p>No</p></div></article>") == "Text"
    assert H.Extractor()('<div class="post-comments"><p>No</p></div><div class="post-body"><p>Text</p></div>') == "Text"


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_streams_that_greed_alone_refuses_are_covered():
    cases = [([["+", ["a"]], "a"], ["a"] * 4, [0, 0, 0, 1]), ([["?", ["a", "b"]], "a"], ["a"], [2]), ([["+", ["a", ["?", ["b"]]]], "b"], ["a", "b", "a", "b"], [0, 1, 0, 2]), ([["+", [["?", ["a"]]]], "b"], ["b"], [1]), ([["{", "x{", [["+", ["a"]], "a"]]], ["x{", "a", "a", "}"], [0, 1])]
    for expression, tokens, want in cases:
        assert H.parse(expression, tokens) == want, expression
        assert H.parse(expression, [*tokens, "c"]) is None
        assert re.compile(H.pattern(expression)).fullmatch("".join(f"{t}\n" for t in tokens))
    rng = random.Random(3)

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice("tt{+?" if depth else "ttt")
            out.append(rng.choice("ab") if kind == "t" else ["{", "x{", some(depth - 1)] if kind == "{" else [kind, some(depth - 1)])
        return out

    for _ in range(300):
        expression = some(2)
        regex = re.compile(H.pattern(expression))
        for _ in range(20):
            tokens = rng.choices(["a", "b", "x{", "}"], weights=[4, 4, 1, 1], k=rng.randint(0, 7))
            assert (H.parse(expression, tokens) is not None) == bool(regex.fullmatch("".join(f"{t}\n" for t in tokens)))


def test_titles_notices_and_sections_stay_and_what_a_host_repeats_goes(spark):
    head, post, main = ("<article><div class='article-header'><h1>T{0}</h1></div><p>x{0}</p></article>", "<article class='post notice'><p>y{0}</p></article>", "<main><section id='social-history'><p>z{0}</p></section></main>")
    share = "<div><p>own {0}</p><p>more {0}</p><p>Share this story</p></div>"
    rows = [(i + 10 * k, f"http://h{k}.org/{i}", page.format(i)) for k, page in enumerate((head, post, main, share)) for i in range(5)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: f"T{i}\nx{i}" for i in range(5)} | {10 + i: f"y{i}" for i in range(5)} | {20 + i: f"z{i}" for i in range(5)} | {30 + i: f"own {i}\nmore {i}" for i in range(5)}
    assert got == want


def test_the_wrapper_tells_places_apart_that_names_and_paths_do_not(spark):
    """No names at all, the same path everywhere: what varies in its place is text, what stays is the template."""
    rows = [(i, "http://bare.org/x", "<div><p>Welcome to us</p>" + "".join(f"<p>Story {i} {j}</p>" for j in range(i % 3 + 1)) + "<p>All rights kept</p></div>") for i in range(9)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "\n".join(f"Story {i} {j}" for j in range(i % 3 + 1)) for i in range(9)}


@pytest.mark.parametrize("fan", [2, 5])
def test_rounds_of_alignments_cover_all_pages_of_a_large_host(spark, monkeypatch, fan):
    monkeypatch.setattr(H, "FAN", fan)
    rng = random.Random(5)
    bodies = ["".join(rng.choice([f"<p>a{i}{j}</p>", f"<ul><li>l{i}{j}</ul>", f"<h2>h{i}{j}</h2>", f"<blockquote>q{i}{j}</blockquote>"]) for j in range(rng.randint(1, 6))) for i in range(40)]
    frame = spark.createDataFrame([(i, "http://big.org/x", page(b, i)) for i, b in enumerate(bodies)], SCHEMA)
    named = frame.select("page_id", "html", H.host(F.col("url")).alias("host"))
    texts = H.strings(named)
    (row,) = H.wrappers(named, H._rules(texts)).collect()
    marks = frozenset((texts.first() or {"strings": ()})["strings"])
    assert all(H.parse(json.loads(row.wrapper), H.stream(H.blocks(page(b, i)), marks)) is not None for i, b in enumerate(bodies))
    assert {r.page_id: r.text.split("\n")[0] for r in H.extract(frame).collect()} == {i: f"Title {i}" for i in range(40)}


class Golden(HTMLParser):
    """Another reading of the synthetic pages: the text inside <article> by blocks, without what is marked as something else."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "br", "div", "article", "ul", "blockquote", "td", "tr", "table", "section", "figure"}
    ASIDE = {"aside", "nav", "footer", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.away, self.parts, self.divs = 0, 0, [""], []

    def handle_starttag(self, tag, attrs):
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        if tag == "div":
            self.divs.append(bool(re.search(r"\b(ad|ads|comments?|sidebar|cookie|notice|share|related)\b", named)))
            self.away += self.divs[-1]
        self.away += tag in self.ASIDE
        self.inside += tag == "article"
        self.cut(tag)

    def handle_endtag(self, tag):
        self.cut(tag)
        if tag == "div" and self.divs:
            self.away -= self.divs.pop()
        self.away -= tag in self.ASIDE and self.away > 0
        self.inside -= tag == "article"

    def cut(self, tag):
        if tag in self.BLOCKS:
            self.parts.append("")

    def handle_data(self, data):
        if self.inside > 0 and not self.away:
            self.parts[-1] += data


def test_every_synthetic_page_equals_another_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        golden = Golden()
        golden.feed(r.html or "")
        golden.close()
        assert got[r.page_id] == "\n".join(t for t in (" ".join(x.split()) for x in golden.parts) if t), r.page_id


def test_long_streams_are_parsed_like_short_ones():
    expression, unit = [["+", ["a", ["?", ["b"]]]], "b"], ["a", "b", "a"]
    for turns in (2, 300_000):
        tokens = unit * turns + ["b"]
        assert H.parse(expression, tokens) == [0, 1, 0] * turns + [2]
        assert H.parse(expression, [*tokens, "a"]) is None
    assert H.parse([["?", [f"t{i}"]] for i in range(3000)] + [["+", ["a"]], "a"], ["t7", *["a"] * 2000]) == [7, *[3000] * 1999, 3001]
