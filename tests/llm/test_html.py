"""Main-text extraction from pages."""

import collections
import random
import time

import numpy as np
import pytest

from loomspan.llm import html_text

MENU = '<nav><a href="/">Home</a></nav><header><h1>Site</h1></header><aside>More</aside>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<article><h1>T</h1><p>A  b\n c</p><p>D<b>e</b>f<p>g</article><footer>x</footer>", ["T", "A b c", "Def", "g"]),
        ("<article><p>1 &lt; 2 &amp;&amp; 3 &#62; 2 &eacute;&nbsp;x</p></article>", ["1 < 2 && 3 > 2 é x"]),
        ('<article><p>a</p><script>var t="</p><p>no</p>";</script><p>b</p></article>', ["a", "b"]),
        ('<main><div class="cookie-notice">Cookies</div><p>text</p><form><input><p>mail</p></form></main>', ["text"]),
        ('<article><p>x</p><div id="comments"><p>first!</p></div><div class="share-bar"><p>s</p></div></article>', ["x"]),
        ('<article><header><h2>Title</h2><p>by line</p></header><p>x</p></article>', ["Title", "x"]),
        ('<article><p>x<br>y<!-- <p>no --> z</p><ul><li>1<li>2</ul></article>', ["x y z", "1", "2"]),
        ('<div role="main"><p>x</p></div><div role="navigation"><p>n</p></div><p>outside</p>', ["x"]),
        ('<article class="post header"><p>kept</p></article><article class="comment"><p>no</p></article>', ["kept"]),
        ("<article><table><tr><td>a</td><td>b</td></tr></table><pre>p\n q</pre></article>", ["a", "b", "p q"]),
        ('<article><p title="a > b">x</p><p title="open>y</p></article>', ["x", "y"]),
        ("<article><p>a < b and <3</p><nav>n<p>m</article>", ["a < b and <3"]),
        ("<ARTICLE><P CLASS='Advert'>no</P><P>yes</P></ARTICLE>", ["yes"]),
        ("plain text", ["plain text"]),
        ('<main><h1>T</h1><p>one</p><article class="card"><p>teaser</p></article><p>two</p></main>', ["T", "one", "teaser", "two"]),
        ('<article><h2 id="related-work">Related work</h2><p class="widget-analysis">a</p><p>let <math><mi>x</mi></math> be</p><p class="related posts">no</p><div class="entry-share">no</div></article>', ["Related work", "a", "let x be"]),
        ("<article><p>x</p></article><p>a <b ", ["x"]),
        ("a <b b", ["a <b b"]),
        ('<article><a ">"<p>y</p></article>', ["y"]),
        ("", []),
        ("<article></article>", []),
    ],
)
def test_blocks(page, want):
    found = html_text.blocks_of(page)
    some = any(r for r, _ in found)
    assert [t for r, t in found if r or not some] == want


@pytest.mark.parametrize("unit", ["a <b ", "a <b x=\"", "<a \">\" ", "</div>x", "<b>x</div>", "<p>", "<div>", "<td>x</td>", "<span>", "<li>x", "<!-- ", "<script>", "</script ", "<script></script ", "<b>x", "&#", "<a href='", "<x/>", "<dt>", "<table><td>"])
def test_pages_are_read_in_proportion_to_their_length(unit):
    began = time.time()
    html_text.loose_blocks(unit * 100_000)
    html_text.loose_blocks("<span>" * 50_000 + unit * 50_000)
    assert time.time() - began < 5


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    rows = []
    for i in range(12):
        own = " ".join(f"own{i}word{k}" for k in range(30))
        rows.append((i, f"https://www.h.example:80/{i}?q=1", f"<div>Welcome to the oldest paper of the whole long valley</div><div>{own}</div><p>{own} all rights of this paper remain with its good editors</p><div>Home</div>"))
    copy = "<article><p>The same article stands on many pages of one host and stays as it is</p></article>"
    rows += [(20 + i, f"http://h.example/a{i}", copy) for i in range(5)]
    rows += [(30, None, None), (None, "http://x.example", ""), (31, "http://alone.example/", "<div>Welcome to the oldest paper of the whole long valley</div>"), (31, "http://alone.example/", "<div>Welcome to the oldest paper of the whole long valley</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        own = " ".join(f"own{i}word{k}" for k in range(30))
        assert by[i] == f"{own}\n{own}"
    assert all(by[20 + i].startswith("The same article") for i in range(5))
    assert by[30] == "" and by[None] == "" and by[31].startswith("Welcome")
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_a_footer_marked_on_some_pages_goes_from_all(spark):
    """Structure alone keeps the unmarked copies; the host's repeats tell. Clashing columns do no harm."""
    line = "printed every day by the good people of the long valley"
    own = [" ".join(f"own{i}word{k}" for k in range(20)) for i in range(8)]
    rows = [(i, f"http://h.example/{i}", f"<div><p>{own[i]}</p></div>" + (f"<footer>{line}</footer>" if i < 6 else f"<p>{line}</p>"), "x", 1) for i in range(8)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")).collect()
    assert {r.page_id: r.text for r in got} == dict(enumerate(own)) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]


def test_host_repeats_against_brute_force():
    """All substrings of RUN tokens and more of random blocks, counted one by one."""
    rng = random.Random(1)
    for _ in range(20):
        blocks = list({" ".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(12)})
        pages = [np.array(sorted(rng.sample(range(6), rng.randint(1, 4)))) for _ in blocks]
        on = collections.defaultdict(set)
        for b, p in zip(blocks, pages):
            t = b.split()
            for a in range(len(t)):
                for z in range(a + html_text.RUN, len(t) + 1):
                    on[tuple(t[a:z])].update(p.tolist())
        want = []
        for b, p in zip(blocks, pages):
            t = b.split()
            c = np.zeros(len(t), bool)
            if len(t) < html_text.RUN:
                c[:] = len(p) >= 3
            for a in range(len(t)):
                for z in range(a + html_text.RUN, len(t) + 1):
                    if len(on[tuple(t[a:z])]) >= 3:
                        c[a:z] = True
            want.append(c.tolist())
        assert [c.tolist() for c in html_text.repeated(blocks, pages, 6, 3)] == want


def test_repeated_runs():
    blocks = ["a b c d e f g h i", "x a b c d e f g h", "h g f e d c b a", "short one"]
    import numpy as np

    covered = html_text.repeated(blocks, [np.array([0]), np.array([1]), np.array([2]), np.array([0, 1, 2])], 3, 2)
    assert ["".join(str(int(x)) for x in c) for c in covered] == ["111111110", "011111111", "00000000", "11"]


@pytest.mark.parametrize("shard", [2000, 20])
def test_boilerplate_is_decided_for_whole_hosts_by_distinct_contents(spark, monkeypatch, shard):
    monkeypatch.setattr(html_text, "SHARD", shard)
    own = lambda h, i: " ".join(f"{h}{i}word{k}" for k in range(30))
    line = "every page of this long run carries the same words at its end"
    html = lambda h, i, more="": f"<h2>Summary</h2><p>Short note</p><p>{own(h, i)}</p><ul><li><a href='/'>Home</a></li></ul>{more}"
    rows = [(i, f"http://big.example/{i}", html("b", i, f"<div>{line}</div>" if i < 3 else "")) for i in range(100)]
    rows += [(200 + i, f"http://few.example/{i}", html("f", i, f"<div>{line}</div>" if i < 2 else "")) for i in range(100)]
    rows += [(400 + i, f"http://copies.example/{i}", f"<div>{own('c', 0)}</div><div>Contact</div>") for i in range(5)]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(100):
        assert got[i] == f"Summary\nShort note\n{own('b', i)}"
        assert got[200 + i] == f"Summary\nShort note\n{own('f', i)}" + (f"\n{line}" if i < 2 else "")
    assert all(got[400 + i] == f"{own('c', 0)}\nContact" for i in range(5))
