import html
import re
import time

import pytest

from lexloom.llm import html_text, queries
from lexloom.llm.html_text import main_text

SF = "/root/testdata/sf0.01"


def by_template(page):
    """The article of the test tables' pages, which all have one <article>, by its own plain rules."""
    if "<article>" not in page:
        return ""
    inside = re.split(r"</article|<footer|<foote?$|<foo?$|</?f?$", page.split("<article>", 1)[1])[0]
    inside = re.sub(r"</?[a-z][^>]*$|</?$", "", inside)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
    return "\n".join(p for p in parts if p)


def test_query_equals_the_template(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op6_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]
        assert r["url"] == page["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == by_template(page["html"]), page["html"][-300:]


LONG = "The cat sat on the mat and it was as happy as it could be with all of the others in the house by the sea. " * 3
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">More of the news</a></li></ul></nav>'


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a &amp; b&nbsp;&#65;&lt;i&gt;</p><p> c\n\t d</p>", "a & b A<i>\nc d"),
        (f"{NAV}<article><h1>T</h1><p>Hi.</p><p>{LONG}</p><p>Bye</p></article><footer>&copy; x</footer>", f"T\nHi.\n{LONG.strip()}\nBye"),
        (f"<header>Site</header><main><p>Short</p></main><aside>{LONG}</aside>", "Short"),
        (f"<article><p>One</p><aside>{LONG}</aside><div class='cookie-notice'>{LONG}</div><p>Two</p><section id=comments><p>{LONG}</p></section></article>", "One\nTwo"),
        ("<article><p>a<script>var x='<p>no</p>';</script>b<style>p{}</style><!-- c --></p><form><p>Name</p><input></form></article>", "ab"),
        (f"<body>{NAV}<div class=sidebar>{LONG}</div><div><h2>Head</h2><p>{LONG}</p><p>Short one.</p></div><div id='footer'>{LONG}</div></body>", f"Head\n{LONG.strip()}\nShort one."),
        (f"<div><p>{LONG}</p><ul><li><a href=x>Read this too</a></li><li><a href=y>And that</a></li></ul></div>", LONG.strip()),
        ('<div class="post-content"><p>x</p><p title="a>b">y</p></div><div class="adbox"><p>z</p></div>', "x\ny"),
        ("<article><p>cut of", "cut of"),
        (f"<div class='layout with-sidebar'><article><header class='post-header'><h1>T</h1></header><p>x</p></article><div class='sidebar'>{LONG}</div></div>", "T\nx"),
        ("<article><p>cut</p></artic", "cut"),
        ("<article><p>1 < 2 and a<b></b>c <3</p></article>", "1 < 2 and ac <3"),
        ("<article><p><b>open<br><p>next &am", "open\nnext &am"),
        ("<article><p class=\"x>odd</p><p>text</p></article>", "odd\ntext"),
        ("<script>only", ""),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


PROSE = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article>P<svg class="i"/>P</article>', "PP"),
        (f"<article><p>{LONG}</p><video src=x><p>after</p><iframe src=y><p>it</p></article>", f"{PROSE}\nafter\nit"),
        (f"<article><p>{LONG}</p><svg><text>no</text></svg><select><option>a</select><math><mi>a</mi><mo>+</mo></math></article>", f"{PROSE}\na+"),
        (f"<div><p>{LONG} © 2020 {LONG}</p><p>© 2024 Site</p></div>", f"{PROSE} © 2020 {PROSE}"),
        (f'<article><div class="related-work"><p>{LONG}</p></div><p id="social">short one</p></article>', f"{PROSE}\nshort one"),
        (f"<article><p>{LONG}</p><h2>References</h2><ul><li><a href=x>Knuth</a></li><li><a href=y>Dijkstra</a></li></ul></article>", f"{PROSE}\nReferences\nKnuth\nDijkstra"),
        (f"<article><p>{LONG}</p><p>one</p><p>two</p><div class=share><a href=x>Send it to a friend</a></div></article>", f"{PROSE}\none\ntwo"),
        (f"<div class=share><p>{LONG}</p><p><a href=x>Send it to a friend</a></p></div>", PROSE),
        ("<title>cut", ""),
    ],
)
def test_markup_is_a_feature_and_loses_no_text(page, text):
    assert main_text(page) == text


OTHER = "A dog ran by the river and it was not as quick as the one that had been there in the morning with all of its friends. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=aspnet>{NAV}<div><h1>T</h1><p>{LONG}</p></div><div class=sidebar>{OTHER}</div></form></body>", f"T\n{PROSE}"),
        (f'<div id="sidebar-left-layout"><article><h1>T</h1><p>{LONG}</p></article></div>', f"T\n{PROSE}"),
        (f'<div class="page-with-nav menu"><div><p>{LONG}</p></div><div class=menu>{OTHER}</div><div class=ads>{OTHER}</div></div>', PROSE),
        (f"<div><p>{LONG}</p></div><form><p>{OTHER}</p></form>", PROSE),  # a form with less than half of it
        (f"<article><p>One</p></article><form><p>{LONG}</p></form>", "One"),  # an article is marked outside
        (f"<div><p>{OTHER}</p></div><div class=comments><p>{LONG}</p><p>{LONG}</p></div>", OTHER.strip()),  # comments are none, however long
        (f'<article><p>{LONG}</p><section id="menu"><p>{OTHER * 2}</p></section><div class=sidebar><a href=x>Read this too</a></div></article>', f"{PROSE}\n{(OTHER * 2).strip()}"),
        (f"<div><p><a name=top>{LONG}</a></p><p><a href=x>{LONG}</a></p></div>", PROSE),
        (f"<div><p>{LONG}</p><p>The sign © stands for the rights of those who wrote the work, and it was in the law by then.</p><p>Copyright by us</p><p>All © 2020</p></div>", f"{PROSE}\nThe sign © stands for the rights of those who wrote the work, and it was in the law by then."),
    ],
)
def test_wrappers_anchors_and_signs_lose_no_text(page, text):
    assert main_text(page) == text


def by_brute_force(found, rules=html_text.Rules()):
    """Labels by the two passes as the module's text has them, block against block."""
    marked = any(b.region > 0 for b in found)
    asked = [b for b in found if b.region >= (1 if marked else 0)]

    def first(b):
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        stop = sum(w in html_text._STOP for w in words) / max(1, len(words))
        links, n, sure = b.linked / len(b.text), len(b.text), b.region == 1
        if links > rules.max_links or (not sure and n < rules.long and re.search(r"(?i)^\W*(copyright\b|©)|©\s*(19|20)\d\d", b.text)):
            return "?" if sure else "bad"
        if n >= rules.short and (stop >= rules.stop_high or (n >= rules.long and stop >= rules.stop_low)):
            return "good"
        return "?" if n < rules.short or stop >= rules.stop_low or sure else "bad"

    labels = [first(b) for b in asked]
    out = {}
    for i, b in enumerate(asked):
        label = labels[i]
        if label == "?":
            ok = [j for j in range(len(asked)) if labels[j] != "?" and (b.region != 1 or asked[j].region == 1)]
            back, on = max((j for j in ok if j < i), default=None), min((j for j in ok if j > i), default=None)
            if back is None and on is None:
                label = "good" if marked else "bad"
            elif back is None or on is None:
                label = labels[on if back is None else back]
            elif b.heading or i - back > on - i:
                label = labels[on]
            elif i - back < on - i:
                label = labels[back]
            else:
                label = "good" if "good" in (labels[back], labels[on]) else "bad"
        out[id(b)] = label == "good"
    if not marked and not any(out.values()):
        out = {id(b): b.linked <= rules.max_links * len(b.text) for b in asked}
    return [out.get(id(b), False) for b in found]


@pytest.mark.parametrize("marked", [True, False])
def test_passes_equal_brute_force_on_whole_tables(spark, marked):
    """As they are, and without their article marks, when densities alone decide."""
    decided = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = r["html"] if marked else re.sub("</?article>", "", r["html"])
        found = html_text.blocks(page)
        html_text.classify(found)
        assert [b.label > 0 for b in found] == by_brute_force(found)
        decided += [b.decided for b in found if b.region >= 0 and (b.region > 0 or not marked)]
    assert decided.count("density") > 0.5 * len(decided)


def test_short_blocks_inherit_from_the_nearest():
    bad = "buy " * 60
    page = f"<div><p>{LONG}</p><p>near good</p><p>{bad}</p><p>near bad</p><p>{bad}</p></div>"
    assert main_text(page) == f"{LONG.strip()}\nnear good"


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "<p>" + "word " * 200000 + "</p>", 6), (None, "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text int")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 1), (1, 0), (1, 0), (2, 999999)]
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("part", ["<video src=x>a ", "<svg>a ", "<title>a ", "<!-- a ", "<script>a ", "<p title='a ", "<div>a ", "</div>a ", "< a ", "&amp", "<a href=x>a "])
def test_long_broken_pages_take_linear_time(part):
    began = time.process_time()
    main_text(f"<article><p>{PROSE}</p>" + part * 20000)
    assert time.process_time() - began < 10
