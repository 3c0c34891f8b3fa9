import html
import json
import re

import pytest

from vectide.llm import wrappers


def page(k, body):
    return f"""<!DOCTYPE html><html><head><title>t{k} &amp;</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <div class="cookie-notice">We use cookies {k}</div><header><h1>Site</h1></header><nav><ul><li><a href="/{k}">menu {k}<li>x</ul></nav>
    <aside>side {k}</aside><div id="sidebar"><p>side too</p></div><form><label>Mail</label><input name=q><button>Go</button></form>
    {body}<section class="comments"><article><p>reader {k}</p></article></section><footer>&copy; {k}</footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head</h1><p><b>One &amp; two.<br><p>Three\n  four</article>", "Head\n\nOne & two.\n\nThree four"),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>A<script>x<p></script>B<!-- <p>no</p> --></p><div class='ad'>buy</div><ul><li>i<li>j</ul><footer>end</footer></article>", "Head\n\nAB\n\ni\n\nj"),
        ("<main><div><p>In <a href='x>y'>main</a> &eacute;&#8212;&nbsp;z</p></div></main>", "In main é— z"),
        ("<article>loose <i>text</i><p></p> tail<table><tr><td>c1<td>c2</table></article>", "loose text\n\ntail\n\nc1\n\nc2"),
        ("<article></article>", ""),
        ("<article><p>unclosed <a href=\"x>quote</a> here</p></article>", "unclosed quote here"),
    ],
)
def test_markup(body, want):
    for w in ({}, wrappers.induce([page(k, body.replace("A", f"A{k}")) for k in range(4)])):
        assert wrappers.extract(page(1, body), w) == want


def test_template_without_semantic_elements():
    words = ["red fox runs", "blue bird sings", "old man sleeps", "new day comes", "big dog barks"]
    pages = [f"<html><body><div class=top><p>Welcome to the site</p></div><div class=c><p>{w} one</p><p>{w} two</p></div><div class=low><p>Made with care</p></div></body></html>" for w in words]
    w = wrappers.induce(pages)
    assert w["content"] == "html/body/div.c"
    assert [wrappers.extract(p, w) for p in pages] == [f"{x} one\n\n{x} two" for x in words]
    flat = [f"<body><p>Welcome to the site</p><p>{x} one</p><p>Made with care</p></body>" for x in words]
    assert [wrappers.extract(p, wrappers.induce(flat)) for p in flat] == [f"{x} one" for x in words]


def brute_match(a, b):
    x, y = a.children(), b.children()

    def best(i, j):
        if i == len(x) or j == len(y):
            return 0
        take = best(i + 1, j + 1) + brute_match(x[i], y[j]) if x[i].key == y[j].key else 0
        return max(take, best(i + 1, j), best(i, j + 1))

    return 1 + best(0, 0)


def test_tree_matching_is_largest():
    docs = ["<div><p>a</p><ul><li>1</li><li>2</li></ul><p>b</p></div>", "<div><ul><li>1</li></ul><p>b</p><p>c</p><ul><li>2</li><li>3</li></ul></div>", "<div><p>z</p></div><div><ul></ul></div>"]
    trees = [wrappers.parse(d) for d in docs]
    for a in trees:
        for b in trees:
            size, pairs = wrappers.match(a, b)
            assert size == brute_match(a, b) == sum(1 for _ in wrappers._flat(pairs))


def test_odd_pages(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    rows = [(1, "http://a.b/x", page(1, "<article><p>Hi</p></article>"), 9), (1, "http://a.b/x", page(1, "<article><p>Hi</p></article>"), 9), (2, None, None, 1), (3, "", "", 2), (4, "nohost", "<" * 2000 + "a" + "<div>" * 5000 + "deep", 3), (5, "http://a.b/y", long, 4), (6, "http://c.d", "plain", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in wrappers.main_texts(df).collect()}
    assert wrappers.main_texts(df).count() == 7 and wrappers.main_texts(df.limit(0)).count() == 0
    assert got[1].text == "Hi" and got[2].text == "" and got[3].text == "" and got[6].text == "plain" and got[4].text.endswith("deep")
    assert got[5].text == "\n\n".join(["word & word"] * 20_000) and got[5].n_chars == len(got[5].text)


def test_whole_table_against_its_markup(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.main_texts(df).collect()}
    for r in df.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_wrappers_are_json(spark):
    df = spark.createDataFrame([("h", page(k, f"<article><p>{k}</p></article>")) for k in range(20)], "host string, html string")
    (row,) = wrappers.host_wrappers(df).collect()
    assert json.loads(row.wrapper)["content"] == "html/body/article"


def test_rare_template_of_a_large_host(spark):
    usual = [f"<html><body><div class=a><p>usual {k} says {k * 7}</p></div><div class=b><p>Usual site line</p></div></body></html>" for k in range(200)]
    rare = [f"<html><body><table><tr><td class=x><div class=m>menu of the rare part</div><div class=t><p>rare {k} tells {k * 3} things</p></div></td></tr></table></body></html>" for k in range(5)]
    df = spark.createDataFrame([(k, "http://big.host/x", p) for k, p in enumerate(usual + rare)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(df).collect()}
    assert [got[k] for k in range(200)] == [f"usual {k} says {k * 7}" for k in range(200)]
    assert [got[200 + k] for k in range(5)] == [f"rare {k} tells {k * 3} things" for k in range(5)]
    (row,) = wrappers.host_wrappers(df.selectExpr("'h' AS host", "html")).collect()
    assert json.loads(row.wrapper) == wrappers.induce(usual + rare)


def test_wrapper_decides_inside_articles():
    texts = [f"report {k} tells at some length what happened in town {k * 7} last week" for k in range(6)]
    advert = [f"<body><article><p>{x}</p><div class=box>Buy our lamps today</div></article></body>" for x in texts]
    assert [wrappers.extract(p, wrappers.induce(advert)) for p in advert] == texts
    teaser = [f"<body><div class=story><p>{x}</p><p>{x} again</p></div><article><p>more {k}</p></article></body>" for k, x in enumerate(texts)]
    assert [wrappers.extract(p, wrappers.induce(teaser)) for p in teaser] == [f"{x}\n\n{x} again" for x in texts]


def test_copies_do_not_erase_each_other():
    same = "".join(f"<p>paragraph {k} of a text that many pages of the host repeat</p>" for k in range(8))
    copies = [f"<body><article>{same}<p>edited {k}</p></article></body>" for k in range(6)]
    w = wrappers.induce(copies)
    assert all(wrappers.extract(p, w).count("paragraph") == 8 and f"edited {k}" in wrappers.extract(p, w) for k, p in enumerate(copies))
    assert wrappers.extract(copies[0], wrappers.induce(copies[:1] * 9)).count("paragraph") == 8


@pytest.mark.parametrize(
    "body,want",
    [
        ("<div class='layout no-sidebar'><article><p>Text</p></article></div>", "Text"),
        ("<div id=page class=with-sidebar><div class=sidebar>side</div><article><p>Text</p></article></div>", "Text"),
        ("<form class=search><div class=overlay><main><p>Text</p></main></div></form><nav>menu</nav>", "Text"),
        ("<div class=has-header><p>Text</p></div><div class=site-footer>low</div>", "Text"),
        ("<div class=header><article><p>Text</p></article></div>", "Text"),
        ("<article><p class=legal>The law says <span class=search>so</span></p><div class=notice><p>Note</p></div><div class=ad>buy</div></article>", "The law says so\n\nNote"),
        ("<div class=modal><p>All there is</p></div>", "All there is"),
    ],
)
def test_names_do_not_drop_the_text(body, want):
    assert wrappers.extract(f"<html><body>{body}</body></html>", {}) == want


def test_all_regions_are_read():
    parts = "<article><p>First part</p></article><article class=comment><p>a reader says</p></article><article><p>Second and longer part</p></article><article class=teaser><p>more news</p></article>"
    assert wrappers.extract(f"<body>{parts}</body>", {}) == "First part\n\nSecond and longer part"
    nested = "<div itemprop=articleBody><article><p>Text</p><article><p>inner</p></article></article></div>"
    assert wrappers.extract(f"<body>{nested}</body>", {}) == "Text\n\ninner"
    pages = [f"<body><p>Site</p><div class=c><p>opening {k} of the text</p></div><p>Site middle</p><div class=c><p>and its ending {k}</p></div></body>" for k in range(5)]
    w = wrappers.induce(pages)
    assert w["content"] == "body/div.c"
    assert [wrappers.extract(p, w) for p in pages] == [f"opening {k} of the text\n\nand its ending {k}" for k in range(5)]
    split = [f"<body><article class=one><p>the long first part {k} of it {k * 3}</p></article><article class=two><p>second part {k}</p></article></body>" for k in range(5)]
    assert [wrappers.extract(p, wrappers.induce(split)) for p in split] == [f"the long first part {k} of it {k * 3}\n\nsecond part {k}" for k in range(5)]


def test_letters_that_grow_in_lower_case_do_not_shift_the_text():
    dotted = "İ" * 60
    body = f"<article><p>{dotted}</p><script>x</SCRIPT ><p>second</p><style>y</scripty></style><p>third</p></article>"
    assert wrappers.extract(f"<body>{body}</body>", {}) == f"{dotted}\n\nsecond\n\nthird"


def test_wide_siblings_are_matched_in_order(spark):
    def wide(n, step):
        return "<html><body><div class=menu>Site menu</div><div class=c>" + "".join(f"<div class=k{j}><p>text {j} of {n}</p></div>" for j in range(0, 5000, step)) + "</div></body></html>"

    a, b = wrappers.Outline(wrappers.parse(wide(1, 1))), wrappers.Outline(wrappers.parse(wide(2, 2)))
    (x, _), (y, _) = wrappers._tree(a.skeleton), wrappers._tree(b.skeleton)
    assert wrappers.match(x, y)[0] == len(b.skeleton) + 1
    pages = [wide(k, 1) for k in range(4)]
    w = wrappers.induce(pages)
    assert [wrappers.extract(p, w) for p in pages] == ["\n\n".join(f"text {j} of {k}" for j in range(5000)) for k in range(4)]


def test_shapes_in_parts_give_the_same_templates(spark, monkeypatch):
    usual = [f"<html><body><div class=a><p>usual {k} says {k * 7}</p>{'<ul><li>x</ul>' if k % 2 else ''}{'<h2>y</h2>' if k % 3 else ''}{'<table><tr><td>z</table>' if k % 5 else ''}</div><div class=b><p>Usual site line</p><div><p>and more of it</p></div></div></body></html>" for k in range(60)]
    rare = [f"<html><body><table><tr><td class=x><div class=m>menu of the rare part</div><div class=t><p>rare {k} tells {k * 3} things</p></div></td></tr></table></body></html>" for k in range(5)]
    df = spark.createDataFrame([("h", p) for p in usual + rare], "host string, html string")
    whole = json.loads(wrappers.host_wrappers(df).first().wrapper)
    monkeypatch.setattr(wrappers, "SHAPES_PER_TASK", 2)
    parts = json.loads(wrappers.host_wrappers(df).first().wrapper)
    assert parts == whole and len(whole["others"]) == 1


def test_how_many_pages_the_wrapper_changes():
    pages = [f"<html><body><div class=shell><div class=top><p>Welcome to our site</p></div><div class=c><p>story {k} of the day {k * 31}</p><div class=box><p>Read our rules</p></div><p>and how it ended {k}</p></div></div></body></html>" for k in range(10)]
    w = wrappers.induce(pages)
    got = [wrappers.extract(p, w) for p in pages]
    assert got == [f"story {k} of the day {k * 31}\n\nand how it ended {k}" for k in range(10)]
    assert sum(g != wrappers.extract(p, {}) for g, p in zip(got, pages, strict=True)) == 10
