"""Main texts: templates built here, whose main text is known."""

import html
import json
import random

import pytest

from pairloom.llm import wrappers as wr

WORDS = "river stone winter garden letter silver mountain evening market window bridge candle forest harbor meadow & < é ü 漢字".split()
SCHEMA = "page_id long, url string, html string, text string, n_chars string, host string"


def words(g, low, high):
    return " ".join(g.choice(WORDS) for _ in range(g.randint(low, high)))


def semantic(g, k):
    """Elements say what they are."""
    title, paras = words(g, 3, 8), [words(g, 10, 60) for _ in range(g.randint(1, 9))]
    quote = f"<blockquote>{html.escape(words(g, 5, 9))}</blockquote>" if g.random() < 0.4 else ""
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paras)
    side = "".join(f"<p>{html.escape(words(g, 9, 20))}</p>" for _ in range(g.randint(2, 5)))
    page = (
        f"<html><head><title>{html.escape(title)}</title><style>p > a {{}}</style></head><body class=x><header><h1>The Site {k % 3}</h1></header><nav><a href=/>Home</a> <a href=/x>All</a></nav>"
        f"<div class='cookie-notice'>We use {k} cookies &amp; more.</div><article><h1>{html.escape(title)}</h1>{quote}{body}<form><input><button>Send {k}</button></form></article>"
        f"<aside>{side}</aside><section id=comments><h3>Comments</h3>{side}{side}</section><script>if (a<b) document.write('<p>no</p>')</script><footer>&copy; {k}</footer></body></html>"
    )
    return page, [title, *([html.unescape(quote[12:-13])] if quote else []), *paras]


def plain(g, k):
    """Nothing but div, table and p: menus are links, the notice is text of the template."""
    paras = [words(g, 30, 80) for _ in range(g.randint(2, 7))]
    links = "".join(f"<li><a href='/{i}'>{html.escape(words(g, 1, 3))}</a>" for i in range(g.randint(3, 9)))
    page = (
        f"<body><div><ul>{links}</ul></div><div><p>All that is printed here may be read by members alone, as was agreed.</div>"
        f"<div><table><tr><td><p>{'<p>'.join(html.escape(p) for p in paras)}</td></tr></table></div><div><ul>{links}</ul></div>"
    )
    return page, paras


def classes(g, k):
    """Classes and ids tell menus, adverts and comments; the comments hold more than the article."""
    paras = [words(g, 15, 40) for _ in range(g.randint(1, 5))]
    body = "".join(f"<p class=p{k}>{html.escape(p)}</p>" + (f"<div class='advert-{k}'>{html.escape(words(g, 20, 30))}</div>" if g.random() < 0.3 else "") for p in paras)
    talk = "".join(f"<li class='c{k}'><p>{html.escape(words(g, 60, 90))}</p>" for _ in range(4))
    return f"<div id=menu><p>{words(g, 2, 4)}</div><div id='content-{k}'>{body}</div><ol class='comment-list'>{talk}</ol><div id=footer>x {k}</div>", paras


MADE = {"semantic": semantic, "plain": plain, "classes": classes}


def made(name, pages, seed=1):
    g = random.Random(seed)
    told = [MADE[name](g, k) for k in range(pages)]
    return [(k, f"https://{name}.example.org/{k}", p, None, None, None) for k, (p, _) in enumerate(told)], {k: " ".join(" ".join(t).split()) for k, (_, t) in enumerate(told)}


def texts(spark, rows):
    return [tuple(r) for r in wr.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()]


@pytest.mark.parametrize("name", MADE)
def test_templates(spark, name):
    rows, want = made(name, 40)
    got = texts(spark, rows)
    assert {r[0]: r[2] for r in got} == want and all(r[3] == len(r[2]) for r in got) and len(got) == 40


@pytest.mark.parametrize("name", ["semantic", "classes"])
def test_only_page_of_a_host(spark, name):
    rows, want = made(name, 1, seed=4)
    assert texts(spark, rows)[0][2] == want[0]


def test_parts_of_a_host_give_the_same_texts(spark, monkeypatch):
    rows, want = made("semantic", 30, seed=3)
    rows = rows + [(100 + r[0], r[1].replace("semantic", "plain"), *r[2:]) for r in made("plain", 30)[0]]
    got = []
    for salt in (1, 7):
        monkeypatch.setattr(wr, "SALT", salt)
        got.append(sorted(texts(spark, rows)))
    assert got[0] == got[1] and {r[0]: r[2] for r in got[0] if r[0] < 100} == want


def test_copies_are_not_text_of_the_template(spark):
    page = made("plain", 1)[0][0][2]
    got = texts(spark, [(k, f"http://h.org/{k}", page, None, None, None) for k in range(6)])
    assert len({r[2] for r in got}) == 1 and made("plain", 1)[1][0] in got[0][2]


def read(source):
    return [t for _, _, t, _ in wr.read_by(wr.Page(source).root, None)]


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a <b>b</b>c\n\t d&nbsp;e&amp;lt;<br>f<p>g", ["a bc d e&lt; f", "g"]),
        ("x <!-- <p>no --> y <![CDATA[<z> &amp;]]>", ["x y <z> &amp;"]),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5", ["1", "2", "3", "4", "5"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ('<div title="a > b" class=\'x>y\'>in</div>a < b > c <3', ["in", "a < b > c <3"]),
        ("a<script>'</p><p>'</SCRIPT>b<style>x</style>c", ["a", "b", "c"]),
        ("a<p>b<div class='no end", ["a", "b"]),
        ("a<!-- never ends <p>b", ["a"]),
        ("İ<script>İ</ScRiPt>ok", ["İ", "ok"]),
        ("<p>&#x41;&#66;&unknown; &copy</p></p></div>z", ["AB&unknown; ©", "z"]),
        ("<div>" * 5000 + "deep" + "</div>" * 5000 + "out", ["deep", "out"]),
        ("", []),
    ],
)
def test_page_texts(source, want):
    assert read(source) == want


def test_folding_and_alignment():
    def sk(source):
        return wr.skeleton(wr.Page(source).root)

    def shape(items):
        return "".join((("(" + shape(x[3]) + ")") if x[0] == "(" else x[0] + (f"[{shape(x[3])}]" if x[3] and x[0] != "#" else "")) + ["", "?", "+", "*"][x[1]] + " " for x in items).strip()

    assert shape(sk("<dl>" + "<dt>a<dd>b" * 5 + "</dl>")) == "dl[(dt[#] dd[#])+]"
    assert shape(sk("<p>a<p>b<hr><p>c")) == "p[#]+"
    one, two = sk("<h1>t</h1><p>a<p>b"), sk("<h1>u</h1><div><ul><li>x</ul></div><p>a")
    assert shape(wr.aligned(one, two)) == shape(wr.aligned(two, one)) == "h1[#] div[ul[li[#]]]? p[#]+"
    assert shape(wr.aligned(sk("<dl><dt>a<dd>b</dl>"), sk("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))) == "dl[(dt[#] dd[#])+]"
    again = wr.aligned(one, one)
    assert shape(again) == shape(one) and [x[2] for x in again] == [2, 2]


def test_wrappers_stay_bounded_and_lose_no_text():
    known = None
    pages = [f"<article><p>a{k}</article>" + "".join(f"<div class='x{chr(97 + k % 26)}{chr(97 + i)}'><p>t{i}</div>" for i in range(26)) for k in range(200)]
    for p in pages:
        known = wr.aligned(known, wr.skeleton(wr.Page(p).root))
    assert wr._size(known) <= wr.NODES
    slot = wr.wrapper(wr.dumped(known))
    for k, p in enumerate(pages):
        assert [t for _, _, t, _ in wr.read_by(wr.Page(p).root, slot)] == [f"a{k}", *(f"t{i}" for i in range(26))]
    assert json.loads(wr.dumped(known))[0][2] == 200


def test_odd_rows(spark):
    x = (None, None, None)
    long = "word " * 300_000
    rows = [(1, "http://a.org/", None, *x), (2, "http://a.org/", "", *x), (3, None, "<p>a b", *x), (None, "no host", "<p>c", *x), (4, "http://A.org/x", f"<article><p>{long}</article>", *x)]
    rows += [(5, "http://b.org/", "<nav><a>x</a></nav><footer>y</footer>", *x)] * 2 + [(6, "http://c.org", " \n ", *x), (7, "http://d.org", "<a href=x>all is a link<p>really", *x)]
    got = sorted(texts(spark, rows), key=str)
    by = {r[0]: r[2] for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[5] == by[6] == "" and by[3] == "a b" and by[None] == "c" and by[4] == long.strip()
    assert {r[3] for r in got if r[0] == 5} == {0}
    assert texts(spark, []) == []


@pytest.mark.parametrize("source, texts_", [("<div>" * 60_000 + "x", 1), ("<div><ul><li>a<li>b" * 5000, 10_000), ("<a href='" * 20_000, 0), ("<td>x" * 30_000, 30_000)])
def test_odd_markup_takes_linear_time(source, texts_):
    root = wr.Page(source).root
    assert sum(1 for _ in wr.read_by(root, wr.wrapper(wr.dumped(wr.skeleton(root))))) == texts_
