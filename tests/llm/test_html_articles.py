"""Whole texts of small pages, labelled by hand."""

import pytest

from conceptloom.llm import htmltext

A, B = "The first paragraph of the article says something about the weather in spring.", "The second paragraph goes on, and says more about it; it ends here."
MENU = "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>"


def article(inner, before="", after=""):
    return f"<html><body>{MENU}{before}<article><p>{A}</p>{inner}<p>{B}</p></article>{after}<footer>(c) us</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<ul><li>one</li><li>two</li></ul>", "one\ntwo"),
        ("<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>", "a\n1\nb\n2"),
        ("<p><a href=x>More here</a></p>", "More here"),
        ("<dl><dt>k</dt><dd>v</dd></dl>", "k\nv"),
        ("<!-->", ""), ("<!--->", ""), ("<!-- x --!>", ""), ("<![CDATA[ x >", ""), ("<!-- a > b -->", ""), ("<!doctype x>", ""), ("<?x y>", ""), ("<!>", ""),
        ("<svg><![CDATA[ <p>no</p> ]]><text>no</text></svg>", ""),
        ("<form><label>Your name</label><input></form>", ""),
        ("<aside>Buy this now</aside>", ""),
        ("<div class='share'><a href=x>Share</a></div>", ""),
        ("<h2>Part</h2>", "Part"),
        ("<pre>x = 1</pre>", "x = 1"),
    ],
)
def test_what_an_article_keeps(inner, text):
    assert htmltext.main_text(article(inner)) == "\n".join(x for x in (A, text, B) if x)


@pytest.mark.parametrize("inner", ["<ul><li>one</li><li>two</li></ul>", "<ul><li>a</li><li>b</li><li>c</li><li>d</li><li>e</li></ul>", "<p><a href=x>Source</a></p>"])
def test_ends_of_articles(inner):
    page = f"<article><p>{A}</p><p>{B}</p>{inner}</article>"
    assert htmltext.main_text(page).split("\n")[:2] == [A, B] and len(htmltext.main_text(page).split("\n")) == 2 + inner.count("<li>") + inner.count("<p>")


def test_a_short_article():
    assert htmltext.main_text("<article><p>OK</p></article>") == htmltext.main_text("<main><p>OK</p></main>") == "OK"


@pytest.mark.parametrize("wrapper", ["<div class='form'>", "<div class='read more'>", "<div class='side-by-side'>", "<div id='comments-off'>", "<form id=aspnet>", "<div class='search-page'><div class='meta'>"])
def test_content_outvotes_the_name_of_its_wrapper(wrapper):
    page = f"<body>{MENU}{wrapper}<article><h1>Title here</h1><p>{A}</p><p>{B}</p></article>{'</div>' * wrapper.count('<div')}<footer>(c) us</footer>"
    assert htmltext.main_text(page) == f"Title here\n{A}\n{B}"


def test_comments_do_not_outvote():
    """Readers' comments that are longer than the article."""
    comments = "".join(f"<article class=comment><p>{B} Number {i}, which I liked as well.</p></article>" for i in range(3))
    page = f"<body><article><h1>T</h1><p>{A}</p><p>{B}</p></article><section id=comments>{comments}</section></body>"
    assert htmltext.main_text(page) == f"T\n{A}\n{B}"


def test_pages_without_marks():
    """No article element: prose and the lists between it stay, lists of links go."""
    links = "<ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(8)) + "</ul>"
    page = f"<body><div>{links}</div><div><p>{A} {B}</p><ul><li>eggs</li><li>flour</li><li>butter and milk</li></ul><p>{B} {A}</p></div><div>{links}</div></body>"
    assert htmltext.main_text(page) == f"{A} {B}\neggs\nflour\nbutter and milk\n{B} {A}"
