import pytest

from hydrolens.llm.html import furniture, main_text

LONG = [f"Paragraph {i} tells, at some length, what the river did on its way, and why, in the year of the flood." for i in range(6)]
PARAS = "".join(f"<p>{t}</p>" for t in LONG)
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Link, number {i}, of the menu</a></li>" for i in range(60)) + "</ul>"


def page(body, body_class=""):
    return f"<html><head><title>t</title></head><body class='{body_class}'>{body}</body></html>"


@pytest.mark.parametrize("body", [
    f"<div class='has-sidebar'><article>{PARAS}</article></div>",
    f"<div class='content navbar-fixed'><article>{PARAS}</article></div>",
    f"<div class='sidebar'><main>{PARAS}</main></div>",
    f"<div class='has-sidebar'>{PARAS}</div>",
    f"<div class='nav-bar'>{MENU}</div><article>{PARAS}</article><div class='site-menu'>{MENU}</div>",
    f"<article>{PARAS}</article><div id='comments'>" + "".join(f"<article class='comment'><p>{t}</p></article>" for t in LONG * 3) + "</div>",
    f"<article>{PARAS}<div class='post-comments'>{PARAS}{PARAS}{PARAS}</div></article>",
    f"<div class='related-posts'><article><p>{LONG[0]}</p></article></div><article>{PARAS}</article>",
])
def test_furniture_goes_and_the_article_stays(body):
    assert main_text(page(body, "no-sidebar")) == "\n\n".join(LONG)


def test_a_section_named_after_a_furniture_word_is_text():
    body = f"<article><h1>Head</h1><section id='market-share'>{PARAS}</section><p>Short tail.</p></article>"
    assert main_text(page(body)) == "\n\n".join(["Head", *LONG, "Short tail."])


def test_all_of_the_article_around_the_best_container_is_kept():
    body = f"<article><h1>Head</h1><div>{PARAS}</div><p>Short.</p></article>"
    assert main_text(page(body)) == "\n\n".join(["Head", *LONG, "Short."])
    body = f"<article><section>{PARAS}</section><section><h2>Code</h2><pre>a  b</pre><table><tr><td>1</td><td>2</td></tr></table></section></article>"
    assert main_text(page(body)) == "\n\n".join([*LONG, "Code", "a b", "1", "2"])


def test_furniture_names():
    assert [furniture(m) for m in ("share", "market-share", "has-sidebar wide", "post-comments", "shareholders", "", "wide nav", "navbar")] == [2, 1, 1, 2, 0, 0, 2, 2]


def test_many_marked_siblings_take_linear_time():
    body = f"<article>{PARAS}</article>" + "<div class='ad'><p>buy</p></div>" * 50000
    assert main_text(page(body)) == "\n\n".join(LONG)
