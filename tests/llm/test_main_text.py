"""Operator 2: names of page furniture on what holds the article, pages without an article element, cut tags."""

import pytest

from tenure.llm.html_text import main_text

FIRST, SECOND = "Long words of the article stand here. " * 12, "And more of them follow below. " * 9
BODY = f"<p>{FIRST}</p><p>{SECOND}</p>"
TEXT = f"{FIRST.strip()}\n{SECOND.strip()}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div id='content-sidebar-wrap'><article><h1>T</h1>{BODY}</article><div class='sidebar'>Beside it</div></div>", f"T\n{TEXT}"),
        (f"<div class='content has-sidebar'><article>{BODY}</article></div><div class=cookie-notice>We use cookies</div>", TEXT),
        (f"<div class='page-with-nav'><article>{BODY}</article><div class=nav><a href=x>One</a></div></div>", TEXT),
        (f"<div class='share-price-news'><article>{BODY}</article></div>", TEXT),
        (f"<form id=page><div>{BODY}<input></div></form>", TEXT),
        (f"<article><div class='entry-header'><h1>Head</h1></div>{BODY}</article>", f"Head\n{TEXT}"),
        (f"<article><div class='body with-sidebar'>{BODY}</div></article>", TEXT),
        (f"<article><p>Short.</p><div class=ad>{FIRST}</div></article>", "Short."),
        (f"<div class=post>{BODY}</div><div class=comments><article><p>Nice one</p></article></div>", TEXT),
        (f"<div class=header><h1>Site</h1></div><div>{BODY}</div><form>Search</form>", TEXT),
        (f"<div class=menu><a href=a>One</a> <a href=b>Two</a></div><div>{BODY}</div><div class=related><article>Other</article></div>", TEXT),
    ],
)
def test_names_are_judged_by_what_they_hold(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_a_cut_tag_is_one_that_html_knows():
    assert main_text("<p>one two <stro") == "one two"
    assert main_text("<p>one two <a href='x y") == "one two"
    assert main_text("<p>one two <!-- thr") == "one two"
    assert main_text("<p>if a <wordy") == "if a <wordy"
