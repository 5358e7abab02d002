"""op8's reader: attributes of any length, and elements that are not closed."""

from __future__ import annotations

import time

import pytest

from lexaudit.llm import html_extract
from lexaudit.llm.html_extract import EMBEDDED, RAW_TAGS, blocks_of


def texts(html):
    return [b.text for b in blocks_of(html)]


def kept(html):
    return [b.text for b in blocks_of(html) if not b.boiler]


@pytest.mark.parametrize("size", [50, 5_000, 1_000_000])
@pytest.mark.parametrize("quote", ["\"", "'"])
def test_values_of_any_length_leak_nothing(size, quote):
    value = "x" * size + "> leaked <b>" + "y" * size
    assert texts(f"<p data-props={quote}{value}{quote} id=a>Para</p><p>next") == ["Para", "next"]


def test_many_attributes():
    html = "<p " + " ".join(f"a{i}='v > {i}'" for i in range(3000)) + ">Para</p>"
    assert texts(html) == ["Para"]


@pytest.mark.parametrize("html", ["<p title=\"open>one</p><p>two", "<p it's>one</p><p>two", "<p a=b\"c>one</p><p>two", "<p x = 'a>b' y>one</p><p>two", "<p '>one</p><p>two"])
def test_quotes_without_meaning(html):
    assert texts(html) == ["one", "two"]


def test_reading_takes_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        html = "<p a=\"" * n
        began = time.perf_counter()
        blocks_of(html)
        blocks_of("<a b='c" * n)
        blocks_of("<button>" * n + "x")
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


@pytest.mark.parametrize("tag", sorted(EMBEDDED))
def test_an_unclosed_element_keeps_the_text_after_it(tag):
    html = f"<article><h1>Title</h1><p>first</p><{tag}>label<p>second</p><ul><li>third</li></ul></article><p>last"
    assert [t for t in kept(html) if t != "label"] == ["Title", "first", "second", "third", "last"]


@pytest.mark.parametrize("tag", sorted(EMBEDDED))
def test_a_closed_element_is_left_out(tag):
    html = f"<article><p>before <{tag}>inner <b>text</b></{tag}>after</p><{tag} class=x><span>alone</span></{tag}><p>next</p></article>"
    assert kept(html) == (["before", "after", "next"] if tag == "select" else ["before after", "next"])  # a select is a block


def test_what_embedded_elements_hold():
    assert kept("<p>a</p><object>x<object>y</object><p>fallback</p></object><p>b</p>") == ["a", "b"]
    assert kept("<p>a <select><option>one<option>two</select> b</p>") in (["a", "b"], ["a b"])
    assert kept("<p>a</p><button>one<button>two</button><p>b</p>") == ["a", "b"]
    assert kept("<template><div><p>x</p></div></template><p>b</p>") == ["b"]
    assert kept("<p>a<svg><title>t</title><text>x</text></svg>b</p>") == ["ab"]


def test_raw_elements_end_at_their_end_tag_alone():
    assert RAW_TAGS == {"script", "style", "textarea", "title", "noscript", "iframe"}
    for tag in RAW_TAGS:
        assert texts(f"<p>a</p><{tag}><p>x</p></b></{tag} ><p>b") == ["a", "b"]


def test_main_text_is_whole():
    page = "<nav><a href=/>Home</a></nav><article><h1>A title of some length</h1><p>" + "The first paragraph has words. " * 5 + "</p><button>Share<p>" + "The second one has words too. " * 5 + "</p></article>"
    text = html_extract.main_text(page) if hasattr(html_extract, "main_text") else None
    if text is not None:
        assert "second one" in text and "Share" not in text
