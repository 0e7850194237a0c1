"""Tags of broken and odd pages: nothing of the text is lost, nothing of the markup stays, and time is linear."""

import time

import pytest

from llm.html_extract import Page


def pieces(source):
    return [text for _, _, text, _ in Page(source).pieces]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>a</p><svg/><p>b</p></article>", ["a", "b"]),
        ("<p>a</p><iframe src=x /><p>b</p>", ["a", "b"]),
        ("<p>a</p><object data=x><p>b</p>", ["a", "b"]),
        ("<p>a</p><noscript><p>b</p>", ["a", "b"]),
        ("<svg><svg></svg><text>no</text></svg><p>b</p>", ["b"]),
        ("<p>a <a href=\"x>link</a> more</p><p class=\"y\">z</p>", ["a ", "link", " more", "z"]),
        ("<p>a</p><a href='x>b", ["a", "b"]),
        ("<p title=\"a > b\">c</p>", ["c"]),
        ("<p title='<b>x</b>'>c</p>", ["c"]),
        ("<p>a</p><![CDATA[x > y]]><p>b</p>", ["a", "b"]),
        ("<!-- <p>no</p> --><?php no ?><!DOCTYPE html><p>b</p>", ["b"]),
        ("<p>a</p><!-- never closed <p>b</p>", ["a"]),
        ("<p>a</p><script>var x = '<p>no</p>'", ["a"]),
        ("<script>if (a < b) {}</script ><p>x</p>", ["x"]),
        ("a < b <c", ["a < b <c"]),
        ("", []),
    ],
)
def test_pieces(source, text):
    assert pieces(source) == text


def test_an_element_closes_what_stands_in_it():
    page = Page("<div><section><p>a</section>b</div></p>c")
    assert page.tag == ["#root", "div", "section", "p"] and [node for node, *_ in page.pieces] == [3, 1, 0]


@pytest.mark.parametrize("part", ["<", "<a ", "<a x=\"", "<a x='\"", "<svg>", "<iframe ", "<!--", "</svg", "<p title=\"", "<a href=\"x>"])
def test_time_is_linear(part):
    start = time.perf_counter()
    Page(part * (1_000_000 // len(part)))
    assert time.perf_counter() - start < 5


def test_many_end_tags_under_many_open_elements():
    start = time.perf_counter()
    Page("<div>" * 50_000 + "</section>" * 50_000)
    assert time.perf_counter() - start < 5
