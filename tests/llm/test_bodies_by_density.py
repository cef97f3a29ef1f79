"""Problem 3: the density core decides the body; pages without a repeated title; input without ends."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest

from lexspan.llm import mainbody

DATA = "/root/testdata/sf0.01/fetched_pages.parquet"


@pytest.fixture(scope="module")
def pages():
    return list(dict.fromkeys(pq.read_table(DATA, columns=["html"]).column("html").to_pylist()))


def test_a_random_core_breaks_nine_of_ten_pages(pages, monkeypatch):
    right = {html: mainbody.body_lines(html) for html in pages}
    right = {html: lines for html, lines in right.items() if lines}
    chosen, draw = mainbody.core, random.Random(7)

    def at_random(page, allowed=None):
        _, _, density = chosen(page, allowed)
        return draw.randrange(len(density)), 0.0, density

    monkeypatch.setattr(mainbody, "core", at_random)
    changed = sum(mainbody.body_lines(html) != lines for html, lines in right.items())
    assert changed >= 0.88 * len(right)  # a random node is sometimes the core itself


def test_a_threshold_no_node_reaches_leaves_no_body(pages, monkeypatch):
    chosen = mainbody.core
    monkeypatch.setattr(mainbody, "core", lambda page, allowed=None: (chosen(page, allowed)[0], float("inf"), chosen(page, allowed)[2]))
    assert not any(mainbody.body_lines(html) for html in pages[:50])


def _agreement(pages, change):
    both = found = true = 0
    for html in pages:
        a, b = set(mainbody.body_lines(html)), set(change(html))
        both, found, true = both + len(a & b), found + len(b), true + len(a)
    return both / true, both / found


def test_pages_without_a_repeated_title(pages):
    recall, precision = _agreement(pages, lambda html: mainbody.body_lines(re.sub(r"<title>.*?</title>", "", html, flags=re.S)))
    assert recall > 0.95 and precision > 0.98


def test_without_any_words_of_footers_and_side_lists(pages, monkeypatch):
    with_words = {html: mainbody.body_lines(html) for html in pages}
    for name in ("_FOOTER", "_ASIDE", "_SIDE_HEAD"):
        monkeypatch.setattr(mainbody, name, re.compile(r"(?!)"))
    both = sum(len(set(mainbody.body_lines(html)) & set(lines)) for html, lines in with_words.items())
    assert both > 0.97 * sum(map(len, with_words.values()))
    assert both > 0.97 * sum(len(mainbody.body_lines(html)) for html in pages)


def test_a_language_of_no_word_list():
    body = "\n".join(f"<p>Sąd uznał, że powód nie wykazał swoich racji w sprawie numer {i}, a pozwany złożył odpowiedź.</p>" for i in range(8))
    html = f"<html><body>\n<ul>\n<li><a href='/'>Start</a></li>\n<li><a href='/k'>Kontakt</a></li>\n</ul>\n<div>\n<h1>Wyrok 12/2020</h1>\n{body}\n</div>\n<div>\n<li><a href='/1'>Inny wyrok</a></li>\n<li><a href='/2'>Jeszcze inny</a></li>\n</div>\n</body></html>"
    first = html.split("\n").index("<h1>Wyrok 12/2020</h1>") + 1
    assert mainbody.body_lines(html) == list(range(first, first + 9))


@pytest.mark.parametrize("unit", ["<script ", "<script>", "<!--", "<title>", "<a ", '<a "', "<a '", "<b>", "<", "<li>"])
def test_input_without_ends_takes_linear_time(unit):
    began = time.perf_counter()
    mainbody.body_lines(unit * (2_000_000 // len(unit)))
    assert time.perf_counter() - began < 5


def test_closing_tags_without_partner_take_linear_time():
    began = time.perf_counter()
    mainbody.body_lines("<b>" * 200_000 + "x" + "</i>" * 200_000)
    assert time.perf_counter() - began < 5
