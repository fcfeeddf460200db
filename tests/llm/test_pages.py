"""Pages whose articles have several parts, names that only look like marks, and hostile markup."""

from __future__ import annotations

import time

import pytest

from brimwatch.llm import density

TEXT = "A long sentence about the matter at hand, with many words and no link anywhere in it. " * 3
ONE, TWO, LEAD = (f"{name}: {TEXT}".strip() for name in ("First", "Second", "Lead"))

PAGES = {
    "names within the article": (
        f"<nav><a href=x>menu</a></nav><article><p>{ONE}</p><section id='social-effects'><p>{TWO}</p></section>"
        f"<div class='related-work'><p>{LEAD}</p></div><div class='related-posts'><p>Read more</p></div>"
        "<div class='share'>Share this</div></article>",
        f"{ONE} {TWO} {LEAD}",
    ),
    "two articles": (f"<main><article><p>{ONE}</p></article><article><p>{TWO}</p></article></main>", f"{ONE} {TWO}"),
    "title and lead before the article": (
        f"<main><h1>Title</h1><p>{LEAD}</p><article><p>{ONE}</p></article></main>",
        f"Title {LEAD} {ONE}",
    ),
    "a list of links with a heading": (
        f"<article><p>{ONE}</p></article><div id='latest'><h3>Recent posts</h3><ul><li><a href=a>one</a></li></ul></div>",
        ONE,
    ),
    "the same without an article": (
        f"<div><p>{ONE}</p><p>{TWO}</p></div><div id='latest'><h3>Recent posts</h3><ul><li><a href=a>one</a></li></ul></div>",
        f"{ONE} {TWO}",
    ),
    "teasers in main": (
        f"<main><article><p>{ONE}</p></article><article><a href=b>Another story to read</a></article></main>",
        ONE,
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert density.main_text(f"<html><head><title>t</title></head><body>{html}</body></html>") == want


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000 + "</b>" * 100_000 + TEXT, "<i><article>" + "<b>" * 50_000 + "</i>" * 50_000 + TEXT,
     "<b>" * 50_000 + "<li>x" * 50_000 + TEXT, "<p>" * 100_000 + TEXT],
)
def test_hostile_markup_takes_linear_time(html):
    begin = time.process_time()
    assert TEXT.split()[0] in density.main_text(html)
    assert time.process_time() - begin < 12


def _recursive(node):
    """(characters, tags, link characters, links) of what is not dropped, by direct recursion."""
    total = [0, 0, 0, 0]
    for part in node.parts:
        if isinstance(part, str):
            total[0] += len("".join(part.split()))
        elif not part.out:
            own = _recursive(part)
            total = [a + b for a, b in zip(total, own, strict=True)]
            total[1] += 1
            total[3] += part.tag == "a"
    if node.tag == "a":
        total[2] = total[0]
    return total


def test_counts_equal_direct_recursion(spark, data):
    for row in spark.read.parquet(f"{data}/pages.parquet").limit(40).collect():
        page = density._parsed(row.html)
        density._measure(page)
        for node in page.nodes:
            if not node.out:
                assert [node.chars, node.tags, node.link_chars, node.links] == _recursive(node)
                assert node.total == pytest.approx(sum(c.density for c in node.children()))
