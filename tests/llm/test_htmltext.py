import math
import re
import time

import numpy as np
import pytest

from skerry.llm import htmltext

SENTENCE = "Words of an article, one after the other, make a sentence; and so it goes on. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>no</title></head><body>{body}</body></html>"


def brute_ratios(runs):
    """Per path: text per run, fused with punctuation and smoothed; from a list of (path, text, linked, prior)."""
    order = list(dict.fromkeys(p for p, *_ in runs))
    ratio = {}
    for path in order:
        texts = [(t.strip(), linked) for p, t, linked, _ in runs if p == path]
        length = sum(len(t) * (0.1 if linked else 1.0) for t, linked in texts)
        ratio[path] = length / len(texts) * (1 + sum(len(re.findall("[.,;:!?]", t)) for t, _ in texts) / len(texts))
    reach = max(1, int(math.sqrt(len(order)) // 2))
    kernel = [math.exp(-0.5 * (d / max(0.5, reach / 2)) ** 2) for d in range(-reach, reach + 1)]
    out = {}
    for i, path in enumerate(order):
        near = [ratio[order[min(max(i + d, 0), len(order) - 1)]] for d in range(-reach, reach + 1)]
        smooth = sum(k * r for k, r in zip(kernel, near)) / sum(kernel)
        out[path] = math.sqrt(ratio[path] * smooth) * next(w for p, _, _, w in runs if p == path)
    return out


def test_ratios_equal_brute_force():
    body = f"<nav><ul><li><a href=x>Home</a><li><a>News, all</a></ul></nav><div><h2>Head</h2><p>{SENTENCE * 3}</p><p>{SENTENCE}</p><ul><li>One thing.<li>Two</ul></div><div class='ads x'><p>Buy!</p></div><article><p>{SENTENCE * 2}</p></article>"
    runs = [("nav li", "Home", True, 1e-3), ("nav li", "News, all", True, 1e-3), ("h2", "Head", False, 1), ("div p", SENTENCE * 3, False, 1), ("div p", SENTENCE, False, 1)]
    runs += [("div li", "One thing.", False, 1), ("div li", "Two", False, 1), ("ad p", "Buy!", False, 1e-3), ("article p", SENTENCE * 2, False, 10)]
    paths = htmltext.tag_paths(htmltext.parse(page(body)))
    got = htmltext.path_ratios(paths)
    want = brute_ratios(runs)
    assert sorted(x for x in got if x) == pytest.approx(sorted(want.values()))
    lengths = {p: sum(len(t.strip()) for q, t, *_ in runs if q == p) * next(w for q, _, _, w in runs if q == p) for p in want}
    mean = sum(want[p] * lengths[p] for p in want) / sum(lengths.values())
    assert sorted(got[htmltext.content_paths(paths)]) == pytest.approx(sorted(v for v in want.values() if v >= max(1.0, 0.02 * mean)))


PLAIN = page(
    f"<div id=top><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></div><div><h1>Title</h1><p>{SENTENCE * 4}</p><h2>Part</h2><p>{SENTENCE * 2}</p><ul><li>First</li><li>Second</li></ul><p>Ok.</p></div>"
    f"<div class='comment-list'><p>{SENTENCE * 5}</p></div><div><a href=1>Next</a> <a href=2>Last page</a></div><footer>&copy; me, 2024.</footer>"
)


def test_paths_decide_on_pages_without_article():
    want = f"Title {SENTENCE * 4}Part {SENTENCE * 2}First Second Ok."
    assert htmltext.main_text(PLAIN) == want
    off = htmltext.main_text(PLAIN, share=0.0, least=0.0)
    assert off != want and "Home" in off and "Next" in off, "without the threshold every path is content"
    high = htmltext.main_text(page(f"<div><p>{SENTENCE * 9}</p></div><section><p>Short one here.</p></section>"), share=0.9)
    assert high == (SENTENCE * 9).strip()
    assert "Short" in htmltext.main_text(page(f"<div><p>{SENTENCE * 9}</p></div><section><p>Short one here.</p></section>"), share=0.0)


def test_names_are_a_prior_only():
    assert htmltext.main_text('<div data-id="ad-7"><p>Body text.</p></div>') == "Body text."
    assert htmltext.main_text('<div title="class=ad"><p>Body text.</p></div>') == "Body text."
    assert htmltext.main_text(page(f"<form><h1>T</h1><p>{SENTENCE * 3}</p><input></form>")) == f"T {(SENTENCE * 3).strip()}"
    assert htmltext.main_text(page(f'<article><p>{SENTENCE}</p><div class="side-by-side"><p>Both.</p></div><div class="share-box">Share it</div></article>')) == f"{SENTENCE}Both."
    assert htmltext.main_text(page(f'<div class="page-menu"><article><p>{SENTENCE}</p></article></div>')) == SENTENCE.strip()
    assert htmltext.main_text(page(f'<article><p>{SENTENCE}</p></article><article class="comment"><p>{SENTENCE * 3}</p></article>')) == SENTENCE.strip()


def test_broken_markup():
    assert htmltext.main_text('<p title="a > b">one, two</p>') == "one, two"
    assert htmltext.main_text("<p title='it>ones</p><p>x < y &lt; z</p>") == "ones x < y < z"
    assert htmltext.main_text("<table><tr><td>a, b<td>c<tr><td>d</table>") == "a, b c d"
    assert htmltext.main_text("<p>one<script>if (a < b) { x = '</p>' }</script>two</p><!-- <p>no") == "onetwo"
    assert htmltext.main_text("<p>text, here <![CDATA[<raw>]]></p>") == "text, here <raw>"
    assert htmltext.main_text("<P CLASS=x>Upper, case</P") == "Upper, case"


@pytest.mark.parametrize("make", [lambda k: "<a " * k + '"', lambda k: "<div>x" * k, lambda k: '<a href="' * k, lambda k: "<ul>" + "<div>" * k + "<li>x</li>" * k, lambda k: "<p x=' " * k, lambda k: "<ul><li>x" * k, lambda k: "</b>" * k, lambda k: "<!--" * k])
def test_time_in_proportion_to_hostile_pages(make):
    def seconds(k):
        began = time.process_time()
        htmltext.main_text(make(k))
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 0.5 + 12 * seconds(10_000)


def test_columns_with_clashing_names(spark):
    rows = [(1, page("<p>One, two.</p>"), "a", "b", "c"), (1, page("<p>One, two.</p>"), "a", "b", "c"), (None, None, None, None, None), (2, "word, " * 100_000, "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, `__html` string, page string, c0 string")
    out = htmltext.extract(df)
    assert out.columns == [*df.columns, "text"] and out.drop("text").exceptAll(df).count() == 0
    assert sorted(r.text for r in out.collect()) == ["", "One, two.", "One, two.", ("word, " * 100_000).strip()]
    assert htmltext.extract(df, html="page", into="page").columns == ["page_id", "html", "__html", "c0", "page"]
    assert np.isfinite(htmltext.path_ratios(htmltext.tag_paths(htmltext.parse("")))).all()
