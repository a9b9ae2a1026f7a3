"""Operator 3: what the distribution decides, on given pages and made ones, and a plain form of it."""

from __future__ import annotations

import random
import re
from html import unescape

import pytest

from weftlog.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"


def given(spark):
    return [r.html for r in spark.read.parquet(PAGES).orderBy("page_id").collect()]


def bare(page):
    """A page without the tags and names that tell its parts."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"</?(article|main|nav|footer|header|aside|section)\b[^>]*>", "", page))


def test_parameters_change_given_pages(spark):
    pages = given(spark)
    texts = [html.main_text(p) for p in pages]
    adverts = [" ".join(unescape(re.sub("<[^>]*>", " ", re.search(r'<div class="ad">(.*?)</div>', p, re.S)[1])).split()) for p in pages]
    assert all(adverts)
    # without a share of the window that a first line has to carry, text starts at the advert before it
    blocks = lambda t: t.split("\n\n")
    assert all(blocks(html.main_text(p, rise=0)).count(a) == blocks(t).count(a) + 1 for p, t, a in zip(pages, texts, adverts, strict=True))
    # with nothing to go by but lengths: headlines stay, most adverts go, and window and surge count
    plain = [html.main_text(bare(p)) for p in pages]
    heads = [t.split("\n\n")[0] for t in texts]
    assert all(h in t for h, t in zip(heads, plain, strict=True))
    assert sum(a in t for a, t in zip(adverts, plain, strict=True)) < len(pages) / 4
    for other in ({"window": 1}, {"window": 9}, {"surge": 1000}):
        assert sum(html.main_text(bare(p), **other) != t for p, t in zip(pages, plain, strict=True)) > 10


@pytest.mark.parametrize("name", ['section class="social-history"', 'p id="copyright-law"', 'div class="ad-hoc"', 'p class="promo-code-explained"', 'div class="widget-table"', 'div class="sharing-economy news"', 'div id="cookie-recipes"'])
def test_names_that_only_contain_such_words(name):
    tag = name.split()[0]
    page = f"<article><h1>Head</h1><p>A first paragraph of the article.</p><{name}>What it tells.</{tag}></article>"
    assert html.main_text(page) == "Head\n\nA first paragraph of the article.\n\nWhat it tells."


def test_a_name_that_holds_all_the_text():
    assert html.main_text('<article><div class="legal">text</div></article>') == "text"
    assert html.main_text('<article><div class="legal"><p>one</p><p>two</p></div><div class="ad">x</div></article>') == "one\n\ntwo"
    assert html.main_text('<article><p>text</p><div class="legal">small print</div></article>') == "text"
    assert html.main_text('<article><nav>only a menu</nav></article><footer>f</footer>') == ""


def plain_text(page, window, surge, rise):
    """The rules of the docstring, line by line, from the lines and their facts."""
    lines = html.lines_of(page)
    size = [len(t) if i else max(0, len(t) - 2 * n) for t, i, _, n, _, _ in lines]
    marked, total = sum(s for s, x in zip(size, lines, strict=True) if x[1]), max(1, sum(size))
    w, full = [], []
    for s, (_, inside, off, _, _, head) in zip(size, lines, strict=True):
        if not s:
            w.append(0.0)
            full.append(0.0)
            continue
        v = (html.ARTICLE * min(s, html.CAP) + html.OWN) * marked / total if inside else min(s, html.CAP) * (html.HEADING if head else 1) * (total - marked) / total
        w.append(v * html.PART if off else v)
        full.append(v)
    of = [sum(w[k : k + window]) for k in range(len(w))]
    least = min(surge, max(of, default=0) / 2)
    kept, k = set(), 0
    while k < len(w):
        if not (w[k] > 0 and of[k] >= least and w[k] >= rise * of[k] / len(w[k : k + window])):
            k += 1
            continue
        k0 = k
        while k < len(w) and of[k] > 0 and (k == k0 or lines[k][1] == lines[k - 1][1] and of[k] >= html.DIVE * least):
            if w[k] > 0 and (not lines[k][2] or w[k] >= rise * max(sum(full[j : j + window]) for j in range(len(full))) / window):
                kept.add(k)
            k += 1
    at = [-1 if x[1] else x[4] for x in lines]
    boxes = {at[k] for k in kept if not lines[k][2]}
    kept |= {k for k, x in enumerate(lines) if at[k] in boxes and not x[2]}
    order = sorted(kept)
    for a, b in zip(order, order[1:], strict=False):
        if at[a] == at[b] > 0:
            kept |= {k for k in range(a, b) if not lines[k][2]}
    return "\n\n".join(lines[k][0] for k in sorted(kept))


def test_a_plain_form_agrees(spark):
    rng = random.Random(9)
    pages = given(spark)[:120]
    pages += [bare(p) for p in pages]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            text = " ".join(rng.choice(["word", "longer", "a"]) for _ in range(rng.choice([1, 3, 10, 60])))
            tag = rng.choice(["p", "div", "h2", "li", "article", "aside", "section", "main", "footer"])
            name = rng.choice(["", "", ' class="ad"', ' class="story"', ' class="sidebar"', ' id="comments"', " hidden"])
            inner = f'<a href="x">{text}</a>' if rng.random() < 0.2 else text
            parts.append(f"<{tag}{name}>{inner}" + (f"</{tag}>" if rng.random() < 0.8 else ""))
        pages.append("".join(parts))
    for page in pages:
        for window, surge, rise in ((html.WINDOW, html.SURGE, html.RISE), (1, 20, 0), (5, 400, 0.9)):
            assert html.main_text(page, window, surge, rise) == plain_text(page, window, surge, rise)
