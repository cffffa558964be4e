"""HTML extraction: what markup decides, and what repeated runs do."""

import pytest
from pyspark.sql import functions as F

from quillmark.llm import html_extraction
from quillmark.llm.html_extraction import HINTED, MAIN, MIN_PAGES, OPEN, RUN, SHELL_BLOCK, page_blocks


@pytest.mark.parametrize("source, found", [
    ("<div class='layout has-sidebar'><nav>Menu</nav><article><h1 class='entry-header'>Head</h1><p class='search-tips'>tips</p></article></div>", [(SHELL_BLOCK, "Menu"), (MAIN, "Head"), (MAIN, "tips")]),
    ("<div id='header-wrapper'><p>text</p></div>", [(OPEN, "text")]),
    ("<div class='sidebar'><article>one</article></div>", [(MAIN, "one")]),
    ("<aside><main>one</main></aside>", [(MAIN, "one")]),
    ("<form><div>one</div><article>two</article></form>", [(SHELL_BLOCK, "one"), (MAIN, "two")]),
    ("<form><div>some text of the page</div></form><p>one</p>", [(OPEN, "some text of the page"), (OPEN, "one")]),
    ("<article>one<section id='comments'><article>two</article></section></article>", [(MAIN, "one"), (SHELL_BLOCK, "two")]),
    ("<article><datalist><option value='1'>x<option>y</datalist><p>one</p></article>", [(MAIN, "one")]),
    ("<article><p>one<button>x</p><p>two</p></article>", [(MAIN, "one"), (MAIN, "two")]),
    ("<article><div><object>x</div>one<p>a <math><mi>b</mi></math></p></article>", [(MAIN, "one"), (MAIN, "a b")]),
    ("<article><div><textarea>x</div>one</article>", [(MAIN, "one")]),
    ("<nav>only</nav>", [(OPEN, "only")]),
    ("<article><section class='related-work'>a</section><div id='social-history'>b</div><div class='header'>c<p>d</p></div><p>e</p></article>", [(MAIN, "a"), (MAIN, "b"), (HINTED, "c"), (HINTED, "d"), (MAIN, "e")]),
    ("<article><p>a</p><div class='ad'>b</div><p class='notice'>c</p></article>", [(MAIN, "a"), (SHELL_BLOCK, "b"), (SHELL_BLOCK, "c")]),
    ("<article><h1 id='how-cookies-work'>How cookies work</h1><p>Body text.</p><h2 id='notice'>Notice</h2><p>More.</p></article>", [(MAIN, "How cookies work"), (MAIN, "Body text."), (MAIN, "Notice"), (MAIN, "More.")]),
    ("<main><section id='comments-on-theory'><h3 class='login'>a</h3></section><div id='login'>b</div><div class='cookie-theory'>c</div></main>", [(HINTED, "a"), (HINTED, "b"), (HINTED, "c")]),
])
def test_what_markup_decides(source, found):
    assert page_blocks(source) == found


def extracted(spark, rows):
    found = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(found) == len(rows)
    return {r.page_id: r.text for r in found}


def words(page, n, kind="w"):
    return " ".join(f"{kind}{page}x{i}" for i in range(n))


def test_runs_repeated_outside_articles_are_cut(spark):
    notice = "Please read our notice on how this site works today"
    shared = words(99, 30, "s")
    pages = [(k, f"http://a.net/{k}", f"<main><p>{words(k, 9)}</p><p>{shared}</p><div class='related'>{notice} {words(k, 2, 'r')}</div></main><div>{words(k, 8, 'o')}</div><div>{notice} {words(k, 2, 'v')}</div>") for k in range(4)]
    other = [(9, "http://b.net/", f"<article><div class='header'>{notice}</div></article>")]
    found = extracted(spark, pages + other)
    assert found == {9: notice} | {k: f"{words(k, 9)}\n{shared}\n{words(k, 2, 'r')}\n{words(k, 8, 'o')}\n{words(k, 2, 'v')}" for k in range(4)}


def test_runs_by_brute_force(spark):
    import random

    rng = random.Random(5)
    passages = [words(k, rng.randint(5, 14), "p") for k in range(12)]
    texts = [" ".join(rng.choice([*passages, words(k, 3, f"u{j}")]) for j in range(8)) for k in range(30)]
    pages = [(k, f"http://{'ab'[k % 2]}.net/{k}", f"<article>{t}</article>" if k % 3 == 0 else f"<p>{t}</p>" if k % 3 == 1 else f"<nav>{t}</nav><p>{t}</p>") for k, t in enumerate(texts)]
    wanted = {}
    for k, t in enumerate(texts):
        ts, hit = t.split(), set()
        for i in range(len(ts) - RUN + 1):
            run = f" {' '.join(ts[i : i + RUN])} "
            if len({u for j, u in enumerate(texts) if j % 2 == k % 2 and j % 3 and run in f" {u} "}) >= MIN_PAGES:
                hit.update(range(i, i + RUN))
        wanted[k] = t if k % 3 == 0 else " ".join(w for i, w in enumerate(ts) if i not in hit)
    assert extracted(spark, pages) == wanted and any(wanted[k] != t for k, t in enumerate(texts))


def test_many_open_elements_are_linear():
    import time

    began = time.perf_counter()
    page_blocks("<div>" * 60_000 + "</span>" * 60_000 + "<p>text")
    assert time.perf_counter() - began < 5


def test_edge_cases(spark):
    long = words(1, 400_000)
    rows = [(None, None, None, "x"), (1, None, "", "x"), (2, "a", f"<p>{long}</p>", "x"), (2, "a", f"<p>{long}</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumns({c: F.lit(7) for c in ("uid", "blocks", "kinds", "content", "key", "covered", "_touched")})
    found = sorted(((r.page_id, r.text) for r in html_extraction.extract_text(pages).collect()), key=repr)
    assert found == sorted([(None, ""), (1, ""), (2, long), (2, long)], key=repr)


def test_copies_of_a_page_keep_their_text(spark):
    page = f"<p>{words(0, 30)}</p>"
    rows = [(0, "http://a.net/0", page), (0, "http://a.net/0", page), (1, "http://a.net/0?utm_source=x", page), (2, "http://a.net/print/0", f"<nav>Print</nav>{page}")]
    # Two contents have the passage: the copies count once.
    passage = words(9, 40, "r")
    rows += [(k, f"http://b.net/{k}", f"<div>{passage} {words(min(k, 4), 20)}</div>") for k in (3, 4, 5, 6)]
    rows += [(k, f"http://c.net/{k}", f"<div>{passage} {words(k, 20)}</div>") for k in (7, 8, 9)]
    found = extracted(spark, rows)
    assert all(found[k] == words(0, 30) for k in range(3))
    assert all(found[k] == f"{passage} {words(min(k, 4), 20)}" for k in (3, 4, 5, 6))
    assert all(found[k] == words(k, 20) for k in (7, 8, 9))
