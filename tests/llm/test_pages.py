import hashlib

import pytest

from tidecast.llm.files import open_file
from tidecast.llm.html import LABELLED, best_region, extract, learn_weights, main_text
from tidecast.llm.warc import coalesced, parse, read_archives, write_archives

WEIGHTS = learn_weights(LABELLED)
BIG = "é" * 600
PAGES = [(1, "http://a/ b", BIG), (2, None, BIG), (3, "u", BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (3, "u", BIG), (8, "u", "<p>\r\n\r\nWARC/1.1\r\n" * 200)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    index = write_archives(pages(spark).repartition(2), str(tmp_path))
    got = sorted(read_archives(index).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(PAGES)
    for r in got:
        data = next(h for p, _, h in PAGES if p == r.page_id) or ""
        assert r.payload_digest == hashlib.sha1(data.encode()).hexdigest() and r.payload_bytes == len(data.encode())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data.encode()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(None, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), *((i, "response", None) for i in range(4, 9))}
    assert {r.page_id: r.url for r in got}[1] == "http://a/%20b"
    some = read_archives(index.where("page_id in (4, 8)"), with_payload=False)
    assert sorted(r.page_id for r in some.collect()) == [4, 8] and "payload" not in some.columns
    row = index.where("page_id = 8").first()
    import gzip

    headers, block = parse(gzip.decompress(open_file(row.archive).read_at(row.length, row.offset)))
    assert headers["warc-type"] == "response" and block.endswith(PAGES[-1][2].encode())


def test_no_pages(spark, tmp_path):
    index = write_archives(pages(spark).where("false"), str(tmp_path))
    assert read_archives(index).collect() == []


def test_reads_are_coalesced():
    far = 10 << 20
    assert list(coalesced([(0, 10), (10, 5), (1000, 10), (far, 10)])) == [(0, 1010, [0, 1, 2]), (far, far + 10, [3])]
    assert list(coalesced([])) == []


@pytest.mark.parametrize("i", range(len(LABELLED)))
def test_labelled_pages(i):
    html, main = LABELLED[i]
    assert main_text(html, WEIGHTS) == main.replace("<b>", "").replace("</b>", "")


def test_region_by_brute_force():
    import random

    r = random.Random(2)
    for _ in range(300):
        scores = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        begin, end = best_region(scores)
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[begin:end]) == best


def test_odd_pages(spark):
    page = (
        "<header><h1>Site</h1></header><div id='nav-main'><a>x y</a></div><article class=post><header><h1>T &lt;x&gt; &amp; y&nbsp;z</h1></header>"
        "<p>One two <b>th</b>ree\n four<p>five<script>var a = '</p>';</script> six<div class='ad-slot'>Buy</div><ul><li>item one<li>item two</ul>"
        "<div class=comments><p>nice</p></div><!-- no --><p title='a > b'>1 < 2</p></article><footer>foot</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (5, "u", "<p>cut of<scr"), (1, "u", page)]
    got = sorted(extract(pages(spark, rows), WEIGHTS).collect())
    assert got[0] == got[1] and got[0].text == "T <x> & y z\nOne two three four\nfive six\nitem one\nitem two\n1 < 2" and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[2:]] == ["", "", "plain words only", "cut of"]
    assert extract(pages(spark).where("false"), WEIGHTS).collect() == []


LONG = "The quick brown fox jumps over the lazy dog near the river bank today. " * 3
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body class="has-sidebar"><h1>Head</h1><p>{LONG}</p></body>', f"Head\n{TEXT}"),
        (f'<div class="post comments-open"><p>{LONG}</p></div>', TEXT),
        (f'<h1 class="post-title">Head</h1><div class="post-body"><p>{LONG}</p></div>', f"Head\n{TEXT}"),
        (f"<article><p>{LONG}</p></article><article><p>Other {LONG}</p></article>", f"{TEXT}\nOther {TEXT}"),
        (f'<p class="story-text">{LONG}</p><p class="story-text">B {LONG}</p><p class="story-text">C</p>', f"{TEXT}\nB {TEXT}\nC"),
        (f'<article><h1 class="entry-header">Head</h1><p>{LONG}</p></article>', f"Head\n{TEXT}"),
        (f'<article><p class="alert">Mind this.</p><p>{LONG}</p></article>', f"Mind this.\n{TEXT}"),
        (f'<div id="page" class="layout sidebar-right"><article><p>{LONG}</p></article></div>', TEXT),
        (f'<html class="no-js header-fixed"><body><nav><a>x</a></nav><main><p>{LONG}</p></main></body></html>', TEXT),
        (f'<div class="comments"><article class="comment">nice</article></div><article><p>{LONG}</p></article><div id="comments"><p>Great {LONG}</p></div>', TEXT),
        (f"<ul><li><a href=x>One</a></li><li><a>Two</a></li></ul><div><p>{LONG}</p></div><div>All rights reserved</div>", TEXT),
        (f'<article><p title="a > b">{LONG}</p><div class="share">Share</div><p>End.</p></article>', f"{TEXT}\nEnd."),
    ],
)
def test_what_classes_say(page, text):
    assert main_text(page, WEIGHTS) == text


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<", "<!--", "</a ", "<p><b>", "</i>", "<a href='x", "<p></b>"])
def test_broken_markup_takes_linear_time(piece):
    """Ten times the page takes about ten times as long, far from a hundred times; the words around it are kept."""
    import time

    def took(n):
        start = time.process_time()
        main_text(f"<p>{LONG}</p>" + piece * n, WEIGHTS)
        return time.process_time() - start

    assert took(100_000) < 30 * max(took(10_000), 0.02)
    assert main_text(f"<p>{LONG}</p>" + piece * 50, WEIGHTS).startswith(TEXT)


def test_a_very_long_page(spark):
    rows = [(1, "u", f"<article>{'<p>Some words of a long page.</p>' * 50_000}</article>")]
    assert extract(pages(spark, rows), WEIGHTS).first().n_chars == 50_000 * 27 - 1


def test_columns_that_clash(spark):
    df = pages(spark, [(1, "u", f"<p>{LONG}</p>")]).selectExpr("*", "'mine' AS text", "7 AS n_chars")
    assert extract(df, WEIGHTS).columns == ["page_id", "url", "text", "n_chars"] and extract(df, WEIGHTS).first().text == TEXT
