"""Language identification and main text."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.llm import html_extract
from cohortcast.llm.lang_id import codewords, decode, features, identify
from cohortcast.llm.html_extract import label, leaf_blocks, main_text


@pytest.fixture(scope="module")
def tongues():
    rnd = random.Random(4)
    sounds = {"aa": ["ba", "do", "ki"], "bb": ["tsch", "ung", "er"], "cc": ["éo", "ux", "ne"], "dd": ["при", "вет", "ом"], "ee": ["zz", "yy", "xa"]}
    return [(k, " ".join("".join(rnd.choices(sounds[lang], k=3)) for _ in range(30)), lang) for k, lang in enumerate(sorted(sounds) * 30)]


def test_held_out_languages(spark, tongues):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, tongues[0][1], None), (1004, tongues[1][1] * 400, "bb")]
    df = spark.createDataFrame([(*r, "x") for r in tongues + odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(df, learn=F.col("doc_id") % 3 != 1).collect()}
    assert len(got) == len(tongues) + len(odd)
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in tongues)
    assert [got[k].lang_pred for k in range(1000, 1005)] == ["und", "und", "und", tongues[0][2], tongues[1][2]]
    assert got[1000].score == 0 and got[1000].ambiguous


def test_one_language_and_none(spark):
    df = spark.createDataFrame([(1, "abc", "aa"), (2, "xyz", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(df, learn=F.lit(True)).collect()} == {"aa"}
    assert {r.lang_pred for r in identify(df, learn=F.lit(False)).collect()} == {"und"}
    assert identify(df.limit(0), learn=F.lit(True)).count() == 0


def test_codewords_differ_and_decode():
    for n in (1, 2, 3, 6, 30):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n
        best, score = decode(4.0 * code, code)
        assert best.tolist() == list(range(n)) and (score > 0.5).all()


def test_long_texts_by_parts():
    t = "abc déf " * 50_000
    whole, letters = features([t])
    part, _ = features([t[:800]])
    assert letters[0] == 6 * 50_000 and float(whole[0] @ part[0]) > 0.999


PAGES = [
    None,
    "",
    "   ",
    "<article><p>Only &amp; open <b>bold\n text<br>next",
    "<script>var a = '</p>'</script><article>x</article>",
    "<!-- open comment <article>x",
    "<nav><a>menu</a></nav><article><h1>T</h1><p>One.<p>Two&nbsp;three</article><footer>&copy; f</footer>",
    "<p>\x00 &#xD800; &bogus; <unknown a='>'>text</unknown>",
]


def test_broken_pages(spark):
    df = spark.createDataFrame([(k, p, "x") for k, p in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got[0] == got[1] == got[2] == got[5] == ""
    assert got[3] == "Only & open bold text\nnext" and got[4] == "x" and got[6] == "T\nOne.\nTwo three"
    assert main_text(df.limit(0)).count() == 0


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    for r in main_text(pages.withColumn("raw", F.col("html"))).collect():
        assert r.text == "\n".join(t for t, _ in leaf_blocks(re.search(r"<article.*?(?:</article>|\Z)", r.raw, re.S)[0]))


@pytest.mark.parametrize("opens, closes", [("<section>", "</section>"), ("<div>", "</div>"), ("<div><div><div>", "</div></div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<main>", "</main>"), ("<div class='col x2'>", "</div>"), ("<div id=story>", "</div>"), ("<span>", "</span>"), ("", "")])
def test_the_container_does_not_decide(opens, closes):
    """Articles of the given pages in other containers, or in none: their blocks stay, and none of the others comes in."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    net, held, total = html_extract.model(), 0, 0
    for html in pages:
        want = [t for t, _ in leaf_blocks(re.search(r"<article.*?(?:</article>|\Z)", html, re.S)[0])]
        blocks = leaf_blocks(re.sub(r"<article\b[^>]*>", opens, html).replace("</article>", closes))
        got = [t for (t, _), kept in zip(blocks, label([blocks], net)[0]) if kept]
        assert set(got) <= set(want)
        held, total = held + len(got), total + len(want)
    assert held >= 0.98 * total


def test_written_pages():
    writer, net = html_extract._Writer(123), html_extract.model()
    wrong = total = 0
    for _ in range(150):
        blocks, y = writer.sample()
        if blocks:
            wrong += int((label([blocks], net)[0] != y).sum())
            total += len(y)
    assert wrong / total < 0.02


def test_windows_of_long_pages():
    page = "<nav><a>m</a></nav><article>" + "".join(f"<p>Sentence number {k}, and more words.</p>" for k in range(1500)) + "</article><footer>f</footer>"
    blocks = leaf_blocks(page)
    kept = label([blocks], html_extract.model())[0]
    assert len(kept) == 1502 and kept[1:-1].mean() > 0.99 and not kept[0] and not kept[-1]


def test_gradient():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4, 2, html_extract.WIDTH)).astype(np.float32)
    w = (rng.standard_normal((html_extract.WIDTH + html_extract.HIDDEN + 1, 4 * html_extract.HIDDEN)) * 0.1).astype(np.float64)
    g = rng.standard_normal((4, 2, html_extract.HIDDEN))
    keep: list = []
    html_extract._lstm(x, w, keep)
    dw = html_extract._lstm_back(x, w, keep, g)
    for at in [(0, 0), (5, 13), (html_extract.WIDTH + 2, 30), (-1, 40)]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-3
        down[at] -= 1e-3
        slope = ((html_extract._lstm(x, up) - html_extract._lstm(x, down)) * g).sum() / 2e-3
        assert slope == pytest.approx(dw[at], abs=2e-2)


def texts(page):
    return [t for t, _ in leaf_blocks(page)]


def test_quotes_count_only_in_values():
    assert texts("<a title=John's>link</a> text one</p><p>two") == ["link text one", "two"]
    assert texts("<p don't>hello</p><p>world it's") == ["hello", "world it's"]
    assert texts('<p title="a > b" class=\'x>\'>kept</p><p title="open>gone</p>') == ["kept"]


def test_unclosed_heads_and_pictures():
    assert texts("<html><head><meta charset=utf-8><title>T</title><body><article><p>Hello</article>") == ["Hello"]
    assert texts("<head><title>T</title><style>p{}</style>Bare text<p>b") == ["Bare text", "b"]
    assert texts("<div><svg><text>x</text><p>after</div><p>more") == ["after", "more"]
    assert texts("<div><object>x</div><p>more") == ["more"]


def test_deep_nesting_is_linear():
    began = time.time()
    assert len(leaf_blocks("<div>x" * 50_000)) == 50_000
    assert len(leaf_blocks("<b>" * 50_000 + "<p>x</i></u>" * 50_000)) == 50_000
    assert time.time() - began < 20


def test_long_pages_are_labelled_as_in_one_pass():
    page = "<article>" + "".join(f"<p>para {k} of some words.</p>" if k % 7 else f"<div class=ad>buy {k}</div>" for k in range(5000)) + "</article><footer>x</footer>"
    blocks, net = leaf_blocks(page), html_extract.model()
    whole = html_extract.score([html_extract.block_vectors(blocks)], net)[0]
    assert np.abs(whole - html_extract.score_long(blocks, net)).max() < 1e-3
    assert (label([blocks], net)[0] == (whole > 0)).all()


def test_words_count_to_the_end():
    block = leaf_blocks("<p>" + "a b c " * 200 + "</p>")[0]
    assert (html_extract.block_vectors([block]) != html_extract.block_vectors([(block[0] + " unlike", block[1])])).any()


def test_what_the_recurrent_part_adds():
    """On pages without telling elements, names and roles, labels come from the document's order: without the recurrent part they are worse."""
    writer, net = html_extract._Writer(99), html_extract.model()
    without = (net[0], net[1], net[2].copy())
    without[2][: 2 * html_extract.HIDDEN] = 0
    right, blocks_seen = [0, 0], 0
    for _ in range(300):
        page = writer.page()
        if "<article" in page or "<main" in page:
            continue
        found = leaf_blocks(re.sub(r" (class|id|role)=('[^']*'|\"[^\"]*\")", "", page))
        y = np.array([writer.MARK in t for t, _ in found], bool)
        blocks = [(t.replace(writer.MARK, "") or "-", v) for t, v in found]
        blocks_seen += len(y)
        for k, weights in enumerate((net, without)):
            right[k] += int((label([blocks], weights)[0] == y).sum())
    assert right[0] > 0.85 * blocks_seen and right[0] > right[1] + 0.02 * blocks_seen  # plain containers are articles by themselves now, so that less is left to add
