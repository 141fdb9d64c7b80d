"""BPE, language identification, quality, HTML and token totals."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from espalier.durable import fresh_path
from espalier.llm import bpe, html_text, langid, quality, token_rollup
from espalier.llm.queries import BPE_FILE, PIECES_FILE, QUERIES, RANKS_FILE
from tests.llm.conftest import SF, of

# --- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def definition():
    return bpe.read_definition(BPE_FILE)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(BPE_FILE)
    found.no_truncation()
    found.no_padding()
    return found


def bpe_by_hand(rows, library):
    out = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), decoded))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most_words", [0, 5, bpe.MOST_WORDS])
def test_bpe(docs, rows, definition, library, most_words):
    found = bpe.decode(bpe.encode(docs, definition, most_words=most_words), definition)
    assert as_rows(found) == bpe_by_hand(rows, library)


def test_bpe_splits_every_character_as_the_library(spark, definition, library):
    """Each code point next to letters, digits, marks and spaces."""
    points = [c for c in range(1, 0x32400) if not 0xD800 <= c <= 0xDFFF]
    texts = [
        (i, "".join(f"a{chr(c)}{chr(c)}1 {chr(c)} .{chr(c)}  {chr(c)}\n" for c in points[i : i + 500]))
        for i in range(0, len(points), 500)
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    found = bpe.decode(bpe.encode(docs, definition), definition)
    assert as_rows(found) == bpe_by_hand(texts, library)


def test_bpe_edges(none, clashing, docs, definition):
    assert bpe.decode(bpe.encode(none, definition), definition).count() == 0
    assert as_rows(bpe.decode(bpe.encode(clashing, definition), definition)) == as_rows(
        bpe.decode(bpe.encode(docs, definition), definition)
    )


def test_bpe_query(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    theirs = [
        (d, n, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, n, i, t in bpe_by_hand(docs, library)
    ]
    assert of(QUERIES["op10_bpe"](spark, SF)) == sorted(theirs, key=repr)


def test_decoding_replaces_broken_bytes(spark, definition, library):
    ids = library.encode("é", add_special_tokens=False).ids
    halves = [i for i, p in enumerate(bpe.pieces(definition)) if p == b"\xc3"][:1] + ids
    frame = spark.createDataFrame([(bytearray(np.array(halves, "<u4").tobytes()),)], "ids binary")
    assert bpe.decode(frame, definition).first().decoded == library.decode(halves, skip_special_tokens=False)


# --- language --------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = tuple(sorted(["▁a", "a", "b", "ab", "▁ab", "ba", "bab", "c"]))
    dice = np.random.default_rng(0)
    table = np.vstack([dice.random((len(pieces), 2)), np.zeros((1, 2))])
    words = ["a", "ab", "abab", "babc", "abz", "b" * 12]

    def by_hand(word, language):
        marked, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(marked[start:i])
                    start = i
            parts.append(marked[start:])
            p = 1.0
            for x in parts:
                known = table[pieces.index(x), language] if x in pieces else 0.0
                p *= max(known, langid._OTHER) if len(x) == 1 else known
            total += p
        return math.log(total)

    found = langid.Lattice(words, 16, langid.Pieces(pieces)).forward(table)
    for w, logs in zip(words, found):
        assert logs == pytest.approx([by_hand(w, 0), by_hand(w, 1)], rel=1e-9)


def test_forward_survives_long_words():
    pieces = tuple(sorted(["▁", "a", "b"]))
    table = np.array([[1e-5, 1e-4], [1e-5, 1e-6], [1e-5, 1e-4], [0, 0]])
    logs = langid.Lattice(["ab" * 300], 601, langid.Pieces(pieces)).forward(table)[0]
    order = {p: i for i, p in enumerate(pieces)}
    hand = [math.log(table[order["▁"], k]) + 300 * (math.log(table[order["a"], k]) + math.log(table[order["b"], k])) for k in (0, 1)]
    assert logs == pytest.approx(hand, rel=1e-9)


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op8_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    held = found.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert held[1] > 250 and held[0] > 0.97
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_edges(docs, none, clashing, spark):
    listed = langid.read_pieces(PIECES_FILE)
    model = langid.learn(docs, listed)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(clashing, model).collect()}
    assert found[0] == found[1] == found[2] == ("und", 0.0)
    assert found[6][0] in model.languages
    assert langid.predict(none, model).count() == 0
    empty = langid.learn(none, listed)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    odd = spark.createDataFrame([(1, "½² 12 !!"), (2, "漢" * 3000), (3, "ab" * 20_000)], "doc_id long, text string")
    assert [r.lang_pred != "und" for r in langid.predict(odd, model).orderBy("doc_id").collect()] == [False, True, True]


# --- quality ---------------------------------------------------------------------


def test_quality_separates_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = QUERIES["op3_quality_classifier"](spark, folder)
    rows = judged.select("doc_id", "keep").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    right = [r.keep == bool(r.quality) for r in rows]
    assert len(rows) > 300 and sum(right) / len(right) > 0.95
    kept = [r.keep for r in rows if r.quality]
    assert sum(kept) / len(kept) > 0.98


def test_sites_shrink(spark):
    """A path of one document follows its host, one of many follows itself."""
    rows = [("h1", "p", 0.1)] * 200 + [("h1", "q", 0.9)] + [("h2", "p", 0.9)] * 200 + [("h2", "q", 0.1)] + [(None, None, 0.5)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    found = {(r.host, r.path): r for r in quality.site_records(scored).collect()}
    assert found["h1", "p"].path_rate == pytest.approx(0.1, abs=0.02)
    assert found["h1", "q"].path_rate < 0.5 + 0.4 and found["h1", "q"].path_rate < found["h2", "p"].path_rate
    assert (None, None) in found


def test_quality_edges(docs, rows, none, clashing, spark):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    how = dict(host=F.col("source"), path=F.col("lang"))
    assert quality.judge(docs, labels, **how).count() == len(rows)
    assert quality.judge(clashing, labels, **how).count() == len(rows)
    assert quality.judge(none, labels, **how).count() == 0
    kept = quality.keep_good(clashing, labels.limit(0), **how)
    assert kept.count() == len(rows) and kept.columns == clashing.columns  # no labels: all stay


# --- HTML ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two <b>bold</b>\n three", "one\n\ntwo bold three"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ol start=3><li>i<li>j</ol></ul>", "- x\n- y\n  3. i\n  4. j"),
        ("<table><tr><th>name<th>n<tr><td>longer name<td>1</table>", "name        | n\nlonger name | 1"),
        ("<head><title>T &lt;</title><style>.ad{display:none}</style></head><p class='ad x'>no</p>yes", "yes"),
        ("<p hidden>a</p><p style='Display : none'>b</p><p aria-hidden=true>c</p><script>if (a<b) '</p>'</script>d", "d"),
        ("<div style='display:none'><p>x<div>y</div></div>z", "z"),
        ("<pre>a  b\n c</pre>d", "a  b\n c\n\nd"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<blockquote><p>q</blockquote>", "> q"),
        ("a<!-- no <p> -->b <![CDATA[x]]>", "ab"),
        ("<a href='x>y'>link</a> cut <b", "link cut <b"),
        ("</p></div>still<td>cell", "still\ncell"),
    ],
)
def test_layout(page, text):
    assert html_text.render(page)[1] == text


@pytest.mark.parametrize(
    "page,text",
    [
        # Text that browsers show.
        ("<p>a<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "ax=1"),
        ("<textarea> a &amp; b\n <i>c</textarea>d", " a & b\n <i>c\nd"),
        ("<select><option>one<option>two</select>", "one\ntwo"),
        ("<svg><title>t</title><text>label</text>none<defs><text>no</text></defs></svg>!", "label\n!"),
        ("<p>a<svg/>b</p>c", "ab\n\nc"),
        ("<p>a<svg><path d='x'/><g/><text>b</text></svg>c", "a\nb\nc"),
        ("<xmp><b>raw</b> &amp;</xmp>", "<b>raw</b> &amp;"),
        ("<input type=submit value=Go> x <input type=hidden value=no>", "Go x"),
        ("x<!-- y --!>z<!-->w<!-- open", "xzw"),
        ("a < b > c <- d </ e", "a < b > c <- d </ e"),
        # Rules of the page.
        ("<style>@media print{.n{display:none}}</style><p class=n>menu", "menu"),
        ("<style>@media screen and (min-width:300px){.n{display:none}}</style><p class=n>menu</p>x", "x"),
        ("<style>@media (max-width: 600px){.n{display:none} .m{color:red}}</style><p class=n>menu", "menu"),
        ("<style>/* x { */ .n{display:none}</style><p class=n>menu</p>y", "y"),
        ("<style>@import 'a'; @font-face{src:x} .n , #k{color:red;display:none}</style><p class=n>a</p><p id=k>b</p>y", "y"),
        ("<div style='visibility:hidden'>a<p style='visibility:visible'>b</p>c</div>", "b"),
        ("<style>.h{visibility:hidden}.v{visibility:visible}</style><div class=h>a<b class=v>b</b>c</div>", "b"),
        ("<div style='display:none'>a<p style='visibility:visible'>b</p></div>c", "c"),
        # The tree.
        ("<div><table><tr><td>a</div>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table></div>f", "ab | c\nd  | e\nf"),
        ("<b>one<p>two</b>three</p>four", "one\n\ntwothree\n\nfour"),
        ("<span>one<p>two</span>three</p>four", "one\n\ntwothree\n\nfour"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a x | y | b"),
        ("<ul><li hidden>a<li>b</ul>", "- b"),
        # Tables.
        ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>longer</table>", "wide  | c\na | b | longer"),
        ("<table><tr><td colspan=2>wider than both<td>c<tr><td>a<td>b<td>d</table>", "wider than both | c\na | b           | d"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>s<td>3</table>", "r | 1\n  | 2\ns | 3"),
        ("<table><tr><td>" + "w" * 50 + "<td>1<tr><td>a<td>2</table>", "w" * 50 + " | 1\na" + " " * 49 + " | 2"),
    ],
)
def test_visible_text(page, text):
    assert html_text.render(page)[1] == text


def test_long_cells_are_wrapped_within_their_column():
    long = " ".join(f"word{i}" for i in range(100))
    lines = html_text.render(f"<table><tr><td>a<td>{long}<td>z<tr><td>bb<td>short<td>y</table>")[1].split("\n")
    assert " ".join(line.split(" | ")[1].rstrip(" |") for line in lines[:-1]) == long
    at = lines[0].index("| z")
    assert lines[-1].index("| y") == at and max(map(len, lines)) < html_text.WIDEST + 20
    solid = "x" * 1001
    assert html_text.render(f"<table><tr><td>{solid}<td>z</table>")[1].count("x") == 1001


_BROKEN = {
    "nested": lambda n: "<div>" * n + "x" + "</div>" * n,
    "lines of nested": lambda n: "<div>x" * n,
    "open tags": lambda n: "<a " * n,
    "quotes": lambda n: '<a ">"' * n,
    "comments": lambda n: "<!--" * n,
    "no rules": lambda n: "<style>" + "a" * n + "</style>",
    "open rules": lambda n: "<style>" + "a{" * n,
    "paragraphs in bold": lambda n: "<b><p>x</b>" * n,
    "bold before": lambda n: "<b>" * n + "<p>" + "</b>" * n,
    "cells": lambda n: "<table>" + "<tr><td>x" * n,
    "rows without a table": lambda n: "<tr><td>" * n,
    "lists": lambda n: "<ul><li>" * (n // 10),
    "tables": lambda n: "<table><tr><td>" * (n // 50),
    "spaces": lambda n: "<a " + " " * n + ">x",
    "end tags": lambda n: "<p>" + "</div>" * n,
    "drawings": lambda n: "<svg><text>a" * n,
}


@pytest.mark.parametrize("name", _BROKEN)
def test_time_grows_with_the_page(name):
    """Five times the page takes about five times as long, not twenty-five."""
    import time

    def seconds(n):
        page, start = _BROKEN[name](n), time.process_time()
        html_text.render(page)
        return time.process_time() - start

    seconds(1000)
    small, large = seconds(8_000), seconds(40_000)
    assert large < max(0.3, 12 * small)


def test_layout_depth_and_title():
    title, text = html_text.render("<title>A\n b</title>" + "<div>" * 5000 + "deep" + "</div>" * 5000)
    assert (title, text) == ("A b", "deep")


def test_extract(spark):
    rows = [(1, None, "x"), (2, "<p>a", "y"), (2, "<p>a", "y"), (None, "<p>" + "w " * 50_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, title string")
    found = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars, r.n_lines) for r in found) == [("1", 0, 0), ("2", 1, 1), ("2", 1, 1), ("None", 99_999, 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_every_visible_word_of_the_pages_stays(spark):
    """Against the plain text of lxml-free stripping: the same words in the same order, tables aside."""
    import re

    for page in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title|noscript|template)\b.*?</\1>", " ", page.html)
        import html

        plain = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        found = [w for w in html_text.render(page.html)[1].split()]
        marks = {"-", "|", ">"}
        assert [w for w in "".join(w for w in found if w not in marks and not re.fullmatch(r"\d+\.", w))] == [
            w for w in "".join(w for w in plain if w not in marks and not re.fullmatch(r"\d+\.", w))
        ]


# --- token totals ------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, tokens long")


def test_batches_commit_once(spark):
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    first = frame(spark, [(1, "a", "en", "v", 5), (2, "a", None, "v", 7), (3, None, "en", "v", 0)])
    assert rollup.commit("one", token_rollup.inserts(first))
    assert not rollup.commit("one", token_rollup.inserts(first))
    again = token_rollup.Rollup(spark, rollup.path)
    assert not again.commit("one", token_rollup.inserts(first))
    assert again.commit("two", token_rollup.revisions(first.filter("doc_id = 1"), frame(spark, [(1, "a", "en", "v", 9)])))
    assert again.commit("three/.. odd", token_rollup.deletes(first.filter("doc_id = 3")))
    assert again.commit("empty", token_rollup.inserts(first.limit(0)))
    assert of(again.totals()) == [("a", "en", "v", 1, 9), ("a", None, "v", 1, 7)]


def test_a_batch_that_died_is_not_seen(spark):
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    rows = frame(spark, [(1, "a", "en", "v", 5)])
    rollup.commit("one", token_rollup.inserts(rows))
    # As if the run had stopped between its two writes.
    stray = spark.createDataFrame([("a", "en", "v", 99, 99)], "source string, lang string, tokenizer string, docs long, tokens long")
    stray.write.parquet(f"{rollup.path}/deltas/{rollup._place('two')}")
    assert of(rollup.totals()) == [("a", "en", "v", 1, 5)]
    assert rollup.commit("two", token_rollup.inserts(rows))
    assert of(rollup.totals()) == [("a", "en", "v", 2, 10)]


def test_token_counts(docs, rows, clashing, none, library):
    with open(RANKS_FILE, "rb") as file:
        how = (file.read(), public_tokenizers.PATTERN, "v")
    theirs = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows if "<|" not in (r[1] or "")}
    found = {r.doc_id: r.tokens for r in token_rollup.token_counts(clashing, *how).collect()}
    assert {k: found[k] for k in theirs if k is not None} == {k: v for k, v in theirs.items() if k is not None}
    assert token_rollup.token_counts(none, *how).count() == 0


def test_token_totals_hold_every_whole_text(spark, library):
    """Counted with the library, one text after another."""
    totals = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        docs, tokens = totals.get((r.source, r.lang), (0, 0))
        totals[r.source, r.lang] = docs + 1, tokens + n
    hand = [(source, lang, "byte_bpe_50k", *both) for (source, lang), both in totals.items()]
    assert of(QUERIES["op5_token_counts"](spark, SF)) == sorted(hand, key=repr)


def test_long_words_are_learnt_like_short_ones():
    """Expected piece counts of words of any length, against sums over all cuts in logs."""
    pieces = tuple(sorted({"a", "b", "ab", "ba", "aab", "▁a", "▁ab", "▁"}))
    table = np.vstack([np.random.default_rng(3).dirichlet(np.ones(len(pieces)) * 2, 2).T, np.zeros((1, 2))])
    for word in ("ab", "aab" * 20, "ba" * 3000, "axb" * 500):
        marked = "▁" + word
        weight = lambda s, lang: max(table[pieces.index(s), lang] if s in pieces else 0.0, langid._OTHER if len(s) == 1 else 0.0)
        for lang in (0, 1):
            n, most = len(marked), 3
            ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = back[n] = 0.0
            with np.errstate(divide="ignore"):
                for end in range(1, n + 1):
                    ahead[end] = np.logaddexp.reduce([ahead[end - k] + np.log(weight(marked[end - k : end], lang)) for k in range(1, min(most, end) + 1)])
                for start in range(n - 1, -1, -1):
                    back[start] = np.logaddexp.reduce([back[start + k] + np.log(weight(marked[start : start + k], lang)) for k in range(1, min(most, n - start) + 1)])
            hand = np.zeros(len(pieces))
            for start in range(n):
                for k in range(1, min(most, n - start) + 1):
                    if marked[start : start + k] in pieces:
                        w = weight(marked[start : start + k], lang)
                        hand[pieces.index(marked[start : start + k])] += np.exp(ahead[start] + np.log(w) + back[start + k] - back[0])
            lattice = langid.Lattice([word], n + 3, langid.Pieces(pieces))
            _, piece, count = lattice.expected(table, np.array([lang]), np.array([1.0]))
            got = np.bincount(piece, count, len(pieces))
            assert np.allclose(got, hand, rtol=1e-6), word[:9]
