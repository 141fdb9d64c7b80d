"""Alignments of two tokenizers against one written byte by byte, with the libraries' own tokens."""

import hashlib
import os
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from espalier.llm import alignment
from espalier.llm.queries import BPE_FILE, PIECES_FILE, QUERIES
from tests.llm.conftest import SF, of

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.read(BPE_FILE, public_tokenizers.PATTERN, PIECES_FILE)


@pytest.fixture(scope="module")
def sides():
    one = Tokenizer.from_file(BPE_FILE)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE)


def spans(tokens):
    """(id, first byte, end byte) of every token, and the bytes of all."""
    out, at = [], 0
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out, b"".join(p for _, p in tokens)


def one_text(text, sides):
    """Tokens, groups and links of a text, by looking at every byte."""
    first, second = sides
    if not text:
        return [], [], [], []
    plain = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte = plain | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain.values())}
    coded = first.encode(" " + text, add_special_tokens=False)
    a, whole_a = spans([(i, bytes(byte[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)])
    named = [(i, second.id_to_piece(i)) for i in second.encode(text)]
    b, whole_b = spans([(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named])
    if not whole_a == whole_b == (" " + text).encode():
        return [], [], [], []
    over = [[k for k, (_, s, e) in enumerate(side) for _ in range(s, e)] for side in (a, b)]
    links = sorted(set(zip(*over)))
    groups, ends_b, at_a, at_b = [], {e: k for k, (_, _, e) in enumerate(b)}, 0, 0
    for k, (_, _, e) in enumerate(a):
        if e in ends_b:
            groups.append(([i for i, _, _ in a[at_a : k + 1]], [i for i, _, _ in b[at_b : ends_b[e] + 1]]))
            at_a, at_b = k + 1, ends_b[e] + 1
    return [i for i, _, _ in a], [i for i, _, _ in b], groups, [(a[x][0], b[y][0]) for x, y in links]


def by_hand(rows, sides):
    done = [(doc_id, *one_text(text, sides)) for doc_id, text in rows]
    counts = Counter(link for *_, links in done for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in done:
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if a else ""
        best = sum(counts[k] == most[k[1]] for k in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[k] for k in links), digest))
    return sorted(out, key=repr)


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def digested(aligned, **how):
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return of(alignment.with_agreement(aligned.withColumn("groups_sha256", digest), **how), *COLUMNS)


MORE = [
    (900, "x ▁ y"),  # the sign itself becomes a space
    (901, "<s>hi</s> <unk> <0x41> <|endoftext|> [INST]"),
    (902, "tab\there\n\nnul\x00 \x7f ﻿ �"),
    (903, "  two  spaces   three    end   "),
    (904, "日本語テキスト 🤷🏽‍♀️ ⅷ ½ ﬁ é é"),
    (905, "𞓐𞓑 \U000e0001 \U0010ffff"),
    (906, " "),
    (907, "a" * 5000 + " " * 300 + "\n" * 200),
]


@pytest.mark.parametrize("most_pairs", [0, 40, alignment.MOST_PAIRS])
def test_awkward_rows(spark, docs, rows, pair, sides, most_pairs):
    table = docs.select("doc_id", "text").filter(F.col("text").isNull() | (F.length("text") < 50_000))
    table = table.unionByName(spark.createDataFrame(MORE, "doc_id long, text string"))
    hand = by_hand([(r[0], r[1]) for r in rows if len(r[1] or "") < 50_000] + MORE, sides)
    assert any(r[1] == 0 and r[0] == 900 for r in hand)
    got = alignment.align(table, pair)
    assert digested(got, most_pairs=most_pairs) == hand


def test_clashing_names_and_no_rows(clashing, none, pair, docs):
    extra = clashing.select("*", *[F.lit("x").alias(c) for c in "row_no links groups n_a count best a b class most n_best count_sum".split()])
    one, two = (of(alignment.with_agreement(alignment.align(t, pair))) for t in (extra, docs))
    assert one == two
    assert alignment.with_agreement(alignment.align(none, pair)).count() == 0


def test_batches_are_cut_anywhere(docs, pair, monkeypatch):
    rows = [r.text for r in docs.filter("length(text) < 3000").collect()]
    import pyarrow as pa

    class Sent:
        value = pair

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([t or "" for t in rows])], names=["a", "b"])
    found = []
    for size in (1, 700, 1 << 20):
        monkeypatch.setattr(alignment, "_TOGETHER", size)
        found.append([r for out in alignment._run(Sent, list("abcdefg"))([batch]) for r in out.to_pylist()])
    assert found[0] == found[1] == found[2]


def test_long_text(docs, pair):
    [row] = alignment.align(docs.filter("doc_id = 7"), pair).collect()
    assert row.n_a >= 30_000 and sum(x.n for x in row.links) == row.n_links


def test_vocabulary_in_another_order_is_refused(tmp_path):
    import json

    with open(BPE_FILE, encoding="utf-8") as file:
        parsed = json.load(file)
    parsed["model"]["merges"].reverse()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parsed))
    with pytest.raises(ValueError):
        alignment.Pair.read(str(path), public_tokenizers.PATTERN, PIECES_FILE)


def test_query_equals_the_libraries(spark, sides):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_cross_tokenizer_alignment"](spark, SF)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert of(got, *COLUMNS) == by_hand(rows, sides)
