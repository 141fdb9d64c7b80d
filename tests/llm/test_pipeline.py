"""The pipeline, stage by stage, against the operators' own brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from espalier.durable import materialize
from espalier.llm.queries import BPE_FILE
from tests.llm.conftest import SF, awkward, of
from tests.llm.test_dedup import lines_by_hand, near_by_hand


@pytest.fixture(scope="module", params=["table", "awkward"])
def stages(request, spark, docs):
    """Each stage's input and output."""
    held = spark.read.parquet(f"{SF}/documents.parquet") if request.param == "table" else docs
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, held, SF), f"test-{name}")
        found.append((held, out))
        held = out
    return found


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.count() <= 3 * before.count()


def test_lines(stages):
    before, after = stages[1]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    hand = sorted([(d, h) for d, _, _, h in lines_by_hand(rows)], key=repr)
    assert of(after, "doc_id", F.sha2("text", 256)) == hand
    assert after.filter("n_chars <> length(text)").count() == 0


def test_near(stages):
    before, after = stages[2]
    hand = near_by_hand([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert {r.doc_id for r in after.collect()} == {component for _, _, component, _ in hand}


def test_mix(stages):
    before, after = stages[3]
    assert after.exceptAll(before.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("x")).count() == 0


def test_bpe(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(BPE_FILE)
    hand = []
    for r in before.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        hand.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert of(after, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(hand, key=repr)


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and found.columns[0] == "doc_id"
    assert corpus_pipeline.ORACLE_SQL is None and len(awkward()) > 50
