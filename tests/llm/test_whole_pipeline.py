"""The quality classifier and the whole pipeline, written out again in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from espalier.llm import quality
from espalier.llm.queries import BPE_FILE, QUERIES
from tests.llm.conftest import SF, of
from tests.llm.test_dedup import lines_by_hand, near_by_hand, sha
from tests.llm.test_mix_and_sketch import n_words, targets_by_hand


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    size, n = max(len(text), 1), max(len(words), 1)

    def share(characters):
        return sum(c in characters for c in text) / size

    return [
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!#$%&*+<=>@[]^_`{}~\\"), share("|"), share("0123456789"),
        min(len(text) / n / 40, 1.0), 1 / n, len(set(words)) / n, share(" \t\n\r"),
    ]


def fitted_by_hand(x, y, ridge=1.0):
    """Ridge logistic regression as repeated weighted least squares."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    penalty = ridge * np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ w)))
        weight = np.maximum(p * (1 - p), 1e-12)
        w = np.linalg.solve(z.T @ (z * weight[:, None]) + penalty, z.T @ (weight * (z @ w) + y - p))
    return centre, scale, w, math.log(y.mean() / (1 - y.mean()))


def drawn(records):
    """{site: (sum, n, above)} -> the prior weight and {site: rate}."""
    spread = sum(n * (s / n - a) ** 2 for s, n, a in records.values())
    chance = sum(a * (1 - a) for _, _, a in records.values())
    mass = sum(n * a * (1 - a) for _, n, a in records.values())
    prior = 10_000.0 if spread <= chance else min(10_000.0, max(1.0, mass / (spread - chance)))
    return prior, {k: (s + prior * a) / (n + prior) for k, (s, n, a) in records.items()}


def quality_by_hand(rows, labels):
    """(host, path, evidence, quality) of every (doc_id, text, lang, source) row."""
    x = np.array([counts_by_hand(r[1] or "") for r in rows])
    marked = [(i, good) for i, r in enumerate(rows) for d, good in labels if d is not None and d == r[0] and good in (0, 1)]
    centre, scale, w, base = fitted_by_hand(x[[i for i, _ in marked]], np.array([g for _, g in marked], float))
    evidence = np.clip(((x - centre) / scale) @ w[:-1] + w[-1] - base, -30, 30)
    p = 1 / (1 + np.exp(-(evidence + base)))
    paths, hosts = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for (_, _, path, host), own in zip(rows, p):
        for record in (paths[host, path], hosts[host]):
            record[0] += own
            record[1] += 1
    _, host_rate = drawn({h: (s, n, p.sum() / len(p)) for h, (s, n) in hosts.items()})
    prior, _ = drawn({(h, k): (s, n, host_rate[h]) for (h, k), (s, n) in paths.items()})
    out = []
    for (_, _, path, host), own, e in zip(rows, p, evidence):
        s, n = paths[host, path]
        rate = min(max((s - own + prior * host_rate[host]) / (n - 1 + prior), 1e-6), 1 - 1e-6)
        out.append((host, path, e, 1 / (1 + math.exp(-(math.log(rate / (1 - rate)) + e)))))
    return out


def test_quality_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    hand = {r[0]: h for r, h in zip(rows, quality_by_hand(rows, labels))}
    found = QUERIES["op3_quality_classifier"](spark, SF).collect()
    assert len(found) == len(rows) == len(hand)
    for r in found:
        host, path, evidence, good = hand[r.doc_id]
        assert (r.host, r.path) == (host, path)
        assert r.evidence == pytest.approx(evidence, rel=1e-4, abs=1e-4)
        assert r.quality == pytest.approx(good, rel=1e-4, abs=1e-5) and r.keep == (good >= 0.5)


# --- the pipeline ----------------------------------------------------------------


def kept_text(rows):
    """Each row's text without the lines of earlier documents; checked against the digests of `lines_by_hand`."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first, n = {}, defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(table)
            if len(key) >= 10:
                first[key] = min(first.get(key, doc_id), doc_id)
                n[key].add(doc_id)
    out = []
    for doc_id, text, *rest in rows:
        keys = [(line, line.strip(" \t\n\x0b\x0c\r").translate(table)) for line in (text or "").split("\n")]
        out.append((doc_id, "\n".join(x for x, k in keys if len(n[k]) < 2 or first[k] == doc_id), *rest))
    assert sorted((d, sha(t)) for d, t, *_ in out) == sorted((d, h) for d, _, _, h in lines_by_hand(rows))
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def mixed_by_hand(rows, seed=7):
    """Each row as often as an epoch begins it."""
    sizes, targets = targets_by_hand(rows)
    out = []
    for source, size in sizes.items():
        def place(r):
            own = xxhash.xxh64_intdigest(int(r[0]).to_bytes(8, "little", signed=True), 42)
            text = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
            h = xxhash.xxh64_intdigest(own.to_bytes(8, "little"), 42)
            h = xxhash.xxh64_intdigest(text.to_bytes(8, "little"), h)
            return signed(xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)), signed(own), signed(text)

        words = int(targets[source])
        whole, before = words // size if size else 0, 0
        for r in sorted((r for r in rows if r[3] == source), key=place):
            out += [r] * (whole + (before < words - whole * size))
            before += n_words(r[1])
    return out


def test_run_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    good = [r for r, (*_, q) in zip(docs, quality_by_hand(docs, labels)) if q >= 0.5]
    fresh = kept_text(good)
    stays = {component for _, _, component, _ in near_by_hand(fresh)}
    mixed = mixed_by_hand([r for r in fresh if r[0] in stays])
    library = Tokenizer.from_file(BPE_FILE)
    hand = []
    for doc_id, text, *_ in mixed:
        ids = library.encode(text, add_special_tokens=False).ids
        blob = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        hand.append((doc_id, len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), bytearray(blob)))
    found = corpus_pipeline.run(spark, SF)
    assert len(docs) > len(good) > len(stays) > 50
    assert of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == sorted(hand, key=repr)


@pytest.fixture(scope="module")
def labels_folder(spark, tmp_path_factory):
    """A folder with labels alone: stages take their documents as they come."""
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_clashing_names(spark, name, stage, none, docs, clashing, labels_folder):
    assert stage(spark, none, labels_folder).count() == 0
    plain, odd = (stage(spark, d, labels_folder) for d in (docs, clashing))
    assert of(odd, *plain.columns) == of(plain)
    if name != "bpe":
        assert odd.columns == [c for c in clashing.columns if c not in ("n_lines", "n_dropped") or name != "lines"] or odd.columns == clashing.columns


def test_quality_without_labels_keeps_all(spark, docs):
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang"))
    assert kept.count() == docs.count()
