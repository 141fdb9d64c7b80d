"""Document quality from a classifier and the record of its site.

The classifier is a logistic regression on a few counts of the text. Its
probabilities, summed over the documents of every host and of every path below
a host, give each site a record; a record of few documents is drawn towards
that of the level above, the host's towards the whole corpus. How strongly is
estimated from the spread between sites (empirical Bayes). A document's own
evidence then moves the odds of its path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import WORD, q, row_key, text_of, unused

# The classifier is fitted on about so many labelled documents, chosen by a hash of the id.
MOST_LABELLED = 20_000
THRESHOLD = 0.5
_FEATURES = ("upper", "marks", "bars", "digits", "long_words", "no_words", "distinct", "spaces")
# Sites agree or differ: the prior weight of the level above, in documents, stays within these.
_LEAST_WEIGHT, _MOST_WEIGHT = 1.0, 10_000.0


@dataclass(frozen=True)
class Model:
    """Centres, scales and weights by feature, the intercept last."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    base: float

    def log_odds(self) -> Column:
        """The document's evidence: log odds against those of the labelled documents."""
        terms = [
            (F.col(f) - c) / s * w for f, c, s, w in zip(_FEATURES, self.centre, self.scale, self.weight)
        ]
        total = F.lit(self.weight[-1] - self.base)
        for term in terms:
            total = total + term
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _share(text: Column, characters: str) -> Column:
    left = F.translate(text, characters, "")
    return (F.length(text) - F.length(left)) / F.greatest(F.length(text), F.lit(1))


def features(docs: DataFrame, text_col: str, *others: Column) -> DataFrame:
    """Numbers between 0 and 1 for every whole text."""
    text = text_of(text_col)
    counted = docs.select(*others, text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    t, n = F.col("text"), F.greatest(F.size("words"), F.lit(1))
    values = {
        "upper": _share(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "marks": _share(t, "!#$%&*+<=>@[]^_`{}~\\"),
        "bars": _share(t, "|"),
        "digits": _share(t, "0123456789"),
        "long_words": F.least(F.length(t) / n / 40.0, F.lit(1.0)),
        "no_words": 1.0 / n,
        "distinct": F.size(F.array_distinct("words")) / n,
        "spaces": _share(t, " \t\n\r"),
    }
    kept = [q(c) for c in counted.columns[: len(others)]]
    return counted.select(*kept, *[v.cast("double").alias(k) for k, v in values.items()])



def fit(sample: np.ndarray, good: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> Model:
    """Newton steps on the standardised features."""
    if not len(good) or good.min() == good.max():
        # One class only, or no labels: the text says nothing.
        flat = (0.0,) * len(_FEATURES)
        return Model(flat, (1.0,) * len(_FEATURES), (*flat, 0.0), 0.0)
    centre, scale = sample.mean(axis=0), sample.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.hstack([(sample - centre) / scale, np.ones((len(sample), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    rate = good.mean()
    return Model(tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, w)), float(np.log(rate / (1 - rate))))


def _posterior(records: DataFrame, rate: str, weight: str) -> DataFrame:
    """Adds `rate` and `weight`: the record drawn towards `above`, by moments.

    For sites with `n` documents, rates `x` and the rate `above` them, the
    spread of the true rates is what the rates vary more than chance would make
    them. Two sums over all sites reach the driver.
    """
    x, above, n = F.col("sum") / F.col("n"), F.col("above"), F.col("n")
    chance = above * (1 - above)
    row = records.agg(
        F.sum(n * (x - above) * (x - above)).alias("spread"), F.sum(chance).alias("chance"), F.sum(n * chance).alias("mass")
    ).first()
    extra = (row["spread"] or 0.0) - (row["chance"] or 0.0)
    prior = _MOST_WEIGHT if extra <= 0 else min(_MOST_WEIGHT, max(_LEAST_WEIGHT, row["mass"] / extra))
    return records.withColumn(weight, F.lit(float(prior))).withColumn(
        rate, (F.col("sum") + prior * above) / (n + prior)
    )


def site_records(scored: DataFrame) -> DataFrame:
    """`host, path` with sums for both levels and the host's posterior rate.

    Grouped sums only, combined before the exchange, so a host with a third of
    all documents costs one row per task.
    """
    paths = materialize(
        scored.groupBy("host", "path").agg(F.sum("p").alias("sum"), F.count(F.lit(1)).alias("n")), "quality-paths"
    )
    total = paths.agg((F.sum("sum") / F.sum("n")).alias("rate")).first()["rate"] or 0.5
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).withColumn("above", F.lit(float(total)))
    hosts = materialize(_posterior(hosts, "host_rate", "host_weight"), "quality-hosts")
    named = hosts.select(F.col("host").alias("of"), F.col("host_rate").alias("above"))
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return _posterior(joined, "path_rate", "path_weight").select(
        "host", "path", "sum", "n", F.col("above").alias("host_rate"), "path_rate", "path_weight"
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """`doc_id, host, path, evidence, host_rate, path_rate, quality, keep` for every row of `docs`.

    `quality` is the probability that the document is good: the odds of its
    path, without the document's own share in them, times its evidence. `keep`
    is quality at or above the threshold. Null hosts are one host, null paths one path of their
    host; a null text counts as empty. Labels with a null are not used; a
    document with several labels counts with each. Without labels of both
    kinds the text is no evidence and every document stays.
    """
    measured = materialize(
        features(
            docs,
            text_col,
            q(id_col).alias("doc_id"),
            *row_key(id_col, text_col),
            host.cast("string").alias("host"),
            path.cast("string").alias("path"),
        ),
        "quality-features",
    )
    marked = labels.select(q(id_col).alias("of"), q(label_col).cast("int").alias("good")).filter("of is not null and good in (0, 1)")
    labelled = measured.join(marked, F.col("doc_id") == F.col("of")).select("doc_id", *_FEATURES, "good")
    count = labelled.count()
    part = min(1.0, most_labelled / max(count, 1))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else labelled
    sample = chosen.toPandas()
    model = fit(sample[list(_FEATURES)].to_numpy(float), sample["good"].to_numpy(float))
    prior = model.base
    evidence = model.log_odds()
    scored = measured.select("doc_id", "key_id", "key_text", "host", "path", evidence.alias("evidence")).withColumn(
        "p", 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    )
    records = site_records(scored).withColumnsRenamed({"host": "of_host", "path": "of_path"})
    match = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    both = scored.join(records, match)
    weight = F.col("path_weight")
    # The path's posterior from its other documents.
    others = (F.col("sum") - F.col("p") + weight * F.col("host_rate")) / (F.col("n") - 1 + weight)
    rate = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = 1 / (1 + F.exp(-(F.ln(rate / (1 - rate)) + F.col("evidence"))))
    return both.select(
        "doc_id",
        "host",
        "path",
        "evidence",
        "host_rate",
        "path_rate",
        quality.alias("quality"),
        (quality >= threshold).alias("keep"),
        "key_id",
        "key_text",
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns."""
    good = judge(docs, labels, host, path, id_col, text_col, **how).filter("keep").select("key_id", "key_text").distinct()
    names = unused(docs, "good_id", "good_text")
    match = [own == q(name) for own, name in zip(row_key(id_col, text_col), names)]
    return docs.join(good.toDF(*names), match, "left_semi")
