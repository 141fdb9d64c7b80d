"""Token totals by source, language and tokenizer version, kept up by deltas.

A change is a signed row: +1 and the count for a document that came, -1 and the
old count for one that went, both for one that was counted anew. A batch of
changes is summed by group and stored under its own id; a second, one-row write
commits it. Totals are the sums over committed batches. Running a batch again
writes the same sums to the same place, so it changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from espalier.llm.common import q, raw, small_batches, text_of

KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import base64

    import tiktoken

    table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _counted(sent):
    def run(batches):
        encoding = _encoding(*sent.value)
        for batch in batches:
            texts = (t.decode("utf-8", "replace") for t in raw(batch.column(batch.num_columns - 1)))
            counts = pa.array([len(encoding.encode_ordinary(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], names=[*batch.schema.names[:-1], "tokens"])

    return run


def token_counts(
    docs: DataFrame, ranks: bytes, pattern: str, version: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id, source, lang, tokenizer, tokens` for every whole text; null is empty and has none."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((ranks, pattern))
    kind = docs.select(q(id_col)).schema[0].dataType.simpleString()
    slim = docs.select(
        q(id_col).alias("doc_id"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.lit(version).alias("tokenizer"),
        text_of(text_col).alias("text"),
    )
    return slim.mapInArrow(_counted(sent), f"doc_id {kind}, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add every row of `counts`."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take every row of `counts` away."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the rows `old` by the rows `new`, each side as it stands."""
    return deletes(old).unionByName(inserts(new))


@dataclass(frozen=True)
class Rollup:
    """Totals kept under `path`, a folder that all executors share."""

    spark: SparkSession
    path: str

    def _place(self, batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()[:32]

    def _committed(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch string, place string").json(f"{self.path}/commits/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def batches(self) -> list[str]:
        found = self._committed()
        return [] if found is None else sorted(r["batch"] for r in found.collect())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes, once; False if it was there already.

        A run that dies before its commit leaves sums that no reader sees; the
        next run of the batch writes over them.
        """
        if batch in self.batches():
            return False
        place = self._place(batch)
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/deltas/{place}")
        line = self.spark.createDataFrame([(batch, place)], "batch string, place string").coalesce(1)
        line.write.mode("overwrite").json(f"{self.path}/commits/{place}")
        return True

    def totals(self) -> DataFrame:
        """`source, lang, tokenizer, docs, tokens` of all committed batches; groups without documents are left out."""
        found = self._committed()
        places = [] if found is None else [r["place"] for r in found.collect()]
        if not places:
            return self.spark.createDataFrame([], _TOTALS)
        deltas = self.spark.read.schema(_TOTALS).parquet(*[f"{self.path}/deltas/{p}" for p in places])
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0")
