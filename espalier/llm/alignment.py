"""How the tokens of two tokenizers lie on one text.

Both tokenizers cut the same bytes, a space and the text. Within a batch, an
as-of join keyed by the document gives each token start of one side the token of
the other side that covers it; both directions together are all overlaps. Where
tokens of both sides end at the same byte, the text falls into groups.

How often two ids overlap in the whole corpus is one grouped sum; the most
frequent pairs, a bounded number, go to where the links are, the others meet
theirs in an exchange.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.bpe import _gather as gather
from espalier.llm.bpe import pieces
from espalier.llm.common import q, text_of

# Pairs of ids that are broadcast, and bytes of text that are aligned together.
MOST_PAIRS = 1 << 18
_TOGETHER = 1 << 20


class _Pieces:
    """The bytes of every id of a vocabulary."""

    def __init__(self, found: list[bytes]):
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.values = np.frombuffer(b"".join(found), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.values, self.starts[ids], self.lengths[ids])


@dataclass(frozen=True)
class Pair:
    """Two tokenizers: a byte-level BPE definition with its split pattern, whose
    ids ascend in the order of merges, and a serialised sentence-piece model that
    puts a space before the text."""

    definition: str
    pattern: str
    model: bytes

    @staticmethod
    def read(definition_file: str, pattern: str, model_file: str) -> Pair:
        with open(definition_file, encoding="utf-8") as file, open(model_file, "rb") as model:
            found = Pair(file.read(), pattern, model.read())
        parsed = json.loads(found.definition)["model"]
        merged = [parsed["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in parsed["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of the byte-level vocabulary don't follow its merges")
        return found


class _Tools:
    def __init__(self, pair: Pair):
        import sentencepiece
        import tiktoken

        found = pieces(pair.definition)
        special = {t["id"] for t in json.loads(pair.definition)["added_tokens"]}
        ranks = {p: i for i, p in enumerate(found) if i not in special}
        self.first = tiktoken.Encoding("first", pat_str=pair.pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pair.model)
        self.a = _Pieces(found)
        self.b = _Pieces([self._bytes(i) for i in range(self.second.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; strings of special tokens are plain text."""
        one = [np.array(self.first.encode_ordinary(" " + t), np.int64) for t in texts]
        return one, [np.array(x, np.int64) for x in self.second.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _tools(pair: Pair) -> _Tools:
    return _Tools(pair)


# --- one batch -------------------------------------------------------------------


@dataclass
class _Side:
    """The tokens of one tokenizer over the texts of a batch, by byte offset."""

    ids: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"at": self.starts, "doc": self.doc, name: np.arange(len(self.ids))})


def _side(ids: list[np.ndarray], pieces: _Pieces) -> _Side:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    ends = np.cumsum(pieces.lengths[flat])
    return _Side(flat, np.repeat(np.arange(len(ids)), [len(i) for i in ids]), ends - pieces.lengths[flat], ends)


def overlaps(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of all pairs that share a byte, each pair once."""
    left, right = a.frame("a"), b.frame("b")
    covered = pd.merge_asof(left, right, on="at", by="doc")
    covering = pd.merge_asof(right, left, on="at", by="doc")
    # Where both start at one byte, the first direction has the pair already.
    inner = covering[a.starts[covering["a"].to_numpy()] < covering["at"].to_numpy()]
    return (
        np.concatenate([covered["a"].to_numpy(), inner["a"].to_numpy()]),
        np.concatenate([covered["b"].to_numpy(), inner["b"].to_numpy()]),
    )


def _listed(values: pa.Array, cuts: np.ndarray, separator: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), values), separator)


def _groups(a: _Side, b: _Side, docs: int) -> tuple[np.ndarray, pa.Array]:
    """Per text: how many groups, and `a1,a2|b1;a3|b2,b3`."""
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    at = np.searchsorted(a.ends, common)
    counts = np.bincount(a.doc[at], minlength=docs)
    one = _listed(pa.array(a.ids).cast(pa.string()), at + 1, ",")
    two = _listed(pa.array(b.ids).cast(pa.string()), np.searchsorted(b.ends, common) + 1, ",")
    return counts, _listed(pc.binary_join_element_wise(one, two, "|"), np.cumsum(counts), ";")


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


def _aligned(tools: _Tools, ids: pa.Array, texts: list[str], names: list[str]) -> pa.RecordBatch:
    one, two = tools.encoded(texts)
    for i, text in enumerate(texts):
        whole = (" " + text).encode() if text else None
        if any(p.joined(x[i]).tobytes() != whole for p, x in ((tools.a, one), (tools.b, two))):
            one[i] = two[i] = one[i][:0]
    a, b = _side(one, tools.a), _side(two, tools.b)
    at, on = overlaps(a, b)
    n_groups, groups = _groups(a, b, len(texts))
    n_a, n_b = len(tools.a.lengths), len(tools.b.lengths)
    pairs, n = np.unique((a.doc[at] * n_a + a.ids[at]) * n_b + b.ids[on], return_counts=True)
    fields = [pa.array(x, pa.int32()) for x in (pairs // n_b % n_a, pairs % n_b, n)]
    cuts = np.searchsorted(pairs // (n_a * n_b), np.arange(len(texts) + 1))
    links = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_LINK)))
    sizes = [np.bincount(x, minlength=len(texts)) for x in (a.doc, b.doc)]
    totals = [*sizes, n_groups, np.bincount(a.doc[at], minlength=len(texts))]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(t, pa.int64()) for t in totals], groups, links], names=names)


def _run(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(sent.value)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, done + _TOGETHER, "right")))
                texts = batch.column(1).slice(start, end - start).to_pylist()
                yield _aligned(tools, batch.column(0).slice(start, end - start), texts, names)
                start = end

    return run


def align(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, groups, links`, one row per row of `docs`.

    Counts of tokens of both sides, of groups, and of links: token occurrences of
    the two sides that share a byte. `groups` spells the ids of each group out,
    `links` lists the pairs of ids linked, with how many links of the text hold
    each. Texts that are null or empty, or whose tokens of either side don't join
    to a space and the text, have no tokens.

    Ids play no part: null and repeated ids and repeated rows each get their own
    row, an empty table gives none, other columns of `docs` are ignored.
    """
    slim = docs.select(q(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    fields = (
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
        "links array<struct<a: int, b: int, n: int>>"
    )
    return slim.mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(pair), names), fields)


# --- the whole corpus ------------------------------------------------------------


def pair_counts(links: DataFrame) -> DataFrame:
    """`a, b, count, best` from `links (a, b, n)`: how many links hold the pair,
    and whether no other `a` has more of them with this `b`. Stored."""
    counts = materialize(links.groupBy("a", "b").agg(F.sum("n").cast("long").alias("count")), "align-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row per id of one vocabulary
    ranked = counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    return materialize(ranked, "align-pairs")


def _class():
    return F.floor(F.log2("count") * 8).cast("int")  # eight classes to a doubling


def _usual_from(pairs: DataFrame, most: int) -> tuple[int, bool]:
    """The lowest class of counts from which at most `most` pairs are left, and whether others are."""
    lowest, n = 1 << 20, 0
    for row in sorted(pairs.groupBy(_class().alias("class")).count().collect(), key=lambda r: -r["class"]):  # hundreds at most
        n += row["count"]
        if n > most:
            return lowest, True
        lowest = row["class"]
    return lowest, False


def with_agreement(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """`aligned (…, links)` with `n_best` and `count_sum` in place of `links`.

    The count of a pair of ids is the number of links of all rows that hold it.
    `n_best` counts the links of a row whose count is the highest that its second
    id has with any first id, ties included; `count_sum` adds up the counts of its
    links. Rows without links, or with null for them, have zeros.
    """
    stored = materialize(aligned.withColumn("row_no", F.monotonically_increasing_id()), "align-rows")
    links = stored.select("row_no", F.inline("links"))
    pairs = pair_counts(links)
    lowest, others = _usual_from(pairs, most_pairs)
    usual = F.broadcast(pairs.filter(_class() >= lowest))  # at most `most_pairs` rows

    def summed(met: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(F.lit(0)))
        return met.groupBy("row_no").agg(best.alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    sums = summed(links.join(usual, ["a", "b"]))
    if others:
        rare = links.join(usual.select("a", "b"), ["a", "b"], "left_anti").join(pairs.filter(_class() < lowest), ["a", "b"])
        sums = sums.unionByName(summed(rare)).groupBy("row_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    whole = stored.drop("links").join(sums, "row_no", "left").drop("row_no")
    return whole.withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
