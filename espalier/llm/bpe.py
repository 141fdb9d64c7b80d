"""Byte-level BPE over a table of distinct words.

Spark splits the texts into words and counts the distinct ones. The most
frequent, a bounded number, are encoded and go to all tasks, to be looked up
where the text lies. Every other word travels once per place to meet its like,
is encoded once there, and its ids travel back and are joined in by position. Ids become text
again by a lookup in the table of pieces, which the vocabulary bounds.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import q, row_key, shuffle_partitions, small_batches, text_of

# Bounds of the frequent words that are broadcast: their number and their bytes.
MOST_WORDS = 1 << 20
MOST_BYTES = 32 << 20
# A longer word is never among them; should many rows hold it, its rows are
# dealt to so many tasks, each of which encodes it.
LONGEST = 1024
_SPREAD = 64
_BUCKETS_PER_TASK = 8
_TALLY = 1 << 20
_SEED = 42  # of Spark's own xxhash64

# The pattern of the vocabulary's pre-tokeniser, the commonest
# case first (the cases begin with different characters, so order is free) and
# without backtracking. White space is spelled out, as Java's class knows ASCII
# only.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r" ?[a-zA-Z\p{L}]++| ?\p{N}++|'(?:[stmd]|re|ve|ll)"
    rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]++|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)


@lru_cache(maxsize=4)
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(definition)
    found.no_truncation()
    found.no_padding()
    return found


def read_definition(path: str) -> str:
    """The tokenizer's file, read on the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def special_tokens(definition: str) -> list[str]:
    return [t["content"] for t in json.loads(definition)["added_tokens"]]


def words(text: Column, special: list[str]) -> Column:
    """The pieces that merges never cross, in order; together they are the text."""
    plain = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    if not special:
        return plain
    either = "|".join(re.escape(s) for s in special)
    cut = F.split(text, f"(?={either})|(?<={either})")
    pieces = F.flatten(
        F.transform(
            cut,
            lambda part: F.when(part.isin(*special), F.array(part)).otherwise(
                F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))
            ),
        )
    )
    return F.when(F.regexp_like(text, F.lit(either)), pieces).otherwise(plain)


def split(docs: DataFrame, text_col: str, definition: str, *others: Column) -> DataFrame:
    """`others`, then `words`, and `odd`: the text where it holds a character
    that Java doesn't know (its Unicode is older than the library's)."""
    text = text_of(text_col)
    odd = F.when(F.regexp_like(text, F.lit(r"\p{Cn}")), text)
    return docs.select(*others, words(text, special_tokens(definition)).alias("words"), odd.alias("odd"))


def _words_of(batch: pa.RecordBatch, rules) -> pa.Array:
    """The last two columns of `split`: words, those of odd texts split by the library."""
    listed, odd = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    if odd.null_count == len(odd):
        return listed
    rows = zip(listed.to_pylist(), odd.to_pylist())
    return pa.array([w if t is None else _split_odd(t, rules.value) for w, t in rows], listed.type)


def _split_odd(text: str, definition: str) -> list[str]:
    special = special_tokens(definition)
    parts = re.split(f"({'|'.join(map(re.escape, special))})", text) if special else [text]
    before = _tokenizer(definition).pre_tokenizer
    return [w for p in parts for w in ([p] if p in special else (p[a:b] for _, (a, b) in before.pre_tokenize_str(p)))]


# --- the table of distinct words -------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _bytes_of(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in found], np.uint64)


def _tally(buckets: int, rules):
    """Per task: its distinct words with their counts, packed by bucket of their hash."""

    def flush(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).group_by("w").aggregate([("n", "sum")])
        found = table["w"].combine_chunks().to_pylist()
        counts = table["n_sum"].to_numpy()
        bucket = (_hashes(found) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order])) + 1
        groups = [g for g in np.split(order, ends) if len(g)]
        parts = [[found[i] for i in g] for g in groups]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(bucket[g[0]]) for g in groups], pa.int32()),
                pa.array([zstandard.ZstdCompressor(3).compress(b"".join(p)) for p in parts], pa.binary()),
                pa.array([_pack(np.array([len(w) for w in p], np.int32)) for p in parts], pa.binary()),
                pa.array([_pack(counts[g].astype(np.int64)) for g in groups], pa.binary()),
            ],
            names=["bucket", "words", "lengths", "counts"],
        )

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            counted = pc.value_counts(_bytes_of(_words_of(batch, rules).flatten()).cast(pa.large_binary()))
            held.append(pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["w", "n"]))
            rows += len(counted)
            if rows > _TALLY:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def _added_up(batches):
    """Each bucket's words with their counts over all tasks."""

    def rows(counts: dict[bytes, int]):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    at, counts = None, {}
    for batch in batches:
        for bucket, blob, lengths, n in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                if counts:
                    yield rows(counts)
                at, counts = bucket, {}
            text, start = zstandard.ZstdDecompressor().decompress(blob), 0
            for length, k in zip(_unpack(lengths, np.int32).tolist(), _unpack(n, np.int64).tolist()):
                word = text[start : start + length]
                counts[word] = counts.get(word, 0) + k
                start += length
    if counts:
        yield rows(counts)


def distinct_words(docs: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """`word, n`: every distinct word once, with its count. Stored."""
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    rules = spark.sparkContext.broadcast(definition)
    return materialize(
        split(docs, text_col, definition)
        .mapInArrow(_tally(tasks * _BUCKETS_PER_TASK, rules), "bucket int, words binary, lengths binary, counts binary")
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_added_up, "word string, n long"),
        "bpe-words",
    )


def _ids(words: list[str], rules) -> list[bytes]:
    """Little-endian unsigned 32-bit integers, as the library encodes each word."""
    done = _tokenizer(rules.value).encode_batch_fast(words, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in done]


def _encoded(rules):
    """Rows that begin with a word, the same words one after another: each word
    is replaced by its ids, and encoded once."""

    def run(batches):
        last, known = None, b""
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            new = words[1:] if words and words[0] == last else words
            ids = _ids(new, rules)
            ids = ids if len(new) == len(words) else [known, *ids]
            last, known = words[-1] if words else last, ids[-1] if ids else known
            spread = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()).take(pa.array(spread)), *batch.columns[1:]], names=["ids", *batch.schema.names[1:]]
            )

    return run


# --- frequent words ----------------------------------------------------------

# Counts fall into classes, eight to a doubling.
def _class() -> Column:
    return F.floor(F.log2("n") * 8).cast("int")


def frequent_class(table: DataFrame, most_words: int, most_bytes: int) -> int:
    """The lowest class of counts from which all words fit both bounds.

    A word's ids take four bytes for each of its bytes at most."""
    sizes = table.filter(_short()).groupBy(_class().alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("b")
    )
    lowest, n, size = 1 << 20, 0, 0
    for row in sorted(sizes.collect(), key=lambda r: -r["class"]):  # a few hundred rows at most
        n, size = n + row["n"], size + row["b"]
        if n > most_words or size > most_bytes:
            break
        lowest = row["class"]
    return lowest


def _short() -> Column:
    return F.octet_length("word") <= LONGEST


class Frequent:
    """The broadcast words in the order of their counts, found by hash; a match
    is verified by the word itself. Built once, on the driver."""

    def __init__(self, table: pa.Table):
        self.words = table["word"].combine_chunks().cast(pa.binary())
        hashes = table["hash"].to_numpy().view(np.uint64)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]
    def places(self, found: pa.Array) -> np.ndarray:
        """The place of each word, -1 for one that isn't here."""
        if not len(self.hashes) or not len(found):
            return np.full(len(found), -1, np.int32)
        hashes = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in found.to_pylist()], np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = self.order[at]
        met = np.flatnonzero(self.hashes[at] == hashes)
        same = pc.equal(self.words.take(pa.array(place[met])), found.cast(pa.binary()).take(pa.array(met)))
        same = same.to_numpy(zero_copy_only=False).astype(bool)
        out = np.full(len(found), -1, np.int32)
        out[met[same]] = place[met[same]]
        # Different words of one hash are neighbours: look at them one by one.
        for i in met[~same]:
            word, j = found[int(i)].as_py(), int(at[i]) + 1
            while j < len(self.hashes) and self.hashes[j] == hashes[i]:
                if self.words[int(self.order[j])].as_py() == word:
                    out[i] = self.order[j]
                    break
                j += 1
        return out


class Codes:
    """The ids of the broadcast words, in the same order."""

    def __init__(self, table: pa.Table):
        ids = table["ids"].combine_chunks().cast(pa.binary())
        self.lengths = (pc.binary_length(ids).to_numpy(zero_copy_only=False) // 4).astype(np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.ids = np.frombuffer(b"".join(ids.to_pylist()), "<u4")


def _looked_up(sent, rules):
    """Per row, as one value: the place of every word among the frequent ones
    (0 for none), and the other words with their positions."""

    def run(batches):
        _tokenizer.cache_clear()  # a worker that has encoded words keeps no vocabulary
        frequent, pack = sent.value, zstandard.ZstdCompressor(1).compress
        for batch in batches:
            listed = _words_of(batch, rules)
            flat = _bytes_of(listed.flatten()).dictionary_encode()
            index = flat.indices.to_numpy(zero_copy_only=False)
            places = frequent.places(flat.dictionary)[index]
            lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            planes = (places + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]
            rare = np.flatnonzero(places < 0)
            others = flat.dictionary.take(pa.array(index[rare])).to_pylist()
            cuts = np.searchsorted(rare, ends)
            packed, first = [], 0
            for end, n, cut in zip(ends, lengths, cuts):
                found = others[first:cut]
                parts = (
                    np.ascontiguousarray(planes[:, end - n : end]).tobytes(),
                    (rare[first:cut] - (end - n)).astype("<i4").tobytes(),
                    np.array([len(w) for w in found], "<i4").tobytes(),
                    b"".join(found),
                )
                packed.append(np.array([n, len(found)], "<i4").tobytes() + pack(b"".join(parts)))
                first = cut
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-2], "coded"]
            )
            pa.default_memory_pool().release_unused()

    return run


def _opened(coded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview]:
    """Places of the frequent words; positions, lengths and bytes of the others."""
    n, rare = np.frombuffer(coded, "<i4", 2)
    inside = zstandard.ZstdDecompressor().decompress(coded[8:])
    planes = np.frombuffer(inside, np.uint8, 3 * n).reshape(3, n).astype(np.int64)
    places = planes[0] + (planes[1] << 8) + (planes[2] << 16) - 1
    at, lengths = np.frombuffer(inside, "<i4", 2 * rare, 3 * int(n)).reshape(2, rare)
    return places, at, lengths, memoryview(inside)[3 * int(n) + 8 * int(rare) :]


def _rare(batches):
    """`coded` rows as one row per word that isn't frequent."""
    for batch in batches:
        row, at, words = [], [], []
        for i, coded in enumerate(batch.column(3).to_pylist()):
            _, places, lengths, text = _opened(coded)
            ends = np.cumsum(lengths).tolist()
            words += [bytes(text[a:b]) for a, b in zip([0, *ends], ends)]
            at.append(places)
            row.append(np.full(len(places), i))
        row = pa.array(np.concatenate(row) if row else [], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()).cast(pa.string()),
                batch.column(0).take(row),
                batch.column(1).take(row),
                pa.array(np.concatenate(at) if at else [], pa.int32()),
            ],
            names=["word", "fill_id", "fill_text", "place"],
        )


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches values[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    steps = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    return values[np.repeat(starts, lengths) + steps]


def _filled(sent):
    def run(batches):
        codes = sent.value
        for batch in batches:
            out = []
            for coded, fills in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                places, holes, _, _ = _opened(coded)
                rare = {f["place"]: f["ids"] for f in fills or ()}
                extra = [np.frombuffer(rare[h], "<u4") for h in holes.tolist()]
                usual = places >= 0
                lengths, starts = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
                lengths[usual], starts[usual] = codes.lengths[places[usual]], codes.starts[places[usual]]
                lengths[holes] = [len(e) for e in extra]
                ids, from_rare = np.empty(int(lengths.sum()), "<u4"), np.repeat(~usual, lengths)
                ids[~from_rare] = _gather(codes.ids, starts[usual], lengths[usual])
                ids[from_rare] = np.concatenate(extra) if extra else []
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(o) // 4 for o in out], pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return run


def encode(
    docs: DataFrame,
    definition: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_words: int = MOST_WORDS,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """`doc_id, n_tokens, ids`, one row per row of `docs`.

    `ids` are little-endian unsigned 32-bit integers, those of the tokenizers
    library without special tokens added; special tokens that the text spells
    out become their ids. A null text counts as empty and has none. Repeated
    rows have equal ids. Other columns of `docs` play no part.

    Rows meet the ids of their rarer words by id and text, so ids that are null
    or repeated don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = distinct_words(docs, definition, text_col)
    lowest = frequent_class(table, most_words, most_bytes)
    rules = spark.sparkContext.broadcast(definition)
    usual = table.filter(_short() & (_class() >= lowest)).select("word", "word", "n", F.xxhash64("word").alias("hash"))
    usual = usual.toDF("again", "word", "n", "hash").mapInArrow(
        _encoded(rules), "ids binary, word string, n long, hash long"
    ).toArrow()
    usual = usual.take(pc.sort_indices(usual, [("n", "descending"), ("word", "ascending")])).combine_chunks()
    # Two broadcasts, as no task needs both.
    sent, codes = spark.sparkContext.broadcast(Frequent(usual)), spark.sparkContext.broadcast(Codes(usual))

    kind = docs.select(q(id_col)).schema[0].dataType.simpleString()
    # One value per row, and one exchange of it that both uses below share.
    coded = (
        split(docs, text_col, definition, *row_key(id_col, text_col), q(id_col).alias("doc_id"))
        .mapInArrow(_looked_up(sent, rules), f"key_id long, key_text long, doc_id {kind}, coded binary")
        .repartition(shuffle_partitions(spark), "key_id", "key_text")
    )
    # All columns go in, as pruning one would make this exchange another one.
    rare = coded.mapInArrow(_rare, "word string, fill_id long, fill_text long, place int")
    tasks = F.when(F.octet_length("word") > LONGEST, F.pmod("fill_id", F.lit(_SPREAD))).otherwise(F.lit(0))
    fills = (
        rare.repartition(shuffle_partitions(spark), "word", tasks)
        .sortWithinPartitions("word")
        .mapInArrow(_encoded(rules), "ids binary, fill_id long, fill_text long, place int")
        .groupBy("fill_id", "fill_text")
        .agg(F.collect_list(F.struct("place", "ids")).alias("fills"))
    )
    match = (F.col("key_id") == F.col("fill_id")) & (F.col("key_text") == F.col("fill_text"))
    joined = coded.join(fills, match, "left").select("doc_id", "coded", "fills")
    return joined.mapInArrow(_filled(codes), f"doc_id {kind}, n_tokens long, ids binary")


# --- decoding ------------------------------------------------------------------


def pieces(definition: str) -> list[bytes]:
    """The bytes of each id. Printable bytes stand for themselves, the others,
    in order, for the code points from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    parsed = json.loads(definition)
    found = {i: bytes(byte[c] for c in token) for token, i in parsed["model"]["vocab"].items()}
    for token in parsed["added_tokens"]:
        found[token["id"]] = token["content"].encode()
    return [found.get(i, b"") for i in range(max(found) + 1)]


def _joined(sent):
    def run(batches):
        values, starts, lengths = sent.value
        for batch in batches:
            texts = []
            for blob in batch.column(batch.num_columns - 1).to_pylist():
                ids = np.frombuffer(blob, "<u4")
                texts.append(_gather(values, starts[ids], lengths[ids]).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return run


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """`encoded (…, ids)` with `decoded`: the text of the pieces, bytes that are
    no UTF-8 replaced. The table of pieces has one row per id of the vocabulary."""
    spark = encoded.sparkSession
    found = pieces(definition)
    lengths = np.array([len(p) for p in found], np.int64)
    sent = spark.sparkContext.broadcast((np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths, lengths))
    last = encoded.select(*[c for c in encoded.columns if c != "ids"], "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema)
    return last.mapInArrow(_joined(sent), f"{fields}, decoded string")
