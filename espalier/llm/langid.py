"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum, over all ways to cut it into pieces, of
the products of their probabilities, which a forward pass yields in one sweep;
that of a text is the product over its words. Training runs the same lattice
forward and backward for expected counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.llm.common import q, small_batches, text_of

# Learning reads about so many documents of each language, chosen by a hash of the id.
MOST_PER_LANGUAGE = 1_000
ROUNDS = 3
UNKNOWN = "und"
_LETTERS = r"\p{L}+"
_START = "▁"
# Probability of one character that is no piece, alike in every language.
_OTHER = 1e-7
_SMOOTHING = 50.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 22
_CACHE = 300_000


class Pieces:
    """Looks substrings up in the vocabulary by rolling hash; collisions within
    the vocabulary are excluded when it is built."""

    def __init__(self, pieces: tuple[str, ...]):
        self.longest = max(map(len, pieces))
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        if (np.diff(self.hashes) == 0).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, -1, np.int32)
        some = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        wanted = hashes[some]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out[some] = np.where(self.hashes[at] == wanted, self.ids[at], -1)
        return out


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=2)
def _pieces(listed: tuple[str, ...]) -> Pieces:
    return Pieces(listed)


def read_pieces(path: str) -> tuple[str, ...]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    letters = ((p, p.removeprefix(_START)) for p in found)
    return tuple(sorted({p for p, bare in letters if bare.isalpha() and bare == bare.lower()}))


def _groups(words: list[str]):
    """Words of like length together, in pieces of bounded size."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        longest = 1 + max(len(words[order[start]]) + 3, 7)  # with the mark of the start
        room = max(1, _CELLS // (longest * 16))
        end = start
        while end < len(order) and end - start < room and len(words[order[end]]) < longest:
            end += 1
        yield order[start:end], longest
        start = end


class Lattice:
    """All cuts of some words of up to `width` characters: ids[length][:, end]."""

    def __init__(self, words: list[str], width: int, pieces: Pieces):
        marked = [_START + w for w in words]
        self.lengths = np.array([len(w) for w in marked])
        codes = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        codes[np.arange(width)[None, :] < self.lengths[:, None]] = flat
        self.width, self.steps = width, min(pieces.longest, width)
        rolled = np.zeros((len(words), width + 1), np.uint64)
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for j in range(width):
                rolled[:, j + 1] = rolled[:, j] * _BASE + codes[:, j]
            for _ in range(self.steps):
                powers.append(powers[-1] * _BASE)
            # ids[n - 1][:, j]: the piece of n characters that starts at j.
            self.ids = [
                pieces.find(rolled[:, n:] - rolled[:, : width + 1 - n] * powers[n]) for n in range(1, self.steps + 1)
            ]

    def weights(self, table: np.ndarray, n: int, start: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the pieces of `n` characters at `start`; one column
        per language, or the language of each row."""
        ids = self.ids[n - 1][:, start]
        found = table[ids] if rows is None else table[ids, rows]
        return np.maximum(found, _OTHER) if n == 1 else found

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Log likelihood of every word in every language."""
        n_words = len(self.lengths)
        sums = np.zeros((self.width + 1, n_words, table.shape[1]))
        sums[0] = 1.0
        logs = np.zeros(n_words)
        for end in range(1, self.width + 1):
            for n in range(1, min(self.steps, end) + 1):
                sums[end] += sums[end - n] * self.weights(table, n, end - n)
            low = (sums[end].max(axis=1) < 1e-100) & (end <= self.lengths)
            if low.any():  # keep long words within the range of a float
                sums[max(0, end - self.steps) : end + 1, low] *= 1e100
                logs[low] -= np.log(1e100)
        last = sums[self.lengths, np.arange(n_words)]
        return np.log(np.maximum(last, 1e-300)) + logs[:, None]

    def expected(self, table: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected piece counts as (language, piece, count), for one language per word."""
        n_words = len(self.lengths)
        everything = np.arange(n_words)
        ahead, back = np.zeros((self.width + 1, n_words)), np.zeros((self.width + 1, n_words))
        # Logs of what the sums at each place have been scaled by; long words need it.
        ahead_logs, back_logs = np.zeros_like(ahead), np.zeros_like(back)
        ahead[0], scale = 1.0, np.zeros(n_words)
        for end in range(1, self.width + 1):
            for n in range(1, min(self.steps, end) + 1):
                ahead[end] += ahead[end - n] * self.weights(table, n, end - n, rows)
            ahead_logs[end] = scale
            low = (ahead[end] < 1e-100) & (end <= self.lengths)
            if low.any():
                near = slice(max(0, end - self.steps), end + 1)
                ahead[near, low] *= 1e100
                ahead_logs[near, low] += np.log(1e100)
                scale[low] += np.log(1e100)
        back[self.lengths, everything] = 1.0
        scale = np.zeros(n_words)
        for start in range(self.width - 1, -1, -1):
            for n in range(1, min(self.steps, self.width - start) + 1):
                back[start] += self.weights(table, n, start, rows) * back[start + n]
            back_logs[start] = scale
            low = (back[start] < 1e-100) & (start < self.lengths)
            if low.any():
                near = slice(start, min(self.width, start + self.steps) + 1)
                back[near, low] *= 1e100
                back_logs[near, low] += np.log(1e100)
                scale[low] += np.log(1e100)
        total = np.maximum(back[0], 1e-300)
        scaled = ahead_logs.any() or back_logs.any()
        at, piece, count = [], [], []
        for n in range(1, self.steps + 1):
            for start in range(self.width - n + 1):
                ids = self.ids[n - 1][:, start]
                share = ahead[start] * self.weights(table, n, start, rows) * back[start + n] / total * counts
                if scaled:
                    share = share * np.exp(back_logs[0] - ahead_logs[start] - back_logs[start + n])
                some = np.flatnonzero((ids >= 0) & (share > 0))
                at.append(rows[some])
                piece.append(ids[some])
                count.append(share[some])
        return np.concatenate(at), np.concatenate(piece), np.concatenate(count)


# --- learning ----------------------------------------------------------------

def _expectations(sent):
    """Expected counts of one task's words, added up by language and piece."""

    def run(batches):
        listed, table = sent.value
        pieces = _pieces(listed)
        totals = np.zeros((table.shape[1], len(listed)))
        for batch in batches:
            words = batch.column(1).to_pylist()
            rows, counts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for chosen, width in _groups(words):
                lattice = Lattice([words[i] for i in chosen], width, pieces)
                at, piece, count = lattice.expected(table, rows[chosen], counts[chosen].astype(float))
                np.add.at(totals, (at, piece), count)
        at, piece = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(piece, pa.int32()), pa.array(totals[at, piece])],
            names=["at", "piece", "expected"],
        )

    return run


def _probabilities(expected: np.ndarray) -> np.ndarray:
    """Rows are pieces, the last one for none. Rare pieces lean on all languages together."""
    pooled = expected.sum(axis=1, keepdims=True) + 0.1
    pooled = pooled / pooled.sum()
    smooth = (expected + _SMOOTHING * pooled) / (expected.sum(axis=0, keepdims=True) + _SMOOTHING)
    return np.vstack([smooth, np.zeros((1, expected.shape[1]))])


class Model:
    def __init__(self, pieces: tuple[str, ...], languages: list[str], table: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages, self.table, self.prior = pieces, languages, table, prior


def learn(
    docs: DataFrame,
    pieces: tuple[str, ...],
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    most: int = MOST_PER_LANGUAGE,
    rounds: int = ROUNDS,
) -> Model:
    """Piece probabilities for each value of `lang_col` that isn't null.

    About `most` documents of each language are read, whole. Words are counted
    by language; the rounds of expected counts run over distinct words, and
    only one number for each language and piece reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter(q(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(q(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    numbers = F.create_map(*[F.lit(x) for i, l in enumerate(languages) for x in (l, i)])
    parts = F.create_map(*[F.lit(x) for l in languages for x in (l, int(min(1.0, most / sizes[l]) * (1 << 20)))])
    chosen = known.filter(F.pmod(F.xxhash64(q(id_col), F.lit(1)), F.lit(1 << 20)) < F.element_at(parts, q(lang_col)))
    counted = materialize(
        chosen.select(
            F.element_at(numbers, q(lang_col)).alias("at"),
            F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(_LETTERS), F.lit(0))).alias("word"),
        )
        .groupBy("at", "word")
        .agg(F.count(F.lit(1)).alias("n")),
        "langid-words",
    )
    expected = np.ones((len(pieces), len(languages)))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, _probabilities(expected)))
        found = (
            counted.mapInArrow(_expectations(sent), "at int, piece int, expected double")
            .groupBy("at", "piece")
            .agg(F.sum("expected").alias("expected"))
            .toPandas()
        )
        expected = np.zeros((len(pieces), len(languages)))
        expected[found["piece"], found["at"]] = found["expected"]
    prior = np.array([sizes[l] for l in languages], float)
    return Model(pieces, languages, _probabilities(expected), np.log(prior / prior.sum()))


# --- prediction ----------------------------------------------------------------


def _predict(sent):
    def run(batches):
        model = sent.value
        pieces, known = _pieces(model.pieces), {}
        for batch in batches:
            ids, listed = batch.column(0), batch.column(1)
            flat = listed.flatten().dictionary_encode()
            index, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
            new = [w for w in words if w not in known] if model.languages else []
            if len(known) + len(new) > _CACHE:
                known, new = {}, words
            for chosen, width in _groups(new):
                logs = Lattice([new[i] for i in chosen], width, pieces).forward(model.table)
                known.update(zip([new[i] for i in chosen], logs))
            scores = np.array([known[w] for w in words]) if model.languages else None
            lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            names, sure = [], []
            for end, n in zip(ends, lengths):
                if not n or not model.languages:
                    names.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                total = scores[index[end - n : end]].sum(axis=0) + model.prior
                best = int(total.argmax())
                names.append(model.languages[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, lang_pred, score`, one row per row of `docs`.

    `score` is the probability of the language among those learnt. A text that
    is null or has no letter is UNKNOWN with score 0, and so is every text if
    nothing was learnt. Only the text is read besides the id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.select(q(id_col)).schema[0].dataType.simpleString()
    listed = docs.select(
        q(id_col).alias("doc_id"),
        F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(_LETTERS), F.lit(0)).alias("words"),
    )
    return listed.mapInArrow(_predict(sent), f"doc_id {kind}, lang_pred string, score double")
