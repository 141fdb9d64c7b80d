"""Title search: fuzzy, by pattern, and through an inverted trigram index."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from espalier.functions.once import with_once
from espalier.functions.trigram import WORD_CHARACTER, Threshold, combined, shared, trigrams
from espalier.sources.runlog import RunLog

# A pattern is looked up by so many of its trigrams at most, and by a further one
# only while its list isn't so many times as long as the shortest.
_LISTS = 4
_LONGER = 8


def _constant(spark: SparkSession, value: Column) -> object:
    """Evaluate an expression over literals once, not per row."""
    return spark.range(1).select(value.alias("value")).first()["value"]


def fuzzy_search(
    df: DataFrame, column: str, text: str, threshold: Threshold = Threshold()
) -> DataFrame:
    """Rows whose `column` is similar to `text`, with both trigram counts.

    One pass without an exchange; see `index_search` for repeated searches.
    """
    wanted = _constant(df.sparkSession, trigrams(F.lit(text)))
    target = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
    own = F.col("__own")
    sets = with_once(df, __own=trigrams(F.col(f"`{column}`")))
    counted = with_once(sets, shared=shared(own, target))
    return (
        counted.withColumn("combined", combined(own, target, F.col("shared")))
        .filter(threshold.reached(F.col("shared"), F.col("combined")))
        .drop("__own")
    )


def pattern_search(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose `column` matches a LIKE pattern, ignoring case."""
    return df.filter(F.col(f"`{column}`").ilike(pattern))


# --- inverted index ------------------------------------------------------


def trigram_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """One posting per trigram and row: `trigram, key, set_size`."""
    titles = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias("__title"))
    sets = with_once(titles, __set=trigrams(F.col("__title")))
    return sets.select(F.explode("__set").alias("trigram"), key, F.size("__set").alias("set_size"))


def write_index(index: DataFrame, key: str, path: str) -> None:
    """Store an index so that a search reads only its own trigrams' postings.

    Ranges run over trigram and key together, so a trigram that most titles
    hold is cut into several files.
    """
    order = [F.col("trigram"), F.col(f"`{key}`")]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def index_search(
    index: DataFrame, key: str, text: str, threshold: Threshold = Threshold()
) -> DataFrame:
    """Keys whose title is similar to `text`: `key, shared, combined`.

    A title that reaches the threshold holds ceil(threshold * n) of the text's
    n trigrams, so it holds at least one of the n - ceil(threshold * n) + 1
    rarest. Only keys found under these are counted under the frequent ones.
    """
    wanted = _constant(index.sparkSession, trigrams(F.lit(text)))
    n = len(wanted)
    near = (F.col("set_size") * threshold.under >= n * threshold.over) & (
        F.lit(n * threshold.under) >= F.col("set_size") * threshold.over
    )
    postings = index.filter(F.col("trigram").isin(wanted) & near)
    found = _postings(postings)
    by_rarity = sorted(wanted, key=lambda t: (found.get(t, 0), t))
    needed = -(-n * threshold.over // threshold.under)
    rare, frequent = by_rarity[: n - needed + 1], by_rarity[n - needed + 1 :]
    first = postings.filter(F.col("trigram").isin(rare))
    rest = postings.filter(F.col("trigram").isin(frequent)).join(
        first.select(F.col(f"`{key}`").alias("__key")).distinct(),
        F.col(f"`{key}`") == F.col("__key"),
        "left_semi",
    )
    counted = (
        first.unionByName(rest).groupBy(key, "set_size").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    )
    return (
        counted.withColumn("combined", F.col("set_size") + n - F.col("shared"))
        .filter(threshold.reached(F.col("shared"), F.col("combined")))
        .select(key, "shared", "combined")
    )


def index_pattern_search(
    index: DataFrame, df: DataFrame, key: str, column: str, pattern: str
) -> DataFrame:
    """`pattern_search` that first narrows `df` by the pattern's rarest trigrams.

    Every title that matches holds all of them; the pattern itself is then tested
    on the rows that are left. Without a whole trigram in the pattern, all rows
    are tested.
    """
    candidates = pattern_candidates(index, key, pattern)
    if candidates is None:
        return pattern_search(df, column, pattern)
    found = candidates.withColumnRenamed(key, "__key")
    return pattern_search(df.join(found, F.col(f"`{key}`") == F.col("__key"), "left_semi"), column, pattern)


def pattern_candidates(index: DataFrame, key: str, pattern: str) -> DataFrame | None:
    """Keys whose title holds the pattern's rarest trigrams; None where it has no whole one.

    The lists of a few trigrams are intersected by counting keys, the shortest
    list first and others as long as they aren't much longer: a long list costs
    more to read than it rules out.
    """
    runs = pattern_trigrams(index.sparkSession, pattern)
    if not runs:
        return None
    wanted = sorted({t for run in runs for t in run})
    found = _postings(index.filter(F.col("trigram").isin(wanted)))
    rarest = sorted(wanted, key=lambda t: (found.get(t, 0), t))
    shortest = found.get(rarest[0], 0)
    if not shortest:
        return index.filter(F.lit(False)).select(key)
    # Trigrams of one word mostly come together: those of different words rule out more.
    first = {min(run, key=rarest.index) for run in runs}
    order = sorted(rarest, key=lambda t: t not in first)
    lists = [t for t in order if found[t] <= _LONGER * shortest][:_LISTS]
    postings = index.filter(F.col("trigram").isin(lists))
    if len(lists) == 1:
        return postings.select(key)
    # A title has each trigram once, so it is in all lists if it comes so often.
    return postings.groupBy(key).agg(F.count(F.lit(1)).alias("__lists")).filter(F.col("__lists") == len(lists)).select(key)


def _postings(wanted: DataFrame) -> dict[str, int]:
    """How many postings each wanted trigram has: one row per trigram of the text."""
    return {r["trigram"]: r["count"] for r in wanted.groupBy("trigram").count().collect()}


def pattern_trigrams(spark: SparkSession, pattern: str) -> list[list[str]]:
    """Per run of letters and digits, the trigrams that any match must hold. Which characters are letters or digits is
    asked of Spark, as titles were cut by Spark: its Unicode isn't Python's."""
    lowered = F.lower(F.lit(pattern))
    characters = F.regexp_extract_all(lowered, F.lit(WORD_CHARACTER), F.lit(0))
    row = _constant(spark, F.struct(lowered.alias("text"), characters.alias("inside")))
    return [run for run in _pattern_trigrams(row["text"], frozenset(row["inside"])) if run]


def _pattern_trigrams(pattern: str, inside: Collection[str]) -> Iterator[list[str]]:
    """A run of the characters `inside` is padded only at an end where the pattern
    shows that the run really ends."""
    for symbols in _runs(_symbols(pattern), inside):
        text = "".join(symbols)
        yield [text[i : i + 3] for i in range(len(text) - 2)]


_ANY = None


def _symbols(pattern: str) -> Iterator[str | None]:
    """The pattern's characters; `_ANY` for a wildcard, backslash escapes."""
    escaped = False
    for ch in pattern:
        if escaped or ch not in "%_\\":
            yield ch
            escaped = False
        elif ch == "\\":
            escaped = True
        else:
            yield _ANY


def _runs(symbols: Iterable[str | None], inside: Collection[str]) -> Iterator[list[str]]:
    run: list[str] = []
    closed_left = True
    for ch in symbols:
        if ch is not _ANY and ch in inside:
            run.append(ch)
            continue
        yield _pad(run, closed_left, ch is not _ANY)
        run, closed_left = [], ch is not _ANY
    yield _pad(run, closed_left, True)


def _pad(run: list[str], closed_left: bool, closed_right: bool) -> list[str]:
    if not run:
        return []
    return [" "] * (2 * closed_left) + run + [" "] * closed_right


# --- upkeep ----------------------------------------------------------------


@dataclass(frozen=True)
class TitleIndex:
    """An inverted index that follows its table: postings come and go by signed runs.

    `read` is an index like that of `trigram_index`, for every search above. A run
    is stored like `write_index` does, so a search reads its own trigrams only,
    of all runs. `compact` merges them; `apply` does it now and then.

    Signs are summed over sorted postings, which a task can spill. Nearly every
    posting is a group of its own, so a hash table of groups would hold all
    postings that a task has read.
    """

    spark: SparkSession
    path: str
    key: str
    column: str
    most_runs: int = 16
    log: RunLog = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "log", RunLog(self.spark, self.path))

    def apply(self, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Take rows in and out. A changed title is its old row removed and its new
        one added; a removed row has to hold the title that it had. A batch that
        is in already changes nothing."""
        if self.log.has(batch):
            return
        sides = [(df, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
        if not sides:
            return
        parts = [trigram_index(df, self.key, self.column).withColumn("sign", F.lit(sign)) for df, sign in sides]
        signed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        number, runs = self.log.newest()
        run = self.log.fresh(number + 1)
        self._stored(signed).write.parquet(run)
        runs = [*runs, run]
        if len(runs) > self.most_runs:
            runs = [self._merged(number + 1, runs)]
        self.log.commit(number + 1, batch, runs)

    def read(self) -> DataFrame:
        """`trigram, key, set_size` of the rows that are in. A filter on the trigram
        reaches the scan of every run."""
        _, runs = self.log.newest()
        if not runs:
            raise LookupError(f"no index under {self.path}")
        return self._live(runs).drop("sign")

    def compact(self) -> None:
        number, runs = self.log.newest()
        if len(runs) > 1:
            self.log.commit(number + 1, f"compacted {number}", [self._merged(number + 1, runs)])

    def _live(self, runs: Sequence[str]) -> DataFrame:
        stored = self.spark.read.parquet(*runs)
        return (stored if len(runs) == 1 else self._summed(stored)).filter("sign > 0")

    def _summed(self, signed: DataFrame) -> DataFrame:
        postings = Window.partitionBy("trigram", F.col(f"`{self.key}`"), "set_size").orderBy("sign")
        whole = postings.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sums = signed.withColumns({"sign": F.sum("sign").over(whole).cast("long"), "__place": F.row_number().over(postings)})
        return sums.filter("__place = 1 and sign <> 0").drop("__place")

    def _stored(self, signed: DataFrame) -> DataFrame:
        """A run as it is written, in the layout of `write_index`. Its ranges hold every posting whole, so it is
        summed within them, and the sort for that is the sort of the files."""
        order = [F.col("trigram"), F.col(f"`{self.key}`")]
        return self._summed(signed.repartitionByRange(*order)).sortWithinPartitions(*order)

    def _merged(self, number: int, runs: Sequence[str]) -> str:
        run = self.log.fresh(number)
        self._stored(self.spark.read.parquet(*runs)).filter("sign > 0").write.parquet(run)
        return run
