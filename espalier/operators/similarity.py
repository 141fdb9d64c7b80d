"""Pairs of similar titles, without comparing all of them.

The join works on distinct trigram sets, ordered rarest trigram first, so
copies of a title cost nothing extra. If two sets share c trigrams, the l-th
of them lies within the first `size - ceil(t * size) + l` places of either set
(prefix filter: Chaudhuri, Ganti, Kaushik, ICDE 2006; positions: Xiao et al.,
WWW 2008). Sets are matched on such a *chain*, their first shared trigrams in
order. A chain starts as one trigram. Where more than `crowd` sets show a chain
it is replaced by its extensions with one more trigram, so one frequent trigram
doesn't gather a large share of the sets. A longer chain has more extensions,
so what counts as crowded doubles with each trigram; this also ends the
refining, after as many steps as the sets can be halved. Sets that may have nothing more in
common keep the ended chain as well. Whether a chain is crowded depends on the
chain alone, so both sides agree, and every similar pair meets at exactly one
chain: the first one, in order, that isn't extended.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from espalier.durable import materialize
from espalier.functions.once import with_once
from espalier.functions.trigram import Threshold, codes, shared, trigrams

CROWD = 5_000
# How many times more sets it takes for a chain with one more trigram to be
# crowded: extending costs a few rows per set, more with every trigram, against
# thousands of candidates per set.
_PATIENCE = 2
# A set's bitmap has this many words of 64 bits.
_WORDS = 4
_NEXT = ","
_END = "."


@dataclass(frozen=True)
class SimilarSets:
    """Similar titles in compact form.

    `members` maps each title to its set (`side, set, title`); `pairs` holds the
    pairs of different sets (`l_set, r_set, shared, combined`). Titles of one set
    (reordered words, other case or punctuation) are similar by themselves and
    stay a group here; `titles` spells all pairs out.
    """

    members: DataFrame
    pairs: DataFrame
    two_sided: bool

    def titles(self) -> DataFrame:
        """`left_title, right_title, shared, combined`. Within one table, each
        unordered pair once, `left_title` being the lesser title."""
        l_side, r_side = (1, 2) if self.two_sided else (1, 1)
        left = self.members.filter(F.col("side") == l_side).alias("l")
        right = self.members.filter(F.col("side") == r_side).alias("r")
        across = (
            self.pairs.join(left, F.col("l_set") == F.col("l.set"))
            .join(right, F.col("r_set") == F.col("r.set"))
            .select("l.title", F.col("r.title").alias("other"), "shared", "combined")
        )
        inside = left.join(right, F.col("l.set") == F.col("r.set"))
        if not self.two_sided:
            across = across.select(
                F.least("title", "other").alias("title"),
                F.greatest("title", "other").alias("other"),
                "shared",
                "combined",
            )
            inside = inside.filter(F.col("l.title") < F.col("r.title"))
        size = F.size("l.tokens")
        same = inside.select(
            "l.title", F.col("r.title").alias("other"), size.alias("shared"), size.alias("combined")
        )
        return across.unionByName(same).withColumnsRenamed({"title": "left_title", "other": "right_title"})

    def classes(self) -> DataFrame:
        """`side, title, class_title, n_links`, one row per title of a side: the
        least title of its set, and how many other sets are similar to it."""
        links = self.pairs.select(F.col("l_set").alias("set"), F.col("r_set").alias("other"))
        links = links.unionByName(links.select(F.col("other").alias("set"), F.col("set").alias("other")))
        if self.two_sided:
            links = links.distinct()
        numbers = links.groupBy("set").agg(F.count(F.lit(1)).alias("n_links"))
        named = self.members.groupBy("set").agg(F.min("title").alias("class_title")).join(numbers, "set", "left")
        return self.members.join(named, "set").select(
            "side", "title", "class_title", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
        )


def similar_sets(
    left: DataFrame,
    right: DataFrame | None,
    column: str,
    threshold: Threshold = Threshold(),
    crowd: int = CROWD,
) -> SimilarSets:
    """Similar titles of two tables, or of one if `right` is None. `crowd` only
    steers the work; the result is the same for any value."""
    titles = _titles(left, column, 1)
    if right is not None:
        titles = titles.unionByName(_titles(right, column, 2))
    titles = materialize(titles, "titles")
    sets = _ordered_sets(titles)
    signatures = _signatures(sets, threshold, crowd)
    if right is None:
        pairs = _meet(signatures, signatures, sets, F.col("l.id") < F.col("r.id"), threshold)
    else:
        pairs = _meet(
            signatures.filter(F.col("sides").bitwiseAND(1) > 0),
            signatures.filter(F.col("sides").bitwiseAND(2) > 0),
            sets,
            F.col("l.id") != F.col("r.id"),
            threshold,
        )
    return SimilarSets(titles, pairs, right is not None)


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    column: str,
    threshold: Threshold = Threshold(),
    crowd: int = CROWD,
) -> DataFrame:
    """Pairs of distinct titles, one from each side, that reach `threshold`:
    `left_title, right_title, shared, combined`."""
    return similar_sets(left, right, column, threshold, crowd).titles()


def similarity_self_join(
    df: DataFrame, column: str, threshold: Threshold = Threshold(), crowd: int = CROWD
) -> DataFrame:
    """Unordered pairs of different titles of one table."""
    return similar_sets(df, None, column, threshold, crowd).titles()


def _titles(df: DataFrame, column: str, side: int) -> DataFrame:
    """Distinct titles with their set and a 128-bit name for the set."""
    distinct = df.select(F.col(f"`{column}`").alias("title")).filter(F.col("title").isNotNull()).distinct()
    sets = with_once(distinct, tokens=F.sort_array(codes(trigrams(F.col("title")))))
    # An empty set is similar to nothing.
    named = sets.filter(F.size("tokens") > 0).withColumn("set", F.unhex(F.md5(F.to_json("tokens"))))
    return named.withColumn("side", F.lit(side))


def _ordered_sets(titles: DataFrame) -> DataFrame:
    """Each distinct set once: `id, set, sides, size, tokens`, rare tokens first,
    with a bitmap of the tokens in `map0, map1, …`."""
    partitions = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = titles.groupBy("set").agg(F.any_value("tokens").alias("tokens"), F.bit_or("side").alias("sides"))
    tokens = sets.select("set", "sides", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("token"), F.lit(64 * _WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    ordered = (
        tokens.join(rarity, "token")
        .withColumn("word", F.floor(place / 64))
        .withColumn("bit", bit)
        # Keeps all partitions, however small: what follows is heavy on CPU.
        .repartition(partitions, "set")
        .groupBy("set", "sides", "size")
        .agg(
            # A set has at most as many tokens as its title has characters and pads.
            F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"),
            *[
                F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"map{w}")
                for w in range(_WORDS)
            ],
        )
        .withColumn("tokens", F.col("ranked.token"))
        .drop("ranked")
    )
    # Stored before use, so the ids stay what they are.
    return materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "title-sets")


def _signatures(sets: DataFrame, threshold: Threshold, crowd: int) -> DataFrame:
    """The chains under which each set is found: one row per set and chain."""
    spare = F.col("size") - threshold.share_of(F.col("size"))
    carried = [c for c in sets.columns if c not in ("set", "tokens")]
    level = sets.withColumn("spare", spare).select(
        *carried, "spare", F.posexplode(F.slice("tokens", 1, F.col("spare") + 1)).alias("pos", "token")
    )
    level = level.withColumn("chain", F.col("token").cast("string")).drop("token")
    kept, length = [], 1
    while True:
        here = level.withColumn("length", F.lit(length)).withColumn("ended", F.lit(False))
        most = crowd * _PATIENCE ** (length - 1)
        crowded = materialize(
            level.groupBy("chain").count().filter(F.col("count") > most).select("chain"), "crowded"
        )
        if crowded.isEmpty():
            kept.append(here)
            break
        busy = here.join(crowded, "chain", "left_semi")
        kept.append(here.join(crowded, "chain", "left_anti"))
        # Only sets this small can reach the threshold on `length` shared tokens.
        small = F.col("size") * threshold.over <= F.lit(length * threshold.under)
        kept.append(
            busy.filter(small).withColumn("chain", F.concat("chain", F.lit(_END))).withColumn("ended", F.lit(True))
        )
        first = F.col("pos") + 1
        following = F.slice("tokens", first + 1, F.greatest(F.col("spare") + length + 1 - first, F.lit(0)))
        # The tokens come back by id, so no stored row carries them; stored, so
        # that a step doesn't redo the ones before it.
        extended = busy.join(sets.select("id", "tokens"), "id").select(
            *carried,
            "spare",
            F.col("chain").alias("__head"),
            F.col("pos").alias("__from"),
            F.posexplode(following).alias("__step", "__next"),
        )
        level = materialize(
            extended.select(
                *carried,
                "spare",
                (F.col("__from") + 1 + F.col("__step")).alias("pos"),
                F.concat("__head", F.lit(_NEXT), F.col("__next").cast("string")).alias("chain"),
            ),
            "longer-chains",
        )
        length += 1
    columns = [*carried, "chain", "pos", "length", "ended"]
    return reduce(DataFrame.unionByName, [k.select(*columns) for k in kept])


def _meet(
    left: DataFrame, right: DataFrame, sets: DataFrame, order: Column, threshold: Threshold
) -> DataFrame:
    """Pairs of sets under a common chain, each pair once, then verified.

    Signatures travel without their tokens. Sizes, positions and bitmaps (the
    bitmap bound: Sandes, Teodoro, Melo, 2020) leave few candidates beyond the
    true pairs; only these meet their tokens.
    """
    over, under = threshold.over, threshold.under
    l_size, r_size = F.col("l.size"), F.col("r.size")
    left_over = F.when(F.col("l.ended"), F.lit(0)).otherwise(
        F.least(l_size - F.col("l.pos") - 1, r_size - F.col("r.pos") - 1)
    )
    sizes = (l_size * over <= r_size * under) & (r_size * over <= l_size * under)
    reachable = (F.col("l.length") + left_over) * (over + under) >= (l_size + r_size) * over
    # Each bit set in only one bitmap stands for a token that isn't shared.
    apart = reduce(
        lambda a, b: a + b,
        [F.bit_count(F.col(f"l.map{w}").bitwiseXOR(F.col(f"r.map{w}"))) for w in range(_WORDS)],
    )
    alike = (l_size + r_size - apart) * (over + under) >= (l_size + r_size) * (2 * over)
    # A sort-merge join whatever the size: the work is in the pairs, so it wants
    # all cores, and a chain that many sets show can spill and be split.
    candidates = (
        left.alias("l")
        .hint("merge")
        .join(right.alias("r"), (F.col("l.chain") == F.col("r.chain")) & order & sizes & reachable & alike)
        .select(
            F.col("l.id").alias("l_id"),
            F.col("r.id").alias("r_id"),
            F.col("l.pos").alias("l_pos"),
            F.col("r.pos").alias("r_pos"),
            F.col("l.length").alias("length"),
            F.col("l.ended").alias("ended"),
        )
        # Some chains bring far more candidates than others: even them out.
        .hint("rebalance")
    )
    l_sets = sets.select(F.col("id").alias("l_id"), F.col("set").alias("l_set"), F.col("tokens").alias("l_tokens"))
    r_sets = sets.select(F.col("id").alias("r_id"), F.col("set").alias("r_set"), F.col("tokens").alias("r_tokens"))
    common = shared(F.col("l_tokens"), F.col("r_tokens"))
    # Shared tokens up to the chain's last one; more than its length means that
    # the pair has an earlier chain.
    until = shared(
        F.slice("l_tokens", 1, F.col("l_pos") + 1),
        F.slice("r_tokens", 1, F.col("r_pos") + 1),
    )
    met = candidates.join(l_sets, "l_id").join(r_sets, "r_id")
    judged = with_once(met, shared=common, until=until).withColumn(
        "combined", F.size("l_tokens") + F.size("r_tokens") - F.col("shared")
    )
    first = (F.col("until") == F.col("length")) & (~F.col("ended") | (F.col("shared") == F.col("length")))
    return judged.filter(first & threshold.reached(F.col("shared"), F.col("combined"))).select(
        "l_set", "r_set", "shared", "combined"
    )
