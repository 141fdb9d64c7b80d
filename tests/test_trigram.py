import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from espalier.functions.trigram import Threshold, codes, similarity, trigrams
from espalier.operators.search import (
    TitleIndex,
    _pattern_trigrams,
    fuzzy_search,
    index_pattern_search,
    index_search,
    pattern_candidates,
    pattern_trigrams,
    pattern_search,
    trigram_index,
    write_index,
)
from espalier.operators.similarity import similar_sets, similarity_join, similarity_self_join
from tests.conftest import rows


def plain(text):
    """The definition, word by word."""
    out, run = set(), ""
    for ch in text.lower() + " ":
        if unicodedata.category(ch)[0] in "LN":
            run += ch
        elif run:
            padded = f"  {run} "
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
            run = ""
    return out


TEXTS = ["", "a", "a b", "b a", "O'Reilly", "Don’t", "Éléphant Über", "x1 22", " -- ", "red widget", "RED WIDGET",
         "\U00020000\U00020001 q", "word " * 50]


def test_sets_follow_the_definition(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    got = {r.s: r.t for r in df.select("s", trigrams(F.col("s")).alias("t")).collect()}
    for text in TEXTS:
        assert sorted(got[text]) == sorted(plain(text)), text
    assert spark.range(1).select(trigrams(F.lit(None).cast("string"))).first()[0] is None


def test_codes_tell_trigrams_apart(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    got = df.select("s", codes(trigrams(F.col("s"))).alias("c")).collect()
    for r in got:
        assert sorted(r.c) == sorted(sum(ord(ch) << (42 - 21 * i) for i, ch in enumerate(t)) for t in plain(r.s))


@pytest.mark.parametrize(("a", "b", "expected"), [
    ("red wigdet", "red widget", 7 / 15), ("a b", "b a", 1.0), ("", "", 0.0), ("", "x", 0.0), ("Don’t", "don t", 1.0)])
def test_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected)


def test_threshold_is_exact():
    with pytest.raises(ValueError):
        Threshold(11, 10)
    with pytest.raises(ValueError):
        Threshold(0, 10)


TITLES = ["red widget", "red wigdet", "blue bolt", "Bolt, blue", "red bolt", "bluebolt", "", "wid", "gadget 100%", "a_b", None]


def _titles(spark):
    return spark.createDataFrame(list(enumerate(TITLES)), "id int, title string")


@pytest.mark.parametrize("text", ["red wid", "bolt", "blue bolt", "zzz", "", "--"])
@pytest.mark.parametrize("threshold", [Threshold(), Threshold(1, 2), Threshold(1, 1)])
def test_fuzzy_search_scan_and_index_agree(spark, text, threshold):
    df, want = _titles(spark), plain(text)
    expected = []
    for i, t in enumerate(TITLES):
        common, union = len(plain(t or "") & want), len(plain(t or "") | want)
        if common and common * threshold.under >= union * threshold.over:
            expected.append((i, common, union))
    assert rows(fuzzy_search(df, "title", text, threshold), "id", "shared", "combined") == sorted(expected, key=repr)
    index = trigram_index(df, "id", "title")
    assert rows(index_search(index, "id", text, threshold)) == sorted(expected, key=repr)


def test_stored_index_reads_only_its_trigrams(spark, folder):
    index = trigram_index(_titles(spark), "id", "title")
    write_index(index, "id", folder + "/i")
    stored = spark.read.schema(index.schema).parquet(folder + "/i")
    found = index_search(stored, "id", "red wid")
    assert rows(found) == rows(index_search(index, "id", "red wid"))
    assert "In(trigram, [" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("pattern", ["%idge%", "RED%", "%bolt", "red widget", "%", "%e b%", "%100\\%%", "a\\_b", "_ed%",
                                     "%d w_d%", "%, b%", "zz%", "%lue bol%"])
def test_pattern_search_scan_and_index_agree(spark, pattern):
    df = _titles(spark)
    index = trigram_index(df, "id", "title")
    found = rows(pattern_search(df, "title", pattern))
    assert rows(index_pattern_search(index, df, "id", "title", pattern)) == found


def test_pattern_trigrams_pad_only_closed_ends():
    letters = frozenset("abcdefghijklmnopqrstuvwxyz")
    assert sorted(sum(_pattern_trigrams("%idge%", letters), [])) == ["dge", "idg"]
    assert sorted(sum(_pattern_trigrams("red%", letters), [])) == ["  r", " re", "red"]
    assert sorted(sum(_pattern_trigrams("%d wi", letters), [])) == ["  w", " wi", "wi "]
    assert sorted(sum(_pattern_trigrams("a_b", letters), [])) == ["  a"]  # "b " is too short


@pytest.mark.parametrize("pattern", ["%ab\U0001e4d0cd%", "\U0001e4d0%", "%\U0001e4d0\U0001e4d1\U0001e4d0%", "%İst%", "%ﬁne%"])
def test_letters_that_only_one_side_knows(spark, pattern):
    """Titles are cut into runs by Spark, whose Unicode is older than Python's."""
    df = spark.createDataFrame([(1, "xab\U0001e4d0cdx"), (2, "\U0001e4d0\U0001e4d1\U0001e4d0"), (3, "abcd"), (4, "İstanbul"), (5, "a ﬁne day")], "id long, title string")
    index = trigram_index(df, "id", "title")
    found = rows(pattern_search(df, "title", pattern))
    assert len(found) >= 1 and rows(index_pattern_search(index, df, "id", "title", pattern)) == found


def test_several_lists_narrow_more_than_one(spark):
    data = [(i, f"alpha {'beta' if i % 2 else 'gamma'} {'delta' if i % 3 else 'omega'} {i}") for i in range(300)]
    df = spark.createDataFrame(data, "id long, title string")
    index = trigram_index(df, "id", "title")
    pattern = "%beta omega%"
    found = {r.id for r in pattern_search(df, "title", pattern).collect()}
    narrowed = [r.id for r in pattern_candidates(index, "id", pattern).collect()]
    assert len(narrowed) == len(set(narrowed)) and found <= set(narrowed) and len(narrowed) <= 60
    shortest = min(index.filter(F.col("trigram").isin(sum(pattern_trigrams(spark, pattern), []))).groupBy("trigram").count().collect(), key=lambda r: r["count"])
    assert shortest["count"] >= 100  # one list alone leaves twice as many
    assert pattern_candidates(index, "id", "%zzz%").count() == 0
    assert pattern_candidates(index, "id", "%a%") is None


# --- upkeep --------------------------------------------------------------


def test_an_index_follows_its_table(spark, folder):
    dice = random.Random(9)
    index, now = TitleIndex(spark, folder, "id", "title", most_runs=3), {}
    with pytest.raises(LookupError):
        index.read()
    for batch in range(6):
        gone = dict(dice.sample(sorted(now.items()), len(now) // 3))
        new = {i: " ".join(dice.choice(["red", "blue", "Widget", "bolt", "é"]) for _ in range(dice.randint(0, 3))) for i in dice.sample(range(40), 12) if i not in now or i in gone}
        now = {**{k: v for k, v in now.items() if k not in gone}, **new}
        index.apply(str(batch), *[spark.createDataFrame(list(d.items()), "id long, title string") for d in (new, gone)])
        index.apply(str(batch), spark.createDataFrame([(99, "twice")], "id long, title string"))
        rebuilt = trigram_index(spark.createDataFrame(list(now.items()), "id long, title string"), "id", "title")
        assert rows(index.read().select("trigram", "id", "set_size")) == rows(rebuilt)
        assert len(index.log.newest()[1]) <= 3
        assert rows(index_search(index.read(), "id", "red widget")) == rows(index_search(rebuilt, "id", "red widget"))
    index.compact()
    index.compact()
    assert len(index.log.newest()[1]) == 1
    assert rows(index.read().select("trigram", "id", "set_size")) == rows(rebuilt)


def test_a_search_reads_its_own_trigrams_of_every_run(spark, folder):
    index = TitleIndex(spark, folder, "id", "title")
    for batch in ("a", "b"):
        index.apply(batch, spark.createDataFrame([(ord(batch), "red widget " + batch)], "id long, title string"))
    plan = index.read().filter(F.col("trigram") == "red")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trigram,red)" in plan


def test_upkeep_keeps_no_table_of_postings(spark, folder):
    """Nearly every posting is a group of its own: in a hash table of groups a task would hold all that it has read."""
    index = TitleIndex(spark, folder, "id", "title")
    titles = spark.createDataFrame([(1, "red widget"), (2, "blue bolt")], "id long, title string")
    for batch in ("a", "b"):
        index.apply(batch, titles)
    postings = trigram_index(titles, "id", "title")
    for signs in (F.lit(1), F.col("id")):
        plan = index._stored(postings.withColumn("sign", signs))._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange") == plan.count("Sort ") == 1
    assert "Aggregate" not in index.read()._jdf.queryExecution().executedPlan().toString()


def test_compaction_sums_runs_where_they_are_written(spark, folder, monkeypatch):
    """Runs meet in the exchange that lays the merged one out, and in no other."""
    index, plans, stored = TitleIndex(spark, folder, "id", "title"), [], TitleIndex._stored
    titles = spark.createDataFrame([(1, "red widget"), (2, "blue bolt")], "id long, title string")
    index.apply("a", titles)
    index.apply("b", removed=titles.filter("id = 2"))

    def seen(self, signed):
        run = stored(self, signed)
        plans.append(run._jdf.queryExecution().executedPlan().toString())
        return run

    monkeypatch.setattr(TitleIndex, "_stored", seen)
    index.compact()
    (plan,) = plans
    assert "Aggregate" not in plan and plan.count("Exchange") == plan.count("Sort ") == 1
    assert {r.id for r in index.read().collect()} == {1}


def test_runs_sum_repeated_and_missing_keys(spark, folder):
    """Rows that repeat a key, or have none, count by posting, in a batch and over batches."""
    index, counts = TitleIndex(spark, folder, "id", "title"), {}
    old = [(1, "red bolt"), (1, "red bolt"), (1, "red nut"), (None, "bolt"), (None, "bolt"), (None, "nuts"), (2, None), (3, ""), (4, "nut")]
    batches = [(old, []), ([(4, "cut"), (1, "red bolt")], [(4, "nut"), (1, "red bolt"), (None, "bolt")]), ([], [(1, "red bolt"), (None, "nuts"), (5, "gone")])]
    for batch, (new, gone) in enumerate(batches):
        index.apply(str(batch), *[spark.createDataFrame(side, "id long, title string") for side in (new, gone)])
        for sign, side in ((1, new), (-1, gone)):
            for i, title in side:
                for t in plain(title or ""):
                    posting = (t, i, len(plain(title)))
                    counts[posting] = counts.get(posting, 0) + sign
        assert rows(index.read().select("trigram", "id", "set_size")) == sorted((p for p, n in counts.items() if n > 0), key=repr)
    index.compact()
    assert rows(index.read().select("trigram", "id", "set_size")) == sorted((p for p, n in counts.items() if n > 0), key=repr)


# --- similarity join -----------------------------------------------------


def _brute(left, right, threshold, ordered):
    out = []
    for a in left:
        for b in right:
            if ordered and not a < b:
                continue
            common, union = len(plain(a) & plain(b)), len(plain(a) | plain(b))
            if common and common * threshold.under >= union * threshold.over:
                out.append((a, b, common, union))
    return sorted(out, key=repr)


def _random_titles(seed, n, alphabet, words, lengths):
    rng = random.Random(seed)
    return sorted({
        " ".join("".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(rng.choice(words)))
        for _ in range(n)})


CASES = [
    # Tiny sets over two letters: the ended chains matter here.
    (_random_titles(1, 60, "ab", (1, 2), (1, 2, 3)), Threshold(3, 10)),
    (_random_titles(2, 60, "abc", (1, 2, 3), (1, 2, 4)), Threshold(1, 2)),
    (_random_titles(3, 80, "abcd", (2, 3), (3, 5)), Threshold(7, 10)),
    (["common " + t for t in _random_titles(4, 70, "ab", (1,), (2, 3, 4))], Threshold(4, 5)),
    (_random_titles(5, 50, "ab", (1, 2), (1, 2)) + ["a b", "b a", "A b"], Threshold(1, 1)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("crowd", [2, 1_000_000])
def test_self_join_equals_brute_force(spark, case, crowd):
    titles, threshold = CASES[case]
    # Copies of one title make up a third of the rows.
    df = spark.createDataFrame([(t,) for t in titles + [titles[0]] * (len(titles) // 2)] + [(None,), ("",)], "t string")
    got = similarity_self_join(df, "t", threshold, crowd)
    assert rows(got) == _brute(sorted(set(titles)), sorted(set(titles)), threshold, ordered=True)


@pytest.mark.parametrize("crowd", [3, 1_000_000])
def test_two_sided_join_equals_brute_force(spark, crowd):
    left = _random_titles(6, 40, "abc", (1, 2), (2, 3))
    right = left[::3] + _random_titles(7, 40, "abc", (1, 2), (2, 3))
    l = spark.createDataFrame([(t,) for t in left], "t string")
    r = spark.createDataFrame([(t,) for t in right], "t string")
    got = similarity_join(l, r, "t", Threshold(2, 5), crowd)
    assert rows(got) == _brute(sorted(set(left)), sorted(set(right)), Threshold(2, 5), ordered=False)


def test_compact_form_names_each_set_once(spark):
    df = spark.createDataFrame([(t,) for t in ["a b", "b a", "A b", "a c", "a b"]], "t string")
    found = similar_sets(df, None, "t", Threshold(3, 10))
    assert sorted(len(g) for g in found.members.groupBy("set").agg(F.collect_set("title")).toPandas().iloc[:, 1]) == [1, 3]
    assert found.pairs.count() == 1
    assert found.titles().count() == 3 + 3  # three variants of "a b" by themselves, and each with "a c"
    assert sorted(tuple(r) for r in found.classes().drop("side").collect()) == [
        ("A b", "A b", 1), ("a b", "A b", 1), ("a c", "a c", 1), ("b a", "A b", 1)]


def test_classes_of_two_sides_count_each_set_once(spark):
    left = spark.createDataFrame([("a b",), ("a c",)], "t string")
    right = spark.createDataFrame([("b a",), ("a c",), ("xyz",)], "t string")
    found = similar_sets(left, right, "t", Threshold(3, 10)).classes()
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "a b", "a b", 1), (1, "a c", "a c", 1), (2, "a c", "a c", 1), (2, "b a", "a b", 1), (2, "xyz", "xyz", 0)]
