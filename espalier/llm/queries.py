"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from espalier.durable import fresh_path, materialize
from espalier.functions.once import with_once
from espalier.llm import (
    alignment,
    bpe,
    exact_dedup,
    html_text,
    langid,
    line_dedup,
    mixing,
    periodic,
    quality,
    simhash,
    sketch,
    spherical,
    token_rollup,
)
from espalier.llm.common import WORD, table, text_of

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(
        table(spark, folder, "documents"), table(spark, folder, "labels"), host=F.col("source"), path=F.col("lang")
    )
    return judged.drop("key_id", "key_text")


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in; then those labelled poor go and those labelled toxic
    are counted anew with runs of white space as one space; at last the poor ones
    are back and the others as they stand. Every batch counts whole texts and runs
    twice; the totals are those of the whole table."""
    docs = table(spark, folder, "documents")
    with open(RANKS_FILE, "rb") as file:
        how = (file.read(), public_tokenizers.PATTERN, "byte_bpe_50k")
    first = materialize(token_rollup.token_counts(docs, *how), "rollup-counts")
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(
        (F.min("quality") == 0).alias("poor"), (F.max("toxic") == 1).alias("toxic")
    )
    poor = first.join(marks.filter("poor"), "doc_id", "left_semi")
    toxic = marks.filter("toxic and not coalesce(poor, false)")
    old = first.join(toxic, "doc_id", "left_semi")
    # Counted before the join, so that counts are exchanged and texts never are.
    spaced = token_rollup.token_counts(docs.withColumn("text", exact_dedup.normalised("text")), *how)
    new = materialize(spaced.join(toxic, "doc_id", "left_semi"), "rollup-anew")
    labels = token_rollup.deletes(poor).unionByName(token_rollup.revisions(old, new))
    back = token_rollup.inserts(poor).unionByName(token_rollup.revisions(new, old))
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    for batch, rows in (("load", token_rollup.inserts(first)), ("labels", labels), ("back", back)) * 2:
        rollup.commit(batch, rows)
    return rollup.totals()


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = langid.learn(docs.filter(fold != 1), langid.read_pieces(PIECES_FILE))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compare_with_next(table(spark, folder, "documents"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    definition = bpe.read_definition(BPE_FILE)
    encoded = bpe.encode(table(spark, folder, "documents"), definition)
    return token_digests(bpe.decode(encoded, definition))


def token_digests(decoded: DataFrame, *others: str) -> DataFrame:
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return decoded.select("doc_id", "n_tokens", *digests, *others)


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    pair = alignment.Pair.read(BPE_FILE, public_tokenizers.PATTERN, PIECES_FILE)
    aligned = alignment.align(table(spark, folder, "documents"), pair)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    return alignment.with_agreement(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))


def op12_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return spherical.near_vectors(table(spark, folder, "embeddings"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.word_runs(with_repeats(table(spark, folder, "documents")))
    best = with_once(found, best=periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id, text`: about every tenth text, by a hash of its id, with a last
    part that repeats one stretch of its words. A null id changes nothing."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(mark % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all(text_of("text"), F.lit(WORD), F.lit(0)))
    split = with_once(docs.select("doc_id", "text"), words=words, g=F.expr("crc32(cast(doc_id as string)) div 10"))
    placed = split.withColumns({"a": F.when(F.size("words") > 0, F.expr("cast(g % size(words) as int)"))}).withColumn(
        "p", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)")
    )
    again = F.transform(
        "words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    )
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_html_extraction,
        op3_quality_classifier,
        op4_simhash_near_dedup,
        op5_token_counts,
        op6_exact_dedup,
        op7_mixing,
        op8_language_id,
        op9_document_fingerprints,
        op10_bpe,
        op11_cross_tokenizer_alignment,
        op12_embedding_near_dedup,
        op13_periodic_runs,
    )
}

# Words and white space are spelled with the same fixed classes as in the code.
ORACLE = {
    "op1_line_dedup": r"""
        WITH cut AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM cut),
        shared AS (
            SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        marked AS (
            SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> first AS gone
            FROM keyed LEFT JOIN shared USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op6_exact_dedup": r"""
        WITH digests AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM digests WINDOW g AS (PARTITION BY text_sha256)
    """,
}
