"""The registered query of every operator: production parameters, whole tables, and the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtally.llm import (adaptive, chunks, fuzzy, language, lexical, mixing, near, neighbours, pieces, preference, quality, toxicity,
                          whitening)
from jobtally.llm.sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    """Whether labels of a document must not be learned; a row without an id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))


def fitted_toxicity(docs: DataFrame, labels: DataFrame, learned: Column) -> toxicity.Detector:
    """A detector from the documents and labels of the learned rows; its prior is their labelled share."""
    known = labels.filter(learned & F.col("toxic").isNotNull())
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    positive = known.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    texts = docs.filter(learned).select(F.col("doc_id").alias("id"), "text")
    return toxicity.fit(texts, positive, min(max(prior, 1e-3), 0.5))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    detector = fitted_toxicity(docs, labels, ~held_out(3, 1))
    return (docs.select("doc_id", held_out(3, 1).alias("held_out"), toxicity.score("text", detector).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80).drop("digest")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Piece ids of every text, and whether they give the text back."""
    model = pieces.load(vocabulary)
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", pieces.coded("text", model).alias("coded"))
    return rows.select("doc_id", "coded.ids", F.size("coded.ids").alias("n_pieces"),
                       F.col("coded.back").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (chunks.deduplicated(_table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "spans", F.col("removed").alias("removed_chars"), F.col("first").alias("first_doc_id")))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document belongs to its one source."""
    mixed, report = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    report = report.withColumn("pattern", mixing.pattern_key(F.array("source")))
    return (mixed.join(report, "pattern").select("doc_id", "size", "source_size", "target", "taken"))


@query
def op1_language(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = docs.filter(~held_out(3, 1)).select(F.col("doc_id").alias("id"), "text", "lang")
    model = language.fit(learned, vocabulary)
    found = docs.select("doc_id", held_out(3, 1).alias("held_out"), language.identify("text", model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.filter(~held_out(5, 0)).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality.fit(docs.select(F.col("doc_id").alias("id"), "text"), known)
    return (docs.select("doc_id", held_out(5, 0).alias("held_out"), quality.score("text", model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fingerprinted(_table(spark, sf_dir, "documents"))


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another last answer; spans are shown as text. Turns without an id belong to no conversation."""
    talks = preference.conversations(_table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return (preference.formatted(preference.swapped_answers(talks)).withColumnRenamed("id", "conv_id")
            .withColumn("chosen_spans", shown("chosen_spans")).withColumn("rejected_spans", shown("rejected_spans")))


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed rules, then limits that follow each language and source."""
    return adaptive.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations are whole numbers of 64 bits here; one that needs more would be null."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)
