"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir), keeps all columns of `docs`, and works on all its rows.

Cases: columns of any other name are carried along in one struct, so none can clash; rows without an id can't be told apart
and are never copies, repeats or holders of one, but are scored, mixed and encoded like all others; different texts under
one id are documents of their own; rows that repeat id and text are copies of each other; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from jobtally.llm import chunks, mixing, near, pieces, toxicity
from jobtally.llm.queries import TOKENIZERS, fitted_toxicity
from jobtally.llm.work import Marks, marked

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector, trained on all labels, scores below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    detector = fitted_toxicity(docs, labels, F.lit(True))
    scored = docs.select(F.struct(*docs.columns).alias("d"), toxicity.score("text", detector).alias("score"))
    return scored.filter(F.col("score") < TOXIC).select("d.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose sets of five-word shingles are linked at 0.8 or more.

    Only rows of ids that lose a text are moved; all others go straight through.
    """
    found = near.near_duplicates(docs, words=5, percent=80).filter("doc_id IS NOT NULL")
    told = found.groupBy("doc_id", "digest").agg(F.count("*").alias("rows"), F.first("kept").alias("kept"))
    told = told.filter("rows > 1 OR NOT kept")
    moves = marked("doc_id", Marks.of(told.select("doc_id")).sent(spark))
    rows = docs.filter(moves).select("doc_id", F.xxhash64("text").alias("digest"), F.struct(*docs.columns).alias("d"))
    left = rows.join(told.filter("NOT kept"), ["doc_id", "digest"], "left_anti").dropDuplicates(["doc_id", "digest"])
    return left.select("d.*").union(docs.filter(~moves))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of fifty words or more that an earlier one holds; n_chars follows the text."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("d"))
    rows = rows.withColumn("d", F.col("d").dropFields("text"))  # the text is there once
    new = {"text": F.col("text"), "n_chars": F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("d.n_chars"))}
    cut = chunks.deduplicated(rows, carry=["d"])
    return cut.select(*(new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as many times as it is taken.

    Rows are found again by id, text and source; rows equal in all three share what was taken of them together.
    """
    mixed, _ = mixing.mix(docs, F.array("source"))
    key = lambda digest, pattern: F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest, pattern))
    taken = mixed.groupBy(key(F.col("digest"), F.col("pattern")).alias("key")).agg(F.sum("times").alias("times"), F.count("*").alias("n"))
    rows = docs.select(key(mixing.digest("text"), mixing.pattern_key(F.array("source"))).alias("key"), F.struct(*docs.columns).alias("d"))
    nr = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("d")))
    own = F.floor(F.col("times") / F.col("n")) + F.when(nr <= F.col("times") % F.col("n"), 1).otherwise(0)
    dealt = rows.join(taken.filter("times > 0"), "key").withColumn("own", own.cast("int")).filter("own > 0")
    return dealt.select("d", F.explode(F.sequence(F.lit(1), F.col("own")))).select("d.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they give its text back."""
    model = pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = docs.select("doc_id", "source", "lang", "text", pieces.coded("text", model).alias("__coded"))
    return rows.select("doc_id", "source", "lang", "__coded.ids", F.size("__coded.ids").alias("n_pieces"),
                       F.col("__coded.back").eqNullSafe(F.col("text")).alias("round_trip"))
