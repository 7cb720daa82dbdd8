"""Quality rules whose limits follow the data: quantile sketches per language and source, then a joined filter.

Fixed rules first refuse texts that are too short or mostly repetition. Of the others every document has four measures
(letters per word, symbols per word, repeated lines, repeated words). A quantile sketch of each measure is kept for every
(language, source): counts of log-linear bins, 2^BITS for each doubling, so that any quantile is right to one part in 2^BITS.
Sketches merge by adding their counts, so partitions, days or sources can be sketched apart. A group of few documents takes
its limits from the merged sketch of its language, and where that is small too from the sketch of everything.

Limits lie `stretch` spreads outside the quartiles. The spread of a measure is the distance of its quartiles, but at least
a stated part of a unit: in a group where hardly any text has symbols the quartiles are all 0.

All measures are whole numbers (per million), so every run, layout and engine finds the same bins and limits.

A null or empty text has no words and fails the fixed rules; null languages and sources are groups of their own; repeated
rows count as separate documents; a table without passing documents has no limits and keeps nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobtally.llm.work import by_slices, written
from jobtally.operators.joins import split_lookup

SYMBOLS = b"#*$%&|<>"
MILLION = 1_000_000
BITS = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# Numerator, denominator and least spread (per million) of every measure.
MEASURES = {
    "word_length": ("word_chars", "n_words", 100_000),
    "symbols": ("n_symbols", "n_words", 50_000),
    "dup_lines": ("n_dup_lines", "n_lines", 150_000),
    "repeats": ("n_repeat_words", "n_words", 100_000),
}
LEAST_WORDS, MOST_REPEATED = 50, 50
_STRUCT = pa.struct([(c, pa.int64()) for c in COUNTS])


def repeated_words(word: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of every row, how many words lie in three-word windows that the row holds twice or more. `word` has word numbers."""
    covered = np.zeros(len(word), bool)
    at = np.flatnonzero(row[2:] == row[:-2]) if len(word) > 2 else np.zeros(0, np.int64)
    kinds = int(word.max()) + 1 if len(word) else 1
    for step in (1, 2):  # windows whose first two words come once only need no look at the third
        key = (row[at] * kinds + word[at]) * kinds + word[at + 1] if step == 1 else pair * kinds + word[at + 2]
        _, kind, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[kind] > 1
        at, pair = at[often], kind[often]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(row[covered], minlength=n)


def counted(texts: list[bytes | None]) -> pa.StructArray:
    """The counts of every text."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    words: list[bytes] = []
    for i, text in enumerate(texts):
        mine = (text or b"").split()
        words += mine
        out["n_words"][i] = len(mine)
        lines = [x for x in (text or b"").split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_symbols"][i] = len(text) - len(text.translate(None, SYMBOLS)) if text else 0
        out["word_chars"][i] = len(b"".join(mine).decode("utf-8", "replace"))
    number = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_repeat_words"] = repeated_words(number, np.repeat(np.arange(n), out["n_words"]), n)
    return pa.StructArray.from_arrays([pa.array(out[c]) for c in COUNTS], fields=list(_STRUCT))


def counts_of(text: Column | str) -> Column:
    """A struct of the counts of a text."""
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    return by_slices(lambda part: counted(part.column("text").cast(pa.large_binary()).to_pylist()), kind)(text)


def base_failed() -> Column:
    """The fixed rules, on the counts of a document."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measure(name: str) -> Column:
    top, bottom, _ = MEASURES[name]
    return F.expr(f"{MILLION}L * {top} div greatest({bottom}, 1)")


def bin_of(value: Column) -> Column:
    """The least value of the bin that holds a whole number from 0 on."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def middle(least: Column) -> Column:
    """The middle of the bin that starts there."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(least)) - BITS, F.lit(0)))
    return least + F.call_function("shiftright", width, F.lit(1))


def sketched(counts: DataFrame, group: list[str]) -> DataFrame:
    """The sketches (group, measure, bin, n) of the documents that pass the fixed rules."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(measure(m)).alias("bin")) for m in MEASURES)))
    return (counts.filter(~F.col("base_failed")).select(*group, values.alias("__v"))
            .groupBy(*group, "__v.measure", "__v.bin").agg(F.count("*").alias("n")))


def merged(sketches: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of wider groups: counts of equal bins are added."""
    return sketches.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, group: list[str]) -> DataFrame:
    """(group, measure, n, q1, q3): the middle of the first bin at which a quarter, and three quarters, are reached."""
    by = W.partitionBy(*group, "measure")
    seen = sketches.select("*", F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).alias("__to"),
                           F.sum("n").over(by).alias("__all"))
    reached = lambda q: F.min(F.when(4 * F.col("__to") >= q * F.col("__all"), F.col("bin")))
    return (seen.groupBy(*group, "measure").agg(F.max("__all").alias("n"), reached(1).alias("q1"), reached(3).alias("q3"))
            .withColumns({q: middle(F.col(q)) for q in ("q1", "q3")}))


def limits(sketches: DataFrame, language: str, source: str, stretch: int = 3, least: int = 100) -> DataFrame:
    """One row for each (language, source): n_group documents sketched, and low and high of every measure.

    Groups under `least` documents take the limits of their language, languages under it those of everything.
    """
    own = quartiles(sketches, [language, source])
    wide = quartiles(merged(sketches, [language]), [language]).select(
        F.col(language).alias("__lang"), F.col("measure").alias("__m"), *(F.col(c).alias(f"__w_{c}") for c in ("n", "q1", "q3")))
    every = quartiles(merged(sketches, []), []).select(F.col("measure").alias("__e"), *(F.col(c).alias(f"__e_{c}") for c in ("q1", "q3")))
    both = (own.join(wide, own[language].eqNullSafe(F.col("__lang")) & (own["measure"] == F.col("__m")))
            .join(every, F.col("measure") == F.col("__e")))
    pick = lambda q: F.when(F.col("n") >= least, F.col(q)).when(F.col("__w_n") >= least, F.col(f"__w_{q}")).otherwise(F.col(f"__e_{q}"))
    both = both.select(language, source, "measure", "n", pick("q1").alias("q1"), pick("q3").alias("q3"))
    cases = [F.when(F.col("measure") == m, F.lit(spread).cast("long")) for m, (_, _, spread) in MEASURES.items()]
    spread = stretch * F.greatest(F.col("q3") - F.col("q1"), F.coalesce(*cases))
    both = both.withColumns({"low": F.col("q1") - spread, "high": F.col("q3") + spread})
    one = lambda side, m: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}")
    return both.groupBy(language, source).agg(F.max("n").alias("n_group"), *(one(s, m) for m in MEASURES for s in ("low", "high")))


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source",
           stretch: int = 3, least: int = 100) -> DataFrame:
    """(id, language, source, the counts, base_failed, kept) of every document.

    The counts are written once; the sketches and the filter read them again, so no text is looked at twice or exchanged.
    Limits reach the documents by a lookup that splits the groups with very many documents.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(language).alias("lang"), F.col(source).alias("source"), counts_of(text).alias("c"))
    counts = written(rows.select("id", "lang", "source", "c.*").withColumn("base_failed", base_failed()), "counts")
    found = limits(sketched(counts, ["lang", "source"]), "lang", "source", stretch, least)
    known = split_lookup(counts, written(found, "limits"), ["lang", "source"], size="n_group")
    inside = reduce(and_, (measure(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")) for m in MEASURES))
    return known.select(F.col("id").alias(id), F.col("lang").alias(language), F.col("source").alias(source), *COUNTS, "base_failed",
                        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
