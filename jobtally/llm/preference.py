"""Preference formatting: a shared prompt and two masked completions, in DataFrame functions alone.

The turns that a chosen and a rejected conversation have in common from the start are rendered once, as the prompt.
What follows is rendered as a completion of each, with the spans of characters that are trained on: the answers of the
assistant and their end marks. Markers inside a text are broken up, so that no text can open a turn.

Cases: a null role or text is rendered as empty, but is no equal of an empty one; turns with the same number are ordered
by role, then text; a conversation that ends inside the other has an empty completion without spans, as both have where
they are equal; a null conversation counts as one without turns; an input column with the name of an output gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ANSWERS = "assistant"
END = "<|end|>\n"
OUTPUTS = ("n_common", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): every conversation as one array of its turns in order."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = F.array_sort(F.collect_list(one))
    return turns.groupBy(F.col(id).alias("id")).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns that are equal."""
    most = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), most), lambda i: F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    differs = F.array_position(same, False)
    return F.when(most <= 0, 0).otherwise(F.when(differs > 0, differs - 1).otherwise(most)).cast("int")


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<​|"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(turn["role"]), F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _safe(t["text"]), F.lit(END))), "")


def spans(turns: Column) -> Column:
    """Start and end, in characters of the rendered turns, of every answer with its end mark."""
    sized = F.transform(turns, lambda t: F.struct(
        F.length(_head(t)).alias("head"), (F.length(_safe(t["text"])) + len(END)).alias("body"),
        F.coalesce(t["role"] == ANSWERS, F.lit(False)).alias("answers")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(done: Column, t: Column) -> Column:
        first, last = done["at"] + t["head"], done["at"] + t["head"] + t["body"]
        found = F.when(t["answers"], F.concat(done["spans"], F.array(F.struct(first.alias("start"), last.alias("end"))))
                       ).otherwise(done["spans"])
        return F.struct(last.alias("at"), found.alias("spans"))

    return F.aggregate(sized, start, add, lambda done: done["spans"])


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The other columns of `pairs`, then n_common, prompt, and text and spans of both completions."""
    a, b = (F.coalesce(F.col(c), F.array().cast(TURNS)) for c in (chosen, rejected))
    others = [c for c in pairs.columns if c not in (chosen, rejected, *OUTPUTS)]
    base = pairs.select(F.struct(F.lit(0), *others).alias("__others"), a.alias("__a"), b.alias("__b"), common_turns(a, b).alias("n_common"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return base.select(
        *(F.col("__others").getField(c).alias(c) for c in others), "n_common", rendered(F.slice("__a", F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(rest("__a")).alias("chosen_text"), spans(rest("__a")).alias("chosen_spans"),
        rendered(rest("__b")).alias("rejected_text"), spans(rest("__b")).alias("rejected_spans"))


def swapped_answers(talks: DataFrame) -> DataFrame:
    """Pairs (id, chosen, rejected): a conversation, and the same with the last answer of the conversation whose id
    differs in the lowest bit. Without that partner, or without an answer of its own to take, the rejected side ends
    before the last answer; a conversation without any answer is both sides."""
    answer = lambda t: F.coalesce(t["role"] == ANSWERS, F.lit(False))
    found = F.array_position(F.reverse(F.transform("turns", answer)), True)
    last = F.when(found > 0, F.size("turns") - found + 1).cast("int")
    talks = talks.select("id", "turns", last.alias("last"))
    other = talks.filter("last IS NOT NULL").select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.element_at("turns", F.col("last")).alias("answer"))
    replaced = F.transform("turns", lambda t, i: F.when(i == F.col("last") - 1, F.col("answer")).otherwise(t))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).when(F.col("answer").isNotNull(), replaced).otherwise(
        F.slice("turns", F.lit(1), F.col("last") - 1))
    return talks.join(other, "id", "left").select("id", F.col("turns").alias("chosen"), rejected.alias("rejected"))
