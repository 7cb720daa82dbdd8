"""Neighbouring columns as one text, so that a wide row moves in fewer bytes.

A row in a shuffle has eight bytes for every column besides its texts, and pads each text to eight; a table of twenty-five
columns takes 165 bytes a row there, compressed, and 98 with its texts and whole numbers in one column. A text sorts as its columns
do one after the other, ascending, NULLs first, so a sort needs no other form of them. It gives back exactly what went in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructField

LEAST = 5  # fewer columns gain too little
_END, _ESCAPE = "\0", "\1"  # between columns; before what stands for one of the two inside a text
_WHOLE = (ByteType(), ShortType(), IntegerType(), LongType())


def packable(field: StructField) -> bool:
    """Texts in binary order and whole numbers; fractions and all else stay columns."""
    return field.dataType == StringType() or field.dataType in _WHOLE


def runs(df: DataFrame, columns: Sequence[str], least: int = LEAST) -> list[list[str]]:
    """``columns`` in their order, cut into the runs that :func:`packed` takes together and single columns."""
    cut = []
    for fits, names in groupby(columns, lambda c: packable(df.schema[c])):
        names = list(names)
        cut += [names] if fits and len(names) >= least else [[c] for c in names]
    return cut


def packed(df: DataFrame, groups: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """The rows with one text for every group of several columns, the column of every group, and what undoes it.

    The last takes rows that still have these columns, with others if need be, and puts the packed ones back in their old order, the others after them.
    """
    texts = {f"__packed{i}": list(g) for i, g in enumerate(groups) if len(g) > 1}
    at = {c: (name, i) for name, g in texts.items() for i, c in enumerate(g)}
    held = [f"__packed{i}" if len(g) > 1 else g[0] for i, g in enumerate(groups)]
    fields = list(df.schema.fields)
    narrow = df.select(*(f.name for f in fields if f.name not in at),
                       *(F.array_join(F.transform(F.array(*(_written(df.schema[c]) for c in g)), _escaped), _END).alias(name)
                         for name, g in texts.items()))

    def unpacked(rows: DataFrame) -> DataFrame:
        def back(f: StructField) -> Column:
            if f.name not in at:
                return F.col(f.name)
            name, i = at[f.name]
            part = F.col(name)[i]
            return (part if f.dataType == StringType() else _number(part, f)).alias(f.name, metadata=f.metadata)

        known = {*texts, *(f.name for f in fields)}
        parts = rows.withColumns({name: F.transform(F.split(name, _END), _text) for name in texts})  # once a row, not once a column
        return parts.select(*(back(f) for f in fields), *(c for c in rows.columns if c not in known))

    return narrow, held, unpacked


def _written(field: StructField) -> Column:
    """Empty for NULL. A text has a mark before it; a number has its sign and length first."""
    value = F.col(field.name)
    if field.dataType == StringType():
        return F.coalesce(F.concat(F.lit("="), value), F.lit(""))
    digits = value.cast("string")
    below = (value.cast("decimal(20,0)") + F.lit(Decimal(10**19))).cast("decimal(20,0)").cast("string")
    number = F.when(value < 0, F.concat(F.lit("-"), F.lpad(below, 19, "0"))).otherwise(F.concat(F.chr(F.length(digits) + 64), digits))
    return F.coalesce(number, F.lit(""))


def _escaped(part: Column) -> Column:
    """Without the separator inside, in the same order. In a lambda, as the code for every column by itself grows too long to be compiled."""
    return F.replace(F.replace(part, F.lit(_ESCAPE), F.lit(_ESCAPE + "\2")), F.lit(_END), F.lit(_ESCAPE + _ESCAPE))


def _text(part: Column) -> Column:
    inner = F.replace(F.replace(part, F.lit(_ESCAPE + _ESCAPE), F.lit(_END)), F.lit(_ESCAPE + "\2"), F.lit(_ESCAPE))
    return F.when(part.startswith("="), inner.substr(F.lit(2), F.length(inner))).when(part != "", part)


def _number(part: Column, field: StructField) -> Column:
    digits = part.substr(F.lit(2), F.length(part))
    below = digits.try_cast("decimal(20,0)") - F.lit(Decimal(10**19))
    return F.when(part.startswith("-"), below.cast(field.dataType)).otherwise(digits.try_cast(field.dataType))
