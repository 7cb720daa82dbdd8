"""Texts shown next to chart values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NULL_NAME = "Null"
KEEP = 15  # longest part of a dataset name that is shown whole


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_or_null(name) -> Column:
    """The name, or the text "Null"."""
    return F.coalesce(_col(name).cast("string"), F.lit(NULL_NAME))


def fixed3(value) -> Column:
    """Number with three decimals, as text."""
    return F.format_string("%.3f", _col(value).cast("double"))


def percent_label(key, percent) -> Column:
    """``key: 12.345%``."""
    return F.concat(name_or_null(key), F.lit(": "), fixed3(percent), F.lit("%"))


def code_label(code, percent) -> Column:
    """``code 8021: 12.345%``."""
    return F.concat(F.lit("code "), percent_label(code, percent))


def rank_label(day, rank) -> Column:
    """``05 - Top2``."""
    return F.concat(_col(day), F.lit(" - Top"), _col(rank).cast("string"))


def hover_label(name, value) -> Column:
    """``name - CPU Time: 12.345``."""
    return F.concat(name_or_null(name), F.lit(" - CPU Time: "), fixed3(value))


def short_dataset_name(name, cut_last_branch: bool = False) -> Column:
    """First three parts of ``/a/b/c``, long first and second parts shortened.

    A part is shortened when it is the only long one. When both are long, or one
    has exactly ``KEEP`` characters, both get dots; ``cut_last_branch`` then also
    cuts them. A name with fewer than three parts gives NULL.
    """
    parts = F.split(_col(name), "/")
    a, b, c = (F.try_element_at(parts, F.lit(i)) for i in (2, 3, 4))
    fits_a, fits_b = F.length(a) < KEEP, F.length(b) < KEEP
    dots = F.lit("...")

    def cut(part: Column) -> Column:
        return F.substring(part, 1, KEEP)

    def path(first: Column, second: Column) -> Column:
        return F.concat(F.lit("/"), first, F.lit("/"), second, F.lit("/"), c)

    both = (cut(a), cut(b)) if cut_last_branch else (a, b)
    return (F.when(fits_a & fits_b, path(a, b))
            .when(fits_a & (F.length(b) > KEEP), path(a, F.concat(cut(b), dots)))
            .when((F.length(a) > KEEP) & fits_b, path(F.concat(cut(a), dots), b))
            .otherwise(path(F.concat(both[0], dots), F.concat(both[1], dots))))
