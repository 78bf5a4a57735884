"""Answer matching and short labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_answer(answer: Column) -> Column:
    """Lower case, white space (Unicode) collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(answer), r"(?U)\s+", " "))


def exact_answer_match(answer: Column, accepted: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(accepted, normalize_answer), normalize_answer(answer)), F.lit(False))


def short_label(parts: Column, limit: int) -> Column:
    """An array joined by arrows and cut to limit characters, with an ellipsis if cut."""
    joined = F.concat_ws(" → ", parts)
    return F.when(F.length(joined) <= limit, joined).otherwise(F.concat(F.rtrim(F.substring(joined, 1, limit - 1)), F.lit("…")))
