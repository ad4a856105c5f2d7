"""Small text helpers of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snippet(text: Column, limit: int = 80) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, F.lit("…")).otherwise(F.lit("")))
    return F.translate(cut, "\n", " ")


def short_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_json_array(text: Column) -> Column:
    return text.rlike(r"^\p{IsWhite_Space}*\[")
