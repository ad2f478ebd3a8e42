"""Scalar functions of the feature layer, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _code(col: Column) -> Column:
    """A code of one or two characters as an integer, else null."""
    return F.when(F.length(col) <= 2, col.try_cast("int"))


def code_distance(a: Column, b: Column) -> Column:
    """Absolute difference of two short integer codes; 0 if either is longer or no integer."""
    return F.coalesce(F.abs(_code(a) - _code(b)).cast("double"), F.lit(0.0))


def completeness_match() -> Column:
    """Kept for the layout of the features: it compares with an empty code, and so is always 0."""
    return F.lit(0.0)


def title_gender(title: Column, male: str, female: str) -> Column:
    """0 if the title holds the male marker, else 1 if it holds the female one, else -1."""
    return F.when(title.contains(male), 0).when(title.contains(female), 1).otherwise(-1)


def gender_weight(resume: Column, position: Column) -> Column:
    """How a resume's gender code meets a position's (-1: any)."""
    unknown = F.when(position == -1, 0.0).otherwise(0.2 * position - 0.1)
    known = F.when(position == -1, -1.5).when(F.coalesce(resume.try_cast("int") == position, F.lit(False)), 1.0).otherwise(-1.0)
    return F.when(resume == "-", unknown).otherwise(known)


def all_digits(col: Column) -> Column:
    """Nothing but digits, points and minus signs, which is no promise that it is a number."""
    return col.rlike("^[0-9.-]+$")


def is_date_text(col: Column) -> Column:
    """Eight digits."""
    return col.rlike("^[0-9]{8}$")


def flag_weight(flag: Column, click: int = 1, delivery: int = 5) -> Column:
    return F.when(flag == "C", click).otherwise(delivery).cast("bigint")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
