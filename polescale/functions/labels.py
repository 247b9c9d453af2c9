"""Folding of attractor labels, roles and three-valued grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polescale.config import FOLD, LABELS
from polescale.functions.text import strip


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def fold_pole_or_none(raw: Column) -> Column:
    """The pole of a label variant; null if unknown."""
    return F.try_element_at(_map(FOLD), F.lower(strip(raw)))


def fold_pole(raw: Column) -> Column:
    """As above, but an unknown or missing label is an error."""
    return F.coalesce(fold_pole_or_none(raw), F.raise_error(F.concat(F.lit("no pole is named "), F.coalesce(raw, F.lit("null")))).cast("string"))


def role(raw: Column) -> Column:
    return F.upper(strip(raw))


def is_seed(flag: Column) -> Column:
    """Strictly boolean true; null and anything else is not."""
    return flag.eqNullSafe(F.lit(True))


def display(pole: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(LABELS), pole), pole, F.lit("—"))


def predict(score: Column, hits: Column, minus: str, plus: str) -> Column:
    """The pole of the score's sign; null without hits or at exactly 0."""
    return F.when(hits > 0, F.when(score > 0, plus).when(score < 0, minus))


def correct(predicted: Column, gold: Column, minus: str, plus: str) -> Column:
    """Null if the gold pole is missing or off the axis; an undecided text is a miss."""
    return F.when(gold.isin(minus, plus), F.coalesce(predicted == gold, F.lit(False)))


def sign_robust(score: Column, lo: Column, hi: Column) -> Column:
    """Whether the whole interval lies strictly on the score's side of 0."""
    return F.coalesce(F.when(score > 0, lo > 0).when(score < 0, hi < 0), F.lit(False))


def as_correct(x: Column, kind: str) -> Column:
    """0/1 as double: of strings only "true" counts, of others whether they are true."""
    if kind == "string":
        return (F.coalesce(F.lower(strip(x)) == "true", F.lit(False))).cast("double")
    return F.coalesce(x.cast("double") != 0, F.lit(False)).cast("double")
