"""Resampling indices that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(b: Column, slot: Column, seed: int, n: Column) -> Column:
    """Index 0..n-1 of slot ``slot`` in draw ``b``, from an MD5."""
    key = F.concat_ws("-", b.cast("string"), slot.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n
