"""Joins of ranges that hold when one key has very many of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.spread import dealt, unbroadcast


def _bins(lo: Column, hi: Column, width: int) -> Column:
    first = F.floor(lo / width)
    return F.sequence(first, F.greatest(first, F.floor(hi / width)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int = 64, parts: int | None = None) -> DataFrame:
    """Rows of a and b of equal keys whose ranges (both ends inside) overlap.

    Ranges are dealt to bins of a fixed width, and the bin is part of the join key: a hot key is spread over
    its bins, and only ranges near each other meet. A pair that meets in several bins counts in the first. parts: of how
    many tasks, if it is known.
    """
    x = a.withColumn("_bin", F.explode(_bins(F.col(a_range[0]), F.col(a_range[1]), width)))
    y = b.withColumn("_bin", F.explode(_bins(F.col(b_range[0]), F.col(b_range[1]), width)))
    first = F.greatest(F.floor(F.col(a_range[0]) / width), F.floor(F.col(b_range[0]) / width))
    hit = (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(a_range[1]) >= F.col(b_range[0])) & (F.col("_bin") == first)
    x, y = (dealt(z, parts, *keys, "_bin") for z in (x, y))
    return unbroadcast(x).join(unbroadcast(y), [*keys, "_bin"]).where(hit).drop("_bin")
