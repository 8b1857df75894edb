"""Latency figures by key: exact percentiles, and sketches that merge across batches.

Exact percentiles hold a count for each distinct value of a group; a sketch has a
bounded size, and sketches of parts merge to that of the whole, so a running archive
stores one for each day and key and never reads the values again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A KLL sketch's size: ranks are within about 1.65 % of the truth at 200.
SIZE = 200


def percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles, interpolated between neighbours; nulls don't count, and a group without values has null."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), *(F.percentile(value, p).alias(name) for name, p in points.items()))


def sketches(rows: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """(keys, n, sketch); groups without values have none."""
    some = rows.where(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys, or of several batches, as those of ``keys``."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: Column | str, point: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(point))
