"""Operators over ordered rows of a key: islands, forward fill, pairing, totals, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: list[str], order: list[str], context: list[str], name: str = "segment_ix") -> DataFrame:
    """Numbers the runs of equal context from 0; null is a value, equal to null."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for c in context:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(ordered))
    fresh = (F.row_number().over(ordered) == 1) | ~same
    return rows.withColumn("_fresh", fresh.cast("int")).withColumn(name, F.sum("_fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_fresh")


def island_bounds(rows: DataFrame, key: list[str], seq: str, context: list[str], name: str = "segment_ix") -> DataFrame:
    """One row for each run, with its first and last sequence number."""
    return rows.groupBy(*key, name, *context).agg(F.min(seq).alias("seq_start"), F.max(seq).alias("seq_end"))


def filled(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each column's last value that is there, up to the row."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Dense numbers from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long") - 1)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")


def paired(rows: DataFrame, key: list[str], order: list[str], is_call: Column, is_result: Column, refer: list[str]) -> DataFrame:
    """Results with the columns ``refer`` of the latest call of their key before them (call_*)."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tagged = rows.withColumn("_call", F.when(is_call, F.struct(*refer)))
    matched = tagged.withColumn("_last", F.last("_call", ignorenulls=True).over(before)).where(is_result)
    return matched.select(*rows.columns, *(F.col(f"_last.{c}").alias(f"call_{c}") for c in refer))


MOST = (1 << 63) - 1


def saturating_sum(column: str) -> Column:
    """The sum of what is there, held at the largest long; null if nothing is."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(total > MOST, F.lit(MOST)).otherwise(total.cast("long"))


def totals(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(*(saturating_sum(c).alias(c) for c in columns))


def overridden(own: DataFrame, given: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``own`` with each column of ``given`` that is there in its place."""
    renamed = given.select(*key, *(F.col(c).alias(f"_given_{c}") for c in columns))
    joined = own.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_given_{c}", c) for c in columns}).drop(*(f"_given_{c}" for c in columns))


def first_there(value: str, order: str) -> Column:
    """The value that is there first (an aggregate)."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def kept_newest(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """All but the newest ``keep`` rows."""
    # the newest are few: found by a limit, then taken out by an anti join
    newest = rows.orderBy(*order).limit(keep)
    return rows.join(newest.select("id"), "id", "left_anti")


def debounced(events: DataFrame, key: list[str], time: str, quiet: str) -> DataFrame:
    """One row for each burst of a key's events: a gap of ``quiet`` ends it."""
    return events.groupBy(*key, F.session_window(time, quiet).alias("burst")).agg(F.count("*").alias("n"), F.max(time).alias("last")).select(*key, F.col("burst.start").alias("first"), "last", "n")
