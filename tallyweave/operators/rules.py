"""Consistency rules: each gives (record, field, flag) rows or a column; order-dependent ones are windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_seen(value: str, record: str, order: str) -> Column:
    """The last non-null value before this row; not the largest."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(record).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def out_of_order(rows: DataFrame, record: str, order: str, value: str) -> DataFrame:
    """Rows whose value is below the last one seen, and those seen before them: (record, order)."""
    seen = Window.partitionBy(record).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col(value).isNotNull(), F.struct(value, F.col(order).alias("__at"))), ignorenulls=True).over(seen)
    bad = rows.withColumn("__p", carried).where(F.col(value) < F.col(f"__p.{value}"))
    return bad.select(record, F.explode(F.array(F.col(order), F.col("__p.__at"))).alias(order)).distinct()


def jumps(rows: DataFrame, record: str, order: str, value: str, limit: float) -> DataFrame:
    return rows.withColumn("previous", last_seen(value, record, order)).where(F.abs(F.col(value) - F.col("previous")) > limit)


def several_ticked(rows: DataFrame, record: str, group: str, ticked: str) -> DataFrame:
    """Ticked rows of groups with more than one ticked."""
    n = F.count_if(F.col(ticked)).over(Window.partitionBy(record, group))
    return rows.withColumn("n_ticked", n).where(F.col(ticked) & (F.col("n_ticked") > 1))


def python_or(a: Column, b: Column) -> Column:
    """a if it is true, else b: of (false, null) null, of (null, false) false."""
    return F.when(a, a).otherwise(b)


def not_applicable(status: Column, when: Column) -> Column:
    """Only a blank becomes NOT_APPLICABLE."""
    return F.when((status == "NOT_PROVIDED") & F.coalesce(when, F.lit(False)), "NOT_APPLICABLE").otherwise(status)


def apart(a: Column, b: Column, days: int, tolerance: int) -> Column:
    """Whether date a isn't `days` after b within the tolerance; null-safe false."""
    return F.coalesce(F.abs(F.datediff(a, b) - days) > tolerance, F.lit(False))
