"""Row-wise analytics: running statistics and Top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_stats(df: DataFrame, key: str, ts: str, tie: str, value: str, rows: int = 100) -> DataFrame:
    """``df`` with n_so_far, ma<rows> (mean of the last ``rows`` rows) and prev of
    the value, per key in the order of (ts, tie): a total order, so running counts
    do not depend on how ties are framed."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return df.select("*", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n_so_far"), F.avg(value).over(w.rowsBetween(1 - rows, 0)).alias(f"ma{rows}"), F.lag(value, 1).over(w).alias(f"prev_{value}"))


def running_stats_in_blocks(df: DataFrame, key: str, ts: str, tie: str, value: str, rows: int = 100, span: int = 3_600_000, block: int = 100_000) -> DataFrame:
    """The same for keys of any size, spread over tasks. Rows get their place in the
    key from counts by span of ``ts`` and their place in the span; blocks of ``block``
    places are windows of their own, each with the ``rows`` before it."""
    spans = df.withColumn("__span", F.floor(F.col(ts) / span))
    counts = spans.groupBy(key, "__span").agg(F.count("*").alias("__n"), F.count(value).alias("__v"))
    before = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v0"))
    inside = Window.partitionBy(key, "__span").orderBy(ts, tie)
    placed = spans.select("*", F.row_number().over(inside).alias("__i"), F.count(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__c"))
    joined = placed.join(counts.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")) & (placed["__span"] == counts["__span"])).drop(counts["__span"])
    place = F.col("__n0") + F.col("__i") - 1
    joined = joined.select(*df.columns, place.alias("__place"), (F.col("__v0") + F.col("__c")).alias("n_so_far"), F.floor(place / block).alias("__own"))
    # A block's last rows come before the next ones, too.
    blocks = F.when(F.col("__place") % block >= block - rows, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    if rows > block:
        raise ValueError("a block must hold the rows of a mean")
    whole = joined.withColumn("__block", F.explode(blocks))
    w = Window.partitionBy(key, "__block").orderBy("__place")
    out = whole.select("*", F.avg(value).over(w.rowsBetween(1 - rows, 0)).alias(f"ma{rows}"), F.lag(value, 1).over(w).alias(f"prev_{value}"))
    return out.where("__block = __own").select(*df.columns, "n_so_far", f"ma{rows}", f"prev_{value}")


def top_n(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each partition; Spark limits each task's groups
    before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def window_leader(df: DataFrame, window: str, name: str, measure: str) -> DataFrame:
    """Name with the largest measure per window, the smaller name among equals."""
    return df.groupBy(window).agg(F.min_by(name, F.struct(-F.col(measure), F.col(name))).alias(name), F.max(measure).alias(measure))
