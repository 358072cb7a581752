"""Numbering rows without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.shared import settled


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, rows_a_task: int = 100_000, rows: int | None = None) -> DataFrame:
    """df with consecutive numbers: rows are dealt into parts by a hash of `order`, numbered in order within each part, and each part begins where the one before ends. `rows`: how many there are, counted if not given."""
    parts = max(1, -(-(df.count() if rows is None else rows) // rows_a_task))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each part
    starts = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(starts, F.col("_part") == F.col("_p")).withColumn(name, (F.col("_own") + F.col("_start") + (start - 1)).cast("long")).drop("_part", "_p", "_own", "_start")


def ranked(df: DataFrame, order: list[Column], name: str, by: str | None = None) -> DataFrame:
    """df with its place in an order, from 1, among all rows or among those with the same value of `by`.

    Rows are dealt out by ranges of the order, so a group of any size is spread; each range is numbered by itself and
    begins where the one before ends. The dealt rows are a table of the shared folder, which keeps the ranges fixed."""
    own = [F.col(by)] if by else []
    dealt = settled(df.repartitionByRange(*own, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(*own, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over((W.partitionBy(by) if by else W.partitionBy()).orderBy("_part")) - F.col("_n")
    starts = counts.select(F.col("_part").alias("_p"), before.alias("_start"), *(c.alias("_by") for c in own))
    met = F.col("_part") == F.col("_p")
    out = dealt.withColumn("_own", F.row_number().over(W.partitionBy(*own, "_part").orderBy(*order)))
    out = out.join(starts, met & F.col(by).eqNullSafe(F.col("_by")) if by else met)
    return out.withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_p", "_own", "_start", "_by")
