"""Set operations over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.distinct().join(old, old.columns, "left_anti")


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return added(new, old)


def kept(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.distinct().join(new, old.columns, "left_semi")


def classify(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): inserted, deleted or unchanged, from one full outer join."""
    o, n = old.select(key).distinct().withColumn("_o", F.lit(True)), new.select(key).distinct().withColumn("_n", F.lit(True))
    kind = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "deleted").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def ordered_union(a: str, b: str):
    """An array column with a's items and then b's that a lacks, in order."""
    return F.array_union(F.col(a), F.col(b))
