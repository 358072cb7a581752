"""The change log as a stream: files of log rows are consumed once, in micro-batches, with their place checkpointed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.history import SCHEMA, coalesce_changes


def read_log(spark: SparkSession, folder: str, files_a_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(SCHEMA)
    if files_a_trigger:
        r = r.option("maxFilesPerTrigger", files_a_trigger)
    return r.parquet(folder)


def foreign(log: DataFrame, remote_author: str = "remote") -> DataFrame:
    """Changes that the remote side didn't make itself."""
    return log.where((F.col("author") != remote_author) | F.col("author").isNull())


def windowed_counts(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes by event and window of event time; extension: the store itself has no event-time windows."""
    timed = log.withColumn("at", F.timestamp_micros("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def sync(log: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, remote_author: str = "remote") -> StreamingQuery:
    """One coalesced change for each row and micro-batch goes to `send`; what was sent is not sent again. Only one run is active for a checkpoint, and changes that arrive meanwhile go with the next."""

    def batch(df: DataFrame, number: int) -> None:
        send(coalesce_changes(foreign(df, remote_author)), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_remote(current: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """A remote batch applied to a table: upserts (newest record of a key first), then deletes (`deleted`); records that lack a value keep the stored one."""
    newest = records.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("version")))).where("_r = 1")
    columns = [c for c in current.columns if c != key]
    n = newest.select(F.col(key).alias("_k"), F.col("deleted").alias("_d"), *[F.col(c).alias(f"_n_{c}") if c in records.columns else F.lit(None).alias(f"_n_{c}") for c in columns])
    both = current.join(n, F.col(key) == F.col("_k"), "full_outer").where(~F.coalesce(F.col("_d"), F.lit(False)))
    return both.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_n_{c}", c).cast(current.schema[c].dataType).alias(c) for c in columns]).select(current.columns)


def park(records: DataFrame, fk: str, known: DataFrame, required: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records to apply, records to keep for later): a required target that isn't known yet parks its record; an optional one becomes null now and the pair (key, target) is kept to repair it."""
    have = known.toDF("_t").distinct()
    met = F.col(fk) == F.col("_t")
    missing = records.where(F.col(fk).isNotNull()).join(have, met, "left_anti")
    if required:
        return records.where(F.col(fk).isNull()).unionByName(records.join(have, met, "left_semi")), missing
    return records.join(have, met, "left").withColumn(fk, F.col("_t")).select(records.columns), missing


def with_defaults(records: DataFrame, defaults: dict[str, object], required: list[str]) -> DataFrame:
    """Missing attributes take their defaults; records that still lack a required one are left out."""
    out = records.select([F.coalesce(F.col(c), F.lit(defaults[c]).cast(records.schema[c].dataType)).alias(c) if c in defaults else F.col(c) for c in records.columns])
    return out.dropna(subset=required) if required else out


def remap_conflicts(incoming: DataFrame, local: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """(old, new) for incoming rows that match a local row by a unique group under another key."""
    loc = local.select(F.col(key).alias("new"), *unique)
    return incoming.select(F.col(key).alias("old"), *unique).join(loc, unique).where("old <> new").select("old", "new")


def replay(parked: DataFrame, fk: str, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parked records whose target has arrived, those that wait on)."""
    return park(parked, fk, arrived)


def repair(table: DataFrame, key: str, fk: str, waiting: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An optional reference that was nulled gets its target once that has arrived: (table, records that wait on). waiting: the records that park() kept. A reference that was set meanwhile stays."""
    now, later = park(waiting, fk, arrived)
    n = now.select(F.col(key).alias("_k"), F.col(fk).alias("_t"))
    return table.join(n, F.col(key) == F.col("_k"), "left").select([F.coalesce(fk, "_t").alias(c) if c == fk else F.col(c) for c in table.columns]), later


def only(log: DataFrame, entities: list[str] | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Changes of these entities; of an entity in `columns`, updates name only those properties, and an update of none of them is left out."""
    out = log.where(F.col("entity_name").isin(entities)) if entities is not None else log
    for entity, names in (columns or {}).items():
        mine = (F.col("entity_name") == entity) & (F.col("event") == "update")
        kept = F.array_intersect(F.split("property_names", ","), F.array(*map(F.lit, names)))
        out = out.where(~mine | (F.size(kept) > 0)).withColumn("property_names", F.when(mine, F.concat_ws(",", kept)).otherwise(F.col("property_names")))
    return out
