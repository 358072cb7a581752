"""The change log: recording, fetching by transaction, archiving by year, retention and watermarks.

A log has the columns pk (rising), event (insert, update, delete), entity_name, entity_pk, property_names (comma-joined
changed properties, or the preserved ones of a delete), preserved_values (JSON array aligned with them), timestamp
(microseconds, also the transaction's id), author and store_identifier. Archives are the same rows in a Parquet table
partitioned by UTC year. Clocks are arguments. Predicates are pushed into the scan and the requested order is kept."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.ranks import numbered
from tessera.functions.scalar import year_of_micros
from tessera.sources.shared import settled

SCHEMA = "pk long, event string, entity_name string, entity_pk string, property_names string, preserved_values string, timestamp long, author string, store_identifier string"
DAY = 86_400_000_000
RETENTION = 30 * DAY
#: Rows of an archive that a task sorts and writes.
ROWS_A_TASK = 500_000


# --- recording ---


def record(changes: DataFrame, start_pk: int, timestamp: int, author: str | None, store: str) -> DataFrame:
    """Log rows for one transaction's changes (event, entity_name, entity_pk, property_names, preserved_values), numbered from start_pk."""
    rows = numbered(changes, ["entity_name", "entity_pk", "event"], "pk", start_pk)
    return rows.select(
        "pk", "event", "entity_name", F.col("entity_pk").cast("string").alias("entity_pk"), "property_names", "preserved_values",
        F.lit(timestamp).cast("long").alias("timestamp"), F.lit(author).cast("string").alias("author"), F.lit(store).alias("store_identifier"),
    )


def updated_names(before: str, after: str, columns: Iterable[str]) -> Column:
    """Comma-joined names of columns that differ between two aliases, nulls being values; empty if none does."""
    return F.concat_ws(",", *[F.when(~F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")), F.lit(c)) for c in columns])


def preserved(columns: list[str]) -> Column:
    """JSON array of the values that a delete keeps, aligned with the names."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns])) if columns else F.lit(None).cast("string")


# --- reading ---


@dataclass
class HistoryRequest:
    """where: a column over the log; limit: transactions; newest_first: their order."""

    where: Column | None = None
    limit: int | None = None
    newest_first: bool = True


def all_logs(main: DataFrame, archives: Iterable[DataFrame] = ()) -> DataFrame:
    """The main log and archives; rows that both hold count once."""
    logs = [main, *archives]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs).dropDuplicates(["store_identifier", "pk"]) if len(logs) > 1 else main


def history_rows(log: DataFrame, r: HistoryRequest) -> DataFrame:
    """The log rows of the requested transactions with their transaction_id, a row for each change, so that a transaction can have any number of them.

    The limit finds the transactions first, from the ids alone."""
    df = log.where(r.where) if r.where is not None else log
    direction = F.desc if r.newest_first else F.asc
    if r.limit is not None:
        ids = df.select(F.col("timestamp").alias("_t"), F.col("store_identifier").alias("_s")).distinct().orderBy(direction("_t"), "_s").limit(r.limit)
        df = df.join(ids, (F.col("timestamp") == F.col("_t")) & F.col("store_identifier").eqNullSafe(F.col("_s")), "left_semi")
    return df.withColumn("transaction_id", F.col("timestamp"))


def fetch_history(log: DataFrame, r: HistoryRequest) -> DataFrame:
    """A row for each transaction: transaction_id, author, store_identifier, n_changes and the changes in order. A transaction is held in one row; history_rows has them apart."""
    direction = F.desc if r.newest_first else F.asc
    change = F.struct("pk", "event", "entity_name", "entity_pk", "property_names", "preserved_values")
    grouped = history_rows(log, r).groupBy("transaction_id", "store_identifier").agg(
        F.min_by("author", "pk").alias("author"), F.count(F.lit(1)).alias("n_changes"), F.array_sort(F.collect_list(change)).alias("changes")
    )
    return grouped.orderBy(direction("transaction_id"), "store_identifier")


def page(log: DataFrame, before: int | None, size: int) -> DataFrame:
    """Distinct transaction ids, newest first, strictly before a cursor."""
    ids = log.select(F.col("timestamp").alias("transaction_id")).distinct()
    ids = ids.where(F.col("transaction_id") < before) if before is not None else ids
    return ids.orderBy(F.desc("transaction_id")).limit(size)


def bounds(low: int | None, high: int | None, *others: tuple[int | None, int | None], union: bool = False) -> tuple[int | None, int | None]:
    """Interval algebra of predicates: the intersection, or the smallest interval that holds the union; None is unbounded."""
    for a, b in others:
        if union:
            low = None if low is None or a is None else min(low, a)
            high = None if high is None or b is None else max(high, b)
        else:
            low = a if low is None else low if a is None else max(low, a)
            high = b if high is None else high if b is None else min(high, b)
    return low, high


def years_of(low: int | None, high: int | None, years: Iterable[int]) -> list[int]:
    """The archive years that can hold a timestamp of the interval."""
    from datetime import UTC, datetime

    def year(us: int) -> int:
        return datetime.fromtimestamp(us / 1e6, UTC).year

    return [y for y in sorted(years, reverse=True) if (low is None or y >= year(low)) and (high is None or y <= year(high))]


def token(log: DataFrame) -> DataFrame:
    """(store_identifier, watermark): the highest pk of each store; newer means strictly above it."""
    return log.groupBy("store_identifier").agg(F.max("pk").alias("watermark"))


def counts(log: DataFrame) -> DataFrame:
    """Rows and distinct transactions of each store."""
    return log.groupBy("store_identifier").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("timestamp").alias("n_transactions"))


def entity_names(log: DataFrame) -> DataFrame:
    return log.select("entity_name").distinct()


def delete_history(log: DataFrame, where: Column) -> DataFrame:
    """The log without the transactions that have a matching row."""
    gone = log.where(where).select(F.col("timestamp").alias("_t"), F.col("store_identifier").alias("_s")).distinct()
    return log.join(gone, (F.col("timestamp") == F.col("_t")) & F.col("store_identifier").eqNullSafe(F.col("_s")), "left_anti")


# --- archive and retention ---


def archivable(log: DataFrame, now: int, cursors: DataFrame | None = None, retention: int = RETENTION) -> DataFrame:
    """Rows older than the cutoff and past their (store, year)'s cursor, with their UTC year."""
    old = log.where(F.col("timestamp") < now - retention).withColumn("year", year_of_micros(F.col("timestamp")))
    if cursors is None:
        return old
    c = cursors.select(F.col("store_identifier").alias("_s"), F.col("year").alias("_y"), "cursor_timestamp", "cursor_identifier")
    after = (F.col("timestamp") > F.col("cursor_timestamp")) | ((F.col("timestamp") == F.col("cursor_timestamp")) & (F.col("pk") > F.col("cursor_identifier")))
    return old.join(c, (F.col("store_identifier") == F.col("_s")) & (F.col("year") == F.col("_y")), "left").where(F.col("_s").isNull() | after).select(*log.columns, "year")


def archive(log: DataFrame, folder: str, now: int, cursors: DataFrame | None = None, retention: int = RETENTION) -> DataFrame:
    """Appends archivable rows to the folder, by year, and returns the new cursors, a table of the shared folder.

    Rows are dealt out by ranges of their place in the log, ROWS_A_TASK to a task, so a year of any size is spread."""
    rows = archivable(log, now, cursors, retention)
    found = settled(_last_rows(rows, now, F.count(F.lit(1)).alias("_n")), "cursors")
    parts = max(1, -(-(found.agg(F.sum("_n")).first()[0] or 0) // ROWS_A_TASK))
    rows.repartitionByRange(parts, "year", "timestamp", "pk", "store_identifier").write.mode("append").partitionBy("year").parquet(folder)
    new = found.drop("_n")
    return new if cursors is None else settled(merge_cursors(cursors, new), "cursors")


def new_cursors(rows: DataFrame, now: int) -> DataFrame:
    """(store_identifier, year, is_complete, cursor_timestamp, cursor_identifier); a year is complete once it has ended."""
    return _last_rows(rows, now)


def _last_rows(rows: DataFrame, now: int, *more: Column) -> DataFrame:
    last = F.max(F.struct("timestamp", "pk"))
    year_now = year_of_micros(F.lit(now).cast("long"))
    return rows.groupBy("store_identifier", "year").agg(last["timestamp"].alias("cursor_timestamp"), last["pk"].alias("cursor_identifier"), *more).withColumn("is_complete", F.col("year") < year_now)


def merge_cursors(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is None:
        return new
    both = old.unionByName(new)
    best = F.max_by(F.struct("cursor_timestamp", "cursor_identifier", "is_complete"), F.struct("cursor_timestamp", "cursor_identifier"))
    return both.groupBy("store_identifier", "year").agg(best.alias("c")).select("store_identifier", "year", "c.cursor_timestamp", "c.cursor_identifier", "c.is_complete")


def purge(log: DataFrame, now: int, retention: int = RETENTION, cursors: DataFrame | None = None) -> DataFrame:
    """The log without expired rows; with cursors, only rows that an archive holds expire."""
    expired = F.col("timestamp") < now - retention
    if cursors is None:
        return log.where(~expired)
    c = cursors.select(F.col("store_identifier").alias("_s"), F.col("year").alias("_y"), "cursor_timestamp", "cursor_identifier")
    at = log.withColumn("_year", year_of_micros(F.col("timestamp")))
    held = F.col("_s").isNotNull() & ((F.col("timestamp") < F.col("cursor_timestamp")) | ((F.col("timestamp") == F.col("cursor_timestamp")) & (F.col("pk") <= F.col("cursor_identifier"))))
    return at.join(c, (F.col("store_identifier") == F.col("_s")) & (F.col("_year") == F.col("_y")), "left").where(~(expired & held)).select(log.columns)


def maintain(log: DataFrame, folder: str, now: int, cursors: DataFrame | None = None, purge_after: bool = True, retention: int = RETENTION) -> tuple[DataFrame, DataFrame]:
    """Archives, then purges what was archived: (log, cursors)."""
    cursors = archive(log, folder, now, cursors, retention)
    return (purge(log, now, retention, cursors) if purge_after else log), cursors


def due(last_archive: int, last_purge: int, now: int, jitter: float, retention: int = RETENTION) -> tuple[bool, bool]:
    """Whether to archive (every 6 to 24 hours, by jitter in 0 to 1) and to purge (every thirtieth to tenth of the retention, a minute at least)."""
    hour, minute = 3_600_000_000, 60_000_000
    wait = max(minute, int(retention / 30 + jitter * (retention / 10 - retention / 30)))
    return now - last_archive >= int((6 + 18 * jitter) * hour), now - last_purge >= wait


# --- incremental use ---


def after_watermark(log: DataFrame, watermark: int, remote_author: str = "remote") -> DataFrame:
    """Rows of transactions by other authors that have a change above the watermark, in order."""
    fresh = log.where((F.col("pk") > watermark) & ((F.col("author") != remote_author) | F.col("author").isNull()))
    ids = fresh.select(F.col("timestamp").alias("_t")).distinct()
    return log.join(ids, F.col("timestamp") == F.col("_t"), "left_semi").where((F.col("author") != remote_author) | F.col("author").isNull()).orderBy("timestamp", "pk")


def coalesce_changes(log: DataFrame) -> DataFrame:
    """One change for each (entity_name, entity_pk): the last insert or delete; if there is none, the first update."""
    strong = F.col("event").isin("insert", "delete")
    change = F.struct("pk", "event", "property_names", "preserved_values", "timestamp", "author")
    grouped = log.groupBy("entity_name", "entity_pk").agg(F.max_by(F.when(strong, change), F.when(strong, F.col("pk"))).alias("s"), F.min_by(change, "pk").alias("f"))
    return grouped.select("entity_name", "entity_pk", F.coalesce("s", "f").alias("c")).select("entity_name", "entity_pk", "c.*")


def missing_rows_deleted(changes: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Inserts and updates whose row is gone become deletes."""
    have = current.select(F.col(key).cast("string").alias("_pk"))
    gone = F.col("_pk").isNull() & F.col("event").isin("insert", "update")
    return changes.join(have, F.col("entity_pk") == F.col("_pk"), "left").withColumn("event", F.when(gone, "delete").otherwise(F.col("event"))).drop("_pk")


def projected_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Record names that one projection (record, entity_pk) had and the next doesn't produce."""
    return before.join(after.select("record"), "record", "left_anti")


def records_of_deleted(records: DataFrame, deleted: DataFrame) -> DataFrame:
    """Records (record, entity_pk, target_pk) that go with deleted rows (entity_pk): their own, and those that target them."""
    gone = deleted.select(F.col("entity_pk").alias("_gone")).distinct()
    own = records.join(gone, F.col("entity_pk") == F.col("_gone"), "left_semi")
    return own.unionAll(records.join(gone, F.col("target_pk") == F.col("_gone"), "left_semi")).dropDuplicates(["record"])


def read_schema() -> T.StructType:
    return T._parse_datatype_string(SCHEMA)
