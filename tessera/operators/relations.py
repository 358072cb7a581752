"""Related keys and rows: for one owner, for many, and as prefetched nested columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.store import Store


def links(store: Store, entity: str, relationship: str) -> DataFrame:
    """(owner, related) of every link: the to-one key, the reverse key, or the bridge without repeats."""
    r = store.catalog.relationship(entity, relationship)
    if r is None:
        raise KeyError(f"{entity} has no relationship {relationship}")
    owner, target = store.catalog.owner(entity, relationship), store.entity(r.target)
    if r.fk:
        out = store.table(owner.table).select(F.col(owner.key).alias("owner"), F.col(r.fk).alias("related"))
    elif r.inverse_fk:
        out = store.table(target.table).select(F.col(r.inverse_fk).alias("owner"), F.col(target.key).alias("related"))
    else:
        table, own, other = r.bridge
        out = store.table(table).select(F.col(own).alias("owner"), F.col(other).alias("related")).distinct()
    return out.where("owner is not null and related is not null")


def keys_of(store: Store, entity: str, relationship: str, owner: Any) -> DataFrame:
    return links(store, entity, relationship).where(F.col("owner") == F.lit(owner)).select("related")


def rows_of(store: Store, entity: str, relationship: str, owner: Any) -> DataFrame:
    r = store.catalog.relationship(entity, relationship)
    if r and r.inverse_fk:
        return store.table(r.target).where(F.col(r.inverse_fk) == F.lit(owner))
    target = store.entity(r.target)
    found = keys_of(store, entity, relationship, owner)
    return store.table(r.target).join(found, F.col(target.key) == F.col("related"), "left_semi")


def keys_of_many(store: Store, entity: str, relationship: str, owners: DataFrame) -> DataFrame:
    """(owner, related) for the owners in a one-column DataFrame: one join, whatever their number."""
    return links(store, entity, relationship).join(owners.toDF("owner").distinct(), "owner", "left_semi")


def rows_of_many(store: Store, entity: str, relationship: str, owners: DataFrame) -> DataFrame:
    """The owner and the columns of each related row."""
    r = store.catalog.relationship(entity, relationship)
    wanted, target = owners.toDF("owner").distinct(), store.entity(r.target)
    if r.inverse_fk:
        rows = store.table(r.target)
        return rows.join(wanted, F.col(r.inverse_fk) == F.col("owner")).select("owner", *rows.columns)
    rows = store.table(r.target)
    found = links(store, entity, relationship).join(wanted, "owner", "left_semi")
    return found.join(rows, F.col("related") == F.col(target.key)).select("owner", *rows.columns)


def rows_by_key(store: Store, entity: str, keys: DataFrame) -> DataFrame:
    key = store.entity(entity).key
    return store.table(entity).join(keys.toDF("_key").distinct(), F.col(key) == F.col("_key"), "left_semi")


def prefetch_many(store: Store, entity: str, base: DataFrame, relationship: str, columns: list[str] | None = None, required: bool = True) -> DataFrame:
    """base with an array column of related rows (structs, or keys only without columns), in order of the first column.

    An owner without related rows has an empty array if the relationship is required, else null."""
    r = store.catalog.relationship(entity, relationship)
    key, target = store.catalog.owner(entity, relationship).key, store.entity(r.target)
    wanted = base.select(key)
    if columns:
        related = rows_of_many(store, entity, relationship, wanted).select("owner", F.struct(*columns).alias("item"))
    else:
        related = keys_of_many(store, entity, relationship, wanted).select("owner", F.col("related").alias("item"))
    grouped = related.groupBy("owner").agg(F.array_sort(F.collect_list("item")).alias(relationship)).withColumnRenamed("owner", "_owner")
    out = base.join(grouped, F.col(key) == F.col("_owner"), "left").drop("_owner")
    if required:
        kind = out.schema[relationship].dataType
        out = out.withColumn(relationship, F.coalesce(relationship, F.array().cast(kind)))
    return out


def missing_targets(store: Store, entity: str, relationship: str) -> DataFrame:
    """Owners whose required to-one target is missing."""
    r = store.catalog.relationship(entity, relationship)
    owner, target = store.catalog.owner(entity, relationship), store.entity(r.target)
    have = store.table(r.target).select(F.col(target.key).alias("_t"))
    return store.table(owner.table).join(have, F.col(r.fk) == F.col("_t"), "left_anti").select(owner.key)


def cardinality_violations(store: Store, entity: str, relationship: str) -> DataFrame:
    """(owner, n) where the number of related rows is outside the relationship's bounds (a bound of 0 is none)."""
    r = store.catalog.relationship(entity, relationship)
    owner = store.catalog.owner(entity, relationship)
    counts = links(store, entity, relationship).groupBy("owner").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("owner", "_o")
    every = store.table(owner.table).select(F.col(owner.key).alias("owner"))
    out = every.join(counts, F.col("owner") == F.col("_o"), "left").select("owner", F.coalesce("n", F.lit(0)).alias("n"))
    bad = F.col("n") < r.min_count
    return out.where(bad | (F.col("n") > r.max_count) if r.max_count else bad)


def canonical(df: DataFrame, store: Store, key: str = "pk", entity: str = "entity") -> DataFrame:
    """(entity, pk) targets with one row for each key: the most derived entity stays."""
    depths = F.create_map(*[F.lit(x) for e in store.catalog for x in (e.name, store.catalog.depth(e.name))])
    ranked = df.select(F.col(key), F.struct(depths[F.col(entity)].alias("depth"), F.col(entity).alias("entity")).alias("_e"))
    return ranked.groupBy(key).agg(F.max("_e")["entity"].alias(entity))
