"""Class-table inheritance: concrete types, polymorphic rows, splits and joins along a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.store import Store


def typed_keys(store: Store, entity: str) -> DataFrame:
    """(pk, entity, depth): a row for each table of the subtree that holds the key."""
    names = [entity, *store.catalog.descendants(entity)]
    parts = [store.table(n).select(F.col(store.entity(n).key).alias("pk"), F.lit(n).alias("entity"), F.lit(store.catalog.depth(n)).alias("depth")) for n in names]
    return reduce(DataFrame.unionAll, parts)


def concrete_types(store: Store, entity: str, keys: DataFrame | None = None) -> DataFrame:
    """(pk, entity): the most derived entity of each row of `entity`, in one pass over the subtree's keys."""
    found = typed_keys(store, entity)
    if keys is not None:
        found = found.join(keys.toDF("pk").distinct(), "pk", "left_semi")
    return found.groupBy("pk").agg(F.max_by("entity", "depth").alias("entity"))


def with_ancestors(store: Store, entity: str) -> DataFrame:
    """Rows of an entity with the columns of all its ancestors."""
    df, e = store.table(entity), store.entity(entity)
    for up in store.catalog.ancestors(entity):
        a = store.entity(up)
        right = store.table(up)
        right = right.select(F.col(a.key).alias("_pk"), *[c for c in right.columns if c != a.key and c not in df.columns])
        df = df.join(right, F.col(e.key) == F.col("_pk")).drop("_pk")
    return df


def polymorphic(store: Store, entity: str) -> DataFrame:
    """Every row of `entity` with `entity_type` and the columns of all its descendants (null where a row isn't one)."""
    df, e = with_ancestors(store, entity), store.entity(entity)
    for down in store.catalog.descendants(entity):
        d = store.entity(down)
        right = store.table(down)
        right = right.select(F.col(d.key).alias("_pk"), *[c for c in right.columns if c != d.key])
        df = df.join(right, F.col(e.key) == F.col("_pk"), "left").withColumn(f"_is_{down}", F.col("_pk").isNotNull()).drop("_pk")
    kind = F.lit(entity)
    for down in sorted(store.catalog.descendants(entity), key=store.catalog.depth):
        kind = F.when(F.col(f"_is_{down}"), down).otherwise(kind)
    return df.withColumn("entity_type", kind).drop(*(f"_is_{d}" for d in store.catalog.descendants(entity)))


def hierarchy_row(store: Store, entity: str, key, direction: str = "both", without: str | None = None) -> DataFrame:
    """The row of one key across the tables of its line: left joins up, down or both, up to an excluded ancestor."""
    e, catalog = store.entity(entity), store.catalog
    names = []
    if direction in ("up", "both"):
        for up in catalog.ancestors(entity):
            if up == without:
                break
            names.append(up)
    if direction in ("down", "both"):
        names += catalog.descendants(entity)
    df = store.by_key(entity, key)
    for n in names:
        o = store.entity(n)
        right = store.table(n).where(F.col(o.key) == F.lit(key))
        right = right.select(F.col(o.key).alias(f"{n}_pk"), *[c for c in right.columns if c != o.key and c not in df.columns])
        df = df.join(right, F.col(e.key) == F.col(f"{n}_pk"), "left")
    return df.limit(1)


def split(store: Store, entity: str, rows: DataFrame) -> dict[str, DataFrame]:
    """Rows with inherited columns as one DataFrame for each table of the line: its own columns and the key."""
    out = {}
    for n in (entity, *store.catalog.ancestors(entity)):
        e = store.entity(n)
        own = {a.name for a in e.attributes} | {r.fk for r in e.relationships if r.fk}
        out[n] = rows.select(F.col(store.entity(entity).key).alias(e.key), *[c for c in rows.columns if c in own and c != e.key])
    return out


def upcast(df: DataFrame, entity: str, column: str = "entity") -> DataFrame:
    """Results relabelled to the entity that was asked for."""
    return df.withColumn(column, F.lit(entity))


def subtree_counts(store: Store) -> DataFrame:
    """(entity, n): the rows of each entity, which include those of its descendants."""
    parts = [store.table(e.name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(e.name).alias("entity"), "n") for e in store.catalog]
    return reduce(DataFrame.unionAll, parts)
