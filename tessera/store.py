"""A store: a catalog bound to tables, with raw SQL, lookups and key-value state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Catalog, Entity


class Store:
    def __init__(self, spark: SparkSession, catalog: Catalog, tables: Mapping[str, DataFrame], identifier: str = "store"):
        self.spark, self.catalog, self.tables, self.identifier = spark, catalog, dict(tables), identifier
        self.versions: dict[str, int] = dict.fromkeys(tables, 0)
        self.values: dict[str, str] = {}

    # --- scans ---

    def table(self, name: str) -> DataFrame:
        """A table by its name or its entity's."""
        if name in self.catalog.entities:
            name = self.catalog[name].table
        try:
            return self.tables[name]
        except KeyError:
            raise KeyError(f"no table {name}") from None

    def entity(self, name: str) -> Entity:
        return self.catalog[name]

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        self.versions[name] = self.versions.get(name, 0) + 1

    def attach(self, name: str, df: DataFrame) -> None:
        """Makes a table of an archive readable as name."""
        self.replace(name, df)

    def detach(self, name: str) -> None:
        del self.tables[name]

    # --- raw SQL ---

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """SQL over the tables, with `?` or `:name` arguments."""
        for name, df in self.tables.items():
            if name in text:
                df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args)

    def rows(self, text: str, args: list | dict | None = None) -> list[list[Any]]:
        return [list(r) for r in self.sql(text, args).collect()]

    def query(self, text: str, args: list | dict | None = None) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.sql(text, args).collect()]

    def fold(self, text: str, initial: Any, body: Callable[[Any, Any], Any], args: list | dict | None = None) -> Any:
        """Folds rows as they stream to the driver, a partition at a time."""
        return reduce(body, self.sql(text, args).toLocalIterator(), initial)

    # --- lookups ---

    def by_key(self, entity: str, key: Any) -> DataFrame:
        return self.table(entity).where(F.col(self.catalog[entity].key) == F.lit(key)).limit(1)

    def keys(self, entity: str, where: str | None = None) -> DataFrame:
        df = self.table(entity)
        df = df.where(where) if where else df
        key = self.catalog[entity].key
        return df.where(F.col(key).isNotNull()).select(key)

    def single_key(self, entity: str, where: str) -> Any:
        found = self.keys(entity, where).limit(2).collect()
        if len(found) != 1:
            raise LookupError(f"{'no' if not found else 'more than one'} row of {entity} where {where}")
        return found[0][0]

    def table_exists(self, name: str) -> bool:
        return name in self.tables

    def row_exists(self, entity: str, key: Any) -> bool:
        return not self.by_key(entity, key).isEmpty()

    def count(self, entity: str, where: str | None = None) -> int:
        df = self.table(entity)
        return (df.where(where) if where else df).count()

    def identifiers(self, entity: str) -> DataFrame:
        """Persistent identifiers: (store, entity, key)."""
        key = self.catalog[entity].key
        return self.table(entity).select(F.struct(F.lit(self.identifier).alias("store"), F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key")).alias("id"))

    # --- key-value state ---

    def get_value(self, key: str, default: Any = None) -> Any:
        return json.loads(self.values[key]) if key in self.values else default

    def set_value(self, key: str, value: Any) -> None:
        self.values[key] = json.dumps(value)

    def remove_value(self, key: str) -> None:
        self.values.pop(key, None)

    # --- interruption ---

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)


def show_chunks(df: DataFrame, key: str, rows: int = 20, width: int = 5) -> str:
    """Rows as text tables, the key first, in chunks of `width` columns."""
    rest = [c for c in df.columns if c != key]
    found = df.limit(rows).collect()
    out = []
    for k in range(0, max(len(rest), 1), width):
        names = [key, *rest[k : k + width]]
        cells = [names, *([str(r[c]) for c in names] for r in found)]
        sizes = [max(len(row[i]) for row in cells) for i in range(len(names))]
        out += [" | ".join(v.ljust(n) for v, n in zip(row, sizes, strict=True)).rstrip() for row in cells] + [""]
    return "\n".join(out)


def bind(spark: SparkSession, catalog: Catalog, path: Callable[[str], str], extra: Iterable[str] = ()) -> Store:
    """A store over Parquet tables, one for each entity."""
    names = {e.table for e in catalog} | set(extra)
    return Store(spark, catalog, {n: spark.read.parquet(path(n)) for n in names})
