"""Fetch, count, identifiers and sections for a request."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.expressions import Expr, Path, Var
from tessera.functions.ranks import ranked
from tessera.plans.compiler import Plan, col, prefixed
from tessera.store import Store

Closure = Callable[[Var], Expr]
#: Up to so many identifiers are an IN list; more become a semi join.
IN_LIST = 1000


@dataclass
class FetchRequest:
    """sort: (closure that gives a path, "asc" or "desc"); properties: attributes to read (the key and to-one keys are always read); prefetch: to-one relationships whose columns are read as well; ids: restricts to these keys and caps the rows at their number."""

    entity: str
    where: Closure | None = None
    sort: Iterable[tuple[Closure, str]] = ()
    limit: int | None = None
    offset: int | None = None
    properties: Iterable[str] | None = None
    prefetch: Iterable[str] = ()
    include_joined: bool = False
    qualified: bool = False
    ids: list[Any] | None = None
    computed: dict[str, Closure] | None = None
    random: bool = False


def planned(store: Store, r: FetchRequest) -> tuple[Plan, Var]:
    v = Var(r.entity, "base")
    plan = Plan(store, v)
    key = col("base", store.entity(r.entity).key)
    if r.where:
        plan.filter(r.where(v))
        if plan.raw is not None:  # raw text takes the place of the whole predicate
            plan = Plan(store, v, prefixed(store.table(r.entity).where(F.expr(plan.raw)), "base"))
    if r.ids is not None:
        if len(r.ids) <= IN_LIST:
            plan.df = plan.df.where(key.isin(r.ids))
        else:
            ids = store.spark.createDataFrame([(x,) for x in r.ids], ["_id"])
            plan.df = plan.df.join(ids, key == F.col("_id"), "left_semi")
    return plan, v


def _ordered(plan: Plan, v: Var, r: FetchRequest) -> list:
    """Nulls last in both directions; a to-one relationship sorts by its key, a related attribute joins its target."""
    out = []
    for f, direction in r.sort:
        path = f(v)
        c = plan.column(path) if isinstance(path, Path) else plan.compile(path)
        out.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
    return out


def fetch(store: Store, r: FetchRequest) -> DataFrame:
    """The rows of a request. Columns have plain names; those of a joined or prefetched entity are `<relationship>_<column>`."""
    plan, v = planned(store, r)
    catalog, e = store.catalog, store.entity(r.entity)
    order = [F.rand()] if r.random else _ordered(plan, v, r)
    for name in r.prefetch:
        if (rel := catalog.relationship(r.entity, name)) is None or rel.to_many:
            raise KeyError(f"{name} is no to-one relationship")
        plan.join_to_one("base", rel, "left")
    extra = {n: plan.compile(f(v)) for n, f in (r.computed or {}).items()}
    df = plan.df.orderBy(*order) if order else plan.df
    if r.offset:
        df = df.offset(r.offset)
    limit = len(r.ids) if r.ids is not None and r.limit is None else r.limit
    if limit is not None:
        df = df.limit(limit)

    wanted = None if r.properties is None else {*r.properties, e.key, *(x.fk for x in e.relationships if x.fk)}
    out = []
    for alias, entity in plan.entities.items():
        base = alias == "base" or alias.startswith("base_is_") and entity in catalog.ancestors(r.entity)
        if not base and not (alias.removeprefix("base_") in r.prefetch or r.include_joined):
            continue
        for c in store.table(entity).columns:
            if base and (wanted is not None and c not in wanted or alias != "base" and c == catalog[entity].key):
                continue
            plain = c if base else f"{alias.removeprefix('base_')}_{c}"
            out.append(col(alias, c).alias(f"{alias}.{c}" if r.qualified else plain))
    return df.select(*out, *(c.alias(n) for n, c in extra.items()))


def fetch_count(store: Store, r: FetchRequest) -> DataFrame:
    """One row: n, the rows that match. With an offset or limit, the rows of that page."""
    plan, _ = planned(store, r)
    df = plan.df
    if r.offset:
        df = df.offset(r.offset)
    if r.limit is not None:
        df = df.limit(r.limit)
    return df.agg(F.count(F.lit(1)).alias("n"))


def fetch_identifiers(store: Store, r: FetchRequest) -> DataFrame:
    key = store.entity(r.entity).key
    return fetch(store, FetchRequest(**{**r.__dict__, "properties": [key], "prefetch": (), "include_joined": False})).select(key)


def fetch_sectioned(store: Store, r: FetchRequest, section: Closure, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Rows with `section`, `section_index` (by first occurrence in the fetched order, or its reverse), `section_count` (all its rows) and `position` (from 1).

    At most `limit` rows of each section, none for limit <= 0; every section still counts all its rows. The request's
    sort is completed by the key, so that first occurrences are defined."""
    key = store.entity(r.entity).key
    plan, v = planned(store, r)
    columns = [col("base", c).alias(c) for c in store.table(r.entity).columns]
    sorts = [(plan.column(f(v)), direction) for f, direction in r.sort] + [(col("base", key), "asc")]
    values = [c.alias(f"_o{k}") for k, (c, _) in enumerate(sorts)]
    order = [F.col(f"_o{k}").asc_nulls_last() if direction == "asc" else F.col(f"_o{k}").desc_nulls_last() for k, (_, direction) in enumerate(sorts)]
    rows = plan.df.select(*columns, plan.compile(section(v)).alias("section"), *values)
    counts = rows.groupBy(F.col("section").alias("_s")).agg(F.count(F.lit(1)).alias("section_count"))
    if limit is None:
        placed = ranked(rows, order, "position", "section")
    else:  # a limit on row numbers alone is applied in each task before the shuffle
        placed = rows.withColumn("position", F.row_number().over(W.partitionBy("section").orderBy(*order))).where(F.col("position") <= max(limit, 1))
    heads = placed.where("position = 1").select(F.col("section").alias("_h"), *(f"_o{k}" for k in range(len(sorts))))  # one row for each section
    index = ranked(heads, [c.desc_nulls_first() if direction == "asc" else c.asc_nulls_first() for c, (_, direction) in zip((F.col(f"_o{k}") for k in range(len(sorts))), sorts, strict=True)] if reverse else order, "section_index")
    index = index.select("_h", F.col("section_index").cast("int").alias("section_index")).join(counts, F.col("_h").eqNullSafe(F.col("_s"))).drop("_s")
    out = placed.withColumn("position", F.col("position").cast("int")).join(index, F.col("section").eqNullSafe(F.col("_h")))
    if limit is not None:
        out = out.where(F.col("position") <= max(limit, 0))
    return out.drop("_h", *(f"_o{k}" for k in range(len(sorts))))


def keyset_page(df: DataFrame, columns: tuple[str, str], after: tuple | None, size: int) -> DataFrame:
    """The next page in the order of two columns, strictly after a cursor."""
    a, b = columns
    if after is not None:
        df = df.where((F.col(a) > after[0]) | ((F.col(a) == after[0]) & (F.col(b) > after[1])))
    return df.orderBy(a, b).limit(size)


def ambiguous(store: Store, entity: str, where: Closure) -> bool:
    """Whether more than one row matches; reads two rows at most."""
    return len(fetch_identifiers(store, FetchRequest(entity, where, limit=2)).collect()) > 1
