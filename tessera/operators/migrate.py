"""Schema migration: two catalogs are compared, the steps classified, checked against the data and applied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog import Attribute, Catalog, Entity
from tessera.operators.mutate import duplicates
from tessera.store import Store

COMPATIBLE, INFERRED, CUSTOM, UNSUPPORTED = "compatible", "inferred", "custom", "unsupported"
# How each kind of step is handled unless its details say otherwise.
STYLES = {
    "create entity": COMPATIBLE, "drop entity": INFERRED, "rename entity": INFERRED,
    "add attribute": COMPATIBLE, "drop attribute": INFERRED, "rename attribute": INFERRED, "loosen attribute": COMPATIBLE, "tighten attribute": INFERRED,
    "change default": COMPATIBLE, "change type": CUSTOM, "externalise attribute": INFERRED, "internalise attribute": INFERRED,
    "add unique": INFERRED, "drop unique": COMPATIBLE,
    "add relationship": CUSTOM, "drop relationship": CUSTOM, "change relationship": CUSTOM, "change inheritance": CUSTOM, "change key": UNSUPPORTED,
}


class MigrationError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    kind: str
    entity: str
    detail: str = ""
    before: object = None
    after: object = None

    @property
    def style(self) -> str:
        return STYLES[self.kind]


def _attributes(old: Entity, new: Entity) -> list[Step]:
    out, used = [], set()
    for a in new.attributes:
        b = old.attribute(a.name)
        if b is None and a.original and (b := old.attribute(a.original)):
            out.append(Step("rename attribute", new.name, a.name, b, a))
        if b is None:
            out.append(Step("add attribute", new.name, a.name, None, a))
            continue
        used.add(b.name)
        if a.type != b.type:
            out.append(Step("change type", new.name, a.name, b, a))
        if a.optional != b.optional:
            out.append(Step("loosen attribute" if a.optional else "tighten attribute", new.name, a.name, b, a))
        if a.default != b.default:
            out.append(Step("change default", new.name, a.name, b, a))
        if a.external != b.external:
            out.append(Step("externalise attribute" if a.external else "internalise attribute", new.name, a.name, b, a))
        if a.unique != b.unique:
            out.append(Step("add unique" if a.unique else "drop unique", new.name, a.name, (a.name,), (a.name,)))
    return out + [Step("drop attribute", new.name, b.name, b) for b in old.attributes if b.name not in used]


def diff(old: Catalog, new: Catalog, renamed: dict[str, str] | None = None) -> list[Step]:
    """Steps from old to new; entities are renamed only as told (old name to new name)."""
    renamed = renamed or {}
    out, back = [], {v: k for k, v in renamed.items()}
    for e in new:
        before = back.get(e.name, e.name)
        if before not in old.entities:
            out.append(Step("create entity", e.name, e.table, None, e))
            continue
        o = old[before]
        if before != e.name:
            out.append(Step("rename entity", e.name, before, o, e))
        if o.key != e.key:
            out.append(Step("change key", e.name, e.key, o, e))
        if renamed.get(o.parent, o.parent) != e.parent:
            out.append(Step("change inheritance", e.name, str(e.parent), o, e))
        out += _attributes(o, e)
        was, now = {r.name: r for r in o.relationships}, {r.name: r for r in e.relationships}
        out += [Step("add relationship", e.name, n, None, r) for n, r in now.items() if n not in was]
        out += [Step("drop relationship", e.name, n, r) for n, r in was.items() if n not in now]
        out += [Step("change relationship", e.name, n, was[n], r) for n, r in now.items() if n in was and (was[n].fk, was[n].inverse_fk, was[n].bridge, was[n].target) != (r.fk, r.inverse_fk, r.bridge, r.target)]
        out += [Step("add unique", e.name, ",".join(g), None, g) for g in e.unique if g not in o.unique]
        out += [Step("drop unique", e.name, ",".join(g), g) for g in o.unique if g not in e.unique]
    return out + [Step("drop entity", e.name, e.table, e) for e in old if renamed.get(e.name, e.name) not in new.entities]


def classify(steps: list[Step]) -> str:
    """The most demanding style among the steps."""
    order = (COMPATIBLE, INFERRED, CUSTOM, UNSUPPORTED)
    return max((s.style for s in steps), key=order.index, default=COMPATIBLE)


def column_fill(df: DataFrame) -> DataFrame:
    """(column, n_values, unused): how many rows hold a value, in one pass; a column without any is unused."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in df.columns])
    return counts.select(F.explode(cells).alias("c")).select("c.*").withColumn("unused", F.col("n_values") == 0)


def check(store: Store, steps: list[Step]) -> list[str]:
    """What in the data stands against the steps; one query for each check."""
    bad = []
    for s in steps:
        if s.kind == "create entity" or store.catalog.entities.get(s.detail if s.kind == "rename entity" else s.entity) is None:
            continue
        df = store.table(s.detail if s.kind == "rename entity" else s.entity)
        if s.kind == "add attribute" and not s.after.optional and s.after.default is None and not df.isEmpty():
            bad.append(f"{s.entity}.{s.detail} is required, has no default, and there are rows")
        elif s.kind == "tighten attribute" and s.after.default is None and not df.where(F.col(s.before.name).isNull()).isEmpty():
            bad.append(f"{s.entity}.{s.detail} has nulls")
        elif s.kind == "add unique" and all(c in df.columns for c in s.after) and not duplicates(df, s.after).isEmpty():
            bad.append(f"{s.entity}: {','.join(s.after)} is not unique")
        elif s.kind == "drop entity" and not df.isEmpty():
            bad.append(f"{s.entity} still has rows")
    return bad


def apply(
    store: Store, new: Catalog, renamed: dict[str, str] | None = None, handler: Callable[[Store, list[Step]], dict[str, DataFrame]] | None = None, validate: bool = True, drop_rows: bool = False
) -> Store:
    """A store with the new catalog. Custom steps need a handler, which gets them and returns tables by name."""
    steps = diff(store.catalog, new, renamed)
    custom = [s for s in steps if s.style == CUSTOM]
    if any(s.style == UNSUPPORTED for s in steps):
        raise MigrationError("unsupported: " + ", ".join(f"{s.kind} {s.entity}" for s in steps if s.style == UNSUPPORTED))
    if custom and handler is None:
        raise MigrationError("needs a handler: " + ", ".join(f"{s.kind} {s.entity}.{s.detail}" for s in custom))
    if validate and (bad := [b for b in check(store, steps) if not (drop_rows and "still has rows" in b)]):
        raise MigrationError("; ".join(bad))
    by_hand = handler(store, custom) if custom else {}
    tables = {n: df for n, df in store.tables.items() if n in {e.table for e in store.catalog} and n in {e.table for e in new} or n not in {e.table for e in store.catalog}}
    back = {v: k for k, v in (renamed or {}).items()}
    for e in new:
        own = [s for s in steps if s.entity == e.name]
        if any(s.kind == "create entity" for s in own):
            tables[e.table] = store.spark.createDataFrame([], e.struct())
            continue
        df = store.table(store.catalog[back.get(e.name, e.name)].table)
        for s in own:
            a: Attribute | None = s.after if isinstance(s.after, Attribute) else None
            if s.kind == "rename attribute":
                df = df.withColumnRenamed(s.before.name, a.name)
            elif s.kind == "add attribute":
                df = df.withColumn(a.name, F.lit(a.default).cast(a.type))
            elif s.kind == "tighten attribute" and a.default is not None:
                df = df.withColumn(a.name, F.coalesce(F.col(a.name), F.lit(a.default).cast(a.type)))
            elif s.kind == "drop attribute":
                df = df.drop(s.detail)
        tables[e.table] = df
    out = Store(store.spark, new, tables | by_hand, store.identifier)
    out.values = dict(store.values)
    return out
