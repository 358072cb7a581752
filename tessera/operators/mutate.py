"""Writes as rewrites: inserts, upserts by uniqueness, diffs, delete rules and links give new tables and log rows.

Every operator takes DataFrames and returns DataFrames, so a save is one plan; sources.snapshots commits the result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.catalog import Entity
from tessera.functions.scalar import ascii_lower
from tessera.operators.history import preserved
from tessera.sources.shared import settled
from tessera.store import Store


#: Pairs that a task compares. Their keys compress so well that partitions joined by their compressed size would hold tens of millions of rows.
PAIRS_A_TASK = 1_000_000


class UniqueViolation(ValueError):
    pass


class DeleteDenied(ValueError):
    """blocking: the keys (pk) of the rows that still refer to what should go."""

    def __init__(self, message: str, blocking: DataFrame):
        super().__init__(message)
        self.blocking = blocking


# --- single tables ---


def insert(table: DataFrame, rows: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """Rows with new keys are added; with `replace`, rows with known keys take the old ones' place, else they must not exist."""
    rows = rows.select([F.col(c).cast(table.schema[c].dataType) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    if not replace and not table.join(rows, key, "left_semi").isEmpty():
        raise UniqueViolation(f"a row with this {key} exists")
    return table.join(rows, key, "left_anti").unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Merge on the key: columns that the rows bring replace the stored ones, others stay; rows with unknown keys are added."""
    changed = [c for c in (columns or rows.columns) if c != key]
    n = rows.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in changed])
    old = table.withColumn("_old", F.lit(True))
    both = old.join(n, F.col(key) == F.col("_k"), "full_outer")
    out = [F.coalesce(F.col(key), F.col("_k")).alias(c) if c == key else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in table.columns]
    return both.select(out)


def upsert_changes(table: DataFrame, rows: DataFrame, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """(key, is_insert, changed): what upsert will do; rows that change nothing don't appear."""
    compared = [c for c in (columns or rows.columns) if c != key]
    old = table.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in compared])
    both = rows.join(old, F.col(key) == F.col("_k"), "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in compared]
    named = both.select(F.col(key), F.col("_k").isNull().alias("is_insert"), F.when(F.col("_k").isNull(), F.lit("")).otherwise(F.concat_ws(",", *differs)).alias("changed"))
    return named.where(F.col("is_insert") | (F.col("changed") != ""))


def update(table: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Columns set where a condition holds (a null condition doesn't)."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.select([F.when(hit, values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows without those for which the condition holds; no condition deletes all."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def erase_column(table: DataFrame, column: str, value=None, where: Column | None = None) -> DataFrame:
    return update(table, {column: F.lit(value)}, where)


def diff(before: DataFrame, after: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """(key, column, old, new) as text for each value that differs in rows that both have; nulls are values."""
    b = before.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = after.join(b, key)
    cells = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new"))) for c in columns])
    return both.select(F.col(key), F.explode(F.array_compact(cells)).alias("d")).select(key, "d.*")


def merge_values(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming values replace stored ones property by property; null ones don't."""
    i = incoming.select(F.col(key), *[F.col(c).alias(f"_i_{c}") for c in incoming.columns if c != key])
    return stored.join(i, key, "left").select([F.coalesce(F.col(f"_i_{c}"), F.col(c)).alias(c) if c != key and c in incoming.columns else F.col(c) for c in stored.columns])


def generate(table: DataFrame, entity: Entity) -> DataFrame:
    """Generated attributes take the values of their SQL."""
    return table.withColumns({a.name: F.expr(a.generated).cast(a.type) for a in entity.attributes if a.generated})


def decode(table: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls become the defaults of their columns."""
    return table.select([F.coalesce(F.col(c), F.lit(defaults[c]).cast(table.schema[c].dataType)).alias(c) if c in defaults else F.col(c) for c in table.columns])


# --- uniqueness ---


def match_unique(table: DataFrame, rows: DataFrame, key: str, groups: Iterable[tuple[str, ...]]) -> DataFrame:
    """rows with `match`: the key of the stored row that shares a unique group (null in a group never matches), and `conflict` where groups give different keys."""
    found = []
    for k, group in enumerate(groups):
        stored = table.select(F.col(key).alias(f"_m{k}"), *[F.col(c).alias(f"_g{k}_{c}") for c in group])
        rows = rows.join(stored, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_g{k}_{c}") for c in group]), "left").drop(*[f"_g{k}_{c}" for c in group])
        found.append(F.col(f"_m{k}"))
    distinct = F.array_distinct(F.array_compact(F.array(*found)))
    return rows.withColumns({"match": F.try_element_at(distinct, F.lit(1)), "conflict": F.size(distinct) > 1}).drop(*[f"_m{k}" for k in range(len(found))])


def duplicates(table: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Groups of equal non-null values that more than one row has, with their count."""
    columns = list(columns)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return table.where(whole).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- relationships ---


def link_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, related, change): pairs that one of two sets of (owner, related) lacks, linked or unlinked; nulls are values.

    The pairs are counted and dealt out once, PAIRS_A_TASK to a task, so a task's memory doesn't grow with them."""
    both = before.select("owner", "related", F.lit(False).alias("_new")).unionAll(after.select("owner", "related", F.lit(True).alias("_new")))
    parts = max(1, -(-both.count() // PAIRS_A_TASK))
    seen = both.repartition(parts, "owner", "related").groupBy("owner", "related").agg(F.bool_and("_new").alias("_added"), F.bool_or("_new").alias("_stays"))
    change = F.when(F.col("_added"), "linked").when(~F.col("_stays"), "unlinked")
    return seen.select("owner", "related", change.alias("change")).where(F.col("change").isNotNull())


def reconcile(before: DataFrame, after: DataFrame, add_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(linked, unlinked) between two sets of (owner, related); with add_only nothing is unlinked."""
    changes = link_changes(before, after)
    on, off = (changes.where(F.col("change") == c).select("owner", "related") for c in ("linked", "unlinked"))
    return on, off.limit(0) if add_only else off


def link_bridge(bridge: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs are added once."""
    return bridge.unionByName(pairs.toDF(*bridge.columns)).distinct()


def unlink_bridge(bridge: DataFrame, pairs: DataFrame) -> DataFrame:
    return bridge.join(pairs.toDF(*bridge.columns), bridge.columns, "left_anti")


def link_many(target: DataFrame, key: str, fk: str, pairs: DataFrame) -> DataFrame:
    """Sets the reverse key of targets in (owner, related)."""
    p = pairs.select(F.col("related").alias("_r"), F.col("owner").alias("_o"))
    return target.join(p, F.col(key) == F.col("_r"), "left").select([F.coalesce("_o", fk).alias(c) if c == fk else F.col(c) for c in target.columns])


def unlink_many(target: DataFrame, key: str, fk: str, pairs: DataFrame, rule: str = "nullify") -> DataFrame:
    """Targets that lose their owner: cascade deletes them, nullify clears the key."""
    p = pairs.select(F.col("related").alias("_r"), F.col("owner").alias("_o"))
    hit = (F.col(key) == F.col("_r")) & (F.col(fk) == F.col("_o"))
    if rule == "cascade":
        return target.join(p, hit, "left_anti")
    return target.join(p, hit, "left").select([F.when(F.col("_r").isNull(), F.col(fk)).alias(c) if c == fk else F.col(c) for c in target.columns])


def link_one(owner: DataFrame, key: str, fk: str, pairs: DataFrame) -> DataFrame:
    """Sets the to-one key of owners in (owner, related); a null target clears it."""
    p = pairs.select(F.col("owner").alias("_o"), F.col("related").alias("_r"))
    return owner.join(p, F.col(key) == F.col("_o"), "left").select([F.when(F.col("_o").isNotNull(), F.col("_r")).otherwise(F.col(fk)).alias(c) if c == fk else F.col(c) for c in owner.columns])


def remap(table: DataFrame, columns: Iterable[str], ids: DataFrame) -> DataFrame:
    """References replaced by (old, new): temporary ids that became permanent, or ids that an upsert superseded."""
    for c in columns:
        m = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        table = table.join(m, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return table


# --- deletes ---


@dataclass
class Deletion:
    """Keys that go, by entity (one-column frames named `pk`), keys (pk) that are cleared, by (table, fk column), and keys whose rows leave a bridge, by (bridge, column)."""

    removed: dict[str, DataFrame] = field(default_factory=dict)
    cleared: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    unlinked: dict[tuple[str, str], DataFrame] = field(default_factory=dict)


def _and(found: dict, key, gone: DataFrame) -> None:
    found[key] = found[key].unionAll(gone).distinct() if key in found else gone


def _line(store: Store, name: str) -> list[Entity]:
    """The entity with its ancestors and descendants: a row of one has its key in the others."""
    return [store.entity(n) for n in (name, *store.catalog.ancestors(name), *store.catalog.descendants(name))]


def plan_delete(store: Store, entity: str, keys: DataFrame) -> Deletion:
    """What deleting rows does under the delete rules of an entity and of those it shares rows with: cascades follow relationships, at any depth, until nothing new is found; nullify clears keys; deny raises if a row that stays still refers to one that goes; links in bridges go with either end.

    Keys of each level are tables of the shared folder. A bridge that is itself an entity's table follows that entity's rules instead."""
    out, queue, denied = Deletion(), {entity: keys.toDF("pk").distinct()}, []
    own_tables = {e.table for e in store.catalog}
    while queue:
        following: dict[str, DataFrame] = {}
        for name, gone in queue.items():
            if name in out.removed:
                gone = gone.join(out.removed[name], "pk", "left_anti")
            gone = settled(gone, "gone")
            if name in out.removed and gone.isEmpty():
                continue
            _and(out.removed, name, gone)
            line = _line(store, name)
            for r in (r for e in line for r in e.relationships):
                if r.bridge and r.bridge[0] not in own_tables:
                    _and(out.unlinked, r.bridge[:2], gone)
                if not r.inverse_fk:
                    continue
                holder = store.catalog.owner(r.target, r.inverse_fk)
                refs = store.table(holder.table).join(gone.toDF("_gone"), F.col(r.inverse_fk) == F.col("_gone"), "left_semi").select(F.col(holder.key).alias("pk")).distinct()
                if r.delete_rule == "deny":
                    denied.append((f"{name}.{r.name}", r.target, refs))
                elif r.delete_rule == "cascade":
                    _and(following, r.target, refs)
                elif r.delete_rule == "nullify":
                    _and(out.cleared, (holder.table, r.inverse_fk), gone)
            for r in (r for e in store.catalog for r in e.relationships if r.bridge and r.target in {x.name for x in line}):
                if r.bridge[0] not in own_tables:
                    _and(out.unlinked, (r.bridge[0], r.bridge[2]), gone)
        queue = following
    for what, target, refs in denied:
        going = [out.removed[e.name] for e in _line(store, target) if e.name in out.removed]
        left = refs.join(reduce(DataFrame.unionAll, going), "pk", "left_anti") if going else refs
        if not left.isEmpty():
            raise DeleteDenied(f"{what} still has rows", left)
    return out


def apply_delete(store: Store, d: Deletion) -> dict[str, DataFrame]:
    """New tables after a deletion, with the rows of bridges that go with it."""
    tables: dict[str, DataFrame] = {}

    def at(table: str) -> DataFrame:
        return tables.get(table, store.table(table))

    for (table, fk), gone in d.cleared.items():
        df, g = at(table), gone.select(F.col("pk").alias("_g"))
        tables[table] = df.join(g, F.col(fk) == F.col("_g"), "left").select([F.when(F.col("_g").isNull(), F.col(fk)).alias(c) if c == fk else F.col(c) for c in df.columns])
    for (table, column), gone in d.unlinked.items():
        tables[table] = at(table).join(gone.toDF("_gone"), F.col(column) == F.col("_gone"), "left_anti")
    for name, gone in d.removed.items():
        for e in _line(store, name):
            tables[e.table] = at(e.table).join(gone.toDF("_gone"), F.col(e.key) == F.col("_gone"), "left_anti")
    return tables


def delete_where(store: Store, entity: str, condition: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Batch delete: (new tables, log rows with the values that attributes marked `preserve` had)."""
    e = store.entity(entity)
    hit = store.table(entity).where(condition)
    d = plan_delete(store, entity, hit.select(e.key))
    logs = []
    for name, gone in d.removed.items():
        o = store.entity(name)
        keep = [a.name for a in o.attributes if a.preserve]
        rows = store.table(name).join(gone.toDF("_gone"), F.col(o.key) == F.col("_gone"), "left_semi")
        logs.append(rows.select(F.lit("delete").alias("event"), F.lit(name).alias("entity_name"), F.col(o.key).cast("string").alias("entity_pk"), F.lit(",".join(keep) or None).cast("string").alias("property_names"), preserved(keep).alias("preserved_values")))
    return apply_delete(store, d), reduce(DataFrame.unionAll, logs)


# --- diagnostics ---


def violations(store: Store, entity: str) -> DataFrame:
    """(kind, columns, pk): rows that break NOT NULL, UNIQUE (also of an index, over part of the rows or blind to case), CHECK, generated values, primary or foreign keys. A CHECK that is null holds."""
    e, df = store.entity(entity), store.table(entity)
    pk = F.col(e.key).cast("string").alias("pk")
    parts = [df.where(F.col(e.key).isNull()).select(F.lit("primary key").alias("kind"), F.lit(e.key).alias("columns"), pk)]
    folded = df.withColumns({a.name: ascii_lower(F.col(a.name)) for a in e.attributes if a.nocase})
    groups = [((e.key,), None), *((g, None) for g in e.unique), *(((a.name,), None) for a in e.attributes if a.unique), *((i.columns, i.where) for i in e.indexes if i.unique)]
    for group, where in dict.fromkeys(groups):
        rows = folded.where(where) if where else folded
        twice = duplicates(rows, group).drop("n")
        parts.append(rows.join(twice, list(group), "left_semi").select(F.lit("unique").alias("kind"), F.lit(",".join(group)).alias("columns"), pk))
    parts += [df.where(~F.expr(check)).select(F.lit("check").alias("kind"), F.lit(check).alias("columns"), pk) for check in e.checks]
    parts += [df.where(~F.col(a.name).eqNullSafe(F.expr(a.generated).cast(a.type))).select(F.lit("generated").alias("kind"), F.lit(a.name).alias("columns"), pk) for a in e.attributes if a.generated]
    parts += [df.where(F.col(a.name).isNull()).select(F.lit("not null").alias("kind"), F.lit(a.name).alias("columns"), pk) for a in e.attributes if not a.optional and a.default is None]
    for r in e.relationships:
        if r.fk:
            t = store.entity(r.target)
            have = store.table(r.target).select(F.col(t.key).alias("_t"))
            parts.append(df.where(F.col(r.fk).isNotNull()).join(have, F.col(r.fk) == F.col("_t"), "left_anti").select(F.lit("foreign key").alias("kind"), F.lit(r.fk).alias("columns"), pk))
            if not r.optional:
                parts.append(df.where(F.col(r.fk).isNull()).select(F.lit("not null").alias("kind"), F.lit(r.fk).alias("columns"), pk))
    return reduce(DataFrame.unionAll, parts)


# --- a whole save ---


@dataclass
class SaveRequest:
    """By entity: rows to insert (with temporary keys where `temporary`), rows to update, keys to delete."""

    inserted: dict[str, DataFrame] = field(default_factory=dict)
    updated: dict[str, DataFrame] = field(default_factory=dict)
    deleted: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class SaveResult:
    tables: dict[str, DataFrame]
    changes: DataFrame | None
    remapped: DataFrame | None


def save(store: Store, r: SaveRequest) -> SaveResult:
    """Inserts in the order of required references (upserting where a unique group matches), then updates, then deletes.

    An insert that matches a stored row by a unique group updates that row: its own key is superseded, and references
    to it in this save follow. Groups that point at different rows are a UniqueViolation. Each change gets a log row."""
    tables: dict[str, DataFrame] = {}
    logs: list[DataFrame] = []
    ids: DataFrame | None = None

    def at(name: str) -> DataFrame:
        return tables.get(store.entity(name).table, store.table(name))

    def note(event: str, name: str, df: DataFrame, key: str, names: Column) -> None:
        logs.append(df.select(F.lit(event).alias("event"), F.lit(name).alias("entity_name"), F.col(key).cast("string").alias("entity_pk"), names.alias("property_names"), F.lit(None).cast("string").alias("preserved_values")))

    none = F.lit(None).cast("string")
    for name in (n for layer in store.catalog.insertion_order() for n in layer if n in r.inserted):
        e, rows = store.entity(name), r.inserted[name]
        if ids is not None:
            rows = remap(rows, [x.fk for x in e.relationships if x.fk and x.fk in rows.columns], ids)
        groups = [*e.unique, *((a.name,) for a in e.attributes if a.unique and (a.name,) not in e.unique), (e.key,)]
        groups = [g for g in dict.fromkeys(groups) if set(g) <= set(rows.columns)]
        matched = match_unique(at(name), rows, e.key, groups)
        if not matched.where("conflict").isEmpty():
            raise UniqueViolation(f"{name}: unique groups match different rows")
        own = matched.where(F.col("match").isNotNull() & (F.col("match") != F.col(e.key))).select(F.col(e.key).alias("old"), F.col("match").alias("new"))
        ids = own if ids is None else ids.unionAll(own)
        final = matched.withColumn(e.key, F.coalesce("match", e.key)).drop("match", "conflict")
        twice = [duplicates(final, g).select(F.lit(",".join(g)).alias("columns")) for g in groups]
        if not reduce(DataFrame.unionAll, twice).isEmpty():
            raise UniqueViolation(f"{name}: rows of one save share a unique value, or a stored row")
        what = upsert_changes(at(name), final, e.key)
        note("insert", name, what.where("is_insert"), e.key, none)
        note("update", name, what.where("not is_insert"), e.key, F.col("changed"))
        tables[e.table] = upsert(at(name), final, e.key)
    for name, rows in r.updated.items():
        e = store.entity(name)
        if ids is not None:
            rows = remap(rows, [x.fk for x in e.relationships if x.fk and x.fk in rows.columns], ids)
        what = upsert_changes(at(name), rows, e.key).where("not is_insert")
        note("update", name, what, e.key, F.col("changed"))
        tables[e.table] = upsert(at(name), rows.join(at(name).select(e.key), e.key, "left_semi"), e.key)
    for name, keys in r.deleted.items():
        moved = Store(store.spark, store.catalog, store.tables | tables, store.identifier)
        d = plan_delete(moved, name, keys)
        for n, gone in d.removed.items():
            note("delete", n, gone, "pk", none)
        tables |= apply_delete(moved, d)
    return SaveResult(tables, reduce(DataFrame.unionAll, logs) if logs else None, ids)
