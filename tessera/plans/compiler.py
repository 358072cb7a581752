"""Predicate trees become columns over a DataFrame that carries the joins they need.

Each column of a variable is named `alias.column`, so no reference is ambiguous. A path through a to-one relationship
joins its target once for each alias, as an inner join: rows without a target are dropped from the whole query, even
under `or` and `not` (the store's semantics). Facts about to-many relationships that stand as a conjunct of the whole
predicate are semi or anti joins; elsewhere, and for counts and firsts, the related rows are aggregated by owner
before one left join. A closure may use outer variables at any depth; the related rows then carry the outer columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.catalog import Relationship
from tessera.expressions import Expr, Lit, Many, Path, Var
from tessera.functions import scalar as S
from tessera.store import Store

OWNER = "_owner"


def name(alias: str, column: str) -> str:
    return f"{alias}.{column}"


def col(alias: str, column: str) -> Column:
    return F.col(f"`{alias}.{column}`")


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select([F.col(c).alias(name(alias, c)) for c in df.columns])


class Plan:
    """A DataFrame, the variables it holds and the aliases that are joined so far."""

    def __init__(self, store: Store, var: Var, df: DataFrame | None = None):
        self.store, self.catalog = store, store.catalog
        self.entities: dict[str, str] = {var.alias: var.entity}
        self.df = prefixed(store.table(var.entity), var.alias) if df is None else df
        self.raw: str | None = None
        self.facts = 0
        for up in self.catalog.ancestors(var.entity):  # a subclass row is also a row of each ancestor
            self.join_entity(var.alias, var.entity, up, "inner")

    # --- joins ---

    def ancestor_alias(self, alias: str, entity: str) -> str:
        return f"{alias}_is_{entity}"

    def join_entity(self, alias: str, own: str, other: str, how: str) -> str:
        """Joins another table of the inheritance line on the shared key, hop by hop where rows may be missing."""
        target = self.ancestor_alias(alias, other)
        if target not in self.entities:
            e, o = self.catalog[own], self.catalog[other]
            right = prefixed(self.store.table(other), target)
            self.df = self.df.join(right, col(alias, e.key) == col(target, o.key), how)
            self.entities[target] = other
        return target

    def join_to_one(self, alias: str, r: Relationship, how: str = "inner") -> str:
        target = f"{alias}_{r.name}"
        if target not in self.entities:
            owner = self.catalog.owner(self.entities[alias], r.name)
            at = alias if owner.name == self.entities[alias] else self.join_entity(alias, self.entities[alias], owner.name, "left")
            right = prefixed(self.store.table(r.target), target)
            self.df = self.df.join(right, col(at, r.fk) == col(target, self.catalog[r.target].key), how)
            self.entities[target] = r.target
        return target

    # --- paths ---

    def walk(self, path: Path, how: str = "inner") -> tuple[str, str, list[str]]:
        """(alias that the last property belongs to, the property, fields of a composite after it)."""
        alias, steps = path.var.alias, list(path.steps)
        while steps:
            entity = self.entities[alias]
            step = steps.pop(0)
            if step.startswith("as "):
                target = step[3:]
                if self.catalog.path(entity, target) is None:
                    return alias, "", []
                alias = self.join_entity(alias, entity, target, "left")
                if not steps:
                    return alias, self.catalog[target].key, []
                continue
            r = self.catalog.relationship(entity, step)
            if r and not r.to_many:
                if not steps:
                    return alias, r.fk, []
                alias = self.join_to_one(alias, r, how)
                continue
            return alias, step, steps
        raise ValueError("a path needs a property")

    def column(self, path: Path, how: str = "inner") -> Column:
        alias, prop, rest = self.walk(path, how)
        if not prop:
            return F.lit(None)
        entity = self.entities[alias]
        owner = self.catalog.owner(entity, prop)
        at = alias if owner.name == entity else self.join_entity(alias, entity, owner.name, "left")
        out = col(at, prop)
        a = owner.attribute(prop)
        if rest:
            kind = a.type if a else "string"
            if a and a.composite and rest[0] not in a.composite:
                raise KeyError(f"{prop} has no field {rest[0]}")
            out = S.json_key(out, rest[0], "string") if kind == "string" else out[rest[0]]
        return out

    # --- related rows ---

    def related(self, m: Many) -> tuple[Plan, Column, DataFrame]:
        """(plan of the related rows, the owner's key, the rows that meet the closure with their owner's key in OWNER)."""
        alias, prop, _ = self.walk(m.path)
        r = self.catalog.relationship(self.entities[alias], prop)
        if not r or not r.to_many:
            raise KeyError(f"{prop} is no to-many relationship")
        owner = self.catalog.owner(self.entities[alias], prop)
        key = col(alias if owner.name == self.entities[alias] else self.join_entity(alias, self.entities[alias], owner.name, "left"), owner.key)
        var = Var(r.target, f"{alias}_{r.name}_{self.facts}")
        self.facts += 1
        inner = Plan(self.store, var)
        if r.bridge:
            table, own, other = r.bridge
            bridge = self.store.table(table).select(F.col(own).alias(OWNER), F.col(other).alias("_other"))
            if m.kind == "count":  # elsewhere a repeated link changes nothing
                bridge = bridge.distinct()
            inner.df = inner.df.join(bridge, col(var.alias, self.catalog[r.target].key) == F.col("_other"))
        else:
            inner.df = inner.df.withColumn(OWNER, col(var.alias, r.inverse_fk))
        if m.f:
            tree = m.f(var)
            if outer := free_aliases(tree) - {var.alias}:
                wanted = self.df.select(key.alias("_outer"), *(F.col(f"`{c}`") for c in self.df.columns if any(c.startswith((f"{a}.", f"{a}_")) for a in outer)))
                if m.kind == "count":  # elsewhere repeats change nothing, and columns that the closure doesn't name are pruned
                    wanted = wanted.distinct()
                inner.df = inner.df.join(wanted, F.col(OWNER) == F.col("_outer"))
                inner.entities |= {a: e for a, e in self.entities.items() if a in outer or any(a.startswith(f"{o}_") for o in outer)}
            inner.filter(tree)
        if m.kind == "has_key":
            inner.df = inner.df.where(col(var.alias, self.catalog[r.target].key) == F.lit(m.extra))
        inner.entities = {var.alias: r.target} | inner.entities
        return inner, key, inner.df

    def fact(self, m: Many) -> Column:
        """A column with the fact, by one left join of the aggregated related rows."""
        inner, key, rows = self.related(m)
        alias = next(iter(inner.entities))
        out = f"_fact{self.facts}_{alias}"
        if m.kind in ("first", "last"):
            target = inner.entities[alias]
            own = self.catalog[target].key
            pick = (F.min if m.kind == "first" else F.max)(F.struct(col(alias, own).alias("k"), col(alias, m.extra).alias("v")))
            summed = rows.groupBy(OWNER).agg(pick["v"].alias(out))
        else:
            summed = rows.groupBy(OWNER).agg(F.count(F.lit(1)).alias(out))
        summed = summed.withColumnRenamed(OWNER, f"{out}_owner")
        self.df = self.df.join(summed, key == F.col(f"{out}_owner"), "left").drop(f"{out}_owner")
        if m.kind in ("first", "last"):
            return F.col(out)
        n = F.coalesce(F.col(out), F.lit(0))
        return n if m.kind == "count" else n == 0 if m.kind == "none" else n > 0

    def filter(self, tree: Expr) -> Plan:
        """Keeps rows for which the predicate holds; conjuncts about related rows become semi and anti joins."""
        for part in conjuncts(tree):
            negated = part.fn == "not" and isinstance(part.args[0], Many)
            m = part.args[0] if negated else part
            if isinstance(m, Many) and m.kind in ("any", "none", "has_key"):
                _, key, rows = self.related(m)
                self.df = self.df.join(rows.select(F.col(OWNER).alias("_key")), key == F.col("_key"), "left_anti" if (m.kind == "none") != negated else "left_semi")
            elif part.fn == "raw":
                self.raw = part.args[0]
            else:
                test = self.compile(part)  # may add joins to self.df
                self.df = self.df.where(test)
        return self

    # --- expressions ---

    def compile(self, e: Expr) -> Column:
        if isinstance(e, Many):
            return self.fact(e)
        if isinstance(e, Path):
            return self.column(e)
        if isinstance(e, Var):
            return col(e.alias, self.catalog[self.entities[e.alias]].key)
        if isinstance(e, Lit):
            return F.lit(e.value)
        return getattr(self, f"_{e.fn}")(*e.args)

    def _compare(self, a: Expr, b: Expr, equal: bool) -> Column:
        if isinstance(a, Lit) and isinstance(b, Lit):
            return F.lit((a.value == b.value) == equal)
        for x, y in ((a, b), (b, a)):
            if isinstance(x, Lit):
                c = self.compile(y)
                if x.value is None:
                    return c.isNull() if equal else c.isNotNull()
                if isinstance(x.value, bool):
                    return c if x.value == equal else ~c
        x, y = self.compile(a), self.compile(b)
        return x == y if equal else x != y

    def _eq(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, True)

    def _ne(self, a: Expr, b: Expr) -> Column:
        return self._compare(a, b, False)

    def _and(self, a: Expr, b: Expr) -> Column:
        return self.compile(a) & self.compile(b)

    def _or(self, a: Expr, b: Expr) -> Column:
        return self.compile(a) | self.compile(b)

    def _not(self, a: Expr) -> Column:
        return ~self.compile(a)

    def _in(self, a: Expr, values: list) -> Column:
        return self.compile(a).isin(values) if values else F.lit(False)

    def _coalesce(self, a: Expr, b: Expr) -> Column:
        return F.coalesce(self.compile(a), self.compile(b))

    def _cond(self, test: Expr, a: Expr, b: Expr) -> Column:
        if isinstance(test, Lit) and isinstance(test.value, bool):
            return self.compile(a if test.value else b)
        zero = False if a.fn in LOGICAL or isinstance(a, Lit) and isinstance(a.value, bool) else 0
        return S.conditional(self.compile(test), self.compile(a), self.compile(b), zero)

    def _cast(self, a: Expr, kind: str) -> Column:
        return self.compile(a).cast(kind)

    def _neg(self, a: Expr) -> Column:
        return -self.compile(a)

    def _like(self, a: Expr, sought: Expr, before: str, after: str, escape: bool) -> Column:
        return S.like(self.compile(a), self.compile(sought), before, after, escape)

    def _concat(self, *parts: Expr) -> Column:
        return F.concat(*map(self.compile, parts))

    def _index(self, a: Expr, k: int) -> Column:
        return S.element(self.compile(a), k)

    def _slice(self, a: Expr, start: int, end: int) -> Column:
        return S.cut(self.compile(a), start, end)

    def _array_has(self, a: Expr, v: Expr) -> Column:
        return F.array_contains(self.compile(a), self.compile(v))

    def _array_any(self, a: Expr, f: Callable) -> Column:
        return F.exists(self.compile(a), lambda x: self.compile(f(_Value(x))))

    def _array_all(self, a: Expr, f: Callable) -> Column:
        return F.forall(self.compile(a), lambda x: self.compile(f(_Value(x))))

    def _value(self, c: Column) -> Column:
        return c

    def _array_max(self, a: Expr) -> Column:
        return F.array_max(self.compile(a))

    def _array_min(self, a: Expr) -> Column:
        return F.array_min(self.compile(a))

    def _array_length(self, a: Expr) -> Column:
        return F.size(self.compile(a))

    def _json_key(self, a: Expr, key: str, kind: str, default) -> Column:
        return S.json_key(self.compile(a), key, kind, default)

    def _between(self, a: Expr, low: Expr, high: Expr) -> Column:
        return self.compile(a).between(self.compile(low), self.compile(high))

    def _rlike(self, a: Expr, pattern: str) -> Column:
        return self.compile(a).rlike(pattern)

    def _is_type(self, v: Var, entity: str) -> Column:
        own = self.entities[v.alias]
        if own == entity or entity in self.catalog.ancestors(own):
            return F.lit(True)
        if self.catalog.path(own, entity) is None:
            return F.lit(False)
        return col(self.join_entity(v.alias, own, entity, "left"), self.catalog[entity].key).isNotNull()


class _Value(Expr):
    """An array's element in a closure."""

    def __init__(self, c: Column):
        super().__init__("value", c)


LOGICAL = frozenset(("eq", "ne", "lt", "le", "gt", "ge", "and", "or", "not", "in", "like", "iequal", "array_has", "array_any", "is_type", "between", "rlike"))

for _fn, _op in {
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
    "div": S.float_div, "int_div": S.int_div, "mod": S.modulo, "iequal": S.iequal,
}.items():
    setattr(Plan, f"_{_fn}", lambda self, a, b, op=_op: op(self.compile(a), self.compile(b)))


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if e.fn == "and" else [e]


def free_aliases(e) -> set[str]:
    """Aliases of the variables in a tree; closures inside are entered with a stand-in for their own variable."""
    if isinstance(e, Path):
        return {e.var.alias}
    if isinstance(e, Var):
        return {e.alias}
    if isinstance(e, Many):
        own = Var("_", "_own")
        return free_aliases(e.path) | (free_aliases(e.f(own)) - {"_own"} if e.f else set())
    if isinstance(e, Expr):
        return set().union(*map(free_aliases, e.args))
    if isinstance(e, list | tuple):
        return set().union(*map(free_aliases, e))
    return set()
