"""The catalog: entities with attributes, relationships, inheritance and constraints, rendered as Spark schemas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class Attribute:
    """A stored value. `composite` names the fields of a JSON text column; `original` is its name before a rename; `nocase` makes its uniqueness blind to ASCII case; `generated` is SQL over the row's other columns that gives its value."""

    name: str
    type: str = "string"
    optional: bool = True
    unique: bool = False
    default: Any = None
    preserve: bool = False
    external: bool = False
    ephemeral: bool = False
    composite: tuple[str, ...] = ()
    original: str | None = None
    nocase: bool = False
    generated: str | None = None


@dataclass(frozen=True)
class Index:
    """Columns by which rows are kept together. A unique one forbids equal rows, among those that meet `where` if that is given."""

    columns: tuple[str, ...]
    unique: bool = False
    where: str | None = None


@dataclass(frozen=True)
class Relationship:
    """To-one with `fk`, a column of its own; one-to-many with `inverse_fk`, a column of the target; many-to-many with `bridge`: (table, own column, other column)."""

    name: str
    target: str
    fk: str | None = None
    inverse_fk: str | None = None
    bridge: tuple[str, str, str] | None = None
    delete_rule: str = "nullify"
    optional: bool = True
    min_count: int = 0
    max_count: int = 0

    def __post_init__(self):
        if [self.fk, self.inverse_fk, self.bridge].count(None) != 2:
            raise ValueError(f"relationship {self.name} needs exactly one of fk, inverse_fk, bridge")
        if self.delete_rule not in ("nullify", "cascade", "deny", "none"):
            raise ValueError(f"unknown delete rule {self.delete_rule}")

    @property
    def to_many(self) -> bool:
        return self.fk is None

    def edges(self, owner: Entity, target: Entity) -> list[tuple[str, str, str, str]]:
        """(table, column, table, column) of each join edge: one, or two through a bridge."""
        if self.fk:
            return [(owner.table, self.fk, target.table, target.key)]
        if self.inverse_fk:
            return [(owner.table, owner.key, target.table, self.inverse_fk)]
        table, own, other = self.bridge
        return [(owner.table, owner.key, table, own), (table, other, target.table, target.key)]


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    key: str
    attributes: tuple[Attribute, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    parent: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def relationship(self, name: str) -> Relationship | None:
        return next((r for r in self.relationships if r.name == name), None)

    def struct(self) -> T.StructType:
        """Key, to-one keys and attributes, with flags in the field metadata."""
        fields = [T.StructField(self.key, T.StringType(), False)]
        fields += [T.StructField(r.fk, T.StringType(), r.optional, {"target": r.target}) for r in self.relationships if r.fk]
        for a in self.attributes:
            if a.name == self.key:
                fields[0] = T.StructField(a.name, T._parse_datatype_string(a.type), False, {"unique": True})
            elif a.name not in {f.name for f in fields}:
                kind = T._parse_datatype_string(a.type)
                fields.append(T.StructField(a.name, kind, a.optional or a.external, {"unique": a.unique, "default": a.default}))
        return T.StructType(fields)


@dataclass
class Catalog:
    entities: dict[str, Entity] = field(default_factory=dict)

    @classmethod
    def of(cls, *entities: Entity) -> Catalog:
        c = cls({e.name: e for e in entities})
        c.validate()
        return c

    def __getitem__(self, name: str) -> Entity:
        try:
            return self.entities[name]
        except KeyError:
            raise KeyError(f"no entity {name}") from None

    def __iter__(self) -> Iterator[Entity]:
        return iter(self.entities.values())

    def validate(self) -> None:
        for e in self:
            if e.parent and e.parent not in self.entities:
                raise ValueError(f"{e.name}: no parent entity {e.parent}")
            self.ancestors(e.name)
            for r in e.relationships:
                if r.target not in self.entities:
                    raise ValueError(f"{e.name}.{r.name}: no entity {r.target}")

    # --- inheritance topology ---

    def ancestors(self, name: str) -> list[str]:
        """Parents upwards, nearest first."""
        out: list[str] = []
        at = self[name].parent
        while at:
            if at in out or at == name:
                raise ValueError(f"inheritance cycle at {at}")
            out.append(at)
            at = self[at].parent
        return out

    def children(self, name: str) -> list[str]:
        return sorted(e.name for e in self if e.parent == name)

    def descendants(self, name: str) -> list[str]:
        """Breadth first."""
        out, level = [], self.children(name)
        while level:
            out += level
            level = [c for n in level for c in self.children(n)]
        return out

    def depth(self, name: str) -> int:
        return len(self.ancestors(name))

    def path(self, start: str, end: str) -> list[str] | None:
        """Entities on the way from start to end, both included, down or up one line of inheritance; None if unrelated."""
        if start == end:
            return [start]
        if start in (up := self.ancestors(end)):
            return [*reversed(up[: up.index(start) + 1]), end]
        if end in (up := self.ancestors(start)):
            return [start, *up[: up.index(end) + 1]]
        return None

    def owner(self, name: str, prop: str) -> Entity:
        """The entity, or the nearest ancestor, that holds a property or column."""
        for n in (name, *self.ancestors(name)):
            e = self[n]
            if prop == e.key or e.attribute(prop) or e.relationship(prop) or any(r.fk == prop for r in e.relationships):
                return e
        raise KeyError(f"{name} has no property {prop}")

    def relationship(self, name: str, prop: str) -> Relationship | None:
        for n in (name, *self.ancestors(name)):
            if r := self[n].relationship(prop):
                return r
        return None

    def insertion_order(self) -> list[list[str]]:
        """Layers in which required to-one targets and parents come first; what lies on a cycle goes in one last layer."""
        needs = {e.name: ({r.target for r in e.relationships if r.fk and not r.optional} | ({e.parent} if e.parent else set())) - {e.name} for e in self}
        layers: list[list[str]] = []
        while needs:
            ready = sorted(n for n, d in needs.items() if not d & needs.keys()) or sorted(needs)
            layers.append(ready)
            for n in ready:
                del needs[n]
        return layers

    def without_unknown_types(self, known: set[str]) -> Catalog:
        """Drops entities that have an attribute of an unknown type, and relationships to them."""
        keep = {e.name for e in self if all(a.type in known for a in e.attributes)}
        while gone := {n for n in keep if self[n].parent and self[n].parent not in keep}:
            keep -= gone
        return Catalog({e.name: Entity(e.name, e.table, e.key, e.attributes, tuple(r for r in e.relationships if r.target in keep), e.parent, e.unique, e.checks, e.indexes) for e in self if e.name in keep})
