"""Predicate trees: variables, paths through relationships, collection closures and scalar calls.

`predicate(entity, lambda o: (o.price > 3) & o.items.any(lambda i: i.quantity >= 45))` builds a tree; plans.compiler
turns it into columns and joins. Python's `&`, `|` and `~` stand for and, or and not."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import Any

_numbers = itertools.count()


class Expr:
    """A node; `fn` names what compiler does with `args`."""

    def __init__(self, fn: str, *args: Any):
        self.fn, self.args = fn, args

    def __eq__(self, other):  # type: ignore[override]
        return Expr("eq", self, wrap(other))

    def __ne__(self, other):  # type: ignore[override]
        return Expr("ne", self, wrap(other))

    __hash__ = object.__hash__

    def __lt__(self, other):
        return Expr("lt", self, wrap(other))

    def __le__(self, other):
        return Expr("le", self, wrap(other))

    def __gt__(self, other):
        return Expr("gt", self, wrap(other))

    def __ge__(self, other):
        return Expr("ge", self, wrap(other))

    def __and__(self, other):
        return Expr("and", self, wrap(other))

    def __or__(self, other):
        return Expr("or", self, wrap(other))

    def __invert__(self):
        return Expr("not", self)

    def __add__(self, other):
        return Expr("add", self, wrap(other))

    def __sub__(self, other):
        return Expr("sub", self, wrap(other))

    def __mul__(self, other):
        return Expr("mul", self, wrap(other))

    def __radd__(self, other):
        return Expr("add", wrap(other), self)

    def __rsub__(self, other):
        return Expr("sub", wrap(other), self)

    def __rmul__(self, other):
        return Expr("mul", wrap(other), self)

    def __truediv__(self, other):
        return Expr("div", self, wrap(other))

    def __floordiv__(self, other):
        return Expr("int_div", self, wrap(other))

    def __mod__(self, other):
        return Expr("mod", self, wrap(other))

    def __neg__(self):
        return Expr("neg", self)

    def __bool__(self):
        raise TypeError("use & | ~ in predicates")

    # --- values ---

    def in_(self, values) -> Expr:
        return Expr("in", self, list(values))

    def or_else(self, other) -> Expr:
        """The value, or another where it is null."""
        return Expr("coalesce", self, wrap(other))

    def flat_map(self, f: Callable[[Expr], Expr]) -> Expr:
        """f of the value where there is one, else false."""
        return Expr("and", Expr("ne", self, wrap(None)), f(self))

    def cast(self, kind: str) -> Expr:
        return Expr("cast", self, kind)

    # --- strings; patterns are case-insensitive for ASCII, and % and _ in the text sought are wildcards unless escaped ---

    def contains_text(self, s, escape: bool = False) -> Expr:
        return Expr("like", self, wrap(s), "%", "%", escape)

    def starts_with(self, s, escape: bool = False) -> Expr:
        return Expr("like", self, wrap(s), "", "%", escape)

    def compares_to(self, s) -> Expr:
        """Equality without regard to ASCII case."""
        return Expr("iequal", self, wrap(s))

    def is_empty_text(self) -> Expr:
        return Expr("eq", self, wrap(""))

    def concat(self, *others) -> Expr:
        return Expr("concat", self, *map(wrap, others))

    # --- arrays and dictionaries held in a column ---

    def at(self, index: int) -> Expr:
        """An element by index from 0, or from the end if negative; null out of range."""
        return Expr("index", self, index)

    def slice(self, start: int, end: int) -> Expr:
        """Elements with start <= index < end; none for negative bounds."""
        return Expr("slice", self, start, end)

    def has(self, value) -> Expr:
        return Expr("array_has", self, wrap(value))

    def any_value(self, f: Callable[[Expr], Expr]) -> Expr:
        return Expr("array_any", self, f)

    def max_value(self) -> Expr:
        return Expr("array_max", self)

    def min_value(self) -> Expr:
        return Expr("array_min", self)

    def length(self) -> Expr:
        return Expr("array_length", self)

    def key(self, name: str, kind: str = "string", default=None) -> Expr:
        """A dictionary's or JSON object's value by key, cast to kind."""
        return Expr("json_key", self, name, kind, default)

    # --- extensions: the predicates that the original interface declares but rejects ---

    def between(self, low, high) -> Expr:
        return Expr("between", self, wrap(low), wrap(high))

    def matches(self, pattern: str) -> Expr:
        return Expr("rlike", self, pattern)

    def all_values(self, f: Callable[[Expr], Expr]) -> Expr:
        return Expr("array_all", self, f)


class Lit(Expr):
    def __init__(self, value):
        super().__init__("lit", value)
        self.value = value


class Var(Expr):
    """A model variable; attributes are reached as Python attributes."""

    def __init__(self, entity: str, alias: str | None = None):
        super().__init__("var")
        self.__dict__["entity"] = entity
        self.__dict__["alias"] = alias or f"{entity.lower()}{next(_numbers)}"

    def __getattr__(self, name: str) -> Path:
        if name.startswith("__"):
            raise AttributeError(name)
        return Path(self, (name,))

    def is_type(self, entity: str) -> Expr:
        return Expr("is_type", self, entity)

    def as_type(self, entity: str) -> Path:
        """A path through the sub- or super-entity that the row also is; null where it isn't."""
        return Path(self, (f"as {entity}",))

    def sql(self, text: str) -> Expr:
        """Raw SQL over the entity's columns; replaces every other predicate."""
        return Expr("raw", text)


class Path(Expr):
    """Steps from a variable: to-one relationships, then an attribute, a field of a composite, or a to-many relationship."""

    def __init__(self, var: Var, steps: tuple[str, ...]):
        super().__init__("path")
        self.__dict__["var"] = var
        self.__dict__["steps"] = steps

    def __getattr__(self, name: str) -> Path:
        if name.startswith("__"):
            raise AttributeError(name)
        return Path(self.var, (*self.steps, name))

    def any(self, f: Callable[[Var], Expr] | None = None) -> Many:
        return Many(self, "any", f)

    def none(self, f: Callable[[Var], Expr] | None = None) -> Many:
        return Many(self, "none", f)

    def count(self) -> Many:
        return Many(self, "count", None)

    def is_empty(self) -> Many:
        return Many(self, "none", None)

    def filter(self, f: Callable[[Var], Expr]) -> Filtered:
        return Filtered(self, f)

    def first(self, attribute: str) -> Many:
        """The attribute of the related row with the lowest key."""
        return Many(self, "first", None, attribute)

    def last(self, attribute: str) -> Many:
        return Many(self, "last", None, attribute)

    def contains(self, key) -> Many:
        """Whether the row with this key is related."""
        return Many(self, "has_key", None, key)


class Filtered:
    def __init__(self, path: Path, f: Callable[[Var], Expr]):
        self.path, self.f = path, f

    def count(self) -> Many:
        return Many(self.path, "count", self.f)

    def is_empty(self) -> Many:
        return Many(self.path, "none", self.f)

    def first(self, attribute: str) -> Many:
        return Many(self.path, "first", self.f, attribute)

    def last(self, attribute: str) -> Many:
        return Many(self.path, "last", self.f, attribute)


class Many(Expr):
    """A fact about the related rows: any, none, count, first, last, has_key."""

    def __init__(self, path: Path, kind: str, f: Callable[[Var], Expr] | None, extra: Any = None):
        super().__init__("many")
        self.__dict__.update(path=path, kind=kind, f=f, extra=extra)


def wrap(value) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def when(test: Expr, then, otherwise) -> Expr:
    """Conditional; where the test is null the result is 0 (false for a Boolean)."""
    return Expr("cond", test, wrap(then), wrap(otherwise))


def evaluate(f: Callable[[Var], Expr], *variables: Var) -> Expr:
    """Another predicate applied to variables at hand; with several variables it holds for each."""
    out = f(variables[0])
    for v in variables[1:]:
        out = out & f(v)
    return out
