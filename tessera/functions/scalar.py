"""Scalar functions with the store's semantics, as built-in column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def like(c: Column, sought: Column, before: str, after: str, escape: bool) -> Column:
    """Case-insensitive for ASCII. % and _ in `sought` stay wildcards unless escape is set; a backslash is an ordinary character."""
    body = F.replace(ascii_lower(sought), F.lit("\\"), F.lit("\\\\"))
    if escape:
        for mark in "%_":
            body = F.replace(body, F.lit(mark), F.lit("\\" + mark))
    return F.like(ascii_lower(c), F.concat(F.lit(before), body, F.lit(after)))


def iequal(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def float_div(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """Both sides are cut to whole numbers; the quotient is cut towards zero; null for a zero divisor."""
    x, y = a.cast("long"), b.cast("long")
    return F.when(y != 0, F.call_function("div", x, y))


def modulo(a: Column, b: Column) -> Column:
    """With the sign of the dividend; null for a zero divisor."""
    return F.try_mod(a.cast("long"), b.cast("long"))


def conditional(test: Column, then: Column, otherwise: Column, zero) -> Column:
    return F.when(test, then).when(~test, otherwise).otherwise(F.lit(zero))


def element(c: Column, index: int) -> Column:
    return F.try_element_at(c, F.lit(index + 1 if index >= 0 else index))


def cut(c: Column, start: int, end: int) -> Column:
    if start < 0 or end <= start:
        return F.slice(c, 1, 0)
    return F.slice(c, start + 1, end - start)


def json_key(c: Column, name: str, kind: str, default=None) -> Column:
    """A key of a JSON object text, quoted so that any name is safe; null if it is missing or not of the kind."""
    if set(name) & set("'\\\"]"):  # a path can't hold these
        value = F.try_element_at(F.from_json(c, "map<string,string>"), F.lit(name))
    else:
        value = F.get_json_object(c, f"$['{name}']")
    value = value.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def json_type(c: Column, name: str) -> Column:
    """The type of a key's value in a JSON object text, by its value in each row: null, true, false, integer, real, text, array or object; no value where the key or the object is missing. The name holds no quote."""
    value = F.try_variant_get(F.try_parse_json(c), f"$['{name}']", "variant")
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(kind == "VOID", "null").when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("string"))
        .when(kind == "BIGINT", "integer").when((kind == "DOUBLE") | kind.startswith("DECIMAL"), "real").when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def map_key(c: Column, name, kind: str, default=None) -> Column:
    value = F.try_element_at(c, F.lit(name)).cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def year_of_micros(c: Column) -> Column:
    """UTC year of microseconds since 1970."""
    return F.year(F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def before(now: Column, years: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    """A calendar span before a timestamp."""
    span = F.make_interval(*map(F.lit, (years, months, weeks, days, hours, minutes, seconds)))
    return now - span


def json_row(columns: list[str]) -> Column:
    """The row as JSON object text; null values are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_json_row(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)
