"""Names and texts of rows in delimited files."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SNAKE = re.compile(r"[a-z0-9_]+")


def snake_case(name: str) -> str:
    """`leftFoo` to `left_foo`, `mins10` to `mins_10`: an underscore wherever lower case begins or
    ends. Names that are in snake case already stay as they are."""
    if _SNAKE.fullmatch(name) and (name.islower() or not any(c.isalpha() for c in name)) and not re.search(r"[a-z]\d|\d[a-z]", name):
        return name
    out = name[:1]
    for before, c in zip(name, name[1:], strict=False):
        if before.lower().islower() != c.islower() and out[-1:] != "_" and c != "_":
            out += "_"
        out += c.lower()
    return out


def unique_names(names: list[str]) -> list[str]:
    """Names that occur more than once get 0, 1, ... appended, again where that clashes."""
    while len(set(names)) < len(names):
        count = Counter(names)
        seen: Counter[str] = Counter()
        out = []
        for n in names:
            out.append(f"{n}{seen[n]}" if count[n] > 1 else n)
            seen[n] += 1
        names = out
    return names


def flat_columns(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """(name, column) of all leaves of nested structs; names are dotted snake case paths."""
    out = []
    for f in schema.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, path)
        else:
            out.append((".".join(snake_case(p) for p in path), F.col(".".join(f"`{p}`" for p in path))))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns. A null struct gives null in all of its columns."""
    leaves = flat_columns(df.schema)
    names = unique_names([n for n, _ in leaves])
    return df.select(*(c.alias(n) for n, (_, c) in zip(names, leaves, strict=True)))


def parse_bool(text: Column) -> Column:
    """`true`, `True`, `TRUE` and their opposites; anything else is an error, null stays null."""
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(text.isin("true", "True", "TRUE"), True).when(text.isin("false", "False", "FALSE"), False).otherwise(bad)


def parse_char(text: Column) -> Column:
    """Exactly one character, else an error."""
    return F.when(text.isNull() | (F.length(text) == 1), text).otherwise(F.raise_error(F.concat(F.lit("not one character: "), text)).cast("string"))


def literal(text: Column, expected: str) -> Column:
    """A column that must hold one fixed text."""
    return F.when(text == expected, text).otherwise(F.raise_error(F.concat(F.lit(f"not {expected!r}: "), F.coalesce(text, F.lit("null")))).cast("string"))


def either(branches: dict[str, Column]) -> Column:
    """A coproduct: a struct in which exactly one branch is filled, with its tag."""
    filled = sum((c.isNotNull().cast("int") for c in branches.values()), F.lit(0))
    tag = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in branches.items()))
    made = F.struct(tag.alias("tag"), *(c.alias(n) for n, c in branches.items()))
    return F.when(filled == 1, made).otherwise(F.raise_error(F.lit("not exactly one branch is filled")).cast(T.NullType()))
