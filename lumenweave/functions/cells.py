"""Pipe cells and arrays of structs: the forms in which aligned values travel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(cell: Column, sep: str = r"\|") -> Column:
    """Trimmed non-empty tokens of a delimited cell; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def aligned(df: DataFrame, columns: Sequence[str], keep: Sequence[str], sep: str = r"\|") -> tuple[DataFrame, DataFrame]:
    """Explodes cells whose values belong together by place, and gives the rows whose lengths differ apart: (rows, misfits)."""
    cut = df.select(*keep, *[F.split(F.col(c), sep).alias(c) for c in columns])
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == F.size(columns[0]))
    same = F.coalesce(same, F.lit(False))
    out = cut.where(same).select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("pos", "x"))
    return out.select(*keep, (F.col("pos") + 1).alias("pos"), *[F.trim(F.col("x")[c]).alias(c) for c in columns]), cut.where(~same).select(*keep)


def union_cell(a: Column, b: Column) -> Column:
    """Sorted union of two pipe cells; empty members are dropped."""
    return F.array_join(F.array_sort(F.array_union(tokens(a), tokens(b))), "|")


def literal_list(cell: Column) -> Column:
    """A list written as a Python or JSON literal, as ARRAY<STRING>; any other text is its only element; ``nan`` gives null elements."""
    json = F.regexp_replace(F.regexp_replace(cell, r"\bnan\b|\bNone\b", "null"), r"(?<=[\[,]\s{0,3})'|'(?=\s*[,\]])", '"')
    return F.when(cell.startswith("["), F.coalesce(F.from_json(json, "array<string>"), F.array(cell))).when(cell.isNotNull(), F.array(cell))


def unique_join(values: Column, sep: str = ", ") -> Column:
    """Aggregate: distinct non-empty values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(values), F.lit("")))), sep)


def ordered_union(original: Column, added: Column, by: str) -> Column:
    """Original structs, then those added ones whose ``by`` is not there yet; each ``by`` once, in order."""
    return F.aggregate(
        F.concat(original, added),
        F.filter(original, lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda y: y[by] == x[by]), acc).otherwise(F.concat(acc, F.array(x))),
    )
