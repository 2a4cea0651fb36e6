"""Several values packed in one field: one value per row, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.segment import HARD, MAYBE_HARD, MAYBE_IDS, MAYBE_MANY, MAYBE_MORE, Segmenter
from lumenweave.functions.text import strip

#: Most entries a dictionary may have. It is sent to every worker, so its size is checked; 500,000 names take about 300 MB.
MOST_KNOWN = 500_000

_BUILT: dict[int, Segmenter] = {}


def dictionary(*tables: DataFrame, most: int = MOST_KNOWN) -> list[str]:
    """Known whole values: the first column of each table, checked to be at most ``most`` entries.

    Raises ValueError beyond that: then pass the names that hold a separator only, as no others need protection.
    """
    names: set[str] = set()
    for t in tables:
        rows = t.select(F.col(t.columns[0]).alias("name")).where("name is not null").distinct().limit(most + 1).toArrow()
        names.update(rows.column(0).to_pylist())
    if len(names) > most:
        raise ValueError(f"the dictionary has more than {most} entries")
    return sorted(names)


def _segmenter(known: list[str]) -> Segmenter:
    """One automaton for each dictionary and Python worker."""
    key = hash(tuple(known))
    if key not in _BUILT:
        if len(_BUILT) > 7:
            _BUILT.clear()
        _BUILT[key] = Segmenter(known)
    return _BUILT[key]


def values(cell: Column, known: list[str]) -> Column:
    """The values of a cell, in order and as written, as ARRAY<STRING>; empty for a cell without a value.

    Cells that can't hold two values don't leave the JVM, nor do those that only hard separators part, if no known value holds one; Python
    gets null in their place.
    """

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segment = _segmenter(known).segment
        for batch in batches:
            yield pd.Series([None if c is None else list(segment(c)) for c in batch], dtype=object)

    bare = strip(cell)
    nothing = bare.isNull() | F.lower(bare).isin("", "nan", "-1")
    maybe = bare.rlike(MAYBE_MANY + "|" + MAYBE_IDS)
    if any(c in HARD for name in known for c in name):
        return F.when(nothing, F.array().cast("array<string>")).when(maybe, cut(F.when(maybe & ~nothing, cell))).otherwise(F.array(bare))
    more = bare.rlike(MAYBE_MORE + "|" + MAYBE_IDS)
    pieces = F.filter(F.transform(F.split(bare, MAYBE_HARD), strip), lambda x: x != "")
    one = F.filter(F.array(F.get(pieces, F.lit(0))), lambda x: ~F.lower(x).isin("nan", "-1"))
    plain = F.when(bare.rlike(MAYBE_HARD), F.when(F.size(pieces) < 2, F.filter(one, lambda x: x.isNotNull())).otherwise(pieces)).otherwise(F.array(bare))
    return F.when(nothing, F.array().cast("array<string>")).when(more, cut(F.when(more & ~nothing, cell))).otherwise(plain)


def unpack(df: DataFrame, row_id: str, field: str, known: list[str], least: int = 1, source: str | None = None) -> DataFrame:
    """One row for each value of ``field``: src_table, row_id, field_name, pos (from 1), item_text.

    ``least`` is the number of values from which a cell counts (2: packed cells only). Null, blank, ``nan`` and a lone
    ``-1`` give no row; blank pieces neither. Very long cells are cut whole. Repeated rows keep their own rows, and other
    columns of ``df``, whatever their names, don't matter. No shuffle.
    """
    cell = F.col(f"`{field}`")
    rows = df.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), cell.alias("cell"))
    if least > 1:
        rows = rows.where(F.col("cell").rlike(MAYBE_MANY + "|" + MAYBE_IDS))
    cut = rows.select("row_id", values(F.col("cell"), known).alias("items")).where(F.size("items") >= least)
    return cut.select(
        F.lit(source).alias("src_table"),
        "row_id",
        F.lit(field).alias("field_name"),
        F.posexplode("items").alias("place", "item_text"),
    ).select("src_table", "row_id", "field_name", (F.col("place") + 1).cast("int").alias("pos"), "item_text")
