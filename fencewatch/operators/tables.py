"""Typed table sort and lookup column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fencewatch.functions.tables import (
    date_sort_key,
    lookup_link,
    numeric_sort_key,
    sort_kind,
    text_sort_key,
)
from fencewatch.operators.keyed import numbered_rows

_KEYS = {"date": date_sort_key, "numeric": numeric_sort_key, "text": text_sort_key}


def sort_key(column: str, kind: str) -> Column:
    return _KEYS[kind](F.col(column).cast("string"))


def typed_sort(
    df: DataFrame,
    column: str,
    kind: str,
    tie_breakers: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Number text rows by what the text means: ``date``, ``numeric`` or ``text``; adds ``row_no``.

    The rows are sorted once, to be numbered; a sink that wants them in order sorts by ``row_no``. The tie breakers should make the order total: the result is then repeatable, and many equal
    keys are still spread over range partitions.
    """
    key = sort_key(column, kind)
    keyed = df.withColumn("sort_key", key)
    direction = F.col("sort_key").desc() if descending else F.col("sort_key").asc()
    rest = [F.col(name).desc() if descending else F.col(name).asc() for name in tie_breakers]
    return numbered_rows(keyed, [], [direction, *rest], "row_no")


def kind_of_column(df: DataFrame, column: str, order: Sequence[str]) -> str:
    """Kind of a column, told from the second row in the given order.

    Reads two rows to the driver (a top-two, whatever the size of the table).
    """
    rows = df.select(column, *order).orderBy(*order).take(2)
    return sort_kind(str(rows[-1][0])) if rows else "text"


def with_lookup_link(df: DataFrame, name: str, prefix: str, column: str) -> DataFrame:
    """Append a link made of a fixed prefix and the value of another column."""
    return df.withColumn(name, lookup_link(F.col(column), prefix))


def with_lookup_link_from_right(
    df: DataFrame, name: str, prefix: str, offset_from_right: int
) -> DataFrame:
    """:func:`with_lookup_link` with the column given by its offset from the last one."""
    return with_lookup_link(df, name, prefix, df.columns[len(df.columns) - 1 - offset_from_right])
