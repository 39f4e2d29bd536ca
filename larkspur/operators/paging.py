"""Pages of ordered lists by cursors: a page begins after the last row of the one before, so no row is sorted to be skipped."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A column to sort by, downwards or not, its nulls at the end or not (null counts as the smallest, as it does in Spark)."""

    column: str
    down: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.down else F.col(self.column).asc_nulls_first()

    def after(self, value: Column | None) -> Column:
        """Whether a row comes after one that has this value, by this key alone."""
        c = F.col(self.column)
        if value is None:
            return F.lit(False) if self.down else c.isNotNull()
        return (c < value) | c.isNull() if self.down else c > value

    def since(self, value: Column | None) -> Column:
        """Whether a row comes after or has the same value; one comparison of a column, which readers of files can prune by."""
        c = F.col(self.column)
        if value is None:
            return c.isNull() if self.down else F.lit(True)
        return (c <= value) | c.isNull() if self.down else c >= value

    def same(self, value: Column | None) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == value


def keys(*names: str) -> list[Key]:
    """Keys by name, with a minus before those downwards.  The last must tell all rows apart."""
    return [Key(n.removeprefix("-"), n.startswith("-")) for n in names]


def ordered(by: list[Key]) -> list[Column]:
    return [k.order() for k in by]


def cursor(row: Row, by: list[Key]) -> str:
    """What a client sends back to get what follows a row."""
    return json.dumps([None if row[k.column] is None else str(row[k.column]) for k in by])


def after(rows: DataFrame, by: list[Key], at: str) -> DataFrame:
    """The rows that come after the one of a cursor.  A text that is no cursor of these keys is an error (ValueError)."""
    told = json.loads(at)
    if not isinstance(told, list) or len(told) != len(by) or not all(v is None or isinstance(v, str) for v in told):
        raise ValueError("not a cursor of this list")
    values = [None if v is None else F.lit(v).cast(rows.schema[k.column].dataType) for k, v in zip(by, told, strict=True)]
    later, same = F.lit(False), F.lit(True)
    for k, v in zip(by, values, strict=True):
        later |= same & k.after(v)
        same &= k.same(v)
    return rows.filter(by[0].since(values[0])).filter(later)


def next_page(rows: DataFrame, by: list[Key], size: int, at: str = "") -> DataFrame:
    """The first `size` rows of a list, or those after a cursor: the top of what is left, whichever page that is.

    The cursor's first key is a filter on a plain column.  Where files are laid out by it, those of the pages before aren't read.
    """
    return (after(rows, by, at) if at else rows).orderBy(*ordered(by)).limit(size)
