"""Located files laid out along a space-filling curve, so that a box on the map reads the files of its cells only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of either coordinate in the curve, and in the cells that are folders (16 by 16 of them).
FINE, COARSE = 16, 4


def _scaled(c: Column, half: float, bits: int) -> Column:
    """A coordinate as a whole number of `bits` bits; what lies outside of the world goes to its edge."""
    most = (1 << bits) - 1
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor((c + half) / (2 * half) * (1 << bits)))).cast("long")


def _spread(x: Column) -> Column:
    """A number of 16 bits with a zero before each bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve(lat: Column, lon: Column) -> Column:
    """Place along a curve that halves the world in turns by latitude and longitude."""
    return F.shiftleft(_spread(_scaled(lat, 90.0, FINE)), 1).bitwiseOR(_spread(_scaled(lon, 180.0, FINE)))


def cell(lat: Column, lon: Column) -> Column:
    """The folder of a place: the curve's first bits."""
    return F.shiftright(curve(lat, lon), 2 * (FINE - COARSE)).cast("int")


def write_located(rows: DataFrame, path: str, parts: int) -> None:
    """The rows that have a place, in `parts` ranges along the curve, each sorted by it, in folders by cell.

    Ranges are cut by how many rows there are, so a crowded cell is several files.
    """
    at = rows.filter("lat is not null and lon is not null").withColumns({"curve": curve(F.col("lat"), F.col("lon")), "cell": cell(F.col("lat"), F.col("lon"))})
    at.repartitionByRange(parts, "curve", "id").sortWithinPartitions("cell", "curve").drop("curve").write.partitionBy("cell").parquet(path)


def cells_of(box: tuple[float, float, float, float]) -> list[int]:
    """The cells that a box (south, west, north, east) touches, 256 at most."""
    side = 1 << COARSE
    low = lambda x, half: min(side - 1, max(0, math.floor((x + half) / (2 * half) * side)))
    rows = range(low(box[0], 90.0), low(box[2], 90.0) + 1)
    columns = range(low(box[1], 180.0), low(box[3], 180.0) + 1)
    bits = lambda x: sum((x >> k & 1) << 2 * k for k in range(COARSE))
    return sorted(bits(r) << 1 | bits(c) for r in rows for c in columns)


def within(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The rows of a table of `write_located` in a box, borders included: folders by cell, row groups by their bounds."""
    south, west, north, east = box
    return rows.filter(F.col("cell").isin(cells_of(box)) & F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("cell")
