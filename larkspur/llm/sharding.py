"""Sharding: minimax contiguous partition of ordered atomic groups.

Texts are ordered by a 64-bit hash; its leading bits cut that order into a fixed number of atoms, so equal texts share an
atom and the table of atoms (2 ** ATOM_BITS rows, whatever the corpus) is the only thing the driver gathers.  The smallest
feasible capacity is found by binary search with a greedy check, and the cuts are laid under that capacity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes

ATOM_BITS = 16
#: An atom with more than 1/CELLS of all rows (and more than CELL_ROWS) is numbered in several cells.
CELLS, CELL_ROWS = 4096, 64
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def feasible(prefix: np.ndarray, shards: int, capacity: int) -> bool:
    """Greedy check: do `shards` contiguous runs of at most `capacity` cover all groups?  prefix: sums, from 0."""
    at = 0
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at == len(prefix) - 1:
            return True
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which `shards` contiguous runs of the ordered groups suffice, by binary search."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max(initial=0)), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(prefix, shards, middle) else (middle + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each ordered group: cut under the smallest feasible capacity, near an even share of what is left.

    Any cut between the earliest that leaves a feasible rest and the greedy one keeps the capacity; the one nearest an
    even share is taken, so that one giant group doesn't empty the shards after it.
    """
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n, capacity, out = len(sizes), smallest_capacity(sizes, shards), np.zeros(len(sizes), np.int32)
    first = [n]  # first[r]: the earliest group from which r runs of that capacity reach the end
    for _ in range(shards - 1):
        first.append(int(np.searchsorted(prefix, prefix[first[-1]] - capacity, "left")))
    at = 0
    for shard in range(shards - 1):
        left = shards - shard
        wanted = prefix[at] + (prefix[-1] - prefix[at]) / left
        to = int(np.searchsorted(prefix, wanted))
        if to > at and wanted - prefix[to - 1] < prefix[min(to, n)] - wanted:
            to -= 1
        to = max(to, int(np.searchsorted(prefix, prefix[at], "right")))  # at least one group that isn't empty
        furthest = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        to = min(max(to, first[left - 1], at), furthest, n)
        out[at:to] = shard
        at = to
    out[at:] = shards - 1
    return out


def shard(docs: DataFrame, shards: int = 16, atom_bits: int = ATOM_BITS) -> DataFrame:
    """Every row with size, text_crc32, law, shard (0 to shards - 1), slot and grown_shard.

    The law is `bytes`: contiguous runs of the hash order whose largest run is as small as can be; equal texts stay
    together, so one group of copies can be larger than an even share.  size: UTF-8 bytes plus 1; null counts as empty
    in size, checksum (0) and group.  slot: from 0, gapless within the shard, by atom, a hash
    of doc_id, the text's hash and doc_id (nulls first), at any size; between repeated rows in any order.  grown_shard is null under this law.  Columns of `docs` with one of these names are
    replaced (and any named _h, _v, _atom, _parts, _cell or _base is left out); `text` itself is kept.  No rows: no rows; fewer groups than shards: some shards stay empty.
    """
    own = [c for c in docs.columns if c.lower() not in {*ADDED, "_h", "_v", "_atom", "_parts", "_cell", "_base"}]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], (text_bytes(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"), F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id")), 32).alias("_v"))
    rows = rows.withColumn("_atom", F.shiftrightunsigned(F.col("_h"), 64 - atom_bits))
    atoms = rows.groupBy("_atom").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).toArrow()
    at, n = np.asarray(atoms["_atom"], np.int64), np.zeros(1 << atom_bits, np.int64)
    size = n.copy()
    size[at], n[at] = np.asarray(atoms["b"]), np.asarray(atoms["n"])
    of = cuts(size, shards)
    # A hot atom is numbered in cells of about `most` rows each, so that no task sorts one group whole.
    most = max(CELL_ROWS, -(-int(n.sum()) // CELLS))
    parts = np.maximum(1, -(-n // most))
    spark = docs.sparkSession
    hot = np.flatnonzero(parts > 1)
    if len(hot):
        wide = spark.createDataFrame(pa.table({"_atom": hot, "_parts": parts[hot]}))  # CELLS rows at most
        rows = rows.join(F.broadcast(wide), "_atom", "left").withColumn("_cell", F.when(F.col("_parts").isNotNull(), F.floor(F.col("_v") * F.col("_parts") / F.lit(1 << 32))).otherwise(F.lit(0)))
        counted = rows.filter(F.col("_parts").isNotNull()).groupBy("_atom", "_cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # about 2 * CELLS rows at most
    else:
        rows, counted = rows.withColumn("_cell", F.lit(0).cast("long")), pa.table({"_atom": pa.array([], pa.int64()), "_cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    single = np.flatnonzero((n > 0) & (parts == 1))
    cell_atom = np.concatenate([single, np.asarray(counted["_atom"], np.int64)])
    cell = np.concatenate([np.zeros(len(single), np.int64), np.asarray(counted["_cell"], np.int64)])
    rows_in = np.concatenate([n[single], np.asarray(counted["n"], np.int64)])
    order = np.lexsort((cell, cell_atom))
    cell_atom, cell, rows_in = cell_atom[order], cell[order], rows_in[order]
    ends = np.cumsum(rows_in)
    shard_of = of[cell_atom]
    per_shard = np.concatenate([[0], np.cumsum(np.bincount(shard_of, rows_in, shards).astype(np.int64))])
    places = spark.createDataFrame(pa.table({"_atom": cell_atom, "_cell": cell, "shard": shard_of, "_base": ends - rows_in - per_shard[shard_of]}))
    within = Window.partitionBy("_atom", "_cell").orderBy("_v", "_h", F.col("doc_id").asc_nulls_first())
    # The table of places has 2 ** atom_bits + 2 * CELLS rows at most.
    out = rows.join(F.broadcast(places), ["_atom", "_cell"]).withColumn("slot", F.col("_base") + F.row_number().over(within) - 1)
    return out.select(*[F.col(f"`{c}`") for c in own], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
