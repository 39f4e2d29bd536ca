"""Near-duplicates: banded Hamming join, closest-first grouping, and the review of groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.sources.staging import staged, unstage

from . import paging
from .browse import placed
from .graph import components


#: Buckets of more than CROWDED different hashes are split into chunks of about CROWDED / 2; keys of one hash into parts of about PART.
CROWDED, PART = 4096, 256
#: Links of a component that one task merges; of larger ones, clusters that a task takes in a round.
LARGE, BLOCK = 50_000, 2000


def dealt(hashes: DataFrame, threshold: int = 5) -> DataFrame:
    """(key, hash, band, value): every hash in each of its bands."""
    return hashes.select("key", "hash", F.explode(X.bands(F.col("hash"), threshold)).alias("b")).select("key", "hash", "b.band", "b.value")


def crowded(hashes: DataFrame, threshold: int = 5, most: int = 2500) -> DataFrame:
    """(band, value, n) of the buckets that hold more than `most` hashes: a report."""
    return dealt(hashes, threshold).groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def masks(count: int, threshold: int) -> list[int]:
    """Signed masks such that two hashes within the threshold agree under one at least, and few of `count` do by chance."""
    X.band_edges(threshold)
    for blocks in range(threshold + 1, 17):
        kept = blocks - threshold
        if count * comb(blocks, kept) / 2 ** (64 * kept / blocks) <= 1024:
            break
    edges_ = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges_, edges_[1:], strict=False)]
    whole = [sum(block[i] for i in pick) for pick in combinations(range(blocks), kept)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def close_hashes(unique: DataFrame, threshold: int) -> DataFrame:
    """(x, y, d, px, py): pairs of different hashes within the threshold, each once, of `unique` (hash, parts), a staged table.

    Pairs are compared within buckets of equal bits under a mask and counted under the first mask they agree in.  Crowded
    buckets are split into chunks, and every pair of chunks is a bucket of its own; the result is the same.  Rows under all masks
    look as small as `unique` to the planner, so the join is told not to broadcast them.
    """
    spread = masks(unique.count(), threshold)
    rows = unique.select("hash", "parts", F.posexplode(F.array(*[F.col("hash").bitwiseAND(F.lit(m)) for m in spread])).alias("pick", "bits"))
    chunks = F.ceil(F.col("n") * 2 / CROWDED).cast("int").alias("chunks")
    hot = staged(rows.groupBy("pick", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("pick", "bits", chunks), "crowded")
    if not hot.isEmpty():
        rows = rows.join(hot, ["pick", "bits"], "left")
    else:
        rows = rows.withColumn("chunks", F.lit(None).cast("int"))
    last = F.coalesce(F.col("chunks") - 1, F.lit(0))
    rows = rows.withColumn("own", F.coalesce(F.pmod(F.xxhash64("hash"), F.col("chunks")).cast("int"), F.lit(0))).withColumn("last", last)
    left = rows.select("pick", "bits", F.col("own").alias("lo"), F.explode(F.sequence("own", "last")).alias("hi"), F.col("hash").alias("x"), F.col("parts").alias("px"))
    right = rows.select("pick", "bits", F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"), F.col("hash").alias("y"), F.col("parts").alias("py"))
    d = X.hamming(F.col("x"), F.col("y"))
    first = F.array_position(F.array(*[F.col("x").bitwiseAND(F.lit(m)) == F.col("y").bitwiseAND(F.lit(m)) for m in spread]), F.lit(True)) - 1
    found = left.join(right.hint("merge"), ["pick", "bits", "lo", "hi"]).filter(((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y"))) & (d <= threshold))
    return found.filter(first == F.col("pick")).select("x", "y", d.alias("d"), "px", "py")


def classes(hashes: DataFrame) -> DataFrame:
    """(key, rep, hash): keys of one hash are a class, named after its smallest key; keys without hash have none."""
    rows = hashes.select("key", "hash").dropna()
    return rows.join(rows.groupBy("hash").agg(F.min("key").alias("rep")), "hash").select("key", "rep", "hash")


def links(hashes: DataFrame, threshold: int = 5) -> DataFrame:
    """(a, b, d), a < b: pairs of classes of different hashes within `threshold` bits, by their smallest keys.

    With `classes` this is all of the links: two keys are within the threshold if they are of one class or their classes are linked.
    A group of copies, however large, is one class here.
    """
    one = staged(hashes.select("key", "hash").dropna().groupBy("hash").agg(F.min("key").alias("rep"), F.lit(1).alias("parts")), "one")
    found = close_hashes(one.select("hash", "parts"), threshold).select("x", "y", "d")
    x, y = one.select(F.col("hash").alias("x"), F.col("rep").alias("rx")), one.select(F.col("hash").alias("y"), F.col("rep").alias("ry"))
    return found.join(x.hint("merge"), "x").join(y.hint("merge"), "y").select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), "d")


def partners(asked: DataFrame, linked: DataFrame, members: DataFrame) -> DataFrame:
    """(key, other, d): what each key asked for is linked to, from `links` and `classes`; only classes asked for are expanded."""
    own = asked.select("key").join(members.select("key", "rep"), "key")
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    near = own.join(both.withColumnRenamed("a", "rep"), "rep").select("key", F.col("b").alias("rep"), "d")
    near = near.unionByName(own.select("key", "rep", F.lit(0).alias("d")))
    return near.join(members.select(F.col("key").alias("other"), "rep"), "rep").filter("key != other").select("key", "other", "d")


def edges(hashes: DataFrame, threshold: int = 5) -> DataFrame:
    """(a, b, d), a < b: all pairs of keys within `threshold` bits, copies expanded; see `links` for a result that isn't.

    Equal hashes are collapsed before pairs are looked for, and the keys of one hash are dealt out in parts when pairs of hashes
    become pairs of keys.
    """
    rows = hashes.select("key", "hash").dropna()
    unique = staged(rows.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), (F.min("key") < F.max("key")).alias("again")), "unique")
    same = unique.filter("again").select(F.col("hash").alias("x"), F.col("hash").alias("y"), F.lit(0).alias("d"), F.col("parts").alias("px"), F.col("parts").alias("py"))
    pairs = close_hashes(unique.select("hash", "parts"), threshold).unionByName(same)
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("px") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("py") - 1)))
    keys = rows.join(unique.select("hash", "parts").hint("merge"), "hash").select("hash", "key", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    keys = staged(keys, "keys")
    left = keys.select(F.col("hash").alias("x"), F.col("part").alias("i"), F.col("key").alias("ka"))
    right = keys.select(F.col("hash").alias("y"), F.col("part").alias("j"), F.col("key").alias("kb"))
    out = pairs.select("x", "i", "y", "j", "d").join(left.hint("merge"), ["x", "i"]).join(right.hint("merge"), ["y", "j"])  # pairs look smaller than they are
    out = out.filter((F.col("ka") < F.col("kb")) | ((F.col("x") != F.col("y")) & (F.col("ka") != F.col("kb"))))
    return out.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "d").distinct()


def _apart(x: np.ndarray, y: np.ndarray, limit: int) -> bool:
    """Whether any hash of one cluster is beyond the limit from one of the other."""
    step = max(1, (1 << 20) // len(y))
    return any((np.bitwise_count(x[k : k + step, None] ^ y) > limit).any() for k in range(0, len(x), step))


def _clusters(links: list[tuple], limit: int) -> list[list]:
    """Clusters of two keys or more, from links (a, b, ha, hb), the closest first: two join only if all their cross pairs are within the limit."""
    value = {k: h for a, b, ha, hb in links for k, h in ((a, ha), (b, hb))}
    own, keys = {k: k for k in value}, {k: [k] for k in value}
    inside = {k: np.array([v], np.int64).view(np.uint64) for k, v in value.items()}
    far = set()  # of clusters that can't join, as they only grow
    for a, b, _, _ in links:
        x, y = own[a], own[b]
        if x == y or (x, y) in far:
            continue
        if _apart(inside[x], inside[y], limit):
            far |= {(x, y), (y, x)}
            continue
        if len(keys[x]) < len(keys[y]):
            x, y = y, x
        inside[x] = np.concatenate([inside[x], inside.pop(y)])
        keys[x] += keys[y]
        own.update(dict.fromkeys(keys.pop(y), x))
    return [m for m in keys.values() if len(m) > 1]


def _merge(limit: int):
    """(group_id, key) of links (root, a, b, ha, hb) that stand together by component, in order."""

    def grouped(rows: pa.RecordBatch) -> pa.RecordBatch:
        root = np.asarray(rows.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
        links = list(zip(*(c.to_pylist() for c in rows.columns[1:]), strict=True))
        found = [(min(m), k) for i, j in zip(cuts, cuts[1:], strict=False) for m in _clusters(links[i:j], limit) for k in m]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], rows.schema.field(1).type) for c in range(2)], names=["group_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last component, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            root = np.asarray(rows.column(0))
            cut = len(root) - int(np.argmax(root[::-1] != root[-1])) if root[0] != root[-1] else 0
            if cut:
                yield grouped(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield grouped(held)

    return run


def _block(limit: int):
    """Closest-first merging of the clusters of a block, as far as what is outside of it can't matter.

    Rows (kind, p, q, d, a, b) are hashes q of clusters p (kind 0), links between two clusters of the block (1), and the first link
    of a cluster to any outside (2).  Links are taken in order.  One to the outside stops its cluster, and one to a stopped
    cluster stops the other: what happens to them hangs on other blocks.  Gives (0, p, into) for merged clusters and (1, p, q) for links
    of clusters that can't merge.
    """

    def run(rows: pa.Table) -> pa.Table:
        kind, p, q, d, a, b = (np.asarray(rows[c]) for c in ("kind", "p", "q", "d", "a", "b"))
        held = np.flatnonzero(kind == 0)
        held = held[np.argsort(p[held], kind="stable")]
        names, first = np.unique(p[held], return_index=True)
        inside = dict(zip(names.tolist(), np.split(q[held].view(np.uint64), first[1:]), strict=True))
        own = {c: c for c in inside}
        parts = {c: [c] for c in inside}
        stopped: set[int] = set()
        far: list[tuple[int, int]] = []
        events = np.flatnonzero(kind > 0)
        events = events[np.lexsort((b[events], a[events], d[events]))]
        for what, u, v in zip(kind[events].tolist(), p[events].tolist(), q[events].tolist(), strict=True):
            x = own[u]
            if what == 2:
                stopped.add(x)
                continue
            y = own[v]
            if x == y:
                continue
            if x in stopped or y in stopped:
                stopped |= {x, y}
            elif _apart(inside[x], inside[y], limit):
                far.append((u, v))
            else:
                if len(parts[x]) < len(parts[y]):
                    x, y = y, x
                inside[x] = np.concatenate([inside[x], inside.pop(y)])
                parts[x] += parts[y]
                own.update(dict.fromkeys(parts.pop(y), x))
        moved = [(c, x) for c, x in own.items() if c != x]
        both = np.array([*moved, *far], np.int64).reshape(-1, 2)
        return pa.table({"kind": np.repeat(np.array([0, 1], np.int32), [len(moved), len(far)]), "p": both[:, 0], "q": both[:, 1]})

    return run


def _rounds(wide: DataFrame, limit: int) -> DataFrame:
    """What `_merge` gives, (group_id, key), in rounds over blocks of clusters; `wide` is (a, b, ha, hb, d).

    Every cluster points to the one that its closest link leads to.  Clusters joined by such pointers, BLOCK of them at most and the
    closest ones first, are a block, which one task merges closest-first until a link to the outside comes up.  The closest link of all
    and every mutually closest pair lie within a block and come first there, so each round settles these at least.  Links
    of clusters that can't merge go; they never could later, as clusters only grow.  Every round is staged, and a component
    is spread over as many tasks as it has blocks.  The last LARGE links are settled at once, a task for what they connect.
    """
    ends = wide.select(F.col("a").alias("key"), F.col("ha").alias("hash")).unionByName(wide.select(F.col("b").alias("key"), F.col("hb").alias("hash"))).distinct()
    names = staged(placed(ends, [F.asc("key")], "n"), "names")  # numbers in the order of keys
    number = lambda c: names.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"))
    pairs = wide.select("a", "b", "d").join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("x"), F.col("nb").alias("y"), F.struct("d", F.col("na").alias("a"), F.col("nb").alias("b")).alias("e"))
    pairs, inside = staged(pairs, "pairs"), staged(names.select("n", "hash", F.col("n").alias("c")), "clusters")
    while left_ := pairs.count():
        last = left_ <= LARGE
        ways = pairs.select(F.col("x").alias("c"), F.col("y").alias("o"), "e").unionByName(pairs.select(F.col("y").alias("c"), F.col("x").alias("o"), "e"))
        best = staged(ways.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", "m.e", "m.o"), "best")
        roots = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")) if last else best.select(F.col("c").alias("a"), F.col("o").alias("b")))
        ranked = best.join(roots.withColumnRenamed("key", "c"), "c").withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("e", "c")))
        blocks = staged(ranked.filter(F.col("place") <= (2 * LARGE if last else BLOCK)).select("c", F.col("root").alias("block")), "blocks")
        of = lambda c, name: blocks.select(F.col("c").alias(c), F.col("block").alias(name))
        wide_ways = ways.join(of("c", "block"), "c").join(of("o", "other"), "o", "left")
        within = wide_ways.filter((F.col("block") == F.col("other")) & (F.col("c") < F.col("o"))).select("block", F.lit(1).alias("kind"), F.col("c").alias("p"), F.col("o").alias("q"), "e")
        beyond = wide_ways.filter(~F.col("block").eqNullSafe(F.col("other"))).groupBy("block", "c").agg(F.min("e").alias("e")).select("block", F.lit(2).alias("kind"), F.col("c").alias("p"), F.lit(0).cast("long").alias("q"), "e")
        rows = within.unionByName(beyond).select("block", "kind", "p", "q", F.col("e.d").cast("long").alias("d"), "e.a", "e.b")
        zero = F.lit(0).cast("long")
        rows = inside.join(blocks, "c").select("block", F.lit(0).alias("kind"), F.col("c").alias("p"), F.col("hash").alias("q"), zero.alias("d"), zero.alias("a"), zero.alias("b")).unionByName(rows)
        done = staged(rows.groupBy("block").applyInArrow(_block(limit), "kind int, p long, q long"), "done")
        into = done.filter("kind = 0")
        to = lambda c: into.select(F.col("p").alias(c), F.col("q").alias(f"to_{c}"))
        far = done.filter("kind = 1").select(F.col("p").alias("x"), F.col("q").alias("y"))
        left = pairs.join(far, ["x", "y"], "left_anti").join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("to_x", "x").alias("u"), F.coalesce("to_y", "y").alias("v"), "e").filter("u != v")
        after = staged(left.groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.min("e").alias("e")), "pairs")
        grown = staged(inside.join(to("c"), "c", "left").select("n", "hash", F.coalesce("to_c", "c").alias("c")), "clusters")
        unstage(pairs, inside, best, roots, blocks, done)
        pairs, inside = after, grown
    many = inside.groupBy("c").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    named = inside.join(many, "c").select("n", "first").join(names.select("n", "key"), "n").select("key", F.col("first").alias("n"))
    return named.join(names.select("n", F.col("key").alias("group_id")), "n").select("group_id", "key")


def groups(hashes: DataFrame, threshold: int = 5, slack: int = 3) -> DataFrame:
    """(group_id, key): groups of near-duplicates, named after their smallest key.

    Keys of one hash always merge first, so the smallest stands for all of them until the groups are known.  Merges never
    leave a connected component of the links.  Components of LARGE links at most are each one task's work; larger ones are
    merged in rounds over blocks of them, with the same result.
    """
    hashes = hashes.select("key", "hash").dropna().distinct()
    one = staged(hashes.groupBy("hash").agg(F.min("key").alias("key"), (F.min("key") < F.max("key")).alias("again")), "one")
    found = staged(links(one.select("key", "hash"), threshold), "edges")
    code = F.xxhash64
    roots = components(found.select(code("a").alias("a"), code("b").alias("b")))
    of = lambda c: one.select(F.col("key").alias(c), F.col("hash").alias(f"h{c}")).hint("merge")
    wide = found.join(of("a"), "a").join(of("b"), "b")
    wide = staged(wide.withColumn("c", code("a")).join(roots.withColumnRenamed("key", "c").hint("merge"), "c").select("root", "a", "b", "ha", "hb", "d"), "wide")
    kind = one.schema["key"].dataType.simpleString()
    large = staged(wide.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("root"), "large")
    alone = large.isEmpty()
    small = wide if alone else wide.join(large, "root", "left_anti")
    # So many parts that small components of a small table aren't put together into one task.
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = small.repartition(parts, "root").sortWithinPartitions("root", "d", "a", "b").select("root", "a", "b", "ha", "hb")
    merged = small.mapInArrow(_merge(threshold + slack), f"group_id {kind}, key {kind}")
    if not alone:
        merged = merged.unionByName(_rounds(wide.join(large, "root", "left_semi").drop("root"), threshold + slack))
    named = one.join(merged.hint("merge"), "key", "left").filter(F.col("group_id").isNotNull() | F.col("again")).select("hash", F.coalesce("group_id", "key").alias("group_id"))
    return hashes.join(named.hint("merge"), "hash").select("group_id", "key")


def without_copies(grouped: DataFrame, files: DataFrame) -> DataFrame:
    """Groups (group_id, path) but those whose members all have one and the same content hash."""
    told = grouped.join(files.select("path", "sha1"), "path").groupBy("group_id").agg(F.countDistinct("sha1").alias("k"), F.count_if(F.col("sha1").isNull()).alias("unknown"))
    return grouped.join(told.filter("k > 1 or unknown > 0").select("group_id"), "group_id", "left_semi")


def flagged(grouped: DataFrame, files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(group_id, path, is_best, is_sharpest): best has most pixels, then bytes; sharpest most edges (0 counts as none), then pixels."""
    rows = grouped.join(files.select("path", "size", "width", "height"), "path").join(hashes.select("path", "sharp"), "path", "left")
    px = X.pixels(F.col("width"), F.col("height"))
    sharp = F.when(F.coalesce("sharp", F.lit(0.0)) == 0, -1.0).otherwise(F.col("sharp"))
    # Of equals the smallest path: max over negated order is not to be had for text, so by min over negated numbers.
    pick = lambda *keys: F.min_by("path", F.struct(*[(-k).alias(f"k{i}") for i, k in enumerate(keys)], "path"))
    chosen = rows.groupBy("group_id").agg(pick(px, F.coalesce("size", F.lit(0))).alias("best"), pick(sharp, px).alias("sharpest"))
    return grouped.join(chosen, "group_id").select("group_id", "path", (F.col("path") == F.col("best")).cast("int").alias("is_best"), (F.col("path") == F.col("sharpest")).cast("int").alias("is_sharpest"))


def spans(grouped: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, span_s): seconds between the first and last camera time; null for fewer than two."""
    t = F.when(F.col("date_source") == "exif", X.seconds_of(F.col("taken_at")))
    rows = grouped.join(files.select("path", t.alias("t")), "path")
    return rows.groupBy("group_id").agg(F.when(F.count("t") >= 2, F.max("t") - F.min("t")).alias("span_s"))


def neighbours(asked: DataFrame, grouped: DataFrame) -> DataFrame:
    """(path, other): of each path asked for the other members of its group."""
    own = asked.select("path").join(grouped.select("group_id", "path"), "path")
    return own.join(grouped.select("group_id", F.col("path").alias("other")), "group_id").filter("path != other").select("path", "other")


def group_totals(grouped: DataFrame, files: DataFrame) -> DataFrame:
    rows = grouped.join(files.select("path", "size"), "path")
    return rows.agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("photos"), F.coalesce(F.sum(F.when(F.col("is_best") == 0, F.col("size"))), F.lit(0)).alias("spare"))


def group_list(grouped: DataFrame, files: DataFrame, info: DataFrame, marks: DataFrame, kind: str = "", view: str | None = None, which: str = "", today: str = "", theirs: str = "") -> DataFrame:
    """(group_id, n, spare, n_sources, sources, span_s, oldest, newest): the groups that a list shows.

    kind: cross (several sources), burst (one source, 10 s at most), spread (longer) or unknown (no times).  view: pending
    (a member without mark), decided (none), None for all.  which: new (a member scanned on `today`), hers (one below
    `theirs`) or mine (none there).
    """
    rows = grouped.join(files.select("path", "size", "taken_at", "scanned_at"), "path").join(info.select("group_id", "span_s"), "group_id", "left").join(marks.select("path", "mark"), "path", "left")
    source = X.one_level_source(F.col("path"))
    theirs_ = X.has_prefix(F.col("path"), theirs + "/")
    out = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("size") - F.coalesce(F.sum(F.when(F.col("is_best") == 1, F.col("size"))), F.lit(0))).alias("spare"),
        F.countDistinct(source).alias("n_sources"),
        F.sort_array(F.collect_set(source)).alias("sources"),
        F.max("span_s").alias("span_s"),
        F.min("taken_at").alias("oldest"),
        F.max("taken_at").alias("newest"),
        F.count_if(F.col("mark").isNull()).alias("open"),
        F.count_if(F.substring("scanned_at", 1, 10) == today).alias("new"),
        F.count_if(theirs_).alias("theirs"),
    )
    wanted = {"cross": F.col("n_sources") > 1, "burst": (F.col("span_s") <= 10) & (F.col("n_sources") == 1), "spread": F.col("span_s") > 10, "unknown": F.col("span_s").isNull()}.get(kind)
    seen = {"pending": F.col("open") > 0, "decided": F.col("open") == 0}.get(view)
    whose = {"new": F.col("new") > 0, "hers": F.col("theirs") > 0, "mine": F.col("theirs") == 0}.get(which)
    for condition in (wanted, seen, whose):
        out = out if condition is None else out.filter(condition)
    return out.select("group_id", "n", "spare", "n_sources", F.when(F.col("n_sources") > 1, F.col("sources")).alias("sources"), "span_s", "oldest", "newest")


def list_keys(order: str) -> list[paging.Key]:
    """Keys of an order of the list; `oldest` has groups without date at the end, and so has `newest`."""
    dated = {"oldest": paging.keys("undated", "oldest", "group_id"), "newest": paging.keys("-newest", "group_id")}
    return {"group": paging.keys("group_id"), "count": paging.keys("-n", "-spare", "group_id"), **dated}.get(order, paging.keys("-spare", "group_id"))


def list_order(order: str) -> list[Column]:
    return [F.col("oldest").isNull() if k.column == "undated" else k.order() for k in list_keys(order)]


def next_groups(listed: DataFrame, order: str, size: int, at: str = "") -> DataFrame:
    """The next groups of a list after a cursor (see `paging`), with `undated` to make the next cursor of."""
    return paging.next_page(listed.withColumn("undated", F.col("oldest").isNull().cast("int")), list_keys(order), size, at)


def members(grouped: DataFrame, files: DataFrame, hashes: DataFrame, marks: DataFrame, vision: DataFrame) -> DataFrame:
    """Every member with its file, sharpness, mark and the facts of a successful vision check."""
    ok = vision.filter("status = 'ok'").select("path", "faces", "eyes_closed", "looking_away", "note")
    own = files.select("path", "id", "kind", "size", "width", "height", "taken_at", "pair_key", F.col("lat").isNotNull().alias("has_geo"))
    return grouped.join(own, "path").join(hashes.select("path", "sharp"), "path", "left").join(marks.select("path", "mark", "keeper"), "path", "left").join(ok, "path", "left")


def decisions(rows: DataFrame) -> DataFrame:
    """(group_id, suggested, chosen, decided, can_besttake) from `members`.

    Suggested: fewest closed eyes, most pixels, a place, a pair, sharpest (unknown counts as -1), largest, smallest path.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    px = X.pixels(F.col("width"), F.col("height"))
    order = F.struct(num("eyes_closed").alias("a"), (-px).alias("b"), (~F.col("has_geo")).alias("c"), (F.coalesce(F.col("pair_key"), F.lit("")) == "").alias("d"), (-F.coalesce("sharp", F.lit(-1.0))).alias("e"), (-num("size")).alias("f"), F.col("path").alias("g"))
    every = lambda m: F.count_if(F.col("mark") == m) == F.count(F.lit(1))
    keep = F.col("mark") == "keep"
    marked = F.count_if(F.col("mark").isNull()) == 0
    suggested = F.min_by("path", order)
    chosen = F.when(every("keep"), "all").when(every("trash"), "trash").when((F.count_if(keep) == 1) & marked, F.max(F.when(keep, F.col("path")))).otherwise(suggested)
    best = (F.count("faces") >= 2) & (F.count_if(num("eyes_closed") > 0) > 0)
    return rows.groupBy("group_id").agg(suggested.alias("suggested"), chosen.alias("chosen"), marked.alias("decided"), best.alias("can_besttake"))


def review_totals(grouped: DataFrame, files: DataFrame, marks: DataFrame) -> DataFrame:
    """(pend_n, pend_bytes, total, done, left, pct) of the review."""
    wait = marks.filter("mark in ('discard', 'trash') and used_batch is null").join(files.select("path", "size"), "path").agg(F.count(F.lit(1)).alias("pend_n"), F.coalesce(F.sum("size"), F.lit(0)).alias("pend_bytes"))
    per = grouped.join(marks.select("path", "mark"), "path", "left").groupBy("group_id").agg(F.count_if(F.col("mark").isNull()).alias("open"))
    done = per.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("open") == 0).alias("done"))
    joined = wait.withColumn("_k", F.lit(1)).join(done.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    return joined.select("*", (F.col("total") - F.col("done")).alias("left"), X.percent(F.col("done"), F.col("total")).alias("pct"))


def valid_submissions(submitted: DataFrame, grouped: DataFrame, files: DataFrame, marks: DataFrame) -> DataFrame:
    """(submission, ok): a submitted set of paths is a whole group of 2 to 80, all indexed and none used."""
    s = submitted.select("submission", "path").distinct()
    size = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("whole"))
    rows = s.join(grouped.select("path", "group_id"), "path", "left").join(size, "group_id", "left")
    rows = rows.join(files.select("path", F.lit(1).alias("indexed")), "path", "left").join(marks.filter("used_batch is not null").select("path", F.lit(1).alias("used")), "path", "left")
    n = F.count(F.lit(1))
    ok = n.between(2, 80) & (F.countDistinct("group_id") == 1) & (F.count("group_id") == n) & (F.max("whole") == n) & (F.count("indexed") == n) & (F.count("used") == 0)
    return rows.groupBy("submission").agg(F.coalesce(ok, F.lit(False)).alias("ok"))


def vision_order(grouped: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, spare, place): groups of two or more indexed photos, the most spare bytes (all but the largest) first."""
    rows = grouped.join(files.filter("kind = 'photo'").select("path", "size"), "path").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("size") - F.max("size")).alias("spare"))
    return placed(rows.filter("n >= 2").select("group_id", "spare"), [F.desc("spare"), F.asc("group_id")], "place")
