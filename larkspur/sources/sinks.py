"""Sinks: versioned snapshots of tables and whole catalogues with guarded commits, comparison of tables, and reports."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MissingTable

#: Folder of a table's or catalogue's numbered states.
STATES = "_states"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


class Conflict(RuntimeError):
    """Another writer has published since the state that this change was computed from."""


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the states of a folder, in order; none if it has none."""
    p, fs = _fs(spark, f"{folder}/{STATES}")
    return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit()) if fs.exists(p) else []


def _publish(spark: SparkSession, folder: str, number: int, state: dict) -> bool:
    """Make `state` (a small JSON object) the folder's state of that number; False if the number is taken.

    The text is written under a name of its own first and then gets the number's name in one step that fails if that exists:
    a hard link on a local file system, elsewhere a rename that doesn't overwrite.  So of several writers one succeeds,
    and no reader sees half a state.  (Stores whose rename isn't one step need a lock around their writers.)
    """
    folder = f"{folder}/{STATES}"
    text = json.dumps(state, sort_keys=True)
    p, fs = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _fs(spark, f"{folder}/{number:012d}")
    try:
        if fs.getScheme() == "file":
            os.link(p.toUri().getPath(), target.toUri().getPath())
        else:
            rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(p, target, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(p, False)


def _state(spark: SparkSession, folder: str, number: int) -> dict:
    p, fs = _fs(spark, f"{folder}/{STATES}/{number:012d}")
    source = fs.open(p)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def state_number(spark: SparkSession, folder: str) -> int:
    """Number of the newest state of a table or catalogue; 0 if nothing was published there."""
    return max(_numbers(spark, folder), default=0)


def _write_version(df: DataFrame, folder: str) -> str:
    """`df` as a folder of its own, which no state names yet."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    return version


def _publish_after(spark: SparkSession, folder: str, after: int | None, state: dict) -> int:
    """The number under which the state was published: the one after `after`, else the next that is free."""
    number = (state_number(spark, folder) if after is None else after) + 1
    while not _publish(spark, folder, number, state):
        if after is not None:
            raise Conflict(f"{folder}: state {number} is another writer's")
        number += 1
    return number


def write_snapshot(df: DataFrame, folder: str, after: int | None = None) -> int:
    """`df` as the newest state of the table in `folder`; its number.

    A table is never overwritten while a plan reads it: versions are folders of their own, named by numbered states.  A change
    that was computed from state `after` is published as the next one, or else it is a Conflict, as another writer was faster;
    nothing is lost then, as the other's state stands and the change can be computed anew (see `update_snapshot`).  Without `after` the
    table is replaced, whoever wrote before.
    """
    if after is not None and state_number(df.sparkSession, folder) != after:
        raise Conflict(f"{folder}: newer than state {after}")
    return _publish_after(df.sparkSession, folder, after, {"version": _write_version(df, folder)})


def has_snapshot(spark: SparkSession, folder: str) -> bool:
    return state_number(spark, folder) > 0


def read_snapshot(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The newest state of the table in `folder`, or that of a number; MissingTable if it has none."""
    number = state_number(spark, folder) if number is None else number
    if number not in _numbers(spark, folder):
        raise MissingTable(folder)
    return spark.read.parquet(f"{folder}/{_state(spark, folder, number)['version']}")


def update_snapshot(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Publish change(newest state); computed anew from the newer state where another writer was faster.

    `change` also carries its guard (rows that were used meanwhile are left alone), as it sees what the others wrote.
    After `tries` conflicts in a row the last one is raised.
    """
    for left in reversed(range(tries)):
        number = state_number(spark, folder)
        try:
            return write_snapshot(change(read_snapshot(spark, folder, number)), folder, after=number)
        except Conflict:
            if not left:
                raise
    raise ValueError("no tries")


class Catalogue:
    """Several tables under one folder whose states are published together.

    A state is a manifest with the version of every table.  `Catalogue(spark, root)` is pinned to the newest state when it is
    made, so all its tables are of one state however much is published while they are read; `Catalogue(spark, root, n)` is
    pinned to state n.  A root without states is a catalogue without tables, number 0.
    """

    def __init__(self, spark: SparkSession, root: str, number: int | None = None):
        self.spark, self.root = spark, root
        self.number = state_number(spark, root) if number is None else number
        if self.number and self.number not in _numbers(spark, root):
            raise MissingTable(f"{root}: state {self.number}")
        self.versions: dict[str, str] = _state(spark, root, self.number)["tables"] if self.number else {}

    def table(self, name: str) -> DataFrame:
        if name not in self.versions:
            raise MissingTable(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{self.versions[name]}")

    def register(self) -> None:
        """Every table as a view of its name."""
        for name in self.versions:
            self.table(name).createOrReplaceTempView(name)

    def publish(self, changed: dict[str, DataFrame]) -> Catalogue:
        """The catalogue with these tables in place of (or beside) its own; Conflict if it isn't the newest state any more."""
        if state_number(self.spark, self.root) != self.number:
            raise Conflict(f"{self.root}: newer than state {self.number}")
        versions = self.versions | {name: _write_version(df, f"{self.root}/{name}") for name, df in changed.items()}
        return Catalogue(self.spark, self.root, _publish_after(self.spark, self.root, self.number, {"tables": versions}))


def update_catalogue(spark: SparkSession, root: str, change: Callable[[Catalogue], dict[str, DataFrame]], tries: int = 10) -> Catalogue:
    """Publish change(newest catalogue), computed anew where another writer was faster; after `tries` conflicts the last is raised."""
    for left in reversed(range(tries)):
        now = Catalogue(spark, root)
        try:
            return now.publish(change(now))
        except Conflict:
            if not left:
                raise
    raise ValueError("no tries")


def differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("path", "size", "sha1")) -> DataFrame:
    """(side, keys...): rows of one table that the other lacks, repeats counted; empty if they agree."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).select(F.lit("only first").alias("side"), *keys).unionByName(y.exceptAll(x).select(F.lit("only second").alias("side"), *keys))


def bucket_digests(df: DataFrame, key: str, columns: tuple[str, ...], bits: int) -> DataFrame:
    """(bucket, n, h1, h2): rows of each of 2 ** bits buckets of a key, counted and summed up by two hashes of all columns.

    A small table that can be kept with a snapshot.  Equal tables have equal digests, in whatever order and files they are;
    sums tell repeated rows apart.
    """
    bucket = F.shiftrightunsigned(F.xxhash64(key), 64 - bits).alias("bucket")
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    mark = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), wide(F.xxhash64(*mark, *nulls)).alias("h1"), wide(F.xxhash64(F.lit(1), *mark, *nulls)).alias("h2"))


def folded(digests: DataFrame, by: int) -> DataFrame:
    """The digests one level up: of buckets with `by` bits less."""
    return digests.groupBy(F.shiftrightunsigned("bucket", by).alias("bucket")).agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket): those in which two tables of digests differ, or that only one has."""
    both = a.select("bucket", "n", "h1", "h2", F.lit(1).alias("side")).unionByName(b.select("bucket", "n", "h1", "h2", F.lit(-1).alias("side")))
    off = " or ".join(f"sum({c} * side) != 0" for c in ("n", "h1", "h2"))
    return both.groupBy("bucket").agg(F.expr(off).alias("off")).filter("off").select("bucket")


def differences_by_digest(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("path", "size", "sha1"), bits: int = 16, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As `differences`, by the first key's buckets: rows are compared only in buckets whose digests differ.

    The shuffles are of the digests and of the rows of unequal buckets, so they follow the difference, not the tables.
    digests: those of both tables, where they are kept; the top half of their bits is compared first.
    """
    x, y = digests or (bucket_digests(a, keys[0], keys, bits), bucket_digests(b, keys[0], keys, bits))
    if digests:
        top = F.broadcast(unequal(folded(x, bits // 2), folded(y, bits // 2)).withColumnRenamed("bucket", "top"))  # 2 ** (bits / 2) at most
        x, y = (d.join(top, F.shiftrightunsigned("bucket", bits // 2) == F.col("top"), "left_semi") for d in (x, y))
    off = F.broadcast(unequal(x, y))  # 2 ** bits numbers at most
    own = lambda t: t.select(*keys).join(off, F.shiftrightunsigned(F.xxhash64(keys[0]), 64 - bits) == F.col("bucket"), "left_semi")
    return differences(own(a), own(b), keys)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "path") -> DataFrame:
    """`df` as a table of the session's catalog with files in `path`, in buckets of a key and sorted by it within them.

    Joins on the key, or on it and more, take its side as it lies: no shuffle of the catalogue for a scan of a few files.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_report(df: DataFrame, path: str, kind: str = "tsv") -> None:
    """A report: `tsv`, `json` (one object a line) or `text` (one string column)."""
    if kind == "tsv":
        df.write.csv(path, sep="\t", quote="", escapeQuotes=False)
    elif kind == "json":
        df.write.json(path)
    elif kind == "text":
        df.write.text(path)
    else:
        raise ValueError(f"no such report: {kind}")


def to_response(df: DataFrame, most: int = 2500) -> list[dict]:
    """Rows for an answer to a client; more than `most` are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; page the result")
    return [r.asDict(recursive=True) for r in rows]
