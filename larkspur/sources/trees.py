"""Folder trees, file contents and archives, read where the files are and never whole.

Tasks open files through Arrow's file systems: a local or mounted path, file://, s3://, gs://, abfs:// and, where libhdfs is
installed, hdfs://.  Other schemes are an error.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shipping import ship

#: Endings of folders that are library packages.
PACKAGES = (".photoslibrary", ".aplibrary", ".migratedphotolibrary", ".photolibrary", ".iphotolibrary")
TREE = "path string, size long, mtime_ns long"
#: Open folders at which the driver stops to list and tasks go on, files of a batch, and bytes read at a time.
SPLITS, BATCH, CHUNK = 256, 8192, 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _listed(fs: pafs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(names of folders, (name, size, mtime_ns) of files) right in a folder; a folder that is gone by now has none.

    Links to folders are not followed; links to files are files.
    """
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(folder) as found:
                entries = list(found)
            folders = [e.name for e in entries if e.is_dir(follow_symlinks=False)]
            stats = [(e.name, e.stat()) for e in entries if e.is_file()]
            return folders, [(n, s.st_size, s.st_mtime_ns) for n, s in stats]
        found = fs.get_file_info(pafs.FileSelector(folder))
    except FileNotFoundError:
        return [], []
    return [i.base_name for i in found if i.type == pafs.FileType.Directory], [(i.base_name, i.size, i.mtime_ns) for i in found if i.type == pafs.FileType.File]


class Part(InputPartition):
    """A folder to descend into, or files that the driver has seen on its way."""

    def __init__(self, folder: str | None, files: list[tuple[str, int, int]]):
        super().__init__(folder)
        self.folder, self.files = folder, files


class TreeReader(DataSourceReader):
    def __init__(self, root: str, packages: tuple[str, ...], splits: int):
        self.root, self.packages, self.splits = root, packages, splits

    def _below(self, fs: pafs.FileSystem, top: str, folder: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        """The folders to go on with and the files of one, both with paths below the root."""
        folders, files = _listed(fs, f"{top}/{folder}" if folder else top)
        path = lambda name: f"{folder}/{name}" if folder else name
        return [path(n) for n in folders if not n.startswith("_") and not n.lower().endswith(self.packages)], [(path(n), *rest) for n, *rest in files if not n.startswith(".")]

    def partitions(self) -> list[Part]:
        fs, top = file_system(self.root)
        if fs.get_file_info(top).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.root)
        level, seen, files = [""], [], []
        while level and len(level) < self.splits:
            below = [self._below(fs, top, f) for f in level]
            level = [f for folders, _ in below for f in folders]
            files += [f for _, own in below for f in own]
        seen = [Part(None, files[k : k + BATCH]) for k in range(0, len(files), BATCH)]
        return [*seen, *(Part(f, []) for f in level)] or [Part(None, [])]

    def _files(self, part: Part) -> Iterator[tuple[str, int, int]]:
        yield from part.files
        fs, top = file_system(self.root)
        open_ = [part.folder] if part.folder is not None else []
        while open_:
            folders, files = self._below(fs, top, open_.pop())
            open_ += folders
            yield from files

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self._files(part):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "size", "mtime_ns"])


class TreeSource(DataSource):
    """spark.read.format("tree").load(root): TREE of every file below a folder, without reading contents.

    Folders are pruned while they are listed: those whose name begins with `_` and library packages (option `packages`,
    endings parted by commas) are never entered.  Files whose name begins with a dot are left out, those with `_` are not.  The driver lists
    until `splits` folders are open; each of these is a partition, whose task lists what is below it.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        packages = self.options.get("packages", ",".join(PACKAGES))
        return TreeReader(self.options["path"], tuple(p for p in packages.split(",") if p), int(self.options.get("splits", SPLITS)))


def walk(spark: SparkSession, root: str, packages: tuple[str, ...] = PACKAGES) -> DataFrame:
    """(path below root, size, mtime_ns, modified) of every file of the catalogue's kind of tree: see TreeSource."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    found = spark.read.format("tree").option("packages", ",".join(packages)).load(root)
    return found.withColumn("modified", F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000).cast("long")))


def digests(stream) -> tuple[str, int]:
    """(sha1, crc32) of what a stream holds, CHUNK bytes at a time: the state goes on from chunk to chunk."""
    sha1, crc = hashlib.sha1(), 0
    while chunk := stream.read(CHUNK):
        sha1.update(chunk)
        crc = zlib.crc32(chunk, crc)
    return sha1.hexdigest(), crc


def _per_file(root: str | None, read: Callable) -> Callable:
    """Rows made by `read` of each file (its path in the first column), with the batch's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                fs, at = file_system(root if root is not None else path)
                yield read(batch.slice(i, 1), fs, f"{at}/{path}" if root is not None else at)

    return run


def _hashed(row: pa.RecordBatch, fs: pafs.FileSystem, at: str) -> pa.RecordBatch:
    try:
        with fs.open_input_stream(at, buffer_size=CHUNK) as stream:
            sha1, crc = digests(stream)
    except OSError:
        sha1 = crc = None
    return pa.RecordBatch.from_arrays([*row.columns, pa.array([sha1], pa.string()), pa.array([crc], pa.int64())], names=[*row.schema.names, "sha1", "crc"])


def hashed(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """(path, size, sha1, crc) of the files of a listing (all below the root), each read once in chunks by one task.

    Memory doesn't grow with files.  A file that can't be read has nulls.
    """
    rows = (walk(spark, root) if listing is None else listing).select("path", "size")
    return _dealt(rows).mapInArrow(_per_file(root, _hashed), "path string, size long, sha1 string, crc long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Files dealt out by their path, some to every core, however small the listing is."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def entries_of(file) -> list[tuple[str, int, int]]:
    """(name, size, crc) of the files of an archive that can seek: its end record and directory are read, ZIP64's too."""
    with zipfile.ZipFile(file) as z:
        return [(i.filename, i.file_size, i.CRC) for i in z.infolist() if not i.is_dir()]


def _directory(row: pa.RecordBatch, fs: pafs.FileSystem, at: str) -> pa.RecordBatch:
    try:
        with fs.open_input_file(at) as file:
            found = entries_of(file)
    except (OSError, ValueError, zipfile.BadZipFile):  # Arrow's files raise ValueError for a place before their start
        found = [(None, None, None)]
    name, size, crc = zip(*found, strict=True) if found else ((), (), ())
    zips = pa.array([row.column(0)[0].as_py()] * len(found), pa.string())
    return pa.RecordBatch.from_arrays([zips, pa.array(name, pa.string()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["zip", "name", "size", "crc"])


ZIP_SCHEMA = "zip string, name string, size long, crc long"


def zip_directories(spark: SparkSession, paths: DataFrame | list[str], root: str | None = None) -> DataFrame:
    """(zip, name, size, crc) of the entries of archives (path, below `root` if that is given); one row without name for a bad one.

    Of an archive only its directory is read, by positioned reads, so its contents may be of any size.
    """
    ship(spark)
    rows = spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths.select("path")
    return _dealt(rows).mapInArrow(_per_file(root, _directory), ZIP_SCHEMA)
