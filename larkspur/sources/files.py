"""Sources of the catalogue: folder trees, zip listings, sidecars, library lists and reports."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

from .trees import ZIP_SCHEMA, entries_of, walk, zip_directories
from .trees import hashed as hashed  # for users of this module

#: Extensions of photos and videos.
PHOTO = [".jpg", ".jpeg", ".heic", ".heif", ".png", ".gif", ".tif", ".tiff", ".webp", ".cr2", ".cr3", ".dng", ".nef", ".arw", ".orf", ".rw2"]
VIDEO = [".mov", ".mp4", ".m4v", ".avi", ".mts", ".3gp", ".mp"]


class MissingTable(LookupError):
    """A table of the catalogue isn't there."""


def catalogue(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a catalogue folder by name; registers each as a view.  A missing one raises MissingTable."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{root}/{n}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise MissingTable(n) from e
        out[n].createOrReplaceTempView(n)
    return out


def media(listing: DataFrame, photo: list[str] = PHOTO, video: list[str] = VIDEO) -> DataFrame:
    """Photos and videos of a listing with ext, kind and has_sidecar.

    A sidecar is `<file>.xmp`, `<stem>.xmp`, `<stem>.aae` or `<stem>.AAE`, written so, in the same folder.
    """
    rows = listing.withColumn("ext", F.lower(X.extension(F.col("path")))).withColumn("kind", X.kind_of(F.col("ext"), photo, video)).filter("kind is not null")
    side = listing.filter(F.col("path").rlike(r"\.(xmp|aae|AAE)$"))
    beside = side.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("_beside")).distinct()
    whole = side.filter(F.endswith("path", F.lit(".xmp"))).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("_whole"))
    out = rows.join(beside, X.without_extension(F.col("path")) == F.col("_beside"), "left").join(whole, F.col("path") == F.col("_whole"), "left")
    return out.withColumn("has_sidecar", (F.col("_beside").isNotNull() | F.col("_whole").isNotNull()).cast("int")).drop("_beside", "_whole")


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files that the catalogue doesn't have with this size and time.

    The join's key is the path alone, so a catalogue in buckets by path (`sinks.write_bucketed`) is read as it lies.
    """
    k = known.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    return listing.join(k, (F.col("path") == F.col("_p")) & (F.col("size") - F.col("_s") == 0) & (F.col("mtime_ns") - F.col("_m") == 0), "left_anti")


def to_fingerprint(files: DataFrame, hashes: DataFrame, limit: int | None = None) -> DataFrame:
    """Photos that have no fingerprint of this size and time, or one without sharpness or that failed."""
    h = hashes.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"), "sharp", "status")
    rows = files.filter("kind = 'photo'").join(h, "path", "left")
    out = rows.filter("_s is null or _s != size or _m != mtime_ns or status = 'failed' or (status = 'ok' and sharp is null)").select(*files.columns)
    return out.orderBy("path").limit(limit) if limit else out


def to_look_at(files: DataFrame, seen: DataFrame, model: str, retry: bool = False, text: str = "") -> DataFrame:
    """Photos not yet looked at by this model as they are now; failures again only if asked."""
    done = seen.filter(F.col("model") == model)
    done = done.filter("status = 'ok'") if retry else done
    rows = files.filter("kind = 'photo'").join(done.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")
    return rows.filter(X.contains(F.col("path"), text)) if text else rows


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"], strict=True):
            try:
                rows = [(path, *entry) for entry in entries_of(io.BytesIO(content))]
            except zipfile.BadZipFile:
                rows = [(path, None, None, None)]
            yield pd.DataFrame(rows, columns=["zip", "name", "size", "crc"])


def zip_contents(archives: DataFrame) -> DataFrame:
    """(zip, name, size, crc) of archives that are rows already (path, content); one row without name for a bad one."""
    return archives.select("path", "content").mapInPandas(_entries, ZIP_SCHEMA)


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """The same for the archives that a path names, whose last part may have wildcards, or that are below a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    folder, name = (folder, name) if "*" in name or "?" in name or name.lower().endswith(".zip") else (path, "*.zip")
    like = F.substring_index("path", "/", -1).rlike("^" + fnmatch.translate(name))
    whole = F.lit(True) if folder == path else F.instr("path", "/") == 0
    return zip_directories(spark, walk(spark, folder).filter(like & whole), folder)


#: Fixed value: the fields of a sidecar that are read.
SIDECAR = "title string, photoTakenTime struct<timestamp: string>, geoData struct<latitude: double, longitude: double>, geoDataExif struct<latitude: double, longitude: double>"


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, taken_at, lat, lon) of the export sidecars below a folder; unreadable ones have nulls."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    return parsed_sidecars(found.select(F.input_file_name().alias("path"), "value"))


def parsed_sidecars(texts: DataFrame) -> DataFrame:
    s = F.from_json("value", SIDECAR)
    rows = texts.select("path", s.alias("s"))
    place = F.coalesce(X.valid_geo(F.col("s.geoData.latitude"), F.col("s.geoData.longitude")), X.valid_geo(F.col("s.geoDataExif.latitude"), F.col("s.geoDataExif.longitude")))
    return rows.select("path", F.col("s.title").alias("title"), X.sidecar_date(F.col("s.photoTakenTime.timestamp")).alias("taken_at"), place["lat"].alias("lat"), place["lon"].alias("lon"))


def library_list(spark: SparkSession, path: str) -> DataFrame:
    """A library's list of photos: one JSON array of objects."""
    return spark.read.option("multiLine", "true").json(path)


def report(spark: SparkSession, path: str) -> DataFrame:
    """(kind, path, error) of a verification report."""
    return spark.read.csv(path, sep="\t", schema="kind string, path string, error string", quote="")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(from, to) of a manifest of moves."""
    return spark.read.csv(path, sep="\t", schema="`from` string, `to` string", quote="")


def staging(listing: DataFrame) -> DataFrame:
    """(folder, is_primary, media, jsons) of an unpacked export: per folder the media and sidecar names."""
    rows = listing.select(X.dirname(F.col("path")).alias("folder"), X.basename(F.col("path")).alias("name"))
    is_json = F.endswith(F.lower("name"), F.lit(".json"))
    kind = X.kind_of(X.extension(F.col("name")), PHOTO, VIDEO)
    out = rows.groupBy("folder").agg(F.sort_array(F.collect_set(F.when(kind.isNotNull(), F.col("name")))).alias("media"), F.sort_array(F.collect_set(F.when(is_json, F.col("name")))).alias("jsons"))
    return out.withColumn("is_primary", F.substring_index("folder", "/", -1).rlike(r"^(Photos from \d{4}|Archive)$"))


#: Names of the extractor's tags.
TAGS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "GPSLatitude", "GPSLongitude", "ImageWidth", "ImageHeight", "Make", "Model", "ContentIdentifier")


def tags(spark: SparkSession, path: str) -> DataFrame:
    """(path and TAGS, all text) from an extractor's JSON arrays, one object for each file; what is missing is null."""
    schema = ", ".join(f"`{t}` string" for t in ("SourceFile", *TAGS))
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumnRenamed("SourceFile", "path").filter("path is not null")
