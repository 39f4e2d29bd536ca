"""Matching export sidecars to media files by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

LEAST_PREFIX = 20


def by_name(media: DataFrame, jsons: DataFrame) -> DataFrame:
    """(folder, file, sidecar): the first candidate name that exists in the folder."""
    asked = media.select("folder", "file", F.posexplode(X.sidecar_names(F.col("file"))).alias("place", "sidecar"))
    return asked.join(jsons.select("folder", "sidecar"), ["folder", "sidecar"]).groupBy("folder", "file").agg(F.min_by("sidecar", "place").alias("sidecar"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, least: int = 1) -> DataFrame:
    """(folder, name, prefix): the longest proper prefix of `name` among its folder's `prefixes` of `least` characters or more.

    Lengths that occur are few, so names are cut to each of them and joined by equality, instead of comparing all with all.
    """
    lengths = prefixes.select(F.length("prefix").alias("n")).filter(F.col("n") >= least).distinct().groupBy().agg(F.collect_list("n").alias("ns"))
    cut = names.select("folder", "name", F.lit(1).alias("_k")).join(F.broadcast(lengths.withColumn("_k", F.lit(1))), "_k")  # one row
    cut = cut.select("folder", "name", F.explode(F.filter("ns", lambda n: n < F.length("name"))).alias("n")).select("folder", "name", F.substring(F.col("name"), F.lit(1), F.col("n")).alias("prefix"), "n")
    return cut.join(prefixes.select("folder", "prefix").distinct(), ["folder", "prefix"]).groupBy("folder", "name").agg(F.max_by("prefix", "n").alias("prefix"))


def truncated(media: DataFrame, jsons: DataFrame) -> DataFrame:
    """(folder, file, sidecar): sidecars whose cut-off name begins the file's full one and whose title fits.

    Of the file itself and the one it was edited from, the first with a fitting longest prefix counts.
    """
    asked = media.select("folder", "file", F.posexplode(X.versions(F.col("file"))).alias("place", "base"))
    asked = asked.withColumn("name", F.concat("base", F.lit(X.SUPPLEMENT)))
    stems = jsons.select("folder", "sidecar", "title", F.regexp_replace("sidecar", r"\.json$", "").alias("prefix"))
    best = longest_prefix(asked.select("folder", "name").distinct(), stems, LEAST_PREFIX)
    hits = asked.join(best, ["folder", "name"]).join(stems, ["folder", "prefix"]).filter(X.agrees(F.col("title"), F.col("base")))
    return hits.groupBy("folder", "file").agg(F.min_by("sidecar", "place").alias("sidecar"))


def sidecars(media: DataFrame, jsons: DataFrame) -> DataFrame:
    """(folder, file, sidecar): by name, else by truncated name."""
    named = by_name(media, jsons)
    return named.unionByName(truncated(media.join(named, ["folder", "file"], "left_anti"), jsons))


def borrowed(media: DataFrame, found: DataFrame, video: list[str]) -> DataFrame:
    """(folder, file, sidecar): videos without a sidecar take that of the still of the same name, whole or without extension."""
    is_video = F.lower(X.extension(F.col("file"))).isin(video)
    still = found.filter(~is_video).groupBy("folder", F.lower(X.stem(F.col("file"))).alias("key")).agg(F.min_by("sidecar", "file").alias("sidecar"))
    need = media.filter(is_video).join(found, ["folder", "file"], "left_anti").select("folder", "file")
    keys = F.posexplode(F.array(F.lower("file"), F.lower(X.without_extension(F.col("file"))))).alias("place", "key")
    return need.select("folder", "file", keys).join(still, ["folder", "key"]).groupBy("folder", "file").agg(F.min_by("sidecar", "place").alias("sidecar"))


def claims(found: DataFrame) -> DataFrame:
    """(folder, file, sidecar, action): the last file that claims a sidecar moves it, the others copy it."""
    last = Window.partitionBy("folder", "sidecar").orderBy(F.desc("file"))
    return found.withColumn("action", F.when(F.row_number().over(last) == 1, "move").otherwise("copy"))


def unclaimed(jsons: DataFrame, found: DataFrame) -> DataFrame:
    return jsons.join(found.select("folder", "sidecar"), ["folder", "sidecar"], "left_anti")


def album_copies(albums: DataFrame, primary: DataFrame) -> DataFrame:
    """Album files with the name, size and content of a file in one of the export's own folders."""
    return albums.join(primary.select("file", "size", "sha1").distinct(), ["file", "size", "sha1"], "left_semi")
