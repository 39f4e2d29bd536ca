"""Exact duplicates: groups, the keeper of each, the clean-up plan and its approved allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import expressions as X

from .browse import small

EXCLUDED = "excluded by hand"
CONFLICT = "both copies have a date set by hand, and they differ"
ORPHAN = "half of a pair whose other half has no copy"
GROUP = ["sha1", "size"]


def exact_groups(files: DataFrame) -> DataFrame:
    """(sha1, size, n) of contents that occur more than once."""
    return files.filter("sha1 is not null").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def largest_groups(files: DataFrame, most: int = 200) -> DataFrame:
    return exact_groups(files).orderBy(F.desc("size"), "sha1").limit(most)


def members(files: DataFrame, groups: DataFrame) -> DataFrame:
    return files.join(groups.select(*GROUP), GROUP, "left_semi")


def surplus(files: DataFrame) -> DataFrame:
    return exact_groups(files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("spare"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("bytes"))


def keeper_order(path: Column, source: Column, order: list[str]) -> Column:
    """Smallest is kept: half of a pair, better source, with sidecar, shorter name, path."""
    return F.struct((F.coalesce(F.col("pair_key"), F.lit("")) == "").alias("a"), X.source_rank(source, order).alias("b"), (F.coalesce(F.col("has_sidecar"), F.lit(0)) == 0).alias("c"), F.length(X.basename(path)).alias("d"), path.alias("e"))


def plan(files: DataFrame, overrides: DataFrame, excluded: DataFrame, order: list[str], wide_roots: list[str] | None = None) -> DataFrame:
    """(keep_src, remove_src, reason, keeper, victim, sha1, size): each surplus copy with its keeper; reason is null if free.

    Held are, the first that applies: excluded copies, copies whose date by hand differs from the keeper's, and halves of pairs
    another member of which (by path) has content that isn't duplicated anywhere.  The keeper comes from one min over each
    group, combined before the shuffle, so that a group of a third of all rows stays spread out.
    """
    source = lambda p: X.two_level_source(p, wide_roots or [])
    set_dates = overrides.select("path", F.col("taken_at").alias("override"))
    groups = exact_groups(files)
    rows = files.join(groups.select(*GROUP), GROUP, "left_semi").join(small(set_dates), "path", "left")
    rows = rows.select("path", *GROUP, "pair_key", "has_sidecar", "override")
    key = keeper_order(F.col("path"), source(F.col("path")), order)
    keepers = rows.groupBy(*GROUP).agg(F.min_by(F.struct("path", "override"), key).alias("k")).select(*GROUP, F.col("k.path").alias("keeper"), F.col("k.override").alias("keeper_override"))
    victims = rows.join(keepers, GROUP).filter("path != keeper")
    gone = small(excluded.select("path", F.lit(True).alias("is_excluded")).distinct())
    copied = groups.select(F.col("sha1").alias("_dup")).distinct()
    lone = files.filter("pair_key is not null").join(copied, F.col("sha1") == F.col("_dup"), "left_anti")
    # Paths are unique, so a pair with two such members orphans all, and with one all but that one.
    lone = lone.groupBy("pair_key").agg(F.min("path").alias("lone_a"), F.max("path").alias("lone_b"))
    out = victims.join(gone, "path", "left").join(lone, "pair_key", "left")
    orphan = F.col("lone_a").isNotNull() & ((F.col("lone_a") != F.col("path")) | (F.col("lone_b") != F.col("path"))) & (F.col("pair_key") != "")
    reason = F.when(F.col("is_excluded"), EXCLUDED).when((F.col("override") != "") & (F.col("keeper_override") != "") & (F.col("override") != F.col("keeper_override")), CONFLICT).when(orphan, ORPHAN)
    return out.select(source(F.col("keeper")).alias("keep_src"), source(F.col("path")).alias("remove_src"), reason.alias("reason"), "keeper", F.col("path").alias("victim"), *GROUP)


def rollup(planned: DataFrame) -> DataFrame:
    """Free copies by rule: how many and how large."""
    return planned.filter("reason is null").groupBy("keep_src", "remove_src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def held(planned: DataFrame) -> DataFrame:
    return planned.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def allocate(planned: DataFrame, approvals: DataFrame) -> DataFrame:
    """(approval_id, victim, keeper): unused approvals, by id, each take the next `cap` victims of their rule by path.

    Approvals of a rule cover consecutive ranks of its victims.  No rank beyond the largest sum of caps is needed, and Spark
    drops such rows in every task before the shuffle (window group limit), so a rule with very many victims is no burden.
    """
    rule = ["keep_src", "remove_src"]
    before = Window.partitionBy(*rule).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    spans = approvals.filter("used_batch is null").withColumn("lo", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("cap"))
    spans = small(spans.select(*rule, F.col("id").alias("approval_id"), "lo", "hi"))
    most = spans.agg(F.max("hi")).first()[0] or 0
    free = planned.filter("reason is null").join(small(spans.select(*rule).distinct()), rule, "left_semi")
    ranked = free.withColumn("rank", F.row_number().over(Window.partitionBy(*rule).orderBy("victim"))).filter(F.col("rank") <= most)
    return ranked.join(spans, rule).filter("rank > lo and rank <= hi").select("approval_id", "victim", "keeper")


def pending_by_rule(planned: DataFrame, approvals: DataFrame) -> DataFrame:
    """The rollup with the ids and summed caps of the rule's unused approvals."""
    open_ = approvals.filter("used_batch is null").groupBy("keep_src", "remove_src").agg(F.array_sort(F.collect_list("id")).alias("approvals"), F.sum("cap").alias("caps"))
    return rollup(planned).join(open_, ["keep_src", "remove_src"], "left")


def sidecars(listing: DataFrame, media: DataFrame) -> DataFrame:
    """(path, sidecar): of each media path the .json, .xmp and .aae files beside it that begin with its name or share its stem.

    A sidecar's possible media names are its own name up to each of its dots, so both sides meet by equality.
    """
    n = listing.select(F.col("path").alias("sidecar")).filter(F.lower("sidecar").rlike(r"\.(json|xmp|aae)$"))
    parts = F.split(X.basename(F.col("sidecar")), r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit("n"), F.array_join(F.slice(parts, F.lit(1), k), ".")))
    keys = F.concat(names, F.array(F.concat(F.lit("s"), X.stem(F.col("sidecar")))))
    n = n.select("sidecar", X.dirname(F.col("sidecar")).alias("_d"), F.explode(keys).alias("_key"))
    own = F.array(F.concat(F.lit("n"), X.basename(F.col("path"))), F.concat(F.lit("s"), X.stem(F.col("path"))))
    m = media.select("path", X.dirname(F.col("path")).alias("_d"), F.explode(own).alias("_key"))
    return m.join(n, ["_d", "_key"]).filter("path != sidecar").select("path", "sidecar").distinct()


def verified(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """The plan with `why` a move is refused (null: it may go), from what is on disk now: (path, size, sha1), absent if missing."""
    o = lambda p: observed.select(F.col("path").alias(f"{p}_path"), F.col("size").alias(f"{p}_size"), F.col("sha1").alias(f"{p}_sha1"))
    rows = planned.join(o("v"), F.col("victim") == F.col("v_path"), "left").join(o("k"), F.col("keeper") == F.col("k_path"), "left")
    why = F.when(F.col("victim") == F.col("keeper"), "same file").when(F.col("v_path").isNull() | F.col("k_path").isNull(), "file missing on disk").when((F.col("v_size") != F.col("size")) | (F.col("k_size") != F.col("size")), "size changed since scan").when(F.coalesce((F.col("v_sha1") != F.col("sha1")) | (F.col("k_sha1") != F.col("sha1")), F.lit(True)), "SHA-1 differs from the index")
    return rows.select(*planned.columns, why.alias("why"))
