"""What a client asks for at once: each function composes operators into named DataFrames, none of which is computed yet.

A catalogue is a mapping of tables: files, overrides, excluded, approvals, log, marks, takes, hashes, grouped, info, vision
(columns as in the operators).  Parameters that aren't allowed set no filter, as in `browse.Browse`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.operators import browse, decisions, duplicates, paging, similar, vision

Catalogue = dict[str, DataFrame]


def grid(c: Catalogue, wanted: browse.Browse, number: int = 1, size: int = 96, at: str = "") -> dict[str, DataFrame]:
    """The list of files: one page (by number, or what follows the cursor `at`), how many there are, and what can be chosen.

    The sources that exist are few; they are fetched to tell whether the wanted one is among them.
    """
    files = browse.overlay(c["files"], c["overrides"])
    seen = files.filter(X.visible(F.col("kind"), F.col("pair_key")))
    sources = browse.count_by(seen, X.one_level_source(F.col("path")), "source").orderBy(F.desc("n"), "source")
    known = [wanted.source] if wanted.source and not sources.filter(F.col("source") == wanted.source).isEmpty() else []
    rows = files.filter(wanted.condition(known))
    years = browse.count_by(seen.filter("taken_at is not null"), F.substring("taken_at", 1, 4), "year").orderBy(F.desc("year"))
    page = paging.next_page(rows, wanted.keys(), size, at) if at or number <= 1 else browse.page(rows, wanted.order(), number, size)
    return {"page": page, "total": rows.agg(F.count(F.lit(1)).alias("n")), "sources": sources, "years": years, "grand": browse.totals(seen)}


def world(c: Catalogue, wanted: browse.Browse, zoom: float) -> dict[str, DataFrame]:
    """The map: cells in the wanted box and the bounds of all that is located."""
    rows = browse.located(c["files"], c["overrides"])
    whole = browse.Browse(year=wanted.year, kind=wanted.kind)
    return {"cells": browse.geo_cells(rows.filter(wanted.condition()), zoom), "bounds": browse.bounds(rows.filter(whole.condition()))}


def timeline(c: Catalogue, this_year: int, source: str = "", dated: bool = False) -> DataFrame:
    """Counts by year and month, of a source if one is given (whether it exists or not), without dates of file times if `dated`."""
    rows = browse.overlay(c["files"], c["overrides"]).filter(X.visible(F.col("kind"), F.col("pair_key")))
    if source:
        rows = rows.filter(X.has_prefix(F.col("path"), source + "/"))
    if dated:
        rows = rows.filter("date_source != 'mtime'")
    return browse.timeline(rows, this_year)


def detail(c: Catalogue, file_id: int) -> dict[str, DataFrame]:
    """One file with its other half, equal files, similar ones, and whether its date was set by hand."""
    files = browse.overlay(c["files"], c["overrides"])
    one = files.filter(F.col("id") == file_id)
    near = files.join(one.select("pair_key").dropna(), "pair_key", "left_semi")
    copies = c["files"].join(one.select("sha1", "size"), ["sha1", "size"], "left_semi").filter(F.col("id") != file_id)
    group = c["grouped"].join(one.select("path"), "path", "left_semi").select("group_id")
    alike = c["grouped"].join(group, "group_id", "left_semi").join(one.select("path"), "path", "left_anti").select("path")
    return {"file": one, "partner": browse.partner(near).filter(F.col("id") == file_id), "twins": copies.select("id", "path"), "similar": files.join(alike, "path", "left_semi").select("id", "path"), "by_hand": c["overrides"].join(one.select("path"), "path", "left_semi")}


def clean_up(c: Catalogue, order: list[str], wide_roots: list[str], now: datetime) -> dict[str, DataFrame]:
    """The plan by rule with its approvals, what is held and why, and the batches with what may be purged."""
    plan = duplicates.plan(c["files"], c["overrides"], c["excluded"], order, wide_roots)
    return {"rules": duplicates.pending_by_rule(plan, c["approvals"]), "held": duplicates.held(plan), "todo": duplicates.allocate(plan, c["approvals"]), "batches": decisions.batches(c["log"]), "purgeable": decisions.purgeable(c["log"], now)}


def rule(c: Catalogue, order: list[str], wide_roots: list[str], keep: str, remove: str, number: int = 1, size: int = 60, sort: str = "path", seed: int = 0) -> DataFrame:
    """One page of a rule's pairs by path, size or in a seeded order."""
    rows = duplicates.plan(c["files"], c["overrides"], c["excluded"], order, wide_roots).filter((F.col("keep_src") == keep) & (F.col("remove_src") == remove) & F.col("reason").isNull())
    by = {"size": [F.desc("size"), F.asc("victim")], "random": [*vision.seeded(seed, "victim"), F.asc("victim")]}.get(sort, [F.asc("victim")])
    return browse.page(rows, by, number, size)


def review(c: Catalogue, kind: str = "", view: str = "pending", order: str = "space", which: str = "", start: int = 0, size: int = 25, today: str = "", theirs: str = "", at: str = "") -> dict[str, DataFrame]:
    """One chunk of the groups to review (from `start` on, or after the cursor `at`) with their members and decisions, how many the list has, and the totals."""
    files = browse.overlay(c["files"], c["overrides"])
    listed = similar.group_list(c["grouped"], files, c["info"], c["marks"], kind, "decided" if view == "decided" else "pending", which, today, theirs)
    chunk = listed.orderBy(*similar.list_order(order)).offset(start).limit(size) if start and not at else similar.next_groups(listed, order, size, at)
    inside = c["grouped"].join(F.broadcast(chunk.select("group_id")), "group_id", "left_semi")  # `size` groups
    members = similar.members(inside, files, c["hashes"], c["marks"], c["vision"])
    return {"groups": chunk, "members": members, "decisions": similar.decisions(members), "shown": listed.agg(F.count(F.lit(1)).alias("n")), "totals": similar.review_totals(c["grouped"], c["files"], c["marks"])}


class Shown:
    """What a client holds of a list that it loads chunk by chunk while it decides on groups, which then leave the list."""

    def __init__(self, size: int = 25):
        self.size, self.ids, self.inside, self.ended = size, [], set(), False

    def start(self) -> int:
        """Where the next chunk begins: after as many groups as are shown and still in the list."""
        return len(self.inside)

    def add(self, chunk: list) -> list:
        """Ids of a chunk that are new, in order; a short chunk, or one without any new id, is the last."""
        new = [k for k in dict.fromkeys(chunk) if k not in set(self.ids)]
        self.ids += new
        self.inside |= set(new)
        self.ended |= len(chunk) < self.size or not new
        return new

    def left(self, ids: list) -> None:
        """These groups are decided and no longer in the list, but still shown."""
        self.inside -= set(ids)


def take(c: Catalogue, group_id) -> dict[str, DataFrame]:
    """A group's frames with their faces, the frame to start from, and the latest approval."""
    members = vision.take_members(c["grouped"].filter(F.col("group_id") == group_id), c["vision"], c["hashes"])
    return {"members": members, "base": vision.take_base(members), "approval": decisions.latest_take(c["takes"].filter(F.col("gid") == group_id))}
