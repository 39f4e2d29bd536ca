"""Moves of files as a plan: what goes where, what carrying it out did, and the way back.

Nothing here touches a file by itself: `carry_out` calls the function that it is given, on the executors, once for each file that
may move.  Sources and targets are paths below one root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "`from` string, `to` string, role string, keeper string, rule string"


def quarantine(plan: DataFrame, partners: DataFrame, beside: DataFrame, batch: str, folder: str = "_quarantine") -> DataFrame:
    """(from, to, role, keeper, rule): victims of a plan (victim, keeper, rule), their partners' clips and all their sidecars.

    partners: (victim, path); beside: (path, sidecar).  Each file moves once, under the role that comes first: photo, sidecar,
    live-video.
    """
    own = plan.select(F.col("victim").alias("from"), F.lit("photo").alias("role"), F.col("victim").alias("_of"))
    clips = partners.join(plan.select("victim"), "victim").select(F.col("path").alias("from"), F.lit("live-video").alias("role"), F.col("victim").alias("_of"))
    main = own.unionByName(clips)
    side = main.join(beside, F.col("from") == F.col("path")).select(F.col("sidecar").alias("from"), F.lit("sidecar").alias("role"), "_of")
    rank = F.array_position(F.array(F.lit("photo"), F.lit("sidecar"), F.lit("live-video")), F.col("role"))
    once = main.unionByName(side).groupBy("from").agg(F.min_by(F.struct("role", "_of"), F.struct(rank, "_of")).alias("r"))
    named = once.select("from", "r.role", F.col("r._of").alias("_of")).join(plan.select(F.col("victim").alias("_of"), "keeper", "rule"), "_of")
    return named.select("from", F.concat(F.lit(f"{folder}/{batch}/"), "from").alias("to"), "role", "keeper", "rule")


def back(log: DataFrame) -> DataFrame:
    """(from, to, role, keeper, rule) that undoes what a log (path, qpath, role, keeper, rule) did and still holds."""
    held = log.filter("restored_at is null and purged_at is null")
    return held.select(F.col("qpath").alias("from"), F.col("path").alias("to"), "role", "keeper", "rule")


def allowed(plan: DataFrame, present: DataFrame) -> DataFrame:
    """The plan with `why` a file may not move, from the paths that exist (path): its source is gone or its target is taken.

    Of several files with one target only the first by name may.
    """
    here = present.select(F.col("path").alias("_here"), F.lit(True).alias("_is"))
    there = present.select(F.col("path").alias("_there"), F.lit(True).alias("_taken"))
    first = plan.groupBy("to").agg(F.min("from").alias("_first"))
    rows = plan.join(here, F.col("from") == F.col("_here"), "left").join(there, F.col("to") == F.col("_there"), "left").join(first, "to")
    why = F.when(F.col("_is").isNull(), "source is missing").when(F.col("_taken"), "target exists").when(F.col("from") != F.col("_first"), "target is claimed")
    return rows.select(*plan.columns, why.alias("why"))


def carry_out(plan: DataFrame, move: Callable[[str, str], None], apply: bool = False) -> DataFrame:
    """The plan (with `why`) and `done`: moved, refused, failed or, unless told to apply it, would move; `why` tells of failures.

    `move` takes source and target; it has to bear being called again for a file that it moved, as a lost executor's rows are
    done again.  Write the result before it is looked at twice.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done, why = [], []
            for source, target, reason in zip(part["from"], part["to"], part["why"], strict=True):
                if isinstance(reason, str):
                    done.append("refused")
                elif not apply:
                    done.append("would move")
                else:
                    try:
                        move(source, target)
                        done.append("moved")
                    except OSError as e:
                        done.append("failed")
                        reason = str(e)
                why.append(reason if isinstance(reason, str) else None)
            yield part.assign(why=why, done=done)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema)
    return plan.mapInPandas(run, f"{schema}, done string")
