"""Work on pictures that a given function does: previews, faces, a model's answers.

Decoders, detectors and models aren't part of this engine: they come as functions, which executors call row by row, and whatever
they raise becomes a status.  What this engine adds is what surrounds them: sizes, what is tried again, order and rates.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import images

#: Longest side of a thumbnail and of a preview, in pixels; longest text of an error that is kept.
THUMB, PREVIEW, ERROR = 360, 1600, 120


def _each(rows: DataFrame, added: dict[str, str], call: Callable[[dict], tuple], without: tuple[str, ...] = ()) -> DataFrame:
    """`rows` (but columns `without`) and what `call` makes of each: columns `added`, by name and type."""
    own = [c for c in rows.columns if c not in without]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [call(r) for r in part.to_dict("records")]
            out = part[own].copy()
            for k, name in enumerate(added):
                out[name] = pd.Series([g[k] for g in got], index=out.index, dtype=object)
            yield out

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema]
    return rows.mapInPandas(run, ", ".join([*kept, *(f"{n} {t}" for n, t in added.items())]))


def untried(pictures: DataFrame, failures: DataFrame) -> DataFrame:
    """Pictures but those that failed before as they are now (path, size, mtime_ns)."""
    return pictures.join(failures.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")


def previews(pictures: DataFrame, longest: int = THUMB, decode: Callable[[bytes], np.ndarray] = images.decode_pnm) -> DataFrame:
    """`pictures` (with content) with status (ok or failed), width, height and preview, a grey PGM that fits in `longest` squared.

    Small pictures keep their size.
    """

    def make(row: dict) -> tuple:
        try:
            grey = images.fitted(decode(bytes(row["content"])), longest)
        except Exception:  # whatever a decoder raises, this picture failed and the others go on
            return "failed", None, None, None
        return "ok", grey.shape[1], grey.shape[0], images.encode_pgm(grey)

    return _each(pictures, {"status": "string", "width": "int", "height": "int", "preview": "binary"}, make, ("content",))


def eyes_first(k: list[float]) -> list[float]:
    """Five landmarks x1, y1, x2, y2, ... as left eye, right eye, nose, left and right corner of the mouth, by place in the picture."""
    p = [tuple(k[i : i + 2]) for i in range(0, 10, 2)]
    return [x for point in (*sorted(p[:2]), p[2], *sorted(p[3:])) for x in point]


def detected(pictures: DataFrame, detect: Callable[[np.ndarray], list], decode: Callable[[bytes], np.ndarray] = images.decode_pnm) -> DataFrame:
    """`pictures` (with content) with status and faces, an array of (b, k) as fractions of the sides: box and ordered landmarks.

    detect: from grey values to a list of (box, ten numbers of landmarks), in pixels.
    """

    def look(row: dict) -> tuple:
        try:
            grey = decode(bytes(row["content"]))
            size = np.array([grey.shape[1], grey.shape[0]] * 5, float)
            return "ok", [{"b": (np.array(b) / size[:4]).tolist(), "k": eyes_first((np.array(k) / size).tolist())} for b, k in detect(grey)]
        except Exception:  # as above
            return "failed", None

    return _each(pictures, {"status": "string", "faces": "array<struct<b: array<double>, k: array<double>>>"}, look, ("content",))


def asked(rows: DataFrame, ask: Callable[[dict], str], tries: int = 2) -> DataFrame:
    """`rows` with answer, status (ok or failed), error, tries and seconds: what `ask` says of each, asked again after an error."""

    def one(row: dict) -> tuple:
        began, error = time.monotonic(), None
        for k in range(1, tries + 1):
            try:
                return ask(row), "ok", None, k, time.monotonic() - began
            except Exception as e:  # a model that doesn't answer is a failure of this row
                error = str(e)[:ERROR]
        return None, "failed", error, tries, time.monotonic() - began

    return _each(rows, {"answer": "string", "status": "string", "error": "string", "tries": "int", "seconds": "double"}, one)


def rates(answers: DataFrame, left: int = 0, workers: int = 1) -> DataFrame:
    """(done, failed, per_second, minutes_left) of `asked`, at `workers` rows a time and with `left` rows still to do."""
    done, spent = F.count(F.lit(1)), F.sum("seconds")
    speed = F.when(spent > 0, done * workers / spent)
    return answers.agg(done.alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), speed.alias("per_second"), (F.lit(left) / speed / 60).alias("minutes_left"))
