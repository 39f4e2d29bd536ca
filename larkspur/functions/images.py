"""Fingerprints of pictures: difference hash and sharpness, over any decoder.

Pictures come as bytes; `decode` turns them into a 2-D array of grey values and may be any function (an imaging library is
not part of this engine).  Arrow batches of bytes go in, three columns come out.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = 4.0
HELD = 1 << 23


def decode_pnm(content: bytes) -> np.ndarray:
    """Grey values of a binary PGM or PPM picture."""
    head = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not head or int(head[4]) > 255:
        raise ValueError("not an 8-bit PGM or PPM picture")
    planes = 1 if head[1] == b"P5" else 3
    w, h = int(head[2]), int(head[3])
    px = np.frombuffer(content, np.uint8, w * h * planes, head.end()).reshape(h, w, planes).astype(float)
    return px[..., 0] if planes == 1 else px @ np.array([0.299, 0.587, 0.114])


def shrunk(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean grey of each cell of a width by height grid (pictures smaller than the grid repeat pixels)."""
    rows, cols = (np.linspace(0, n, k + 1).astype(int) for n, k in ((grey.shape[0], height), (grey.shape[1], width)))
    out = np.empty((height, width))
    for i in range(height):
        for j in range(width):
            a, b = min(rows[i], grey.shape[0] - 1), min(cols[j], grey.shape[1] - 1)
            out[i, j] = grey[a : max(rows[i + 1], a + 1), b : max(cols[j + 1], b + 1)].mean()
    return out


def fitted(grey: np.ndarray, longest: int) -> np.ndarray:
    """Grey values shrunk to fit in a square of `longest`, the sides' ratio kept; smaller pictures as they are."""
    h, w = grey.shape
    scale = min(1.0, longest / max(h, w))
    return grey if scale == 1.0 else shrunk(grey, max(1, round(w * scale)), max(1, round(h * scale)))


def encode_pgm(grey: np.ndarray) -> bytes:
    px = np.clip(np.round(grey), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + px.tobytes()


def outlined(grey: np.ndarray, boxes: list, value: float = 255.0) -> np.ndarray:
    """A copy with the outlines of boxes (left, top, right, bottom, in pixels) drawn."""
    out, (h, w) = grey.astype(float).copy(), grey.shape
    for box in boxes:
        left, top, right, bottom = (int(np.clip(round(x), 0, most - 1)) for x, most in zip(box, (w, h, w, h), strict=True))
        out[[top, bottom], left : right + 1] = value
        out[top : bottom + 1, [left, right]] = value
    return out


def sheet(pictures: list[np.ndarray], columns: int, cell: int) -> np.ndarray:
    """One picture of several, row by row, each fitted into a cell and centred on black."""
    rows = max(1, -(-len(pictures) // columns))
    out = np.zeros((rows * cell, columns * cell))
    for n, grey in enumerate(pictures):
        small = fitted(grey, cell)
        top = n // columns * cell + (cell - small.shape[0]) // 2
        left = n % columns * cell + (cell - small.shape[1]) // 2
        out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def any_decoder() -> Callable[[bytes], np.ndarray]:
    """A decoder of all formats that an imaging library reads, if one is installed; else that of PGM and PPM."""
    try:
        from PIL import Image
    except ImportError:
        return decode_pnm
    return lambda content: np.asarray(Image.open(io.BytesIO(content)).convert("L"), float)


def _grids(greys: np.ndarray, width: int, height: int) -> np.ndarray:
    """`shrunk` of pictures of one size, all at once."""
    n, h, w = greys.shape
    if h < height or w < width:
        return np.stack([shrunk(g, width, height) for g in greys])
    rows, cols = (np.linspace(0, size, k + 1).astype(int) for size, k in ((h, height), (w, width)))
    sums = np.add.reduceat(np.add.reduceat(greys, rows[:-1], axis=1), cols[:-1], axis=2)
    return sums / (np.diff(rows)[:, None] * np.diff(cols))


def looked_at(greys: np.ndarray) -> list[tuple[str, int | None, float]]:
    """`fingerprint` of each of some pictures of one size (picture, row, column)."""
    greys = greys.astype(float)
    p = np.pad(greys, ((0, 0), (1, 1), (1, 1)), mode="edge")
    edges = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * greys
    sharp = np.clip(np.round(edges) + 128, 0, 255).reshape(len(greys), -1).var(axis=1)
    small = _grids(greys, 9, 8)
    flat = small.reshape(len(greys), -1).std(axis=1) < FLAT
    bits = np.packbits((small[:, :, :-1] > small[:, :, 1:]).reshape(len(greys), 64), axis=1)
    hashes = bits.view(">u8").ravel().astype(np.uint64).view(np.int64)
    return [("flat", None, x) if f else ("ok", h, x) for f, h, x in zip(flat.tolist(), hashes.tolist(), sharp.tolist(), strict=True)]


def fingerprint(grey: np.ndarray) -> tuple[str, int | None, float]:
    """(status, signed 64-bit hash, sharpness): each cell of a 9 by 8 grid against its right neighbour, row by row."""
    return looked_at(grey[None])[0]


def fingerprints(pictures: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_pnm) -> DataFrame:
    """`pictures` (with content binary) with status (ok, flat or failed), dhash and sharp instead of content.

    Pictures of one size are looked at together, HELD grey values at a time.
    """

    @F.pandas_udf("status string, dhash long, sharp double")
    def look(content: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [("failed", None, None)] * len(content)
        waiting: dict[tuple, list[tuple[int, np.ndarray]]] = {}

        def flush() -> None:
            for same in waiting.values():
                for (i, _), row in zip(same, looked_at(np.stack([g for _, g in same])), strict=True):
                    rows[i] = row
            waiting.clear()

        held = 0
        for i, c in enumerate(content):
            try:
                grey = np.asarray(decode(bytes(c)), float)
                if grey.ndim != 2 or not grey.size:
                    raise ValueError("no picture")
            except Exception:  # whatever a decoder raises, this picture failed and the others go on
                continue
            waiting.setdefault(grey.shape, []).append((i, grey))
            held += grey.size
            if held > HELD:
                flush()
                held = 0
        flush()
        status, dhash, sharp = zip(*rows, strict=True) if rows else ((), (), ())
        # Hashes never pass through floats, which have 53 bits.
        return pd.DataFrame({"status": pd.array(status, "string"), "dhash": pd.array(dhash, "Int64"), "sharp": pd.array(sharp, "Float64")})

    return pictures.withColumn("_f", look("content")).select(*[c for c in pictures.columns if c != "content"], "_f.*")
