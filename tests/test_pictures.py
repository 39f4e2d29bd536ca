"""Pictures and moves: what surrounds the functions that do the work."""

import shutil

import numpy as np
import pytest

from larkspur.functions import images
from larkspur.operators import pictures
from larkspur.sources import moves

PGM = images.encode_pgm(np.tile(np.arange(0, 240, 2.0), (60, 1)))


def test_previews_fit_and_failures_are_told(spark):
    df = spark.createDataFrame([("a", 1, 1, PGM), ("b", 1, 1, b"nothing"), ("c", 2, 1, None)], "path string, size long, mtime_ns long, content binary")
    got = {r.path: r for r in pictures.previews(df, 40).collect()}
    assert (got["a"].status, got["a"].width, got["a"].height) == ("ok", 40, 20) and got["b"].status == got["c"].status == "failed"
    assert images.decode_pnm(bytes(got["a"].preview)).shape == (20, 40)
    assert (r := pictures.previews(df, 400).filter("path = 'a'").first()).width == 120 and bytes(r.preview) == PGM
    failures = spark.createDataFrame([("b", 1, 1), ("c", 1, 1)], "path string, size long, mtime_ns long")
    assert {r.path for r in pictures.untried(df, failures).collect()} == {"a", "c"}
    assert images.any_decoder()(PGM).shape == (60, 120)


def test_faces_are_fractions_in_order(spark):
    df = spark.createDataFrame([("a", PGM), ("b", b"x")], "path string, content binary")
    face = ([12, 6, 60, 30], [48, 12, 24, 12, 36, 18, 48, 24, 24, 24])
    got = {r.path: r for r in pictures.detected(df, lambda grey: [face]).collect()}
    assert got["a"].faces[0].b == pytest.approx([0.1, 0.1, 0.5, 0.5]) and got["a"].faces[0].k == pytest.approx([0.2, 0.2, 0.4, 0.2, 0.3, 0.3, 0.2, 0.4, 0.4, 0.4])
    assert got["b"].status == "failed" and got["b"].faces is None


def test_models_are_asked_again(spark):
    def ask(row):
        if row["n"] % 3 == 0:
            raise ValueError("no answer " * 50)
        return f"open {row['n']}"

    got = pictures.asked(spark.range(9).withColumnRenamed("id", "n"), ask, 3)
    rows = {r.n: r for r in got.collect()}
    assert rows[1].answer == "open 1" and rows[1].tries == 1 and (rows[3].status, rows[3].tries, len(rows[3].error)) == ("failed", 3, 120)
    told = pictures.rates(spark.createDataFrame([("ok", 2.0), ("failed", 2.0)], "status string, seconds double"), left=60, workers=2).first()
    assert (told.done, told.failed, told.per_second, told.minutes_left) == (2, 1, 1.0, 1.0)


def test_sheets_and_outlines():
    grey = np.full((10, 20), 9.0)
    assert images.sheet([grey] * 5, 2, 10).shape == (30, 20) and images.sheet([grey], 2, 10)[0].sum() == 0
    lined = images.outlined(grey, [[2, 2, 5, 5], [-3, 4, 90, 90]])
    assert lined[2, 3] == 255 and lined[3, 3] == 9 and lined[9, 19] == 255 and grey.max() == 9


def test_moves(spark, tmp_path):
    for name in ("a/x.jpg", "a/x.jpg.json", "a/x.mov", "b/y.jpg", "b/keep.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    plan = spark.createDataFrame([("a/x.jpg", "b/keep.jpg", "r"), ("b/y.jpg", None, "all"), ("c/gone.jpg", "b/keep.jpg", "r")], "victim string, keeper string, rule string")
    partners = spark.createDataFrame([("a/x.jpg", "a/x.mov")], "victim string, path string")
    beside = spark.createDataFrame([("a/x.jpg", "a/x.jpg.json"), ("a/x.mov", "a/x.jpg.json"), ("b/keep.jpg", "b/k.xmp")], "path string, sidecar string")
    todo = moves.quarantine(plan, partners, beside, "b1")
    assert {(r["from"], r.role, r.keeper) for r in todo.collect()} == {("a/x.jpg", "photo", "b/keep.jpg"), ("a/x.jpg.json", "sidecar", "b/keep.jpg"), ("a/x.mov", "live-video", "b/keep.jpg"), ("b/y.jpg", "photo", None), ("c/gone.jpg", "photo", "b/keep.jpg")}
    paths = lambda: spark.createDataFrame([(str(p.relative_to(tmp_path)),) for p in tmp_path.rglob("*") if p.is_file()] + [("_quarantine/b1/b/y.jpg",)], "path string")
    checked = moves.allowed(todo, paths())
    root = str(tmp_path)

    def move(source, target):
        import os

        os.makedirs(os.path.dirname(f"{root}/{target}"), exist_ok=True)
        shutil.move(f"{root}/{source}", f"{root}/{target}")

    assert {r.done for r in moves.carry_out(checked, move).collect()} == {"would move", "refused"} and (tmp_path / "a/x.jpg").exists()
    done = {r["from"]: (r.done, r.why) for r in moves.carry_out(checked, move, apply=True).collect()}
    assert done == {"a/x.jpg": ("moved", None), "a/x.jpg.json": ("moved", None), "a/x.mov": ("moved", None), "b/y.jpg": ("refused", "target exists"), "c/gone.jpg": ("refused", "source is missing")}
    log = spark.createDataFrame([("a/x.jpg", "_quarantine/b1/a/x.jpg", "photo", "k", "r", None, None), ("b/z", "q", "photo", "k", "r", "t", None)], "path string, qpath string, role string, keeper string, rule string, restored_at string, purged_at string")
    again = moves.carry_out(moves.allowed(moves.back(log), paths()), move, apply=True).collect()
    assert [(r["to"], r.done) for r in again] == [("a/x.jpg", "moved")] and (tmp_path / "a/x.jpg").read_text() == "a/x.jpg"
    same = spark.createDataFrame([("a", "t"), ("b", "t")], "`from` string, `to` string")
    assert {r["from"]: r.why for r in moves.allowed(same, spark.createDataFrame([("a",), ("b",)], "path string")).collect()} == {"a": None, "b": "target is claimed"}


def test_pictures_of_many_sizes_together(spark, monkeypatch):
    """The same as one by one, whatever stands beside a picture; no hash loses bits to one without."""
    rng = np.random.default_rng(9)
    greys = [rng.integers(0, 256, size) for size in [(8, 9), (16, 18), (31, 47), (5, 4), (16, 18), (8, 9), (1, 1)] * 3] + [np.full((20, 30), 90), np.full((8, 9), 7)]
    monkeypatch.setattr(images, "HELD", 1000)
    rows = [(i, images.encode_pgm(g)) for i, g in enumerate(greys)] + [(99, b"no picture"), (98, None)]
    got = {r.id: (r.status, r.dhash, r.sharp) for r in images.fingerprints(spark.createDataFrame(rows, "id int, content binary").coalesce(1)).collect()}
    for i, g in enumerate(greys):
        small = images.shrunk(g.astype(float), 9, 8)
        bits = int("".join("01"[int(x)] for x in (small[:, :-1] > small[:, 1:]).ravel()), 2)
        status = "flat" if small.std() < images.FLAT else "ok"
        assert got[i][:2] == (status, None if status == "flat" else bits - (1 << 64) if bits >> 63 else bits)
        p = np.pad(g.astype(float), 1, mode="edge")
        edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
        assert got[i][2] == pytest.approx(np.clip(edges + 128, 0, 255).var())
    assert got[99] == got[98] == ("failed", None, None)
