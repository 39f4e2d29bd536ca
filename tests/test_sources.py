"""Sources, sinks and the stream, on files made here."""

import hashlib
import io
import json
import os
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from larkspur.sources import files, sinks, staging, trees
from larkspur.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my photos"
    for name in ("a/one.JPG", "a/one.JPG.supplemental-metadata.json", "a/_hidden/x.jpg", "b/two.mov", "b/two.aae", "b/three.heif", "b/three.heif.xmp", "b/four.rw2", "b/four.json", "b/four.XMP", "b/five.bmp", "b/L.photoslibrary/in.jpg", "b/M.iPhotoLibrary/x/in.jpg", "note.txt", "b/.dot.jpg", "a/_DSC0001.NEF", "_MG_1234.CR2", "a/.seen/s.jpg", "_top/y.jpg"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    return root


def test_walk_and_hash(spark, tree):
    listing = files.walk(spark, str(tree))
    beside = {"a/one.JPG.supplemental-metadata.json", "b/two.aae", "b/three.heif.xmp", "b/four.json", "b/four.XMP"}
    assert {r.path for r in listing.collect()} == {"a/one.JPG", "b/two.mov", "b/three.heif", "b/four.rw2", "b/five.bmp", "note.txt", "a/_DSC0001.NEF", "_MG_1234.CR2", "a/.seen/s.jpg"} | beside
    # Export sidecars and other spellings aren't sidecars of the archive.
    assert {r.path: (r.kind, r.has_sidecar) for r in files.media(listing).collect()} == {"a/one.JPG": ("photo", 0), "b/two.mov": ("video", 1), "b/three.heif": ("photo", 1), "b/four.rw2": ("photo", 0), "a/_DSC0001.NEF": ("photo", 0), "_MG_1234.CR2": ("photo", 0), "a/.seen/s.jpg": ("photo", 0)}
    got = {r.path: r.crc for r in files.hashed(spark, str(tree)).collect()}
    assert got["b/two.mov"] == zlib.crc32(b"b/two.mov") and got["a/_DSC0001.NEF"] == zlib.crc32(b"a/_DSC0001.NEF")
    assert {r.folder: (r.media, r.jsons) for r in files.staging(listing).collect()}["a"] == (["_DSC0001.NEF", "one.JPG"], ["one.JPG.supplemental-metadata.json"])


def test_a_tree_is_listed_by_parts(spark, tree, monkeypatch):
    """The same files, whether the driver lists all folders, a few or only the top; pruned folders are never opened."""
    opened = []
    listed = trees._listed
    monkeypatch.setattr(trees, "_listed", lambda fs, folder: opened.append(folder) or listed(fs, folder))
    found = []
    for splits in (1, 2, 100):
        reader = trees.TreeReader(str(tree), trees.PACKAGES, splits)
        found.append(sorted(p for part in reader.partitions() for b in reader.read(part) for p in b.column(0).to_pylist()))
    assert found[0] == found[1] == found[2] == sorted(r.path for r in files.walk(spark, str(tree)).collect())
    assert not [f for f in opened if "_hidden" in f or "_top" in f or "ibrary" in f]
    os.symlink(tree / "a", tree / "b/loop")
    os.symlink(tree / "b", tree / "a/loop")
    assert files.walk(spark, str(tree)).count() == len(found[0])
    one = {r.path: r for r in files.walk(spark, f"file://{tree}").collect()}["note.txt"]
    assert one.mtime_ns == (tree / "note.txt").stat().st_mtime_ns and one["size"] == 8
    with pytest.raises(Exception, match="nowhere"):
        files.walk(spark, str(tree / "nowhere")).count()


def test_large_files_are_hashed_in_chunks(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large.mov", "wb") as f:  # sparse: no disk is used
        f.truncate(size)
    (tmp_path / "empty.jpg").write_bytes(b"")
    got = {r.path: r for r in files.hashed(spark, str(tmp_path)).collect()}
    whole, crc, zeros = hashlib.sha1(), 0, bytes(1 << 24)
    for n in [1 << 24] * (size >> 24) + [size & (1 << 24) - 1]:
        whole.update(zeros[:n])
        crc = zlib.crc32(zeros[:n], crc)
    assert (got["large.mov"].sha1, got["large.mov"].crc, got["large.mov"]["size"]) == (whole.hexdigest(), crc, size)
    assert (got["empty.jpg"].sha1, got["empty.jpg"].crc) == (hashlib.sha1().hexdigest(), 0)
    gone = spark.createDataFrame([("gone.jpg", 1)], "path string, size long")
    assert [tuple(r) for r in files.hashed(spark, str(tmp_path), gone).collect()] == [("gone.jpg", 1, None, None)]


class Counted(io.FileIO):
    """A file that counts the bytes read from it."""

    total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.total += len(data)
        return data


def test_only_directories_of_archives_are_read(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(20):
            z.writestr(f"Root/{k}.jpg", bytes(1 << 20))
        with z.open("Root/wide.mov", "w", force_zip64=True) as f:
            f.write(b"wide")
    with Counted(tmp_path / "big.zip") as f:
        found = trees.entries_of(f)
    assert len(found) == 21 and found[0] == ("Root/0.jpg", 1 << 20, zlib.crc32(bytes(1 << 20))) and found[-1][0] == "Root/wide.mov"
    assert f.total < 80_000
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:  # more entries than the plain end record can count
        for k in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{k}"), b"")
    with Counted(tmp_path / "many.zip") as f:
        assert len(trees.entries_of(f)) == 66_000


def test_zip_listings(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("Root/a.jpg", b"abc")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    for got in (files.zip_entries(spark, f"{tmp_path}/*.zip").collect(), files.zip_directories(spark, [f"{tmp_path}/x.zip", f"{tmp_path}/bad.zip"]).collect()):
        assert sorted([(r.name, r["size"], r.crc) for r in got], key=str) == sorted([("Root/a.jpg", 3, zlib.crc32(b"abc")), (None, None, None)], key=str)


def test_sidecars_and_lists(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps({"title": "t", "photoTakenTime": {"timestamp": "1000000000"}, "geoData": {"latitude": 0.0, "longitude": 0.0}, "geoDataExif": {"latitude": 1.5, "longitude": 2.0}}))
    (tmp_path / "s/b.json").write_text("not json")
    (tmp_path / "s/c.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "600000000"}}))
    got = {r.path[-6:]: (r.title, r.taken_at, r.lat) for r in files.sidecars(spark, f"{tmp_path}/s").collect()}
    assert got == {"a.json": ("t", "2001-09-09T01:46:40", 1.5), "b.json": (None, None, None), "c.json": (None, None, None)}
    (tmp_path / "l.json").write_text(json.dumps([{"uuid": "1", "filename": "x"}, {"uuid": "2"}]))
    assert files.library_list(spark, f"{tmp_path}/l.json").count() == 2
    (tmp_path / "r.tsv").write_text('MISSING\ta/"q.jpg\nUNREADABLE\tb.jpg\tdenied\n')
    assert [tuple(r) for r in files.report(spark, f"{tmp_path}/r.tsv").collect()] == [("MISSING", 'a/"q.jpg', None), ("UNREADABLE", "b.jpg", "denied")]


def test_snapshots(spark, tmp_path):
    folder = f"{tmp_path}/t"
    a = spark.createDataFrame([("x", 1, "s")], "path string, size int, sha1 string")
    sinks.write_snapshot(a, folder)
    old = sinks.read_snapshot(spark, folder)
    sinks.write_snapshot(old.unionByName(a), folder)
    assert old.count() == 1 and sinks.read_snapshot(spark, folder).count() == 2
    assert [tuple(r) for r in sinks.differences(sinks.read_snapshot(spark, folder), a).collect()] == [("only first", "x", 1, "s")]
    sinks.write_report(a, f"{tmp_path}/r")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/r", sep="\t").collect()] == [("x", "1", "s")]
    assert sinks.to_response(a) == [{"path": "x", "size": 1, "sha1": "s"}]
    with pytest.raises(ValueError):
        sinks.to_response(a.unionByName(a), 1)
    with pytest.raises(files.MissingTable):
        files.catalogue(spark, str(tmp_path), ["nothing"])
    with pytest.raises(files.MissingTable):
        sinks.read_snapshot(spark, f"{tmp_path}/nowhere")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception) as other:
        files.catalogue(spark, str(tmp_path), ["broken"])
    assert not isinstance(other.value, files.MissingTable)


def test_snapshots_are_numbered(spark, tmp_path):
    for k in range(12):
        sinks.write_snapshot(spark.range(k + 1), f"{tmp_path}/t")
    assert sinks.read_snapshot(spark, f"{tmp_path}/t").count() == 12
    for state in (tmp_path / "t/_states").iterdir():
        os.utime(state, (1, 1))  # times of files don't matter
    assert sinks.read_snapshot(spark, f"{tmp_path}/t").count() == 12 == sinks.state_number(spark, f"{tmp_path}/t")
    assert sinks.read_snapshot(spark, f"{tmp_path}/t", 3).count() == 3
    with pytest.raises(files.MissingTable):
        sinks.read_snapshot(spark, f"{tmp_path}/t", 13)


def test_two_writers_lose_nothing(spark, tmp_path):
    at = f"{tmp_path}/t"
    marks = spark.createDataFrame([(k, None) for k in range(20)], "id int, used string")
    first = sinks.write_snapshot(marks, at, after=0)
    with pytest.raises(sinks.Conflict):
        sinks.write_snapshot(marks, at, after=0)
    stamp = lambda old, which, by: old.withColumn("used", F.when(which & F.col("used").isNull(), by).otherwise(F.col("used")))
    mine = stamp(sinks.read_snapshot(spark, at, first), F.col("id") % 2 == 0, "mine")
    seen = []

    def slow(old):
        """Another writer publishes while this change is computed for the first time."""
        if not seen:
            sinks.write_snapshot(mine, at, after=first)
        seen.append(old.filter("used is not null").count())
        return stamp(old, F.col("id") % 3 == 0, "theirs")

    assert sinks.update_snapshot(spark, at, slow) == 3 and seen == [0, 10]
    got = {r.id: r.used for r in sinks.read_snapshot(spark, at).collect()}
    assert got == {k: "mine" if k % 2 == 0 else "theirs" if k % 3 == 0 else None for k in range(20)}
    with pytest.raises(sinks.Conflict):
        sinks.write_snapshot(mine, at, after=first)
    with pytest.raises(sinks.Conflict):
        sinks.update_snapshot(spark, at, lambda old: sinks.write_snapshot(old, at) and old, tries=2)


def test_many_writers_at_once(spark, tmp_path):
    at = f"{tmp_path}/t"
    sinks.write_snapshot(spark.createDataFrame([], "id int"), at)
    add = lambda k: sinks.update_snapshot(spark, at, lambda old: old.union(spark.createDataFrame([(k,)], "id int")), tries=30)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(add, range(8)))
    assert sorted(numbers) == list(range(2, 10))
    assert sorted(r.id for r in sinks.read_snapshot(spark, at).collect()) == list(range(8))
    taken = [sinks._publish(spark, at, 50, {"version": str(k)}) for k in range(3)]
    assert taken == [True, False, False] and sinks._state(spark, at, 50) == {"version": "0"}
    assert not [p.name for p in (tmp_path / "t/_states").iterdir() if not p.name.isdigit() and not p.name.endswith(".crc")]


def test_a_catalogue_is_read_in_one_state(spark, tmp_path):
    root = f"{tmp_path}/c"
    frame = lambda *ids: spark.createDataFrame([(k,) for k in ids], "id int")
    ids = lambda df: sorted(r.id for r in df.collect())
    one = sinks.Catalogue(spark, root).publish({"files": frame(1, 2), "marks": frame(1)})
    reader = sinks.Catalogue(spark, root)
    files_before = ids(reader.table("files"))
    two = one.publish({"files": frame(3), "marks": frame(3), "more": frame()})
    assert files_before == [1, 2] and ids(reader.table("marks")) == [1]  # published between two reads
    assert (ids(two.table("files")), ids(two.table("marks")), two.number) == ([3], [3], 2)
    assert ids(sinks.Catalogue(spark, root, 1).table("files")) == [1, 2]
    with pytest.raises(sinks.Conflict):
        reader.publish({"marks": frame(9)})
    with pytest.raises(files.MissingTable):
        one.table("more")
    with pytest.raises(files.MissingTable):
        sinks.Catalogue(spark, root, 7)

    def forget(now):
        if now.number == 2:
            two.publish({"marks": frame(3, 4)})
        return {"files": now.table("files").join(now.table("marks"), "id", "left_anti")}

    assert sinks.update_catalogue(spark, root, forget).number == 4
    now = sinks.Catalogue(spark, root)
    now.register()
    assert spark.sql("select count(*) from marks").first()[0] == 2 and ids(now.table("files")) == []


def test_a_failed_read_loses_nothing(spark, tmp_path, monkeypatch):
    schema = "path string, size int, scanned_at string"
    spark.createDataFrame([(f"f{k}", 1, "1") for k in range(100)], schema).write.parquet(f"{tmp_path}/in")
    catch_up = lambda: incremental.catch_up(incremental.scan_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/t", f"{tmp_path}/c", ["path"])
    catch_up()
    spark.createDataFrame([("f0", 2, "2")], schema).write.mode("append").parquet(f"{tmp_path}/in")

    def fails(*_):
        raise OSError("the store does not answer")

    with monkeypatch.context() as m:
        m.setattr(sinks, "read_snapshot", fails)
        with pytest.raises(Exception, match="does not answer"):
            catch_up()
    assert sinks.read_snapshot(spark, f"{tmp_path}/t").count() == 100
    catch_up()
    assert {r.path: r["size"] for r in sinks.read_snapshot(spark, f"{tmp_path}/t").collect()} == {f"f{k}": 2 if k == 0 else 1 for k in range(100)}


def test_only_one_process_may_stage_in_a_folder_of_its_own():
    conf, context = SimpleNamespace(get=lambda *_: None), SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_incremental_stream(spark, tmp_path):
    schema = "path string, size int, scanned_at string"
    for rows in ([("a", 1, "1"), ("b", 1, "1")], [("a", 2, "2"), ("a", 3, "3")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.catch_up(incremental.scan_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/t", f"{tmp_path}/c", ["path"])
    assert {r.path: r["size"] for r in sinks.read_snapshot(spark, f"{tmp_path}/t").collect()} == {"a": 3, "b": 1}
