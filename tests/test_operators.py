"""Invariants of the catalogue operators on hand-made and random tables."""

import itertools
import math
import random
import threading
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import browse, decisions, duplicates, graph, paging, reconcile, sidecars, similar, vision
from larkspur.plans import queries

FILES = "id long, path string, kind string, size long, sha1 string, pair_key string, has_sidecar int"


def plan_inputs(spark):
    files = spark.createDataFrame(
        [
            (1, "b/x.jpg", "photo", 5, "A", None, 0),
            (2, "a/x.jpg", "photo", 5, "A", None, 0),
            (3, "c/x.jpg", "photo", 5, "A", "p1", 0),
            (4, "b/lone.mov", "video", 9, "L", "p2", 0),
            (5, "b/still.jpg", "photo", 7, "B", "p2", 1),
            (6, "a/still.jpg", "photo", 7, "B", None, 0),
            (7, "b/still2.jpg", "photo", 7, "B", "p2", 0),
            (8, "b/null.mov", "video", 1, None, "p3", 0),
            (9, "b/n.jpg", "photo", 3, "C", "p3", 0),
            (10, "a/n.jpg", "photo", 3, "C", "p4", 0),
            (11, "b/e1.jpg", "photo", 2, "D", None, 0),
            (12, "b/e22.jpg", "photo", 2, "D", None, 0),
            (13, "b/e333.jpg", "photo", 2, "D", None, 0),
            (14, "a/same-sha-other-size.jpg", "photo", 99, "A", None, 0),
        ],
        FILES,
    )
    overrides = spark.createDataFrame([("b/e1.jpg", "2001"), ("b/e22.jpg", "2002"), ("b/e333.jpg", "2001")], "path string, taken_at string")
    return files, overrides


def test_plan(spark):
    files, overrides = plan_inputs(spark)
    excluded = spark.createDataFrame([("b/e333.jpg",)], "path string")
    got = {r.victim: (r.keeper, r.reason) for r in duplicates.plan(files, overrides, excluded, ["a", "b"]).collect()}
    assert got == {
        "b/x.jpg": ("c/x.jpg", None),
        "a/x.jpg": ("c/x.jpg", None),
        "a/still.jpg": ("b/still.jpg", None),
        "b/still2.jpg": ("b/still.jpg", duplicates.ORPHAN),
        "b/n.jpg": ("a/n.jpg", duplicates.ORPHAN),
        "b/e22.jpg": ("b/e1.jpg", duplicates.CONFLICT),
        "b/e333.jpg": ("b/e1.jpg", duplicates.EXCLUDED),
    }


def test_plan_invariants(spark):
    r = random.Random(4)
    rows = [(i, f"{r.choice('abc')}/{i}.jpg", "photo", r.randint(1, 2), r.choice("ABCDE"), r.choice([None, "p1", "p2", "p3"]), r.randint(0, 1)) for i in range(120)]
    files = spark.createDataFrame(rows, FILES)
    none = spark.createDataFrame([], "path string, taken_at string")
    plan = duplicates.plan(files, none, none.select("path"), ["b"]).collect()
    groups = defaultdict(set)
    for row in rows:
        groups[row[4], row[3]].add(row[1])
    victims = Counter(p.victim for p in plan)
    assert max(victims.values()) == 1
    for key, paths in groups.items():
        own = [p for p in plan if (p.sha1, p.size) == key]
        assert len({p.keeper for p in own}) <= 1 and ({p.victim for p in own} | {p.keeper for p in own} == paths or len(paths) == 1)


def test_allocation_of_two_approvals(spark):
    plan = spark.createDataFrame([("a", "b", None, "k", f"b/{i}") for i in range(4)] + [("a", "b", "held", "k", "b/0x")], "keep_src string, remove_src string, reason string, keeper string, victim string")
    approvals = spark.createDataFrame([(1, "a", "b", 2, None), (2, "a", "b", 9, "used"), (3, "a", "b", 3, None), (4, "z", "b", 3, None)], "id int, keep_src string, remove_src string, cap int, used_batch string")
    assert sorted((r.approval_id, r.victim) for r in duplicates.allocate(plan, approvals).collect()) == [(1, "b/0"), (1, "b/1"), (3, "b/2"), (3, "b/3")]
    assert duplicates.allocate(plan, approvals.limit(0)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=2, max_size=25), st.integers(0, 7), st.randoms())
def test_edges_are_all_close_pairs(spark, hashes, threshold, r):
    hashes = hashes + [h ^ sum(1 << b for b in r.sample(range(63), r.randint(0, threshold + 1))) for h in hashes]
    df = spark.createDataFrame(list(enumerate(hashes)), "key long, hash long")
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    wanted = {(i, j, far(hashes[i], hashes[j])) for i, j in itertools.combinations(range(len(hashes)), 2) if far(hashes[i], hashes[j]) <= threshold}
    assert {tuple(x) for x in similar.edges(df, threshold).collect()} == wanted


def plain_groups(values, threshold, limit):
    far = lambda a, b: ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count()
    close = sorted((far(a, b), a, b) for a, b in itertools.combinations(sorted(values), 2) if far(a, b) <= threshold)
    of = {k: {k} for k in values}
    for _, a, b in close:
        if of[a] is not of[b] and all(far(x, y) <= limit for x in of[a] for y in of[b]):
            whole = of[a] | of[b]
            for k in whole:
                of[k] = whole
    return {frozenset(v) for v in of.values() if len(v) > 1}


def test_groups(spark):
    r = random.Random(2)
    values = {}
    for c in range(12):
        centre = r.getrandbits(64)
        for k in range(6):
            h = centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
            values[f"{c:02d}-{k}"] = h - (1 << 64) if h >> 63 else h
    values |= {"chain0": 0, "chain1": 0b11111, "chain2": 0b1111111111}
    df = spark.createDataFrame(list(values.items()), "key string, hash long")
    got = defaultdict(set)
    for row in similar.groups(df).collect():
        got[row.group_id].add(row.key)
    assert {frozenset(v) for v in got.values()} == plain_groups(values, 5, 8)
    assert all(g == min(v) for g, v in got.items())
    again = defaultdict(set)
    for row in similar.groups(df.repartition(7)).collect():
        again[row.group_id].add(row.key)
    assert again == got


def test_groups_of_real_prints(spark):
    prints = queries.text_prints(spark, "/root/testdata/sf0.01")
    values = {r.key: r.hash for r in prints.collect()}
    got = defaultdict(set)
    for row in similar.groups(prints).collect():
        got[row.group_id].add(row.key)
    assert {frozenset(v) for v in got.values()} == plain_groups(values, 5, 8) and all(g == min(v) for g, v in got.items()) and got


@pytest.mark.parametrize("shape", ["tree", "ball", "chain"])
def test_rounds_merge_like_closest_first(spark, monkeypatch, shape):
    """A component too large for one task: the same groups by rounds over blocks of clusters."""
    monkeypatch.setattr(similar, "LARGE", {"tree": 0, "ball": 60, "chain": 0}[shape])
    monkeypatch.setattr(similar, "BLOCK", 25)
    r = random.Random(len(shape))
    flip = lambda h, most: h ^ sum(1 << b for b in r.sample(range(64), r.randint(1, most)))
    values = [r.getrandbits(64)]
    for k in range({"tree": 260, "ball": 120, "chain": 40}[shape]):
        values.append(flip({"tree": r.choice(values), "ball": values[0], "chain": values[-1]}[shape], {"tree": 4, "ball": 5, "chain": 2}[shape]))
    names = list(range(len(values)))
    r.shuffle(names)
    values = {f"k{n:04d}": h - (1 << 64) if h >> 63 else h for n, h in zip(names, dict.fromkeys(values), strict=False)}
    got = defaultdict(set)
    for row in similar.groups(spark.createDataFrame(list(values.items()), "key string, hash long")).collect():
        got[row.group_id].add(row.key)
    assert {frozenset(v) for v in got.values()} == plain_groups(values, 5, 8) and all(g == min(v) for g, v in got.items()) and got


def test_links_and_classes_are_all_edges(spark):
    r = random.Random(8)
    values = [sum(1 << b for b in r.sample(range(16), r.randint(0, 6))) for _ in range(120)] + [7] * 40
    df = spark.createDataFrame([*enumerate(values), (500, None)], "key long, hash long").repartition(3)
    members, linked = similar.classes(df), similar.links(df, 3)
    rep = {row.key: row.rep for row in members.collect()}
    assert rep == {k: values.index(v) for k, v in enumerate(values)}
    far = lambda a, b: (values[a] ^ values[b]).bit_count()
    reps = sorted(set(rep.values()))
    assert sorted(map(tuple, linked.collect())) == sorted((a, b, far(a, b)) for a, b in itertools.combinations(reps, 2) if far(a, b) <= 3)
    asked = spark.createDataFrame([(k,) for k in (0, 3, 125, 500, 999)], "key long")
    want = sorted((k, o, far(k, o)) for k in (0, 3, 125) for o in range(160) if o != k and far(k, o) <= 3)
    assert sorted(map(tuple, similar.partners(asked, linked, members).collect())) == want


def test_crowded_buckets_are_told(spark):
    df = spark.createDataFrame([(i, i << 60) for i in range(8)], "key long, hash long")
    assert {r.n for r in similar.crowded(df, 5, 7).collect()} == {8}


def test_no_pair_is_lost_in_crowded_buckets(spark, monkeypatch):
    # More equal hashes than the old limit of a bucket, and one that meets them only there.
    equal = spark.range(2600).selectExpr("id AS key", "7L AS hash").union(spark.createDataFrame([(9000, 6), (9001, -1)], "key long, hash long"))
    assert similar.edges(equal, 5).count() == 2600 * 2599 // 2 + 2600
    assert {(r.group_id, r.key) for r in similar.groups(equal).collect()} == {(0, k) for k in [*range(2600), 9000]}
    # Chunks and parts change nothing.
    monkeypatch.setattr(similar, "CROWDED", 4)
    monkeypatch.setattr(similar, "PART", 2)
    r = random.Random(4)
    values = [sum(1 << b for b in r.sample(range(12), r.randint(0, 5))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(values)), "key long, hash long")
    near = {(i, j, (values[i] ^ values[j]).bit_count()) for i, j in itertools.combinations(range(150), 2) if (values[i] ^ values[j]).bit_count() <= 3}
    assert sorted(map(tuple, similar.edges(df, 3).collect())) == sorted(near)


def test_flags_and_spans(spark):
    g = spark.createDataFrame([(1, p) for p in "abcd"] + [(2, "e"), (2, "f")], "group_id int, path string")
    files = spark.createDataFrame([("a", 5, 10, 10, "exif", "2001-01-01T00:00:00"), ("b", 6, 10, 10, "exif", "2001-01-01T00:01:05"), ("c", 9, None, 10, "mtime", "2020-01-01T00:00:00"), ("d", 1, 1, 1, "exif", "nonsense"), ("e", 1, 1, 1, "exif", "2001-01-01T00:00:00"), ("f", 1, 1, 1, None, None)], "path string, size long, width int, height int, date_source string, taken_at string")
    hashes = spark.createDataFrame([("a", 0.0), ("b", None), ("d", 0.5)], "path string, sharp double")
    flags = {r.path: (r.is_best, r.is_sharpest) for r in similar.flagged(g, files, hashes).collect()}
    assert flags == {"a": (0, 0), "b": (1, 0), "c": (0, 0), "d": (0, 1), "e": (1, 1), "f": (0, 0)}
    assert {r.group_id: r.span_s for r in similar.spans(g, files).collect()} == {1: 65, 2: None}


@pytest.mark.parametrize("at_once", [1_000_000, -1])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 95), (95, 91)], "a long, b long")
    assert {r.key: r.root for r in graph.components(links).collect()} == {i: 0 for i in range(51)} | {90: 90, 91: 90, 95: 90}


def test_sidecar_matching(spark):
    s = ".supplemental-metadata"
    media = ["IMG.jpg", "IMG(1).jpg", "OLD.jpg", "E-edited.jpg", "a_very_long_name_that_is_cut_off.jpg", "another_long_name_of_a_file.jpg", "NONE.jpg", "MV.MP4", "PXL.MP"]
    jsons = [("IMG.jpg" + s + ".json", "x"), ("IMG.jpg" + s + "(1).json", "x"), ("OLD.jpg.json", "x"), ("E.jpg.json", "x"), ("a_very_long_name_that_is_cut.json", "a_very_long_name_that_is_cut_off.jpg"), ("a_very_long_name_that.json", "a_very_long_name_that_is_cut_off.jpg"), ("another_long_name_of_a_f.json", "wrong title.jpg"), ("NO.json", "NONE.jpg"), ("MV.jpg.json", "x"), ("PXL.MP.jpg.json", "x")]
    m = spark.createDataFrame([("d", f) for f in [*media, "MV.jpg", "PXL.MP.jpg"]], "folder string, file string")
    j = spark.createDataFrame([("d", *x) for x in jsons], "folder string, sidecar string, title string")
    found = sidecars.sidecars(m, j)
    got = {r.file: r.sidecar for r in found.collect()}
    assert got == {"IMG.jpg": jsons[0][0], "IMG(1).jpg": jsons[1][0], "OLD.jpg": "OLD.jpg.json", "E-edited.jpg": "E.jpg.json", media[4]: jsons[4][0], "MV.jpg": "MV.jpg.json", "PXL.MP.jpg": "PXL.MP.jpg.json"}
    assert {r.file: r.sidecar for r in sidecars.borrowed(m, found, [".mp4", ".mp"]).collect()} == {"MV.MP4": "MV.jpg.json", "PXL.MP": "PXL.MP.jpg.json"}
    assert {r.sidecar for r in sidecars.unclaimed(j, found).collect()} == {"a_very_long_name_that.json", "another_long_name_of_a_f.json", "NO.json"}


def test_pair_keys(spark):
    rows = [(1, "a/I.HEIC", "photo", "c1"), (2, "b/J.MOV", "video", "c1"), (3, "a/K_HEVC.MOV", "video", "c9"), (4, "a/K.HEIC", "photo", None), (5, "a/P.MP", "video", None), (6, "a/P.MP.jpg", "photo", ""), (7, "a/Q.jpg", "photo", None), (8, "a/q.png", "photo", None)]
    got = {r.id: r.pair_key for r in browse.pair_keys(spark.createDataFrame(rows, "id int, path string, kind string, content_id string")).collect()}
    assert got == {1: "cid:c1", 2: "cid:c1", 3: "stem:a/k", 4: "stem:a/k", 5: "stem:a/p.mp", 6: "stem:a/p.mp", 7: None, 8: None}


def test_timeline_fills_years_and_months(spark):
    rows = spark.createDataFrame([("1999-03-01T00:00:00",), ("2002-03-05",), ("2002-12-05",), ("1980-01-01",), ("2999-01-01",), (None,), ("x",)], "taken_at string")
    got = [(r.year, r.m03, r.m12, r.total, r.fullest) for r in browse.timeline(rows, 2024).orderBy("year").collect()]
    assert got == [(1999, 1, 0, 1, 1), (2000, 0, 0, 0, 1), (2001, 0, 0, 0, 1), (2002, 1, 1, 2, 1)]
    assert browse.timeline(rows.limit(0), 2024).count() == 0


def test_decisions_leave_used_marks_alone(spark):
    marks = spark.createDataFrame([("a", "keep", None, "t0", None), ("b", "discard", "a", "t0", "b1"), ("c", "trash", None, "t0", None)], "path string, mark string, keeper string, set_at string, used_batch string")
    s = spark.createDataFrame([(1, "a", "later"), (1, "b", "later"), (2, "d", "d"), (2, "e", "d"), (3, "f", "nobody"), (4, "g", "trash")], "submission int, path string, pick string")
    ok = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "submission int, ok boolean")
    got = {r.path: (r.mark, r.keeper) for r in decisions.decide(marks, s, ok, "t1").collect()}
    assert got == {"b": ("discard", "a"), "c": ("trash", None), "d": ("keep", None), "e": ("discard", "d")}


def test_batches_and_purging(spark):
    log = spark.createDataFrame([("b1", "x", 5, "2024-01-01T00:00:00", None, None), ("b1", "y", 6, "2024-01-02T00:00:00", "r", None), ("b2", "z", 7, "2024-05-20T00:00:00", None, None), ("b3", "w", 1, "2024-01-01T00:00:00", None, "p")], "batch string, path string, size long, moved_at string, restored_at string, purged_at string")
    assert {r.batch: (r.n, r.held, r.held_bytes) for r in decisions.batches(log).collect()} == {"b1": (2, 1, 5), "b2": (1, 1, 7), "b3": (1, 0, 0)}
    assert {r.batch: r.may_purge for r in decisions.purgeable(log, datetime(2024, 6, 1)).collect()} == {"b1": True, "b2": False}
    assert [r.path for r in decisions.restorable(log, "b1", "X").collect()] == ["x"]


def test_missing_files_are_classified(spark):
    rows = [("MISSING", "a/x.aae", False), ("MISSING", "a/L.photoslibrary/database.lock", False), ("MISSING", "a/L.photoslibrary/library.db", False), ("MISSING", "a/L.photoslibrary/private/x.jpg", False), ("MISSING", "a/L.photoslibrary/originals/x.jpg", False), ("MISSING", "g/GX01.LRV", False), ("MISSING", "g/GX02.THM", False), ("UNREADABLE", "a/y.aae", True), ("UNREADABLE", "a/z.jpg", False), ("MISSING", "b/Snagit/a.png", False)]
    names = spark.createDataFrame([("gx01.mp4",)], "name string")
    got = [r["class"] for r in sorted(reconcile.classify_missing(spark.createDataFrame(rows, "kind string, path string, broken_link boolean"), names).collect(), key=lambda r: rows.index((r.kind, r.path, r.broken_link)))]
    assert got == ["metadata", "junk", "metadata", "junk", "real", "junk", "real", "junk", "real", "junk"]


def test_take_base_and_sampling(spark):
    m = spark.createDataFrame([(1, "a", 2, 1, 3.0), (1, "b", 2, 1, 4.0), (2, "c", 3, 3, 1.0)], "group_id int, path string, seen int, closed int, sharp double")
    assert {r.group_id: (r.base, r.reliable) for r in vision.take_base(m).collect()} == {1: ("b", True), 2: ("c", False)}
    big = spark.range(500).select(F.col("id").cast("string").alias("path"))
    assert vision.sample(big, 9, 1).collect() == vision.sample(big.repartition(5), 9, 1).collect() != vision.sample(big, 9, 2).collect()


def test_list_problem(spark):
    df = spark.createDataFrame([("a", 1)], "filename string, size int")
    assert "file size" in reconcile.list_problem(df) and reconcile.list_problem(df.withColumnRenamed("size", "filesize")) is None


@pytest.mark.parametrize("kind", ["keep", "trash", "mixed"])
def test_group_decisions(spark, kind):
    marks = {"keep": ["keep", "keep"], "trash": ["trash", "trash"], "mixed": ["discard", "keep"]}[kind]
    rows = spark.createDataFrame([(1, f"p{i}", m, 1, 1, 5, False, None, None, None, None) for i, m in enumerate(marks)], "group_id int, path string, mark string, width int, height int, size int, has_geo boolean, pair_key string, sharp double, eyes_closed int, faces int")
    assert similar.decisions(rows).first().chosen == {"keep": "all", "trash": "trash", "mixed": "p1"}[kind]


@pytest.mark.parametrize("names", [("-taken_at", "-id"), ("taken_at", "id"), ("-size", "taken_at", "id"), ("path", "id")])
def test_pages_by_cursor(spark, tmp_path, names):
    """All pages one after the other are the whole list, with nulls and ties; a page is read with a filter on its first key."""
    r = random.Random(3)
    rows = [(i, f"p{r.randint(0, 9)}'é", r.choice([None, "2019-01-01T00:00:00", "2020-05-05T00:00:00", "2001-02-03T04:05:06"]), r.choice([None, 1.5, 0.1, 7.0])) for i in range(60)]
    at = f"{tmp_path}/rows"
    spark.createDataFrame(rows, "id long, path string, taken_at string, size double").write.parquet(at)
    df, by = spark.read.parquet(at), paging.keys(*names)
    whole, got, last = [x.id for x in df.orderBy(*paging.ordered(by)).collect()], [], ""
    while True:
        chunk = paging.next_page(df, by, 7, last).collect()
        got += [x.id for x in chunk]
        if len(chunk) < 7:
            break
        last = paging.cursor(chunk[-1], by)
    assert got == whole
    plan = paging.next_page(df, by, 7, paging.cursor(df.filter(f"{by[0].column} is not null").first(), by))._jdf.queryExecution().toString()
    assert "Offset" not in plan and by[0].column in plan.split("PushedFilters: [")[1].split("]")[0]
    for wrong in ("[]", '["1"]', "{}", "[1, 2, 3, 4]"):
        with pytest.raises(ValueError):
            paging.after(df, by, wrong)


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts of more than 64 KB are errors, as those of gigabytes are by default."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def close_couples(spark, n=3000):
    return spark.range(n).selectExpr("id AS key", "xxhash64(id div 2) ^ (id % 2) AS hash")


def test_links_broadcast_nothing_that_grows(spark, small_broadcasts):
    assert similar.links(close_couples(spark), 5).filter("d = 1 and a + 1 = b").count() == 1500


def test_edges_broadcast_nothing_that_grows(spark, small_broadcasts):
    assert similar.edges(close_couples(spark), 5).filter("d = 1 and a + 1 = b").count() == 1500


def test_groups_broadcast_nothing_that_grows(spark, small_broadcasts):
    assert similar.groups(close_couples(spark)).count() == 3000


NEED, OFFER = "group_id int, face int, box array<double>", "group_id int, donor int, box array<double>"


def test_donors_are_the_nearest_that_fit(spark):
    r = random.Random(6)
    box = lambda: (lambda x, y, w: [x, y, x + w, y + r.choice([w, 5.0])])(r.choice([0.0, r.uniform(-90, 90)]), r.choice([0.0, -0.0, r.uniform(-30, 30)]), r.choice([8.0, 16.0, 2 ** r.uniform(-2, 6)]))
    odd = [None, [1.0, 1.0, 1.0, 9.0], [9.0, 0.0, 1.0, 5.0], [float("nan"), 0.0, 8.0, 5.0], [0.0, 0.0, float("inf"), 5.0], [1e300, 0.0, 2e300, 5.0], [1.2e300, 0.0, 2.2e300, 5.0]]
    need = [(k % 3, k // 2, b) for k, b in enumerate([*odd, *(box() for _ in range(300))])]
    offer = [(k % 3, k, b) for k, b in enumerate([*odd, *(box() for _ in range(300))])] + [(0, None, need[30][2])]
    want = {}
    for g, face, a in need:
        for h, donor, b in offer:
            if g == h and a and b and a[2] > a[0] and a[2] < float("inf") and 0.7 < (b[2] - b[0]) / (a[2] - a[0]) < 1.4:
                d = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
                if d < 0.6 * (a[2] - a[0]):
                    want[g, face] = min(want.get((g, face), (math.inf, 0)), (d, -1 if donor is None else donor))
    got = vision.donors(spark.createDataFrame(need, NEED), spark.createDataFrame(offer, OFFER)).collect()
    assert len(want) > 40 and {(x.group_id, x.face): -1 if x.donor is None else x.donor for x in got} == {k: v[1] for k, v in want.items()}
    assert len(got) == len(want) and all(abs(x.distance - want[x.group_id, x.face][0]) < 1e-9 for x in got)


def test_donors_of_a_group_of_many_faces(spark):
    """Every face with every donor of its group would be 40 billion pairs."""
    rows = spark.range(200_000).selectExpr("1 AS group_id", "cast(id AS int) AS face", "array(double(id % 900), 0D, id % 900 + 20D, 10D) AS box")
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = vision.donors(rows, rows.withColumnRenamed("face", "donor"))
        assert got.filter("distance = 0 and donor = face % 900").count() == 200_000
    finally:
        late.cancel()
