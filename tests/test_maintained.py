"""What is kept so that later work follows the change: aggregates by deltas, digests, files along a curve, buckets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import layout, maintained, similar
from larkspur.sources import files as sources
from larkspur.sources import sinks, staging

MARKS = "path string, mark string, used_batch string"


def test_aggregates_follow_any_decisions(spark):
    r = random.Random(5)
    paths = [f"p{k:02d}" for k in range(40)]
    grouped = spark.createDataFrame([(k // 4, p) for k, p in enumerate(paths[:32])], "group_id int, path string")
    files = spark.createDataFrame([(p, 10 + k) for k, p in enumerate(paths[:37])], "path string, size long")  # some marks have no file any more
    marks: dict[str, tuple] = {}
    frame = lambda m: spark.createDataFrame([(p, *v) for p, v in sorted(m.items())], MARKS)
    stored = staging.staged(maintained.counted(grouped, files, frame(marks)), "stored")
    for _ in range(6):
        touched = r.sample(paths, r.randint(0, 15))
        after = dict(marks)
        for p in touched:
            after.pop(p, None)
            if r.random() < 0.8:
                after[p] = (r.choice(["keep", "trash", "discard"]), r.choice([None, None, "b1"]))
        part = lambda m: frame({p: m[p] for p in touched if p in m})  # noqa: B023, E731
        stored = staging.staged(maintained.applied(stored, maintained.delta(grouped, files, part(marks), part(after))), "stored")
        marks = after
        now = frame(marks)
        assert sorted(map(str, stored.collect())) == sorted(map(str, maintained.counted(grouped, files, now).collect()))
        assert maintained.totals(stored).first() == similar.review_totals(grouped, files, now).first()
    state = {r.group_id: r.state for r in maintained.decided(stored).collect()}
    for g in range(8):
        own = [marks.get(p, (None,))[0] for p in paths[4 * g : 4 * g + 4]]
        assert state[g] == ("all" if set(own) == {"keep"} else "trash" if set(own) == {"trash"} else "decided" if None not in own else "open")


def test_boxes_read_their_cells(spark, tmp_path):
    r = random.Random(7)
    places = [(k, r.uniform(-90, 90), r.uniform(-180, 180)) for k in range(600)] + [(1000 + k, 47.5, 8.5) for k in range(300)]
    places += [(2000, 90.0, 180.0), (2001, -90.0, -180.0), (2002, None, 3.0), (2003, 0.0, 0.0)]
    at = f"{tmp_path}/located"
    layout.write_located(spark.createDataFrame(places, "id int, lat double, lon double"), at, 8)
    rows = spark.read.parquet(at)
    whole = {f.rpartition("/")[0] for f in rows.inputFiles()}
    for box in [(-90.0, -180.0, 90.0, 180.0), (40.0, 0.0, 50.0, 10.0), (47.5, 8.5, 47.5, 8.5), (0.0, 0.0, 0.0, 0.0), (80.0, 170.0, 90.0, 180.0), *[(a, b, a + r.uniform(0, 60), b + r.uniform(0, 90)) for a, b in [(r.uniform(-90, 60), r.uniform(-180, 100)) for _ in range(6)]]]:
        got = layout.within(rows, box)
        assert sorted(x.id for x in got.collect()) == sorted(i for i, lat, lon in places if lat is not None and box[0] <= lat <= box[2] and box[1] <= lon <= box[3])
        plan = got._jdf.queryExecution().toString()
        assert "cell#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(lat" in plan.split("PushedFilters: [")[1]
    few = layout.cells_of((40.0, 0.0, 50.0, 10.0))
    assert len(few) < 0.1 * len(whole) <= 26 and len(layout.cells_of((-90.0, -180.0, 90.0, 180.0))) == 256
    # Neighbours on the curve are neighbours on the map: cells are the curve's first bits.
    assert rows.filter(layout.cell(F.col("lat"), F.col("lon")) != F.col("cell")).count() == 0


@pytest.mark.parametrize("kept", [False, True])
def test_only_unequal_buckets_are_compared(spark, kept, monkeypatch):
    r = random.Random(2)
    rows = [(f"p{k}", r.choice([None, k, 7]), r.choice([None, "", "s"])) for k in range(500)] + [(None, 1, "x")]
    other = rows[:400] + rows[:3] + [(p, (n or 0) + 1, s) for p, n, s in rows[400:410]] + rows[412:] + [("new", 1, None), ("p1", rows[1][1], "" if rows[1][2] is None else None)]
    schema = "path string, size int, sha1 string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema).repartition(3)
    seen = []
    plain = sinks.differences
    monkeypatch.setattr(sinks, "differences", lambda x, y, keys: seen.append((x.count(), y.count())) or plain(x, y, keys))
    keys = ("path", "size", "sha1")
    digests = tuple(staging.staged(sinks.bucket_digests(t, "path", keys, 10), "digests") for t in (a, b)) if kept else None
    got = sinks.differences_by_digest(a, b, bits=10, digests=digests)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain(a, b, keys).collect()))
    assert seen[0][0] < 60 and seen[0][1] < 60
    assert sinks.differences_by_digest(a, a.repartition(5), bits=10).count() == 0 and seen[1] == (0, 0)


def test_a_bucketed_catalogue_is_not_shuffled(spark, tmp_path):
    known = spark.range(2000).selectExpr("concat('p', id) AS path", "id AS size", "id AS mtime_ns")
    table = sinks.write_bucketed(known, "known_files", f"{tmp_path}/known", 4)
    listing = spark.range(1990, 2010).selectExpr("concat('p', id) AS path", "CASE WHEN id = 1995 THEN 0 ELSE id END AS size", "id AS mtime_ns")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sources.changed(listing, table)
        assert {r.path for r in got.collect()} == {"p1995", *(f"p{k}" for k in range(2000, 2010))}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table known_files")
