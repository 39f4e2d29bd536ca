"""Pages over a small catalogue made of the driver's smallest tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.operators import browse, similar
from larkspur.plans import pages
from larkspur.plans.queries import base, log, takes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalogue(spark):
    c = {n: base(spark, SF, n) for n in ("files", "overrides", "excluded", "marks", "hashes")}
    grouped = similar.flagged(base(spark, SF, "grouped"), c["files"], c["hashes"])
    seen = base(spark, SF, "vision").withColumn("detail", F.lit('[{"b":[0,0,1,1],"k":[],"e":"closed","l":"camera"}]'))
    approvals = spark.createDataFrame([], "id int, keep_src string, remove_src string, cap int, used_batch string")
    return c | {"grouped": grouped, "info": similar.spans(grouped, c["files"]), "vision": seen, "approvals": approvals, "log": log(spark, SF), "takes": takes(spark, SF)}


def test_grid(catalogue):
    got = pages.grid(catalogue, browse.Browse(kind="photo", source="nowhere"), size=10)
    total = got["total"].first().n
    assert got["page"].count() == 10 and total > 10 and got["grand"].first().n == sum(r.n for r in got["sources"].collect())
    one = got["sources"].first()
    assert pages.grid(catalogue, browse.Browse(source=one.source))["total"].first().n == one.n
    assert got["years"].count() > 3


def test_map_and_timeline(catalogue):
    box = browse.Browse(bbox="-60,-120,60,120")
    got = pages.world(catalogue, box, 3)
    inside = sum(r.n for r in got["cells"].collect())
    assert 0 < inside < got["bounds"].first().n
    whole = sum(r.total for r in pages.timeline(catalogue, 2024).collect())
    assert whole > sum(r.total for r in pages.timeline(catalogue, 2024, dated=True).collect()) > 0
    assert pages.timeline(catalogue, 2024, source="nowhere").count() == 0


def test_detail(catalogue):
    got = pages.detail(catalogue, 2)
    assert got["file"].count() == 1 and got["similar"].count() > 0
    assert {n: f.count() for n, f in got.items()}["partner"] in (0, 1)


def test_clean_up(catalogue):
    got = pages.clean_up(catalogue, ["src3"], ["src1"], datetime(2024, 2, 15))
    rules = got["rules"].collect()
    assert got["todo"].count() == 0 and got["batches"].count() > 5 and got["purgeable"].count() > 5
    if rules:
        page = pages.rule(catalogue, ["src3"], ["src1"], rules[0].keep_src, rules[0].remove_src, sort="random")
        assert page.count() == min(60, rules[0].n)


def test_review(catalogue):
    got = pages.review(catalogue, size=5)
    ids = {r.group_id for r in got["groups"].collect()}
    assert len(ids) == 5 and {r.group_id for r in got["decisions"].collect()} == ids == {r.group_id for r in got["members"].collect()}
    assert got["shown"].first().n >= 5 and got["totals"].first().total > 0
    assert pages.take(catalogue, next(iter(ids)))["base"].count() <= 1


def test_a_list_is_loaded_while_groups_leave_it():
    pending, shown, seen = list(range(60)), pages.Shown(25), []
    while not shown.ended:
        seen += shown.add(pending[shown.start() : shown.start() + 25])
        done = seen[::3]  # decided meanwhile
        pending = [k for k in pending if k not in done]
        shown.left(done)
    assert seen == list(range(60)) == shown.ids and not shown.add([3, 4]) and shown.ended
