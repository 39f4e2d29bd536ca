"""The pipeline's stages against the operators' plain versions, each on its own input."""

import random
import shutil
from collections import Counter

import pytest

import corpus_pipeline
from larkspur.llm import toxicity

from . import test_operators as plain


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    words = max((r.text or "" for r in docs.collect()), key=len).split(" ")
    spark.createDataFrame([(1, " ".join(words[50:75])), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(15, 1), (18, 0), (21, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    yield str(folder)
    shutil.rmtree(folder)


def test_stages(spark, docs, tables):
    columns = docs.columns
    staged = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, tables)
        if name != "sharding":
            assert out.columns == columns
        staged[name] = (df, out)
        df = out
    before, after = staged["simhash"]
    groups = plain.plain_alike(plain.pairs(before))  # five words, similarity 0.8
    assert {r.doc_id for r in after.collect() if r.doc_id is not None} == {c for i, _, c in groups if i is not None}
    before, after = staged["decontamination"]
    words = max((r.text or "" for r in docs.collect()), key=len).split(" ")
    hits = plain.plain_hits(plain.pairs(before), [(1, " ".join(words[50:75]))])
    clean = {h[0] for h in hits if not h[-1]}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = staged["toxicity"]
    score = toxicity.fit(before, spark.read.parquet(f"{tables}/labels.parquet")).scorer()
    assert Counter(after.collect()) == Counter(r for r in before.collect() if score(r.text) < 0.5)
    before, after = staged["mixing"]
    wanted = plain.plain_copies([(r.doc_id, r.text, r.source) for r in before.collect()])
    assert Counter((r.doc_id, r.text, r.source) for r in after.collect()) == sum((Counter({(i, t, s): copies * n}) for (i, t, s, copies), n in wanted.items()), Counter())
    assert set(after.collect()) <= set(before.collect())
    before, after = staged["sharding"]
    plain.check_shards(after.collect(), plain.pairs(before))


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    r = random.Random(3)
    plain_words = [f"calm{k}" + "abcdefghij"[k % 10] for k in range(80)]
    text = lambda toxic: " ".join(r.sample(plain_words, 20) + r.sample(["venomous", "wretched", "loathsome"], 2) * toxic)
    docs = spark.createDataFrame([(i, text(i % 9 == 0), "en", "s", 1) for i in range(1200)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(0, 1200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    toxic = {i for i in range(1200) if i % 9 == 0}
    assert len(kept & toxic) <= 0.05 * len(toxic) and len(kept) >= 0.98 * (1200 - len(toxic))


def test_run_and_empty_tables(spark, docs, empty, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
