"""Each operator against a plain version of its definition, on hostile rows, empty tables and the small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import decontamination, licenses, mixing, pii, queries, rules, secrets, sharding, simhash, suffix_dedup, toxicity, wording
from larkspur.llm.common import staged
from larkspur.operators import graph

WS = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "sf0.001"])
def some(request, spark, docs):
    return docs if request.param == "docs" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# 1: secrets


def plain_secrets(text):
    text, found = text or "", []
    for k, p, fits in ((0, "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), (1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text, re.I | re.A if k == 0 else 0) if fits(m)]
    return sorted(found)


def test_secrets(some):
    got = secrets.find_secrets(some).select("doc_id", "base", "found").collect()
    key = lambda s: [tuple(x) for x in s]
    assert Counter((r.doc_id, tuple(key(r.base))) for r in got) == Counter((i, tuple(plain_secrets(t))) for i, t in pairs(some))
    for r in got:
        base, more = key(r.base), [x for x in key(r.found) if x[1] == 3]
        assert [x for x in key(r.found) if x[1] < 3] == base and key(r.found) == sorted(key(r.found))
        assert not any(s < e and a < b and s < b and a < e for s, _, e in more for a, _, b in base)


def test_random_tokens_are_told_from_structured_ones(spark):
    rng = np.random.default_rng(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(list(letters), 40)) for _ in range(60)]
    names = [f"Customer/Order/Archive/Invoice/Number{k:04d}" for k in range(60)]
    runs = ["Aa1" * 14 + str(k % 10) for k in range(60)]
    df = spark.createDataFrame([(i, f"use {t} here") for i, t in enumerate(keys + names + runs)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.find_secrets(df).collect() if any(s.kind == 3 for s in r.found)}
    assert len(hit & set(range(60))) >= 54 and len(hit - set(range(60))) <= 6


def plain_battery(x, k, excess, lo, hi):
    """Largest z of the three tests of ordinals x over an alphabet of k, one symbol at a time."""
    n = len(x)
    counts = Counter(x)
    chi = sum((c - n / k) ** 2 / (n / k) for c in counts.values()) + (k - len(counts)) * n / k
    shift = n * excess
    z_chi = (chi - (k - 1) - shift) / (2 * (k - 1) + 4 * shift) ** 0.5
    high = [lo <= v < hi for v in x]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
    mean = 1 + 2 * up * (n - up) / n
    z_runs = abs(runs - mean) / max(1e-9, (mean - 1) * (mean - 2) / (n - 1)) ** 0.5 - secrets.DRIFT * n**0.5
    middle = sum(x) / n
    spread = max(1e-9, sum((v - middle) ** 2 for v in x))
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False)) / spread
    return max(z_chi, z_runs, abs(serial + 1 / n) * n**0.5 - secrets.DRIFT * n**0.5)


def test_battery_like_a_plain_one(spark):
    r = random.Random(12)
    shapes = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFabcdef0123456789+/", "ABCDEFabcdef0123456789-_"]
    tokens = ["".join(r.choice(c) for _ in range(r.randint(20, 150))) for c in shapes for _ in range(12)] + ["ab12" * 9, "A1" * 20, "Zz9" + "+" * 30, "no-digit-here-at-all-token"]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(tokens)], "doc_id long, text string")
    got = {row.doc_id: row.judged for row in secrets.find_secrets(df).collect()}
    for i, t in enumerate(tokens):
        code = next((k for k, (_, fits, _, _) in enumerate(secrets.ENCODINGS) if re.search(fits, t)), None)
        if code is None or not re.fullmatch(secrets.CANDIDATE, t):
            assert not got[i]
            continue
        name, _, lower, alphabet = secrets.ENCODINGS[code]
        x = [alphabet.index(c) for c in (t.lower() if lower else t)]
        z = plain_battery(x, len(alphabet), secrets.EXCESS[name], *secrets.CLASS[name])
        p = 1 / (1 + np.exp(-max(-40.0, min(40.0, 1.5976 * z + 0.07056 * z**3))))
        bin_ = max(0, min(secrets.LAST_BIN, int(np.floor(-np.log10(p) * secrets.BINS_A_TEN))))
        assert [(j.encoding, j.start, j.end) for j in got[i]] == [(name, 2, 2 + len(t))] or got[i][0].fixed
        assert got[i][0].p == pytest.approx(10 ** (-bin_ / secrets.BINS_A_TEN))


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abcdef{k}" for k in range(700))
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.base] == plain_secrets(text)


def test_thresholds_follow_benjamini_hochberg(spark):
    tests = spark.createDataFrame([(0, 60)] * 3 + [(0, 0)] * 97 + [(1, 10)] * 5, "stratum int, bin int")
    assert secrets.thresholds(tests, 0.05) == {0: 60}


# 2: toxicity


def test_nnpu_finds_the_positives_hidden_among_unlabelled():
    rng = np.random.default_rng(1)
    make = lambda n, toxic: [np.flatnonzero(rng.random(40) < np.where((np.arange(40) < 5) & toxic, 0.6, 0.1)) for _ in range(n)]
    positive, hidden, clean = make(200, True), make(100, True), make(900, False)
    w, b, risks = toxicity.nnpu_fit(toxicity.Sparse.of(positive), toxicity.Sparse.of(hidden + clean), 40, 0.1)
    score = toxicity.Sparse.of(make(200, True) + make(200, False)).times(w) + b
    assert (score[:200] > 0).mean() > 0.6 and (score[200:] > 0).mean() < 0.1
    assert min(risks) > -0.05


def test_toxicity_precision_and_recall(spark):
    """Held-out rows of the table of 10,000 documents."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit, flagged = sum(r.predicted and r.toxic for r in rows), sum(r.predicted for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.9 * flagged


def test_toxicity_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    a, b = ([r.score for r in rows if r.held_out and r.toxic == k] for k in (1, 0))
    assert np.mean([(x > y) + (x == y) / 2 for x in a for y in b]) > 0.75
    assert np.mean([r.predicted for r in rows if r.held_out and r.toxic == 0]) < 0.05


def test_toxicity_takes_any_rows(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1), (6, 0), (9, None), (None, 1), (15, 1), (15, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).columns == [*[c for c in docs.columns if c != "score"], "score"]
    assert toxicity.score(docs, model).filter("score between 0 and 1").count() == docs.count()
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(empty, none).count() == 0 and none.weights == {}
    assert all(r.score == pytest.approx(none.prior) for r in toxicity.score(docs, none).collect())


def test_toxicity_where_every_row_is_labelled(spark):
    r = random.Random(3)
    plain = [f"calm{k}" + "abcdefghij"[k % 10] for k in range(60)]
    text = lambda toxic: " ".join(r.sample(plain, 15) + ["venomous", "wretched"] * toxic)
    docs = spark.createDataFrame([(i, text(i % 5 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    labels = labels.filter("doc_id % 50 <> 49")  # a few rows without label are too few
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 5 == 0) for x in rows]) > 0.95
    rows = toxicity.score(docs, toxicity.fit(docs, labels.unionByName(docs.selectExpr("doc_id", "0 AS toxic")))).collect()
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 5 == 0) for x in rows]) > 0.95


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(7, "same text again")] * 300 + [(7, "another text")] * 2 + [(i, f"text {i} " * (1 + 200 * (i % 9 == 0))) for i in range(20, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in (7, *range(20, 100))], "doc_id long, toxic int")
    picked, prior = toxicity.sample(docs, labels, 3000, 9000, 1 << 30)
    got = picked.collect()
    texts = dict(rows)
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    toxic = {i for i in learn if i % 3 == 0 and 20 <= i < 100}
    assert Counter(r.text for r in got if r.y) == Counter(texts[i] for i in toxic)
    assert Counter(r.text for r in got if not r.y) == Counter(texts[i] for i in learn)  # whatever their label
    assert prior == pytest.approx(len(toxic) / len({i for i in learn if i < 100}))
    few, _ = toxicity.sample(docs, labels, 3000, 9000, 6000)
    sizes = defaultdict(int)
    for r in few.collect():
        sizes[r.y] += len(r.text)
    assert 0 < sizes[0] <= 6000 and 0 < sizes[1] <= 6000
    some, _ = toxicity.sample(docs, labels, 10, 20, 1 << 30)
    assert 3 <= some.filter("y = 1").count() <= 25 and 5 <= some.filter("y = 0").count() <= 45


def test_risk_and_scores_like_plain_ones():
    """The same steps over dense lists, one text at a time."""
    rng = np.random.default_rng(5)
    n, prior, rate, ridge = 6, 0.2, 0.05, 2e-3
    make = lambda k, low: [sorted(rng.choice(n, int(rng.integers(low, 4)), replace=False).tolist()) for _ in range(k)]
    positive, unlabelled = make(7, 1), make(11, 0)
    w, b, m, v, risks = [0.0] * n, float(np.log(prior / (1 - prior))), [0.0] * (n + 1), [0.0] * (n + 1), []
    loss = lambda z: float(np.log1p(np.exp(z)))
    up = lambda z: 1 / (1 + float(np.exp(-z)))
    for step in range(1, 31):
        z = lambda x: b + sum(w[k] for k in x)  # noqa: E731, B023
        negative = sum(loss(z(x)) for x in unlabelled) / 11 - prior * sum(loss(z(x)) for x in positive) / 7
        risks.append(negative)
        grad = [0.0] * (n + 1)
        for rows, sign, kind in ((unlabelled, 1, "u"), (positive, -1, "p")):
            for x in rows:
                g = up(z(x)) / 11 if kind == "u" else -prior * up(z(x)) / 7  # of the negative risk
                g = g if negative >= 0 else -g
                if kind == "p" and negative >= 0:
                    g -= prior * up(-z(x)) / 7  # of the positive risk
                for k in [*x, n]:
                    grad[k] += g
        for k in range(n + 1):
            g = grad[k] + (ridge * w[k] if k < n else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            move = rate * (m[k] / (1 - 0.9**step)) / ((v[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
            if k < n:
                w[k] -= move
            else:
                b -= move
    of = lambda rows: toxicity.Sparse.of([np.array(x, np.int64) for x in rows])
    got_w, got_b, got_risks = toxicity.nnpu_fit(of(positive), of(unlabelled), n, prior, steps=30, rate=rate, ridge=ridge)
    assert got_risks == pytest.approx(risks, abs=1e-9) and got_w == pytest.approx(w, abs=1e-7) and got_b == pytest.approx(b, abs=1e-7)
    model = toxicity.Model({f: 0.5 + k for k, f in enumerate(toxicity.features("venom Venomous wort")[::2])}, -1.5, 0.1)
    for text in (None, "", "venom", "a venomous VENOM, wort", "nothing"):
        assert model.scorer()(text) == pytest.approx(up(-1.5 + sum(model.weights.get(f, 0) for f in toxicity.features(text))))


# 3: mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(some):
    got = mixing.mix(some).collect()
    size = lambda t: len(WS.findall(t or ""))
    sizes = defaultdict(int)
    for r in some.collect():
        sizes[r.source] += size(r.text)
    wanted = plain_targets(sizes)
    assert len(got) == some.count()
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert np.floor(rate) <= r.copies <= np.ceil(rate) <= 2
    assert Counter(got) == Counter(mixing.mix(some.repartition(5)).collect())
    emitted = mixing.emit(mixing.mix(some), some.columns)
    assert emitted.columns == some.columns and emitted.count() == sum(r.copies for r in got)


def plain_copies(rows, seed=42):
    """rows: (doc_id, text, source); copies of each: texts lie on a circle in order of a hash, and one more copy is of those that begin on an arc."""
    size = lambda t: len(WS.findall(t or ""))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sizes, steps = defaultdict(int), defaultdict(lambda: defaultdict(int))
    draw = lambda r: int(md5(f"{seed}:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")[:13], 16)
    for r in rows:
        sizes[r[2]] += size(r[1])
        steps[r[2]][draw(r)] += size(r[1])
    targets, more = plain_targets(sizes), defaultdict(set)
    times = {s: int(targets[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    for s, whole in sizes.items():
        start = int(md5(f"{seed}:start" + (f":{s}" if s is not None else ""))[:13], 16) / 16**13 * whole
        want, place = targets[s] - times[s] * whole, 0
        for u, n in sorted(steps[s].items()):
            if start <= place < start + want or place < start + want - whole:
                more[s].add(u)
            place += n
    return Counter((r[0], r[1], r[2], times[r[2]] + (draw(r) in more[r[2]])) for r in rows)


@pytest.mark.parametrize("ranges", [0, 3, 12])
def test_mixing_draws(some, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "MOST", 1 << 12)
    rows = [(r.doc_id, r.text, r.source) for r in some.collect()]
    assert Counter((r.doc_id, r.text, r.source, r.copies) for r in mixing.mix(some).collect()) == plain_copies(rows)
    narrow = mixing.mix(some, keep=["doc_id", "n_chars"])
    assert narrow.columns == ["doc_id", "n_chars", "size", "source_size", "target", "copies"]
    assert Counter((r.doc_id, r.copies) for r in narrow.collect()) == Counter((i, n) for (i, _, _, n), k in plain_copies(rows).items() for _ in range(k))


def test_a_copys_chance_is_the_rates_fraction(spark):
    """Over many sources of one document, and over seeds for sources of several: copies average the rate."""
    alone = [(i, "w " * (1 + i % 90), f"one{i:04d}") for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(alone, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in rows:
        rate = r.target / r.source_size
        by[round(rate * 5)].append(r.copies - rate)
    assert all(abs(np.mean(v)) < 4 * 0.5 / len(v) ** 0.5 for v in by.values() if len(v) > 50) and sum(len(v) > 50 for v in by.values()) > 1
    assert {r.copies for r in rows} >= {0, 1} or {r.copies for r in rows} >= {1, 2}
    some = [(i, "w " * (1 + i * i % 70 + 500 * (i % 40 == 3)), f"s{i // 20:02d}") for i in range(800)]
    df = spark.createDataFrame(some, "doc_id long, text string, source string")
    copies, rate = defaultdict(list), {}
    for seed in range(8):
        for r in mixing.mix(df, seed=seed, keep=["doc_id"]).collect():
            copies[r.doc_id].append(r.copies)
            rate[r.doc_id] = r.target / r.source_size
    off = np.array([np.mean(copies[i]) - rate[i] for i in sorted(copies)])
    large = np.array([i % 40 == 3 for i in sorted(copies)])
    assert abs(off.mean()) < 0.03 and abs(off[large].mean()) < 0.25 and 0.05 < off.std() < 0.25


@pytest.mark.parametrize("known", [True, False])
def test_mixing_comes_near_targets(spark, known):
    df = spark.createDataFrame([(i if known else None, f"w{i} " * (1 + i % 50 + 3000 * (i % 500 == 7)), f"s{i % 5}") for i in range(6000)], "doc_id long, text string, source string")
    taken = defaultdict(int)
    for r in (rows := mixing.mix(df).collect()):
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[r.source] - r.target) <= 3100 for r in rows)  # the longest text


def test_mixing_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


# 4: sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    def least(rest, k):
        if k == 1:
            return sum(rest)
        return min(max(sum(rest[:i]), least(rest[i:], k - 1)) for i in range(len(rest) + 1))

    arr = np.array(sizes)
    capacity = sharding.smallest_capacity(arr, shards)
    assert capacity == least(sizes, shards)
    cut = sharding.cuts(arr, shards)
    assert (np.diff(cut) >= 0).all() and np.bincount(cut, arr, shards).max() <= capacity


def check_shards(rows, docs):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(some, monkeypatch):
    for cells, least in ((4096, 64), (8, 1)):
        monkeypatch.setattr(sharding, "CELLS", cells)
        monkeypatch.setattr(sharding, "CELL_ROWS", least)
        out = sharding.shard(some)
        rows = out.collect()
        check_shards(rows, pairs(some))
        of = defaultdict(set)
        for r in rows:
            of[r.text or ""].add(r.shard)
        assert all(len(v) == 1 for v in of.values())


def test_sharding_is_even(spark):
    df = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 300)) for i in range(20000)], "doc_id long, text string")
    total = Counter()
    for r in sharding.shard(df).select("shard", "size").collect():
        total[r.shard] += r["size"]
    assert max(total.values()) < 1.01 * sum(total.values()) / 16 and min(total.values()) > 0.98 * sum(total.values()) / 16


def test_sharding_of_nothing(empty):
    assert sharding.shard(empty).count() == 0


# 5: rules


def plain_rules(text):
    text = text or ""
    words = WS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_rules(some):
    kept = staged(rules.ledger(some), "test")
    rows = kept.collect()
    assert Counter((r.doc_id, *(r[m] for m in rules.MEASURES)) for r in rows) == Counter((i, *plain_rules(t)) for i, t in pairs(some))
    masks = Counter(r.fail_bits for r in rows)
    for policy, names in rules.POLICIES.items():
        whole = rules.mask(names)
        for r in rules.ablation(kept, policy).collect():
            bit = rules.mask((r.rule,))
            assert r.n_failed == sum(n for m, n in masks.items() if m & bit)
            assert r.n_only == sum(n for m, n in masks.items() if m & whole == bit)
            assert r.n_kept_without == sum(n for m, n in masks.items() if not m & whole & ~bit)


def test_rules_of_nothing(empty):
    assert rules.ledger(empty).count() == 0 and rules.ablation(rules.ledger(empty), "base-1").count() == 0


# 6: decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_hits(texts, items, window=10):
    out = []
    grams = [(i, w[k : k + window]) for i, t in items if (w := plain_words(t)) for k in range(max(1, len(w) - window + 1))]
    for d, t in texts:
        words, hit, names = plain_words(t), set(), set()
        for i, g in grams:
            for k in range(len(words) - len(g) + 1):
                if words[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    names |= {str(i)} if i is not None else set()
        out.append((d, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("bits", [27, 7])
def test_decontamination(spark, docs, empty, monkeypatch, bits):
    monkeypatch.setattr(decontamination, "BITS", bits)
    texts = pairs(docs)
    words = max((t or "" for _, t in texts), key=len).split(" ")
    items = [(1, " ".join(words[50:75])), (2, " ".join(words[60:72]).upper()), (3, " ".join(words[5:9])), (4, "One"), (5, None), (6, ""), (None, " ".join(words[90:101])), (7, "never seen words in any of these texts at all"), (2, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminate(docs, bench)
    assert set(docs.columns) <= set(out.columns)
    assert Counter(tuple(r) for r in out.select("doc_id", *decontamination.ADDED).collect()) == plain_hits(texts, items)
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and Counter(left.collect()) == Counter(r for r in docs.collect() if not next(iter(plain_hits([(r.doc_id, r.text)], items)))[-1])
    assert decontamination.decontaminate(empty, bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab Éß,1\n", max_size=30), max_size=6), st.integers(1, 12))
def test_spelled_words_and_shingles(texts, chunk):
    before, wording.CHUNK = wording.CHUNK, chunk
    try:
        spelled = wording.spelled_column(pa.array(texts, pa.string()))
    finally:
        wording.CHUNK = before
    wanted = [(i, w) for i, t in enumerate(texts) for w in wording.words(t)]
    got = [(i, spelled.raw[a:b]) for i, a, b in zip(spelled.text.tolist(), spelled.start.tolist(), spelled.end.tolist(), strict=True)]
    assert got == wanted and spelled.count.tolist() == [len(wording.words(t)) for t in texts]
    assert len(set(spelled.hash.tolist())) == len({w for _, w in wanted})
    h, at = spelled.shingles(2)
    assert at.tolist() == [k for k in range(len(wanted) - 1) if wanted[k][0] == wanted[k + 1][0]]
    assert len(set(h.tolist())) == len({(wanted[k][1], wanted[k + 1][1]) for k in at.tolist()})


# 7: licences


def test_licenses(some, empty):
    def words(t):
        return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", "".join(c.lower() if c.isascii() else c for c in t)).strip(" ").split(" ")

    table = [(n, Counter(licenses.template_bigrams(t))) for n, t in licenses.TEMPLATES]
    wanted = Counter()
    for i, t in pairs(some):
        t, found = t or "", []
        for u in {" ".join(words(x)) for x in [t, *re.split(r"\n[ \t\r]*\n", t), *t.split("\n")]}:
            ws = u.split(" ")
            grams = Counter(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))
            found += [(round(d, 9), n, u) for n, g in table if (d := 2 * (grams & g).total() / (grams.total() + g.total())) >= 0.8]
        wanted[i, tuple(sorted(found, key=lambda x: (-x[0], x[1], x[2])))] += 1
    got = licenses.scan(some).collect()
    assert Counter((r.doc_id, tuple((round(m.dice, 9), m.license, m.unit) for m in r.matches)) for r in got) == wanted
    assert any(r.matches for r in got)
    assert licenses.scan(empty).count() == 0


def test_license_texts_in_full(spark):
    full = {
        "MIT": f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{licenses.MIT_GRANT}\n\n{licenses.MIT_NOTICE}\n\n{licenses.MIT_WARRANTY}\n",
        "BSD-2-Clause": f"Copyright 2020 A. Person\n\n{licenses.BSD_GRANT}\n\n{licenses.BSD_TWO}\n\n{licenses.BSD_WARRANTY}\n",
        "BSD-3-Clause": f"Copyright 2020 A. Person\n\n{licenses.BSD_GRANT}\n\n{licenses.BSD_TWO}\n\n{licenses.BSD_THIRD}\n\n{licenses.BSD_WARRANTY}\n",
        "ISC": f"Copyright 2020 A. Person\n\n{licenses.ISC_GRANT}\n\n{licenses.ISC_WARRANTY}",
        "AGPL-3.0": f"prose before it\n\n{licenses.AGPL_3}\n\nprose after it",
        "Zlib": licenses.ZLIB.replace("'as-is'", "as is"),
        "BSD-2-Clause/BSD-3-Clause": f"prose before it\n{licenses.BSD_GRANT}\nprose after it",
    }
    df = spark.createDataFrame(list(full.items()), "doc_id string, text string")
    whole = {r.doc_id: next(m.license for m in r.matches if m.unit == max((x.unit for x in r.matches), key=len)) for r in licenses.scan(df).collect()}
    assert whole == {k: k for k in full}


def test_license_bounds_lose_nothing():
    keys = set(licenses.keywords(licenses.TEMPLATES, 0.8))
    for _, t in licenses.TEMPLATES:
        grams = licenses.template_bigrams(t)
        left = [g for g in grams if not keys & set(g.split(" "))]
        assert all(2 * len(left) / (len(grams) + n) < 0.8 for n in range(max(1, len(left)), 2 * len(grams)))


# 8: long repeats


def plain_repeats(rows, length):
    """rows: (doc_id, text, hash of the text), ids without text before all."""
    seen, gone = {}, defaultdict(set)
    for i, t, b in sorted({((i is not None, i), t, (x or "").encode()) for i, x, t in rows}):
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, t, s)) != (i, t, s):
                gone[i, t] |= set(range(s, s + length))
    out = Counter()
    for i, x, t in rows:
        b, g = (x or "").encode(), gone[(i is not None, i), t]
        out[i, len(b), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in g)).hexdigest()] += 1
    return out


def hashed(df):
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]


def removed(df):
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).drop("kept").collect())


@pytest.mark.parametrize("crowded", [2048, 1])
def test_long_repeats(some, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    assert removed(some) == plain_repeats(hashed(some), 100)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in suffix_dedup.remove_repeats(some).collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeats_of_ids_that_recur(spark, kind):
    rng = np.random.default_rng(3)
    prose = lambda n: "".join(rng.choice(list("abcdefg "), n))
    a, b, passage = prose(400), prose(400), prose(300)
    rows = [(1, a), (2, a[:200]), (2, b), (2, b), (3, b[100:350]), *[(None, passage + prose(100)) for _ in range(3)], (None, prose(400)), (None, None), (4, passage), (5, "ab" * 400), (5, "ab" * 300), (6, "é" * 150)]
    df = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, t) for i, t in rows], f"doc_id {kind}, text string").repartition(4)
    got = removed(df)
    assert got == plain_repeats(hashed(df), 100)
    assert sum(n for k, n in got.items() if k[0] in (2, "2") and k[1] == 400 and not k[2]) == 2  # nothing else goes under an id that recurs


def test_one_anchor_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 20)
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefg "), 130))
    rows = [(k, "".join(rng.choice(list("uvwxyz "), int(rng.integers(1, 80)))) + passage + "".join(rng.choice(list("uvwxyz "), int(rng.integers(1, 80))))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(df) == plain_repeats(hashed(df), 100)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GATHERED", 300)
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefg "), 5000))
    rows = [(1, base), (2, base[1700:4200]), (3, "z" * 2500), (4, base[:900] + base[:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(df) == plain_repeats(hashed(df), 100)
    data = np.frombuffer(base.encode(), np.uint8)
    whole = suffix_dedup.contexts(data, np.array([5000]), 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    cut = suffix_dedup.chunked(data, np.array([5000]), 100, suffix_dedup.K)
    spread = lambda found: [(h, w) for h, _, a, b in zip(*(x.tolist() for x in found), strict=True) for w in range(a, b + 1)]
    assert spread(cut) == spread(whole) and len(cut[0]) > len(whole[0])


def test_no_repeats_in_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=12), st.integers(1, 9))
def test_index(strings, length):
    data = [*(s.encode() for s in strings), b"c" + b"d" * 40]  # one string alone is not indexed: windows of one anchor differ
    kinds = sorted(set(data))
    code = np.array([kinds.index(d) for d in data])
    ends = np.cumsum([len(d) for d in kinds])
    places = np.arange(len(data)) << suffix_dedup.PLACE_BITS
    fits = np.array([len(d) >= length for d in data])
    i, lo, hi = suffix_dedup.block_repeats(code[fits], places[fits], np.zeros(fits.sum(), np.int64), np.frombuffer(b"".join(kinds), np.uint8), ends, length)
    wanted, seen = set(), set()
    for k, s in enumerate(data):
        for at in range(len(s) - length + 1):
            if s[at : at + length] in seen:
                wanted.add((k, at))
            seen.add(s[at : at + length])
    assert {(k, at) for k, a, b in zip(i.tolist(), lo.tolist(), hi.tolist(), strict=True) for at in range(a, b + 1)} == wanted


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=8))
def test_runs_of_the_transform(strings):
    data = b"".join(s.encode() + b"?" for s in strings)
    starts = np.cumsum([0, *(len(s) + 1 for s in strings[:-1])])
    index = suffix_dedup.RunLengthIndex(np.frombuffer(data, np.uint8), starts)
    suffixes = sorted((s[k:], n, starts[n] + k, s[k - 1] if k else "") for n, s in enumerate(strings) for k in range(len(s) + 1))
    heads = [r for r in range(len(suffixes)) if not r or not suffixes[r][3] or suffixes[r][3] != suffixes[r - 1][3]]
    assert dict(zip(index.sample.tolist(), index.above.tolist(), strict=True)) == {suffixes[r][2]: suffixes[r - 1][2] if r else -1 for r in heads}
    assert len(index.symbols) == len(heads)


# 9: personal data


def plain_pii(text):
    text, out = text or "", []
    luhn = lambda d: sum((x := int(c) * (1 + k % 2)) - 9 * (x > 9) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    for k, (p, fits) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if fits(m[0])]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@+-( 0", max_size=40))
def test_pii_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_pii(some):
    got = pii.find_pii(some).collect()
    wanted = Counter()
    for i, t in pairs(some):
        spans = plain_pii(t)
        counts = [sum(k == x[1] for x in spans) for k in range(4)]
        wanted[i, *counts, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == wanted


def test_pii_contexts_are_bootstrapped(spark):
    rows = [(i, f"w{i} my card number 4539 1488 0343 6467 was paid") for i in range(0, 1)]
    rows += [(i, f"please ring direct line +1 (555) 010-{1000 + i} today") for i in range(1, 20)]
    rows += [(100, "please ring direct line 020-7946-0018 today"), (101, "it happened in year 1999 again"), (102, "lot number 123456 in stock"), (None, "é direct line 020-7946-0018 today"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find_pii(df).collect()}
    assert found[100] == [("context", 24, 37)] and found[None] == [("context", 14, 27)] and found[101] == found[102] == found[103] == []


def test_pii_finds_what_was_held_back(spark):
    """Identifiers of shapes that no fixed pattern has, in contexts shared with some that they have, and in other ones."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    mail = lambda: f"{word()}.{word()}@{word()}.example.org"
    around = [("write to", "for details"), ("reachable under", "any time"), ("contact address", "or call")]
    shapes = [lambda: f"@{word()}_{r.randint(10, 99)}", lambda: f"{r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"{word().title()}"]
    rows, hidden, wrong = [], {}, {}
    for i in range(600):
        before, after = around[i % 3]
        if i % 4:
            rows.append((i, f"{prose(9)} {before} {mail()} {after} {prose(9)}"))
        else:
            text, m = f"{prose(9)} {before} ", shapes[i // 4 % 3]()
            hidden[i] = (len(text) + m.startswith("@"), len(text) + len(m))
            rows.append((i, f"{text}{m} {after} {prose(9)}"))
    for i in range(600, 900):
        text, m = f"{prose(9)} in the year ", str(r.randint(1900, 2020))
        rows.append((i, f"{text}{m} the {word()} {word().title()} {prose(6)} order number {r.randint(10**5, 10**6)} {prose(4)}"))
    # A second step: contexts that no seed has, but identifiers found in the first.
    late = [rows[i][1][slice(*hidden[i])] for i in list(hidden)[:24] if i // 4 % 3 == 1]
    for k, m in enumerate(late * 6):
        rows.append((1000 + k, f"{prose(5)} badge code {m} shown {prose(5)}"))
    for k in range(20):
        text, m = f"{prose(5)} badge code ", f"{r.randint(100, 999)}-{r.randint(1000, 9999)}"
        hidden[2000 + k] = (len(text), len(text) + len(m))
        rows.append((2000 + k, f"{text}{m} shown {prose(5)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: [(s.start, s.end) for s in x.found if s.kind == "context"] for x in pii.find_pii(df).collect()}
    hit = sum(hidden[i] in got[i] for i in hidden)
    given = [(i, s) for i in got for s in got[i] if not 1000 <= i < 2000]
    assert hit >= 0.9 * len(hidden) and sum(hidden.get(i) == s for i, s in given) >= 0.9 * len(given)


def test_pii_chain_of_contexts(spark, caplog):
    """Each context is told only by instances that the one before has: rounds go on until none is left out."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    name = lambda k, j: f"{word()}@{word()}.example.org" if k == 0 else f"{k + 100}-{j}7{k + 200}"
    n = 4  # with 25 of them the same holds, and takes minutes
    steps = [[name(k, j) for j in range(5)] for k in range(n + 1)]
    letters = lambda k: "xyzw"[k % 4] + "mnop"[k // 4 % 4] + "qrst"[k // 16]
    rows = []
    for k in range(n):
        for m in steps[k] * 2 + steps[k + 1]:
            rows.append((len(rows), m, f"{word()} {word()} con{letters(k)} text{letters(k)} {m} {word()} {word()}"))
    df = spark.createDataFrame(rows, "doc_id long, m string, text string").coalesce(1)
    with caplog.at_level("INFO"):
        got = {x.doc_id: x.found for x in pii.find_pii(df).collect()}
    for i, m, text in rows:
        start = text.index(m)
        assert ("email" if "@" in m else "context", start, start + len(m)) in [tuple(x) for x in got[i]]
    assert int(re.search(r"settled after (\d+) rounds", caplog.text)[1]) >= n


def test_pii_scores_go_on_until_settled(spark):
    """Trust that is passed on from pattern to pattern takes more turns than a fixed number of them allows."""
    n = 9
    edges = [(k, 10 * (k + s) + j, k + s == 0, 2 - s) for k in range(n) for s in (0, 1) for j in range(5)]
    turns, staged_ = [], pii.staged
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pii, "staged", lambda df, label: turns.append(label) or staged_(df, label))
        trusted, belief = pii.scored(spark.createDataFrame(edges, "pattern long, instance long, seed boolean, n long"), spark.createDataFrame([(k, 15) for k in range(n)], "pattern long, total long"), 5, 0.6)
    assert {r.pattern for r in trusted.collect()} == set(range(n)) and all(r.belief > 0.99 for r in belief.collect())
    assert turns.count("trusted") > 20


def test_pii_graph_scores_like_plain_ones(spark):
    r = random.Random(4)
    edges = [(p, x, x < 6, r.randint(1, 4)) for p in range(8) for x in range(20) if r.random() < (0.6 if x < 9 else 0.2)]
    totals = {p: sum(n for q, _, _, n in edges if q == p) + r.randint(0, 6) for p in range(8)}
    belief = {x: float(s) for _, x, s, _ in edges}
    seeded, before = dict(belief), None
    while before is None or abs(sum(belief.values()) - before) > pii.STILL:
        before = sum(belief.values()) if before is not None or True else None
        trusted = {}
        for p in totals:
            own = [(x, n) for q, x, _, n in edges if q == p]
            conf = min(1.0, sum(n * belief[x] for x, n in own) / totals[p])
            if conf >= 0.5 and len({x for x, _ in own if belief[x] >= 0.5}) >= 3:
                trusted[p] = conf
        last = sum(belief.values())
        belief = {x: max(seeded[x], 1 - float(np.prod([max(1e-9, 1 - trusted[q]) for q, y, _, _ in edges if y == x and q in trusted]))) for x in seeded}
        before = last
    got, believed = pii.scored(spark.createDataFrame(edges, "pattern long, instance long, seed boolean, n long"), spark.createDataFrame(list(totals.items()), "pattern long, total long"), 3, 0.5)
    assert {x.pattern: x.confidence for x in got.collect()} == pytest.approx(trusted, abs=1e-2)
    assert {x.instance: x.belief for x in believed.collect()} == pytest.approx(belief, abs=1e-2) and len(trusted) > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB1_@. é", max_size=25), max_size=5))
def test_mentions_cover_tokens_and_seeds(texts):
    m = pii.Mentions(pa.array(texts, pa.string()))
    spelled, sp = [], m.spelled
    for i, j in zip(m.first.tolist(), m.stop.tolist(), strict=True):
        spelled.append((int(sp.text[i]), m.body[sp.start[i] : sp.end[j - 1]].tobytes().decode()))
    for row, t in enumerate(texts):
        base = pii.base_spans(t)
        rest = list(t)
        for s, _, e in base:
            rest[s:e] = " " * (e - s)
        words = [w.strip("._/@%+-") for w in re.split(r"[^A-Za-z0-9._/@%+é-]+", t)]
        if not base:
            assert [w for k, w in spelled if k == row and len(w) < 9] == [w for w in words if re.search("[A-Za-z0-9é]", w) and len(w) < 9] or re.search(r"[._/@%+-]{4,}", t)


def test_pii_of_nothing(empty):
    assert pii.find_pii(empty).count() == 0


def test_redaction():
    assert pii.redact("call 12345 or 67890 now", [(5, 10), (8, 10), (14, 19)], "#") == "call # or # now"


# 10: near duplicates


def plain_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WS.findall(words)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(texts):
    prints = [(i, plain_print(t)) for i, t in texts]
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {k: min((prints[j][0] for j in range(len(prints)) if label[j] == k and prints[j][0] is not None), default=None) for k in set(label)}
    return Counter((i, f"{p:016x}", least[k]) for (i, p), k in zip(prints, label, strict=True))


@pytest.mark.parametrize("crowded", [4096, 1])
def test_near_duplicates(some, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "SAMPLE", 1 if crowded == 1 else 16)
    got = simhash.near_duplicates(some).collect()
    assert Counter(tuple(r) for r in got) == plain_components(pairs(some))


def plain_sets(text, words=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WS.findall(w)
    return frozenset(" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain_alike(texts, least=0.8):
    """(doc_id, text, smallest doc_id reachable) by the Jaccard coefficient of all pairs."""
    sets = [plain_sets(t) for _, t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or a and b and len(a & b) >= least * len(a | b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = defaultdict(list)
    for (i, _), x in zip(texts, label, strict=True):
        first[x] += [] if i is None else [i]
    return Counter((i, t, min(first[x], default=None)) for (i, t), x in zip(texts, label, strict=True))


@pytest.mark.parametrize("crowded", [4096, 8])
def test_alike(some, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    texts = dict((r.t, r.text) for r in some.select(F.xxhash64("text").alias("t"), "text").collect())
    assert Counter((r.doc_id, texts[r.t], r.component_id) for r in simhash.alike(some).collect()) == plain_alike(pairs(some))


def test_alike_finds_near_all_links(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for k in range(150):
        base = [word() for _ in range(r.randint(30, 400))]
        rows.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    sets = [plain_sets(t) for t in rows]
    j = lambda a, b: len(a & b) / len(a | b)
    near = {(x, y) for x in range(len(rows)) for y in range(x) if x // 3 == y // 3 and j(sets[x], sets[y]) >= 0.8}
    label = {x.doc_id: x.class_id for x in simhash.alike(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(near) > 100 and sum(label[x] == label[y] for x, y in near) >= 0.97 * len(near)
    for x, y in [(x, y) for x in range(len(rows)) for y in range(x) if label[x] == label[y]]:
        assert x // 3 == y // 3 and (j(sets[x], sets[y]) >= 0.8 or all(any((min(p, q), max(p, q))[::-1] in near for q in range(3 * (x // 3), 3 * (x // 3) + 3)) for p in (x, y)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 255)), max_size=90), st.integers(0, 5))
def test_forest_links_what_is_near(rows, most):
    rows = sorted(rows, key=lambda x: x[0])
    bucket = np.array([b for b, _ in rows], np.int64)
    prints = np.array([[v, 7] for _, v in rows], np.uint64).reshape(-1, 2)
    i, j, d = simhash.forest(bucket, prints, most)
    links = [(x, y) for x in range(len(rows)) for y in range(x) if rows[x][0] == rows[y][0] and (rows[x][1] ^ rows[y][1]).bit_count() <= most]
    one = lambda a, b: graph.local_labels(len(rows), np.array(a, np.int64), np.array(b, np.int64)).tolist()
    assert one(i, j) == one([x for x, _ in links], [y for _, y in links])
    assert len(i) < max(1, len(rows)) or not len(i)
    assert d.tolist() == [(rows[x][1] ^ rows[y][1]).bit_count() for x, y in zip(i.tolist(), j.tolist(), strict=True)]


def test_one_of_each_group_stays(some, docs, empty):
    kept = simhash.keep_one(some)
    assert kept.columns == some.columns
    wanted = plain_alike(pairs(some))
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter({c for i, _, c in wanted if i is not None})
    assert kept.filter("doc_id is null").count() == some.filter("doc_id is null").count()
    assert simhash.keep_one(empty).count() == 0


def test_pigeonhole_masks_leave_no_pair_out():
    rng = np.random.default_rng(0)
    for count in (10, 10**6, 10**9, 10**11):
        blocks, kept = simhash.layout(count, 4)
        masks = [m & (1 << 64) - 1 for m in simhash.masks(blocks, kept)]
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not m & flips for m in masks)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 12) - 1), min_size=1, max_size=80, unique=True))
def test_bucket_links_connect_what_is_near(values):
    prints = np.array(sorted(values), np.uint64)
    a, b = simhash.bucket_links(np.zeros(len(prints), int), prints, 2)
    near = [(i, j) for i in range(len(values)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 2]
    i, j = (np.array([p[k] for p in near], int) for k in (0, 1))
    assert graph.local_labels(len(values), a, b).tolist() == graph.local_labels(len(values), i, j).tolist()


@pytest.mark.parametrize("at_once", [1_000_000, 20, -1])
def test_components_of_a_long_chain(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long").repartition(7)
    got = {r.key: r.root for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert graph.components(links.limit(0)).count() == 0


def test_alike_finds_all_links(spark):
    """Pairs at and just above the threshold, of which one of a hundred was left out by masks of bits, and pairs just below it."""
    r = random.Random(9)
    rows = []
    for k in range(700):  # 10 * m shingles each, 8 * m of 10 * m in common (4/5) or one fewer
        m = r.randint(3, 14)
        own = lambda n: [f"{r.getrandbits(40):x}" for _ in range(n)]
        both, more = own(8 * m + 4 - k % 2), own(m + k % 2)
        rows += [" ".join(both + more), " ".join(own(m + k % 2) + both)]
    sets = [plain_sets(t) for t in rows]
    near = {x for x in range(0, len(rows), 2) if len(sets[x] & sets[x + 1]) >= 0.8 * len(sets[x] | sets[x + 1])}
    label = {x.doc_id: x.class_id for x in simhash.alike(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(near) == 350 and {x for x in range(0, len(rows), 2) if label[x] == label[x + 1]} == near and len(set(label.values())) == len(rows) - 350


def test_forest_of_near_copies_has_as_many_links_as_copies():
    """A bucket of near copies: no more rows than members, in a turn after the first none; sets tell which links join classes."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 142, replace=False), rng.integers(0, 1 << 63, 8).astype(np.uint64)])) for _ in range(300)]
    n, at, bucket = np.array([len(s) for s in sets]), np.zeros(300, np.int64), np.zeros(300, np.int64)
    rows = {"h": bucket, "k": np.arange(300), "n": n, "at": at} | {f"p{x}": np.array([simhash.parities(s)[x] for s in sets]).view(np.int64) for x in range(2)}
    batch = lambda **more: pa.RecordBatch.from_arrays([pa.array(v) for v in (rows | more).values()], names=list(rows | more))
    similar = {(i, j) for i in range(300) for j in range(i) if len(both := np.intersect1d(sets[i], sets[j])) >= 0.8 * (n[i] + n[j] - len(both))}
    assert len(similar) > 20_000
    links = [p for b in simhash._candidates(1, 0.8, False)(iter([batch()])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(links) == 299
    verified = [(a, b) for a, b in links if (b, a) in similar]
    label = graph.local_labels(300, *(np.array([p[x] for p in verified], np.int64) for x in (0, 1)))
    whole = graph.local_labels(300, *(np.array([p[x] for p in similar], np.int64) for x in (0, 1)))
    split = np.where(np.arange(300) % 7 == 0, np.arange(300), 1)  # as if many were single still
    pairs_ = [b for b in simhash._candidates(1, 0.8, True)(iter([batch(c=split)]))]
    crowd = [k for b in simhash._crowds(1, 0.8)(iter([batch(c=split)])) for k in b.column("k").to_pylist()]
    assert sum(b.num_rows for b in pairs_) == 0 and len(crowd) <= 300
    more = simhash.confirmed(sets, split, 0.8)
    assert len(more) < len(set(split.tolist())) and all((max(p), min(p)) in similar for p in more)
    joined = graph.local_labels(300, *(np.concatenate([np.array([p[x] for p in more], np.int64), np.array([[i, 1][x] for i in range(300) if i % 7], np.int64)]) for x in (0, 1)))
    assert len(set(joined.tolist())) == len(set(whole.tolist())) == len(set(label.tolist())) == 1


@pytest.mark.parametrize("crowded", [4096, 12])
def test_alike_confirms_large_buckets_by_the_sets(spark, some, monkeypatch, crowded):
    """Buckets of any size are wide here, and the closest are found without a forest, so that classes are joined in the second turn."""
    monkeypatch.setattr(simhash, "WIDE", 1)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "spanning", lambda bucket, near: tuple(x[:1] for x in simhash.small_pairs(bucket, near, 1000)))
    texts = dict((r.t, r.text) for r in some.select(F.xxhash64("text").alias("t"), "text").collect())
    assert Counter((r.doc_id, texts[r.t], r.component_id) for r in simhash.alike(some).collect()) == plain_alike(pairs(some))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=400), st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=90))
def test_sketches_differ_no_more_than_sets(a, b):
    one, other = (np.array(sorted(set(x)), np.uint64) for x in (a, a[: len(a) // 3] + b))
    assert simhash.differing(simhash.sketch(one), simhash.sketch(one)) == 0
    assert simhash.differing(simhash.sketch(one), simhash.sketch(other)) <= len(set(one.tolist()) ^ set(other.tolist()))
