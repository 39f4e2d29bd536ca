"""Line dedup, source divergence and periodic runs against plain versions of their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import decontamination, divergence, licenses, line_dedup, mixing, periodic, pii, queries, rules, secrets, sharding, simhash, suffix_dedup, toxicity

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def shared_lines():
    """Rows whose lines meet in two, three and many documents, some of them twice in one."""
    long = [f"A line of the page, number {k} é" for k in range(6)]
    texts = ["\n".join([long[k % 6], f"own text {k} that no one else has", "  " + long[(k * 5) % 6].upper() + "\t", "short", ""]) for k in range(40)]
    texts += [None, "", "\n\n", "nineteen characters\n" * 3, "twenty characters ok\n" * 2, "twenty characters ok", "Twenty Characters OK\r", "ü" * 20, "ü" * 20, "x\n" + "ü" * 20, "ß" * 19, "ß" * 19, "ß" * 19]
    return [(i * 7 % 53, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (5, texts[3]), (5, texts[3])]


def plain_lines(rows, least_docs=3, least_chars=20):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("most_sent", [1 << 20, 0])
def test_lines(spark, docs, most_sent, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 4)
    monkeypatch.setattr(line_dedup, "PROBES", 16)
    for df in (spark.createDataFrame(shared_lines(), "doc_id long, text string").repartition(3), docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = line_dedup.drop_repeated(df, most_sent=most_sent)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == plain_lines(rows)


def test_lines_of_other_ids_and_columns(spark, empty):
    rows = [(None if i is None else f"d{i:03d}", t, [1], i) for i, t in shared_lines()]
    df = spark.createDataFrame(rows, "doc_id string, text string, `n.words` array<int>, N_Lines long")
    for most_sent in (1 << 20, 0):
        got = line_dedup.drop_repeated(df, most_sent=most_sent)
        assert got.columns == ["doc_id", "text", "n.words", "n_lines", "n_dropped", "kept"]
        assert Counter((r[0], r[3], r[4], r[5]) for r in got.collect()) == plain_lines([(r[0], r[1]) for r in rows])
        assert line_dedup.drop_repeated(empty, most_sent=most_sent).count() == 0
    one = line_dedup.drop_repeated(df, least_docs=1, least_chars=5)
    assert Counter((r[0], r[3], r[4], r[5]) for r in one.collect()) == plain_lines([(r[0], r[1]) for r in rows], 1, 5)


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 5000):
        two = rng.integers(0, 1 << 63, (n, 2), np.uint64)
        two[: n // 2, 0] = 7  # hashes that share a half
        sizes, bits, place = line_dedup.built(two[:, 0], two[:, 1])
        assert sorted(place.tolist()) == list(range(n)) and len(bits) == sizes.sum() <= 3 + 4 * n / 64 + len(sizes)
        prints = np.empty(n, np.uint64)
        prints[place] = two[:, 1]
        parts = [x.tobytes() for x in (sizes, bits, prints, np.ones(n, np.uint32), np.zeros(n, np.int64))]
        index = line_dedup.Index([(3, *parts)] if n else [])
        shard = np.full(n, 3)
        assert np.array_equal(index.find(shard, two[:, 0], two[:, 1]), place)
        other = rng.integers(0, 1 << 63, (1000, 2), np.uint64)
        assert (index.find(np.full(1000, 3), other[:, 0], other[:, 1]) == -1).all()
        assert (index.find(shard + 1, two[:, 0], two[:, 1]) == -1).all()


def plain_audit(rows, least=3, most=200):
    """Dense: every kept term in every group, in Python's whole numbers."""
    groups, times, held = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        g = (lang or "", source or "")
        own = [w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add(g)
        times[g].update(own)
        held[g[0]].update(set(own))
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 1) // (total + v)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(times[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(times[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        whole = Counter({t: sum(times[lang, s][t] for s in sources) for t in kept})
        q = {t: share(whole[t], sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if times[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def test_divergence(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 40)
    monkeypatch.setattr(divergence, "ENTRIES", 30)
    told = [("the cat the Ünit x y", "en", "a"), ("THE dog the ünit x", "en", "b"), ("the ünit x z z z", "en", None), (None, "en", "d"), ("", "xx", "only"), ("123 456", "yy", "p"), ("one", "yy", "q"), (None, None, None)]
    more = [(" ".join(f"w{chr(97 + (k * j) % 26)}" for j in range(k % 9 + 1)), ("en", "de")[k % 2], f"s{k % 7}") for k in range(120)]
    for rows in (told * 2 + more + more[:10], [(r.text, r.lang, r.source) for r in docs.collect()]):
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "text string, lang string, source string, value long").repartition(3)
        assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)
        assert sorted(map(tuple, divergence.audit(df, 5, 3).collect())) == plain_audit(rows, 5, 3)
    assert divergence.audit(empty).count() == 0


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(least, 2 * q):
                found.setdefault((start, end + q), q)  # the smallest period comes first
            start = end
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def found_runs(texts):
    size = np.array([len(t) for t in texts], np.int64)
    ends = 1 << 20
    flat = np.array([x for k, t in enumerate(texts) for x in [*t, ends + k]], np.int64)
    place = np.concatenate([np.arange(n + 1) for n in size])
    head = np.cumsum(size + 1) - size - 1
    out = [[] for _ in texts]
    for s, n, q in zip(*(x.tolist() for x in periodic.runs(flat, place, np.repeat(size, size + 1))), strict=True):
        k = int(np.searchsorted(head, s, "right")) - 1
        out[k].append((s - int(head[k]), n, q))
    return out


words_ = st.lists(st.integers(0, 2), max_size=90) | st.lists(st.integers(0, 1), max_size=60) | st.builds(lambda a, b, k, c: (a + b * k + c) if b else a, st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=30), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=20))


@settings(max_examples=300, deadline=None)
@given(st.lists(words_, min_size=1, max_size=5))
def test_runs_like_plain_ones(texts):
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_runs_of_known_shapes():
    fib = [0, 1]
    while len(fib) < 400:
        fib = fib + fib[: len(fib) * 5 // 8 + 1]
    word = ["a"]
    while len(word) < 500:
        word = [x for c in word for x in ("ab" if c == "a" else "a")]
    thue = [bin(k).count("1") % 2 for k in range(1024)]
    texts = [[0] * 3000, [ord(c) for c in word], thue, fib, list(range(50)) * 7, [*range(5), *[9] * 11], [9] * 12, [*range(5), *[9] * 12, 1], []]
    assert found_runs(texts) == [plain_runs(t) for t in texts]
    assert found_runs([[0] * 200_000]) == [[(0, 200_000, 1)]]


def test_find_runs(spark, docs, empty):
    rng = np.random.default_rng(4)
    texts = [None, "", "x " * 30, "a b  c\td\n" * 9 + "z", *(" ".join(f"w{x}" for x in rng.integers(0, 3, 60)) for _ in range(60)), "é ü " * 12 + "\x85 x"]
    rows = [(i, t, [1], t) for i, t in enumerate(texts)] + [(None, "q r " * 10, None, None), (0, "b " * 20, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `runs.x` array<int>, Runs string").repartition(2)
    got = periodic.find_runs(df)
    assert got.columns == ["doc_id", "text", "runs.x", "n_words", "runs", "collapsed"]
    for r in [*got.collect(), *periodic.find_runs(docs).collect()]:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = plain_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words) and r.collapsed == " ".join(plain_collapse(words, want))
    assert periodic.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(df, least=6)


def test_op13_over_the_table(spark):
    got = {r.doc_id: r for r in queries.op13_periodic(spark, SF).collect()}
    seen = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if n > 1500:
            continue  # the plain version is slow
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
        runs = plain_runs(words)
        seen += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        row = got[r.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest()
    assert seen > 50


def test_the_whole_table_of_lines(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_lines([(r.doc_id, r.text) for r in df.collect()])
    for most_sent in (1 << 20, 0):
        got = line_dedup.drop_repeated(df, most_sent=most_sent)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == want
    assert line_dedup.drop_repeated(df).agg(F.sum("n_dropped")).first()[0] > 100


#: Every operator over a table of hostile columns: what it gives, one row for each of the table's.
OPERATORS = {
    "secrets": lambda d, b: secrets.find_secrets(d),
    "toxicity": lambda d, b: toxicity.score(d, toxicity.Model({}, 0.0, 0.1)),
    "mixing": lambda d, b: mixing.mix(d),
    "sharding": lambda d, b: sharding.shard(d),
    "rules": lambda d, b: rules.ledger(d, ("doc_id", "n.words", "_text")),
    "decontamination": lambda d, b: decontamination.decontaminate(d, b),
    "clean": lambda d, b: decontamination.clean(d, b.limit(0)),
    "licenses": lambda d, b: licenses.scan(d),
    "suffixes": lambda d, b: suffix_dedup.remove_repeats(d),
    "pii": lambda d, b: pii.find_pii(d),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "lines": lambda d, b: line_dedup.drop_repeated(d),
    "runs": lambda d, b: periodic.find_runs(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hostile_columns(spark, docs, name):
    """Text ids, and columns with dots, with names that operators use, and with names that they add."""
    columns = ["n.words", "_text", "_id", "_t", "id", "t", "h", "k", "c0", "r0", "Runs", "N_LINES", "own_id", "hit_id", "source_size", "mix_source", "found", "shard", "copies"]
    wide = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "lang", "source", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(columns)])
    bench = spark.createDataFrame([("i1", "line one here line one here the rest of it"), (None, None)], "item_id string, text string")
    got = OPERATORS[name](wide, bench)
    assert Counter(r[got.columns.index("doc_id")] for r in got.collect()) == Counter(r.doc_id for r in wide.select("doc_id").collect())
    if name in ("toxicity", "decontamination", "clean", "lines", "runs"):
        kept = got.columns
        assert "n.words" in kept and "_text" in kept and "_id" in kept and got.select("`n.words`", "_id").distinct().collect() == [("x0", "x2")]
