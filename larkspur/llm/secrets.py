"""Secret scan (native): fixed patterns, and a battery of randomness tests under false-discovery control.

Every token of 20 or more characters of the base64 alphabets is a candidate, be it inside a fixed pattern's match or not.  Its encoding is inferred from the characters it
uses, which fixes an alphabet; three tests follow: chi-squared uniformity over the alphabet, runs of one class of symbols,
and the serial correlation of neighbours.  The null hypothesis is that a token is structured, by an effect of stated
size, in at least one of these ways; how far such an effect shifts a statistic depends on the token's length, so short tokens
need to look more random than long ones.  The largest of the three p-values rejects it (intersection-union), and the
Benjamini-Hochberg procedure runs within each stratum of encoding and length over the candidates of the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed patterns, with the letters of the keywords in either case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a longer run has no other start
HEX = "[0-9a-f]{24,}"
CANDIDATE, LEAST = "[A-Za-z0-9+/_-]{20,}={0,2}", 20
KINDS = ("assign", "access", "hex", "random")

#: (name, what a token of that encoding matches, whether it is read in lower case, alphabet); the first that matches counts.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", True, DIGITS + LOWER[:6]),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", True, LOWER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-zA-Z])([a-z0-9]+|[A-Z0-9]+)$", True, DIGITS + LOWER),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", False, LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", False, LOWER.upper() + LOWER + DIGITS + "-_"),
)
#: Effects of structure: the excess of the collision rate over that of the uniform alphabet, per encoding, and the drift
#: of the runs and serial statistics per square root of a symbol.
EXCESS = {"hex": 0.8, "base32": 0.8, "base36": 1.0, "base64": 1.5, "base64url": 1.5}
DRIFT = 0.75
#: The runs test tells symbols from this place of the alphabet up to below the other from the rest: a class of characters.
CLASS = {"hex": (10, 16), "base32": (26, 32), "base36": (10, 36), "base64": (26, 52), "base64url": (26, 52)}
#: Longest length of each stratum but the last; bins of p-values, BINS_A_TEN for a factor of ten.
BANDS = (24, 32, 40, 64, 128)
BINS_A_TEN, LAST_BIN = 20, 200


def located(text: Column, pattern: str, build) -> Column:
    """Array of build(match, start, end) for the leftmost non-overlapping matches, in code points, end exclusive.

    The text splits into gaps between matches, so starts are running sums of lengths.  Sums are kept in chunks of 256
    matches, which keeps the work of appending near linear for texts with very many.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def chunks(steps: Column) -> Column:
        one = build(F.lit(""), F.lit(0), F.lit(0))
        none = F.filter(F.array(one), lambda x: F.lit(False))

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["g"]
            end = start + F.length(p["m"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], build(p["m"], start, end)).alias("out"))

        def chunk(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(steps, k * 256 + 1, F.lit(256)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.array_append(acc["all"], i["out"]).alias("all")))[0]

        every = F.filter(F.array(F.array(one)), lambda x: F.lit(False))
        count = F.ceil(F.size(steps) / 256).cast("int")
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), every.alias("all")), chunk)["all"])

    nothing = F.filter(F.array(build(F.lit(""), F.lit(0), F.lit(0))), lambda x: F.lit(False))
    return F.when(text.rlike(pattern), F.transform(F.array(pairs), chunks)[0]).otherwise(nothing)


def _span(kind: int):
    return lambda m, start, end: F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), m.alias("m"))


def normal_cdf(z: Column) -> Column:
    """The logistic approximation of the normal distribution function."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), 1.5976 * z + 0.07056 * z * z * z))))


def encoding(token: Column) -> Column:
    """Index in ENCODINGS of a token's encoding, or null."""
    core = F.regexp_replace(token, "=+$", "")
    out = F.lit(None).cast("int")
    for k, (_, fits, _, _) in reversed([*enumerate(ENCODINGS)]):
        out = F.when(core.rlike(fits), F.lit(k)).otherwise(out)
    return out


def ordinals(token: Column, code: Column) -> Column:
    """Places of the token's symbols in its alphabet, from 0."""
    core = F.regexp_replace(token, "=+$", "")
    shown, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (_, _, lower, alphabet) in enumerate(ENCODINGS):
        shown = F.when(code == k, F.lower(core) if lower else core).otherwise(shown)
        letters = F.when(code == k, F.lit(alphabet)).otherwise(letters)
    return F.transform(F.filter(F.split(shown, ""), lambda c: c != ""), lambda c: F.position(c, letters) - 1)


def battery(x: Column, k: Column, excess: Column, class_: Column) -> Column:
    """Largest z of the three tests, each against the structured null; low values speak for randomness.

    x: ordinals of the symbols, k: size of the alphabet, class_: first ordinal of a class of characters, and that after its last.
    """
    inside = lambda y: (y >= class_["lo"]) & (y < class_["hi"])
    n = F.size(x).cast("double")
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter(x, lambda y: y == s)).cast("double"), F.lit(2.0)))
    chi = k / n * squares - n
    shift = n * excess
    z_chi = (chi - (k - 1) - shift) / F.sqrt(2 * (k - 1) + 4 * shift)
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    high = F.size(F.filter(x, inside)).cast("double")
    runs = 1 + F.size(F.filter(pairs, lambda p: inside(p["a"]) != inside(p["b"]))).cast("double")
    mean_runs = 1 + 2 * high * (n - high) / n
    var_runs = F.greatest(F.lit(1e-9), (mean_runs - 1) * (mean_runs - 2) / (n - 1))
    z_runs = F.abs(runs - mean_runs) / F.sqrt(var_runs) - DRIFT * F.sqrt(n)
    mean = F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y) / n
    spread = F.greatest(F.lit(1e-9), F.aggregate(x, F.lit(0.0), lambda acc, y: acc + (y - mean) * (y - mean)))
    serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean)) / spread
    z_serial = F.abs(serial + 1 / n) * F.sqrt(n) - DRIFT * F.sqrt(n)
    return F.greatest(z_chi, z_runs, z_serial)


def tested(candidates: Column) -> Column:
    """Array of (start, end, fixed, stratum, bin) of the candidates (start, end, m, fixed) whose encoding can be inferred."""
    own = ("start", "end", "fixed")
    keep = lambda c: [c[x].alias(x) for x in own]
    coded = F.filter(F.transform(candidates, lambda c: F.struct(*keep(c), c["m"].alias("m"), encoding(c["m"]).alias("code"))), lambda c: c["code"].isNotNull())
    placed = F.transform(coded, lambda c: F.struct(*keep(c), c["code"].alias("code"), ordinals(c["m"], c["code"]).alias("x")))
    sizes = F.array(*[F.lit(float(len(a))) for _, _, _, a in ENCODINGS])
    excesses = F.array(*[F.lit(EXCESS[name]) for name, _, _, _ in ENCODINGS])

    classes = F.array(*[F.struct(F.lit(CLASS[name][0]).alias("lo"), F.lit(CLASS[name][1]).alias("hi")) for name, _, _, _ in ENCODINGS])

    def score(c: Column) -> Column:
        p = normal_cdf(battery(c["x"], *(F.element_at(of, c["code"] + 1) for of in (sizes, excesses, classes))))
        bin_ = F.greatest(F.lit(0), F.least(F.lit(LAST_BIN), F.floor(-F.log10(p) * BINS_A_TEN))).cast("int")
        band = sum((F.when(F.size(c["x"]) > b, F.lit(1)).otherwise(F.lit(0)) for b in BANDS), F.lit(0))
        return F.struct(*keep(c), (c["code"] * (len(BANDS) + 1) + band).cast("int").alias("stratum"), bin_.alias("bin"))

    return F.transform(placed, score)


def scanned(docs: DataFrame) -> DataFrame:
    """Rows of `docs` (doc_id, text) with `base`, the fixed patterns' spans, and `tests`, of these and of the candidates outside of them.

    Of an assignment the value is tested.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(located(text, ASSIGN, _span(0)), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(assign, located(text, ACCESS, _span(1)), located(text, HEX, _span(2))))
    free = lambda c: ~F.exists("_base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"]))
    as_candidate = lambda m, fixed: lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), m(c).alias("m"), F.lit(fixed).alias("fixed"))
    value = lambda b: F.when(b["kind"] == 0, F.regexp_extract(b["m"], ASSIGN, 2)).otherwise(b["m"])
    inside = F.filter(F.transform("_base", as_candidate(value, True)), lambda c: F.length(c["m"]) >= LEAST)
    outside = F.transform(F.filter("_c", free), as_candidate(lambda c: c["m"], False))
    spans = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return docs.select("doc_id", base.alias("_base"), located(text, CANDIDATE, _span(3)).alias("_c")).select("doc_id", spans.alias("base"), tested(F.concat(inside, outside)).alias("tests"))


def thresholds(tests: DataFrame, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg per stratum of `tests` (stratum, bin): the least bin whose p-values are rejected at `rate`.

    Only counts per stratum and bin are gathered: (encodings * lengths) * (LAST_BIN + 1) rows at most, whatever the corpus.
    A bin's p-value is the largest in it.
    """
    counts = tests.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    least: dict[int, int] = {}
    for stratum in {r.stratum for r in counts}:
        total, above = sum(r.n for r in counts if r.stratum == stratum), 0
        for r in sorted((r for r in counts if r.stratum == stratum), key=lambda r: -r.bin):
            above += r.n
            if math.pow(10, -r.bin / BINS_A_TEN) * total <= rate * above:
                least[stratum] = r.bin
    return least


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Of every row of `docs` (doc_id, text): `base`, `found` and `judged`.

    base: the fixed patterns' spans, by start and then kind (0 assign, 1 access, 2 hex); found: these and, as kind 3, the
    candidates that pass the battery at false-discovery rate `rate`, none of which overlaps a base span, as arrays of
    (start, kind, end).  judged: array of (start, end, fixed, encoding, p, random) of all that was tested, `fixed` for a base span,
    which stays whatever the battery says of it; p is an upper bound.  Positions are code points, end exclusive.  Null and
    empty texts have none; repeated rows stay repeated and count as often in the discovery rate; columns but doc_id and
    text are ignored.  No rows: no rows.
    """
    rows = staged(scanned(docs), "secrets")  # texts are read once
    least = thresholds(rows.select(F.explode("tests").alias("t")).select("t.stratum", "t.bin"), rate)
    never = F.lit(LAST_BIN + 1)
    limit = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv]) if least else F.create_map(F.lit(-1), never)
    names = F.array(*[F.lit(name) for name, _, _, _ in ENCODINGS])
    code = lambda t: F.floor(t["stratum"] / (len(BANDS) + 1)).cast("int")
    random = lambda t: t["bin"] >= F.coalesce(F.try_element_at(limit, t["stratum"]), never)
    judged = F.transform("tests", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["fixed"].alias("fixed"), F.element_at(names, code(t) + 1).alias("encoding"), F.pow(F.lit(10.0), -t["bin"] / BINS_A_TEN).alias("p"), random(t).alias("random")))
    more = F.transform(F.filter("judged", lambda t: t["random"] & ~t["fixed"]), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return rows.select("doc_id", "base", judged.alias("judged")).select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("found"), "judged")


def listed(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")
