"""Personal data: fixed patterns, and contexts bootstrapped from what they find.

The fixed patterns' matches are seeds.  A mention, a seed or a token that looks like an identifier or a name, stands in lexical
patterns: the word before it, the two before, the two after, or the one on either side.  Patterns and instances make
a graph.  From the seeds' patterns Spark scores, in turns until nothing changes, patterns by the confidence of what they extract
against all their occurrences in the corpus, and instances by the patterns that extract them; instances found so
bring in their other patterns, until no new instance is found.  Mentions in patterns of high confidence are added as spans of
kind `context`.  All of these are tables that Spark joins; only bitmaps of fixed size go to every worker.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, sliced, staged
from .wording import Spelled, bitmap, in_bitmap, mix

log = logging.getLogger(__name__)

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many different confident instances, and this confidence, to extract.
SUPPORT, CONFIDENCE = 5, 0.6
#: Summed beliefs count as settled below this change.
STILL = 1e-3
#: Bitmaps of patterns and instances have 2 ** BITS bits.
BITS = 24

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Marks that join words to one token, three in a row at most.
JOINING = np.isin(np.arange(256), np.frombuffer(b"._/@%+-", np.uint8))
#: Kinds of patterns, by the words around a mention.
BEFORE, TWO_BEFORE, TWO_AFTER, BOTH = 1, 2, 3, 4


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start and then kind; code points, end exclusive."""
    if not text:
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > end and text[start - 1] in LOCAL:
            start -= 1
        if domain and start < at:
            out.append((start, 0, end := domain.end()))
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Mentions:
    """Mentions in a column of texts: words first to stop of `spelled`, whether seeds, whether they look like an identifier or a name."""

    def __init__(self, column: pa.Array, base: list | None = None):
        data, start, end = buffers(column)
        self.spelled = sp = Spelled(data, start, end)
        low, n = (int(start[0]) if len(start) else 0), len(sp.start)
        self.body, self.low = data[low : int(end[-1]) if len(end) else low], start - low
        body = np.append(self.body, np.uint8(0))
        self.base = [base_spans(t) for t in column.to_pylist()] if base is None else base
        # Words of one token: with a few joining marks between.
        gap = sp.start[1:] - sp.end[:-1]
        joined, special = (sp.text[1:] == sp.text[:-1]) & (gap <= 3), np.zeros(max(0, n - 1), bool)
        for k in range(3):
            mark = body[np.minimum(sp.end[:-1] + k, len(body) - 1)] if n else np.empty(0, np.uint8)
            joined &= (gap <= k) | JOINING[mark]
            special |= (gap > k) & np.isin(mark, np.frombuffer(b"@_", np.uint8))
        first = np.flatnonzero(np.concatenate([[True], ~joined]))[:n] if n else np.empty(0, np.int64)
        stop = np.append(first[1:], n)[: len(first)]
        digit = ((body >= 48) & (body <= 57)).astype(np.uint8)
        digits = np.add.reduceat(digit, np.stack([sp.start, sp.end], 1).ravel(), dtype=np.int64)[::2] if n else np.empty(0, np.int64)
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        digits, special = sums(digits), sums(np.append(special & joined, False)[:n])
        like = (digits[stop] - digits[first] >= 3) | (special[stop] > special[first])
        initial = body[sp.start[first]] if n else np.empty(0, np.uint8)
        self.name = ~like & (initial >= 65) & (initial <= 90)
        # Seeds take the place of the tokens that they touch.
        found = [(r, s, e) for r, spans in enumerate(self.base) for s, _, e in spans]
        places = [self._bytes(column, r, s, e) for r, s, e in found]
        a = np.array([x for x, _ in places], np.int64)
        b = np.array([x for _, x in places], np.int64)
        i, j = np.searchsorted(sp.end, a, "right"), np.searchsorted(sp.start, b, "left")
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, i, 1)
        np.add.at(covered, np.maximum(i, j), -1)
        covered = sums(np.cumsum(covered)[:n] > 0)
        free = covered[stop] == covered[first]
        self.first, self.stop = np.append(first[free], i[j > i]), np.append(stop[free], j[j > i])
        self.seed = np.append(np.zeros(free.sum(), bool), np.ones((j > i).sum(), bool))
        self.name = np.append(self.name[free], np.zeros((j > i).sum(), bool))
        self.like = np.append(like[free], np.ones((j > i).sum(), bool)) | self.name
        # An instance is known by its words, whatever marks stand between them.
        size = self.stop - self.first
        at = np.repeat(self.first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        value = mix(sp.hash[at] + (at - np.repeat(self.first, size)).astype(np.uint64))
        self.instance = mix(np.add.reduceat(value, np.cumsum(size) - size) if len(size) else np.empty(0, np.uint64))

    def _bytes(self, column: pa.Array, row: int, start: int, end: int) -> tuple[int, int]:
        """Where a span of code points stands in `body`."""
        low, text = int(self.low[row]), column[row].as_py()
        at = low + len(text[:start].encode("utf-8", "replace"))
        return at, at + len(text[start:end].encode("utf-8", "replace"))

    def patterns(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, mention, hash) of the patterns of each kind; a name needs two words to be told by."""
        sp, n = self.spelled, len(self.spelled.hash)

        def word(k: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            there = (k >= 0) & (k < n)
            k = np.minimum(np.maximum(k, 0), max(0, n - 1))
            return there & (sp.text[k] == sp.text[own]), sp.hash[k]

        if not len(self.first):
            return
        near = {p: word(self.first + p if p < 0 else self.stop + p - 1, self.first) for p in (-2, -1, 1, 2)}
        for kind, around in ((BEFORE, (-1,)), (TWO_BEFORE, (-2, -1)), (TWO_AFTER, (1, 2)), (BOTH, (-1, 1))):
            there, value = np.ones(len(self.first), bool), np.full(len(self.first), kind, np.uint64)
            for p in around:
                there &= near[p][0]
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + near[p][1])
            if kind == BEFORE:
                there &= ~self.name
            at = np.flatnonzero(there)
            yield kind, at, value[at]


def spelled_pattern(m: Mentions, kind: int, mention: int) -> str:
    """A pattern as text, `_` for the mention."""
    word = lambda k: m.spelled.joined(int(k), int(k) + 1).decode("utf-8", "replace")
    i, j = m.first[mention], m.stop[mention]
    return {BEFORE: lambda: f"{word(i - 1)} _", TWO_BEFORE: lambda: f"{word(i - 2)} {word(i - 1)} _", TWO_AFTER: lambda: f"_ {word(j)} {word(j + 1)}", BOTH: lambda: f"{word(i - 1)} _ {word(j)}"}[kind]()


def _edges(patterns, instances):
    """(pattern, said, instance, seed, n) of each batch of texts: of patterns that one bitmap may have, or of instances that the other may.

    Without a bitmap of instances these are the seeds; without one of patterns only instances count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            m = Mentions(batch.column(0))
            known = m.seed if instances is None else in_bitmap(instances.value, m.instance) & m.like
            for kind, at, p in m.patterns():
                some = (in_bitmap(patterns.value, p) & m.like[at]) if patterns is not None else known[at]
                at, p = at[some], p[some]
                x = m.instance[at]
                order = np.lexsort((m.seed[at], x, p))
                p, x, at = p[order], x[order], at[order]
                new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] != x[:-1])]))[: len(p)]
                count = np.diff(np.append(new, len(p)))
                seed = np.maximum.reduceat(m.seed[at], new) if len(new) else np.empty(0, bool)
                said = [spelled_pattern(m, kind, k) for k in at[new].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(p[new].view(np.int64)), pa.array(said, pa.string()), pa.array(x[new].view(np.int64)), pa.array(seed), pa.array(count.astype(np.int64))], names=["pattern", "said", "instance", "seed", "n"])

    return run


def _totals(patterns):
    """(pattern, total, likely): how often patterns stand in each batch of texts, whatever they are about, and about mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            m = Mentions(batch.column(0))
            for _, at, p in m.patterns():
                some = in_bitmap(patterns.value, p)
                p, where = np.unique(p[some], return_inverse=True)
                total, likely = np.bincount(where, minlength=len(p)), np.bincount(where, m.like[at[some]], len(p))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.view(np.int64), total.astype(np.int64), likely.astype(np.int64))], names=["pattern", "total", "likely"])

    return run


EDGES = "pattern long, said string, instance long, seed boolean, n long"


def scored(edges: DataFrame, totals: DataFrame, support: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) of trusted patterns and (instance, belief), from edges (pattern, instance, seed, n) and (pattern, total).

    A pattern's confidence is the summed belief in its mentions over all occurrences; it is trusted if it reaches
    `confidence` with `support` different instances believed by half.  An instance's belief is 1 for a seed, else one minus
    the product of its trusted patterns' doubts.  Both are computed in turns until the same patterns are trusted and the sum of
    beliefs changes no more.  From the seeds on, beliefs and trusted patterns only grow, so that comes about.
    """
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("seeded"))
    seeds = staged(seeds, "seeds")
    belief, before = seeds.withColumnRenamed("seeded", "belief"), None
    while True:
        sure = F.countDistinct(F.when(F.col("belief") >= 0.5, F.col("instance")))
        got = edges.join(belief, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("sum"), sure.alias("sure"))
        trusted = got.join(totals, "pattern").select("pattern", F.least(F.lit(1.0), F.col("sum") / F.col("total")).alias("confidence"), "sure")
        trusted = staged(trusted.filter((F.col("confidence") >= confidence) & (F.col("sure") >= support)).select("pattern", "confidence"), "trusted")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        via = edges.select("pattern", "instance").distinct().join(trusted, "pattern").groupBy("instance").agg((1 - doubt).alias("via"))
        belief = staged(seeds.join(via, "instance", "left").select("instance", F.greatest("seeded", F.coalesce("via", F.lit(0.0))).alias("belief")), "belief")
        now = trusted.count(), belief.agg(F.sum("belief")).first()[0] or 0.0
        if before is not None and now[0] == before[0] and now[1] - before[1] <= STILL:
            return trusted, belief
        before = now


def trusted_patterns(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, said, confidence) of the patterns that may extract, from all texts of `docs`; see `scored`.

    Rounds go on until one finds no instance that the ones before have not; how many there were is logged.
    """
    texts = docs.select("text").filter(F.octet_length("text") > 0)
    send = docs.sparkSession.sparkContext.broadcast
    of_known = texts.mapInArrow(_edges(None, None), EDGES)  # the seeds' patterns
    known = patterns = None
    for turn in count(1):
        if known is not None:
            found = texts.mapInArrow(_edges(None, send(bitmap(known.withColumnRenamed("instance", "h"), BITS))), EDGES)
            of_known = found.join(known, "instance", "left_semi")
        few = of_known.groupBy("pattern").agg(F.countDistinct("instance").alias("k"), F.min("said").alias("said")).filter(F.col("k") >= support).select("pattern", "said")
        if patterns is not None:
            few = few.unionByName(patterns.select("pattern", "said")).dropDuplicates(["pattern"])
        few = staged(few, "few")
        totals = texts.mapInArrow(_totals(send(bitmap(few.withColumnRenamed("pattern", "h"), BITS))), "pattern long, total long, likely long")
        totals = totals.groupBy("pattern").agg(F.sum("total").alias("total"), F.sum("likely").alias("likely")).filter(F.col("likely") >= confidence * F.col("total"))
        patterns = staged(few.join(totals, "pattern"), "patterns")  # others can't become trusted, whatever is believed
        if patterns.isEmpty():
            return patterns.select("pattern", "said", F.lit(0.0).alias("confidence"))
        edges = texts.mapInArrow(_edges(send(bitmap(patterns.withColumnRenamed("pattern", "h"), BITS)), None), EDGES).join(patterns.select("pattern"), "pattern", "left_semi")
        edges = staged(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")), "edges")
        trusted, belief = scored(edges, patterns.select("pattern", "total"), support, confidence)
        now = belief.filter("belief >= 0.5").select("instance")
        if known is not None:
            now = now.unionByName(known).distinct()
        now = staged(now, "known")
        if known is not None and now.count() == known.count():
            break
        if known is None and edges.filter("not seed").select("instance").distinct().join(now, "instance", "left_semi").isEmpty():
            break
        known = now
    log.info("contexts settled after %d rounds", turn)
    return trusted.join(patterns.select("pattern", "said"), "pattern").select("pattern", "said", "confidence")


FOUND = "array<struct<kind: string, start: long, end: long>>"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fixed patterns' spans of each text, their counts and digest; t is kept to know the text by."""
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(2).to_pylist():
            base = base_spans(text)
            listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            rows.append((*(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base]))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "t", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])


def _extracted(patterns):
    """(id, t, start, end, pattern) of mentions that aren't seeds, in patterns that the bitmap may have; code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            m = Mentions(batch.column(2))
            for _, at, p in m.patterns():
                some = in_bitmap(patterns.value, p) & m.like[at] & ~m.seed[at]
                at, p = at[some], p[some]
                row = m.spelled.text[m.first[at]]
                places = []
                for r, a, b in zip(row.tolist(), m.spelled.start[m.first[at]].tolist(), m.spelled.end[m.stop[at] - 1].tolist(), strict=True):
                    start = len(m.body[m.low[r] : a].tobytes().decode("utf-8", "replace"))
                    places.append((start, start + len(m.body[a:b].tobytes().decode("utf-8", "replace"))))
                start, end = zip(*places, strict=True) if places else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p.view(np.int64))], names=["id", "t", "start", "end", "pattern"])

    return run


def find_pii(docs: DataFrame, **settings) -> DataFrame:
    """Of every row of `docs` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256 and found.

    found: array of (kind, start, end), code points, end exclusive, by start and then kind (email, ip, card, phone,
    context); counts and base_sha256 cover the first four kinds, the fixed patterns.  Null and empty texts have none, and
    repeated rows stay repeated (they count as often in a pattern's confidence, once in its support).  Without any trusted
    pattern the result is that of the fixed patterns.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    base = keyed.mapInArrow(_base, f"doc_id {kind}, t long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found {FOUND}")
    own = [c for c in base.columns if c != "t"]
    trusted = staged(trusted_patterns(docs, **settings), "trusted")
    if trusted.isEmpty():
        return base.select(*own)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(trusted.withColumnRenamed("pattern", "h"), BITS))
    hits = keyed.filter(F.octet_length("text") > 0).mapInArrow(_extracted(sent), f"id {kind}, t long, start long, end long, pattern long")
    hits = hits.join(trusted.select("pattern"), "pattern", "left_semi").select("id", F.col("t").alias("_t"), "start", "end").distinct()
    per = hits.groupBy("id", "_t").agg(F.collect_list(F.struct(F.lit("context").alias("kind"), "start", "end")).alias("more"))
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("_t")), "left")
    # By start, then by kind in the order of the fixed ones, `context` last.
    place = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    ranked = F.transform(F.concat("found", "more"), lambda x: F.struct(x["start"].alias("start"), F.when(place(x) > 0, place(x)).otherwise(len(KINDS) + 1).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    every = F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(*own[:-1], F.when(F.col("more").isNull(), F.col("found")).otherwise(every).alias("found"))


def redact(text: str, found: list[tuple[int, int]], by: str = "[personal data]") -> str:
    """`text` with the spans (start, end) replaced; overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(found):
        if end > at:
            out.append(text[at : max(at, start)] + (by if start >= at else ""))
            at = end
    return "".join(out) + text[at:]
