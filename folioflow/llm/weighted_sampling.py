"""Document fingerprints by consistent weighted sampling.

A text's terms are its distinct runs of five words, weighted by how often they occur (fewer words: the whole
sequence). Each of SAMPLES samples draws, from the term's hash alone, c ~ Gamma(2, 1) and r ~ Gamma(2, 1) with b ~ U(0, 1), takes
t = floor(ln(weight) / r + b), y = exp(r (t - b)) and a = c / (y exp(r)), and keeps the term and t of the least a. Two texts agree
in a sample with the probability of their generalised Jaccard similarity. With r b = e1 and r (1 - b) = e2, two independent
exponentials, a term of weight 1 has a = c exp(-e2), so that it needs no more than three uniforms.

A fingerprint is 16 bits of each sample as hex digits. Neighbours in descending doc_id are found by dealing ranges of doc_id
to groups of about GROUP_BYTES of measured text, in which rows are streamed in order; the first row of each group is sent to the group before it too.
A doc_id of many rows, null for one, is dealt by ranges of its texts' hash, which is their order.

Defined results: null is the empty text; a text without words has the fingerprint of zeros, which is alike (1) to itself alone; doc_ids that
are null come last, and rows of equal doc_id are ordered by their text's hash; the only row is its own next; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .simhash import shingle_hashes, words_of

SHINGLE, SAMPLES = 5, 64
#: Text of a group that is aimed at, and the most groups, as the driver holds a number or two for each.
GROUP_BYTES, MOST_GROUPS = 8 << 20, 200_000
#: Terms drawn at once, so that the numbers stay in a core's cache.
ROWS = 512
_SEEDS = np.random.default_rng(20240613).integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_LAST = np.iinfo(np.int64).max


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _uniform(z: np.ndarray, shift: int) -> np.ndarray:
    return (((z >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)


class Draw:
    """The least a of each sample, with its term and t."""

    def __init__(self):
        self.a, self.term, self.t = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)

    def take(self, a: np.ndarray, term: np.ndarray, t: np.ndarray | None = None) -> None:
        t = np.zeros(SAMPLES, np.int64) if t is None else t
        less = (a < self.a) | ((a == self.a) & ((term < self.term) | ((term == self.term) & (t < self.t))))
        self.a, self.term, self.t = np.where(less, a, self.a), np.where(less, term, self.term), np.where(less, t, self.t)

    def join(self, other: Draw) -> Draw:
        self.take(other.a, other.term, other.t)
        return self

    def codes(self) -> np.ndarray:
        if np.isinf(self.a[0]):
            return np.zeros(SAMPLES, np.uint16)
        code = _mix(_mix(self.term ^ _SEEDS) + self.t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return np.maximum(code, 1).astype(np.uint16)


def draw(terms: np.ndarray) -> Draw:
    """The draw of terms of weight 1. Equal terms change nothing."""
    out = Draw()
    for i in range(0, len(terms), ROWS):
        h = terms[i : i + ROWS]
        z = _mix(h[:, None] ^ _SEEDS)
        a = -np.log(_uniform(z, 43) * _uniform(z, 22)) * _uniform(z, 1)
        k = a.argmin(0)
        out.take(a[k, np.arange(SAMPLES)], h[k])
    return out


def draw_heavy(out: Draw, terms: np.ndarray) -> Draw:
    """out with the terms that occur more than once, by their weights."""
    every, n = np.unique(terms, return_counts=True)
    every, n = every[n > 1], n[n > 1]
    for i in range(0, len(every), ROWS):
        h, weight = every[i : i + ROWS], n[i : i + ROWS]
        z = _mix(h[:, None] ^ _SEEDS)
        c, e2 = -np.log(_uniform(z, 43) * _uniform(z, 22)), -np.log(_uniform(z, 1))
        e1 = -np.log(_uniform(_mix(z), 43))
        r = e1 + e2
        t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + e1 / r)
        a = np.where(t > 0, c * np.exp(e1 - r * t - r), c * _uniform(z, 1))
        k = a.argmin(0)
        at = np.arange(SAMPLES)
        out.take(a[k, at].astype(np.float32), h[k], t[k, at].astype(np.int64))
    return out


class Text:
    """A text with its words and terms; parts of its terms are drawn once and used for both texts they are in."""

    def __init__(self, doc_id, text: str | None):
        self.id, self.text = doc_id, text or ""
        self.words = words_of(self.text)
        self.terms = shingle_hashes(self.words, SHINGLE)
        self.parts: list[tuple[int, int, Draw]] = []

    def cut(self, *at: int) -> None:
        edges = sorted({0, len(self.terms), *(min(max(x, 0), len(self.terms)) for x in at)})
        self.parts = [(i, j, draw(self.terms[i:j])) for i, j in zip(edges, edges[1:], strict=False)]

    def drawn(self, start: int, end: int) -> Draw:
        out = Draw()
        for i, j, d in self.parts:
            if start <= i and j <= end:
                out.join(d)
        return out

    def codes(self) -> np.ndarray:
        return draw_heavy(self.drawn(0, len(self.terms)), self.terms).codes()

    def kept(self) -> tuple[str, int]:
        """The part that an edit leaves, and how many of its terms are whole words' alone."""
        head = self.text[: len(self.text) - len(self.text) // 2]
        return head, max(0, len(head.encode().split()) - SHINGLE)


def codes_of(text: str | None) -> np.ndarray:
    """A text's samples, as 16 bits each."""
    own = Text(None, text)
    own.cut()
    return own.codes()


def _lent(before: Text | None, own: Text) -> tuple[str, int]:
    """What before's edit takes from own, and the end of own's terms from 1 that are whole in it."""
    if before is None:
        return "", 1
    tail = own.text[: len(before.text) // 2]
    return tail, max(1, len(tail.encode().split()) - SHINGLE)


def edited(own: Text, after: Text) -> tuple[str, np.ndarray]:
    """own's edited text and its samples."""
    head, whole = own.kept()
    tail, end = _lent(own, after)
    text = head + tail
    words, n_tail = words_of(text), len(tail.encode().split())
    first = len(words) - n_tail + 1  # where after's second word stands
    if len(words) < 4 * SHINGLE or first < whole or len(own.words) <= SHINGLE or len(after.words) <= SHINGLE:
        return text, codes_of(text)
    middle = shingle_hashes(words[whole : first + SHINGLE - 1], SHINGLE) if first > whole else own.terms[:0]
    rest_at = first + end - 1
    rest = shingle_hashes(words[rest_at:], SHINGLE) if len(words) - rest_at >= SHINGLE else own.terms[:0]
    if len(words[whole : first + SHINGLE - 1]) < SHINGLE:
        return text, codes_of(text)
    out = own.drawn(0, whole).join(after.drawn(1, end)).join(draw(np.concatenate([middle, rest])))
    return text, draw_heavy(out, np.concatenate([own.terms[:whole], middle, after.terms[1:end], rest])).codes()


def _hex(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("size")).first()
    groups = min(MOST_GROUPS, max(4 * spark.sparkContext.defaultParallelism, -(-total["size"] // GROUP_BYTES)))
    bounds = rows.select("id").agg(F.percentile_approx("id", [k / groups for k in range(1, groups)], min(20 * groups, 1_000_000))).first()[0] or []
    bounds = np.array(sorted(set(bounds)), np.int64)
    # A doc_id with more rows than a group should have is a bound itself, and its rows are dealt by their texts' hash.
    limit = max(1, -(-total["n"] // groups))
    heavy = {r["id"]: -(-r["n"] // limit) for r in rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).collect()} if total["n"] > groups else {}
    bounds = np.unique(np.concatenate([bounds, np.array([x for i in heavy if i is not None for x in (i - 1, i)], np.int64)]))
    many = np.array(sorted(i for i in heavy if i is not None), np.int64)
    pieces = np.array([heavy[int(i)] for i in many], np.int64)

    def group_of(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        """Groups count from the largest ids, within an id of many rows from the least hash; null ids are the last."""
        known, own = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        at = np.where(known, len(bounds) - np.searchsorted(bounds, own, side="left"), len(bounds) + 1).astype(np.int64)
        parts = np.where(known, 1, heavy.get(None, 1)).astype(np.int64)
        if len(many):
            k = np.minimum(np.searchsorted(many, own), len(many) - 1)
            parts = np.where(known & (many[k] == own), pieces[k], parts)
        place = ((hashes.to_numpy().astype(np.float64) / 2.0**64 + 0.5) * parts).astype(np.int64)
        return (at << 32) + np.clip(place, 0, parts - 1)

    rows = rows.withColumn("h", F.xxhash64("text"))

    def tops(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(group_of(b.column(0), b.column(1))), b.column(0), b.column(1)], names=["g", "id", "h"])

    # The first row of each group; groups are as many as the text's size says, and as many again at most.
    tops_of = rows.select("id", "h").mapInArrow(tops, "g long, id long, h long").groupBy("g").agg(F.max("id").alias("top"), F.min_by("h", F.struct((-F.col("id")).alias("i"), "h")).alias("h"))
    first = {r["g"]: (r["top"], r["h"]) for r in tops_of.collect()}
    order = sorted(first)
    sent = {g: order[k - 1] for k, g in enumerate(order)}  # the first group's goes to the last

    def deal(batches):
        for b in batches:
            g, ids, hashes = group_of(b.column(0), b.column(1)), b.column(0).to_pylist(), b.column(1).to_pylist()
            also = np.array([i for i, x in enumerate(zip(ids, hashes, strict=True)) if x == first[int(g[i])]], np.int64)
            own = [b.column(0), b.column(1), b.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.zeros(len(ids), bool)), *own], names=["g", "halo", "id", "h", "text"])
            if len(also):
                some = b.take(pa.array(also))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([sent[int(x)] for x in g[also]], np.int64)), pa.array(np.ones(len(also), bool)), *some.columns], names=["g", "halo", "id", "h", "text"])

    dealt = rows.select("id", "h", "text").mapInArrow(deal, "g long, halo boolean, id long, h long, text string").repartition(max(1, groups // 2), "g")
    dealt = dealt.sortWithinPartitions("g", "halo", F.col("id").desc_nulls_last(), "h", F.col("text")).drop("h")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        own, own_codes, group = None, None, None
        for b in batches:
            out = []
            for g, halo, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    own, group = None, g
                elif own is None:
                    continue  # halo rows after the first
                after = Text(doc_id, text)
                after.cut(1, _lent(own, after)[1], after.kept()[1])
                codes = after.codes()
                if own is not None:
                    changed, edited_codes = edited(own, after)
                    out.append((own.id, len(own.text), hashlib.sha256(changed.encode()).hexdigest(), _hex(own_codes), _hex(edited_codes), float((own_codes == edited_codes).mean()), float((own_codes == codes).mean())))
                own, own_codes = (None, None) if halo else (after, codes)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
