"""Personal data: e-mail addresses, IP addresses, card and phone numbers by form, and further ones by the words they stand among.

The forms find seeds. Everything else that looks like an identifier is a candidate: other runs of digits, other tokens with an @ or a spelt-out one, addresses of colons.
A seed's or candidate's surroundings give patterns: the two words before it, the word before and the word after, a label before it ("tel:"). Patterns and
instances (an identifier's value, however it is set apart) form a graph, on which Spark scores them in turn: a pattern's confidence in a kind is the
part of its different instances that are of this kind, one more instance of none being counted in; it is trusted from SUPPORT instances and TRUST on. An instance's
confidence is one minus the product of what its trusted patterns leave open, for kinds that its form allows. It then counts for its other patterns, and so on for ROUNDS.
Candidates whose confidence reaches TRUST, by their value, are added to the spans. Seeds count as they are; copies of a text, having the same values, add no support.

Texts are read once, by linear scans; patterns and instances travel as 64-bit hashes in rows of the graph, which are as many as the identifiers. Nothing is gathered by
pattern or by value beyond sums, and no part of the graph reaches the driver or, unless it is measured to be small, a broadcast.

Defined results: a null text is an empty one, which has no spans. Rows that repeat are searched alike, rows without id or of one id are told apart. Positions count code points,
however long the text is. Where candidates of two forms overlap, the earlier and then the longer stays; none overlaps a seed. Of kinds with equal confidence the first listed holds. An empty table gives no rows; extra columns pass by.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, sized, small_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, TRUST = 3, 3, 0.7
#: Words of a pattern are at most so long, and looked for no further away.
WORD_MOST, NEAR = 24, 80

# Linear forms of the fixed patterns: a run of digits is entered at its start, an address at its @.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates.
_COLONS = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")
_DIGITS = re.compile(r"[+(]?[0-9](?:[\x20().:/_-]{0,2}[0-9])+")
_AT = re.compile(r"@|[\[({<]\x20?(?:at|AT|ät)\x20?[\])}>]")
_SPELT = re.compile(r"\x20?[\[({<]\x20?(?:dot|DOT|punkt|point|punto)\x20?[\])}>]\x20?|\.")
_NAME, _TOKEN = re.compile(r"[\w%+-]+"), re.compile(r"\S+")
_DOTTED = re.compile(r"[0-9]+(\.[0-9]+){3}(:[0-9]+)?(/[0-9]+)?")
_DIGIT, _NOT_WORD = re.compile(r"[0-9]"), re.compile(r"[^\w]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def seeds(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed forms, leftmost and without overlap of their kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return out


def spelt_address(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around an @ (from at to after), in any letters, spelt-out dots included, unless a name in it is longer than 63."""
    start = at
    if start and text[start - 1] == " " and after - at > 1:
        start -= 1
    floor = max(0, start - 64)
    head = start
    while head > floor and (text[head - 1].isalnum() or text[head - 1] in "._%+-"):
        head -= 1
    if head == start or head == floor and floor:
        return None
    tail = after + 1 if after - at > 1 and text[after : after + 1] == " " else after
    m = _NAME.match(text, tail, tail + 64)
    if not m:
        return None
    end = m.end()
    while (d := _SPELT.match(text, end)) and (n := _NAME.match(text, d.end(), d.end() + 64)):
        m, end = n, n.end()
    return (head, end) if m.end() - m.start() < 64 else None


def alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands directly before or after."""
    return not (start and text[start - 1].isalnum()) and not text[end : end + 1].isalnum()


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """start, end and allowed kinds (bits in the order of KINDS) of what looks like an identifier and overlaps no seed."""
    met = []
    if "@" in text or _AT.search(text):
        met += [(*span, 1) for m in _AT.finditer(text) if (span := spelt_address(text, *m.span()))]
    if ":" in text:
        met += [(*m.span(), 2) for m in _COLONS.finditer(text) if alone(text, *m.span())]
    for m in _DIGITS.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        bits = 2 * (_DOTTED.fullmatch(m[0]) is not None) + 4 * (12 <= n <= 19) + 8 * (5 <= n <= 15)
        if bits and alone(text, *m.span()):
            met.append((*m.span(), bits))
    starts, reach = [], [0]
    for a, b in sorted((a, b) for _, a, b in taken):
        starts.append(a)
        reach.append(max(reach[-1], b))
    out, last = [], 0
    for a, b, bits in sorted(met, key=lambda x: (x[0], -x[1])):
        if a >= last and reach[bisect_left(starts, b)] <= a:
            out.append((a, b, bits))
            last = b
    return out


def hashed(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(parts))
    return h - (1 << 64) if h >> 63 else h


def value_key(value: str) -> int:
    """An identifier's value: letters lower-cased, without what sets digits apart."""
    return hashed(value.lower() if any(c.isalpha() for c in value) or "." in value else _NOT_WORD.sub("", value))


def plain_word(token: str) -> str:
    """A word of a pattern: lower-cased, without punctuation around it; empty if it holds digits or no letter."""
    word = _NOT_WORD.sub("", token.lower())[:WORD_MOST]
    return "" if _DIGIT.search(word) or not any(c.isalpha() for c in word) else word


def patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the patterns of what stands from start to end."""
    left = _TOKEN.findall(text, max(0, start - NEAR), start)[-2:]
    right = _TOKEN.findall(text, end, end + NEAR)[:2]
    right = right[1:] if right and not text[end : end + 1].isspace() and not any(c.isalpha() for c in right[0]) else right[:1]
    before, after = [plain_word(t) for t in left], plain_word(right[0]) if right else ""
    out = []
    if len(before) == 2 and all(before):
        out.append(hashed("before", *before))
    if before and before[-1] and after:
        out.append(hashed("around", before[-1], after))
    if left and left[-1][-1] in ":=#" and before[-1]:
        out.append(hashed("label", before[-1]))
    return out


_SPANS = [("kind", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("allowed", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row without span for each text, and one for each seed (kind from 0 on) and candidate (kind -1) in it."""
    for batch in batches:
        n = batch.num_rows
        names = ["uid", "id", *(name for name, _ in _SPANS)]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), *(pa.nulls(n, kind) for _, kind in _SPANS)], names)
        rows = []
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            own = seeds(text)
            rows += [(uid, KINDS.index(kind), a, b, 0, value_key(text[a:b]), patterns(text, a, b)) for kind, a, b in own]
            rows += [(uid, -1, a, b, bits, value_key(text[a:b]), patterns(text, a, b)) for a, b, bits in candidates(text, own)]
        columns = list(zip(*rows, strict=True)) or [()] * (len(_SPANS) + 1)
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns[1:], _SPANS, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.nulls(len(rows), batch.schema.field("id").type), *arrays], names)


def instances(spans: DataFrame) -> DataFrame:
    """Rows value, kind (-1: no seed has it), allowed: the different identifiers."""
    return spans.groupBy("value").agg(F.max("kind").alias("kind"), F.max("allowed").alias("allowed"))


def trusted(edges: DataFrame, support: int, trust: float) -> DataFrame:
    """Rows pattern, c (its confidence in each kind) of the patterns that are trusted in one; of an edge, s are the confidences of its instance."""
    kinds = range(len(KINDS))
    sums = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.get("s", F.lit(k))), 9).alias(f"s{k}") for k in kinds])
    share = lambda k: F.col(f"s{k}") / (F.col("n") + 1)
    good = [F.when((F.col(f"s{k}") >= support) & (share(k) >= trust), share(k)).otherwise(F.lit(0.0)) for k in kinds]
    return sums.select("pattern", F.array(*good).alias("c")).filter(F.array_max("c") > 0)


def scored(edges: DataFrame, good: DataFrame) -> DataFrame:
    """Rows value, s: candidates that trusted patterns hold, with their confidence in each kind."""
    held = edges.filter("kind = -1").join(sized(good), "pattern")
    left = [F.round(F.exp(F.sum(F.log(F.lit(1.0) - F.get("c", F.lit(k))))), 9).alias(f"l{k}") for k in range(len(KINDS))]
    sums = held.groupBy("value").agg(F.max("allowed").alias("allowed"), *left)
    return sums.select("value", F.array(*[F.when(F.col("allowed").bitwiseAND(1 << k) > 0, F.lit(1.0) - F.col(f"l{k}")).otherwise(F.lit(0.0)) for k in range(len(KINDS))]).alias("s"))


def bootstrap(spans: DataFrame, stash: Tables, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """Rows value, kind: seeds' values, and those of candidates that are found after so many rounds of patterns and instances."""
    every = stash.write(instances(spans), "instances")
    edges = stash.write(spans.select(F.explode("patterns").alias("pattern"), "value").distinct().join(every, "value"), "edges")
    own = F.array(*[(F.col("kind") == k).cast("double") for k in range(len(KINDS))])
    now, values = edges.withColumn("s", own), None
    for k in range(rounds):
        good = stash.write(trusted(now, support, trust), f"patterns{k}")
        values = stash.write(scored(edges, good).filter(F.array_max("s") >= trust), f"values{k}")
        now = edges.join(sized(values.withColumnRenamed("s", "t")), "value", "left").withColumn("s", F.coalesce("t", own)).drop("t")
    for name in ("edges", *(f"patterns{k}" for k in range(rounds)), *(f"values{k}" for k in range(rounds - 1))):
        stash.remove(name)
    known = every.filter("kind >= 0").select("value", "kind")
    if values is None:
        return known
    return known.unionByName(values.select("value", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("kind")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows id, seeds and spans: arrays of structs kind (its place in KINDS), first, past, in order of kind and place; spans hold the seeds too."""
    small_batches(docs.sparkSession)
    stash = Tables(docs.sparkSession)
    # Row numbers are drawn in the one pass over the texts and written with what it found, so that they hold from then on.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    both = stash.write(rows.mapInArrow(found, f"uid long, id {kind}, kind int, first int, past int, allowed int, value long, patterns array<long>"), "found")
    spans = both.filter("kind is not null")
    values = bootstrap(spans.drop("id"), stash, **how).withColumnRenamed("kind", "new")
    more = spans.filter("kind = -1").join(sized(values), "value").filter(F.expr("(allowed & shiftleft(1, new)) > 0"))
    every = spans.filter("kind >= 0").select("uid", "kind", "first", "past", F.lit(True).alias("seed"))
    every = every.unionByName(more.select("uid", F.col("new").alias("kind"), "first", "past", F.lit(False).alias("seed")))
    own = both.filter("kind is null").select("uid", "id").join(every, "uid", "left")
    listed_ = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("kind", "first", "past"))))
    return own.groupBy("uid").agg(F.first("id").alias("id"), listed_(F.col("seed")).alias("seeds"), listed_(F.col("seed").isNotNull()).alias("spans")).drop("uid")


def listed(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["past"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row the number of seeds of each kind, the digest of their list, and the list of all spans."""
    out = scan(docs, id_col, text_col, **how)
    count = lambda k: F.size(F.filter("seeds", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(F.col("id").alias(id_col), *map(count, range(len(KINDS))), F.sha2(listed("seeds"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
