"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each position that is set in over half of the shingle hashes. Its segments are looked
up in tables: the small Hamming ball around each segment is enumerated, table rows with that value are fetched and
the complete distance is verified. Equal fingerprints are one table row, so copies never make pairs.

Buckets of over CROWD fingerprints, where pairs would grow with the square, are linked without pairs: by shared
points of small balls around the rest of the fingerprint (link), which finds the same components exactly.

Near-duplicates of a stated Jaccard similarity (near_groups, one_of_each) are found by the same method, with fingerprints of 192 bits in nine segments: at similarity
0.8 of the shingles a bit differs with probability 0.15, so that whole balls would be too large. The bits that differ are those whose majority was narrow, and of each
segment's ball the points that are likeliest by that are looked up. What meets there is held against the complete distance, and what passes against the exact similarity.

Defined results: a null or wordless text has fingerprint zero and links as any other; equal texts link; a group's
component_id is its smallest doc_id (null if all are null); rows that repeat get a row each (one_of_each keeps
all of the group's rows of the doc_id that stays, or without one if none has any); an empty table gives no rows; extra columns pass through one_of_each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches
from .graph import components

#: Bits in which linked 64-bit fingerprints may differ.
RADIUS = 3
#: Fingerprints in one bucket from which it is linked by ball points, not pairs.
CROWD = 128
#: Shingles hashed and counted at once, which bounds the memory that a very long text needs.
BLOCK = 1 << 16


def shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    """Runs of k words joined by a space, repeats included; fewer words: the whole sequence."""
    if len(words) <= k:
        return iter([b" ".join(words)] if words else [])
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - k]]
    return (joined[s : e - 1] for s, e in zip(starts, ends[k - 1 :], strict=False))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles(words, k)), np.uint64, max(1, len(words) - k + 1) if words else 0)


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that follow from each hash; the first are the hash itself."""
    if not k:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, longs: int = 1) -> np.ndarray:
    """longs x 64 bits, each set if it is set in over half of the hashes."""
    out = np.zeros(longs, np.uint64)
    for k in range(longs):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), BLOCK):
            part = np.ascontiguousarray(_spread(hashes[i : i + BLOCK], k).astype("<u8"))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows id, fp (64 bits as a long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [int(majority(shingle_hashes(words_of(t.as_py()), shingle)).view(np.int64)[0]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _bit_masks(n: int, bits: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(bits), n)]


def link(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges a, b that connect exactly those of the distinct 64-bit fps (column fp) that a chain of steps of at most RADIUS bits connects.

    Of two halves one differs in at most one bit, so balls of one bit around each half find every pair.
    """
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    fp = F.col("fp")
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(fp, 32).alias("key"), low(fp).alias("rest")), F.struct(F.lit(1).alias("seg"), low(fp).alias("key"), F.shiftrightunsigned(fp, 32).alias("rest")))
    table = cut(fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.*"))
    hot = cut(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("seg", "key"))
    some_hot = not hot.isEmpty()
    # Of two values that differ in one bit, the one that has the bit set is the one that probes.
    flips = F.filter(F.array(*[F.lit(m).cast("long") for m in (0, *_bit_masks(1, 32))]), lambda m: (m == 0) | (F.col("key").bitwiseAND(m) != 0))
    probes = table.select("seg", F.col("fp").alias("a"), F.col("rest").alias("near"), "key", F.explode(flips).alias("m")).select("seg", "a", "near", "m", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    cold = table.join(hot, ["seg", "key"], "left_anti") if some_hot else table
    verified = (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS) & ((F.col("m") != 0) | (F.col("a") < F.col("fp")))
    p, t = probes.alias("p"), cold.alias("t")
    edges = p.join(t, (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key")) & verified).select("a", F.col("fp").alias("b"))
    if some_hot:
        edges = edges.unionByName(_crowded(table, hot))
    return cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _crowded(table: DataFrame, hot: DataFrame) -> DataFrame:
    """Edges for the crowded buckets, linear in their rows.

    A member of the bucket is native to the points z within one bit of its rest and far from those at two bits; a member
    of a bucket one bit away probes its points within one bit. All that meet a native at z are within three bits of it,
    and any pair with a member of the bucket within three bits meets at a point that is native to that member.
    """
    keys = hot.select("seg", "key")
    far = [F.lit(m).cast("long") for m in _bit_masks(2, 32)]
    one = F.array(*[F.lit(m).cast("long") for m in (0, *_bit_masks(1, 32))])
    point = lambda masks: F.transform(masks, lambda m: F.col("rest").bitwiseXOR(m))
    members = table.join(keys, ["seg", "key"])
    native = members.select("seg", "key", "fp", F.explode(point(one)).alias("z"))
    around = members.select("seg", "key", "fp", F.explode(point(F.array(*far))).alias("z"))
    flips = F.array(*[F.lit(m).cast("long") for m in _bit_masks(1, 32)])
    beside = table.select("seg", "fp", "rest", F.explode(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))).alias("key")).join(keys, ["seg", "key"])
    beside = beside.select("seg", "key", "fp", F.explode(point(one)).alias("z"))
    hub = native.groupBy("seg", "key", "z").agg(F.min("fp").alias("a"))
    met = native.unionByName(around).unionByName(beside).join(hub, ["seg", "key", "z"])
    return met.filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def group(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """prints (cut: id, fp) with component_id: the smallest id that links reach from a row's fp."""
    roots = components(edges)
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = cut(of)
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(cut(of.join(ids, "root").select("fp", "component_id")), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows id, fp, fingerprint (16 hex digits), component_id: one for each document."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    edges = link(prints.select("fp").distinct())
    return group(prints, edges).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


# --- Near-duplicates of a stated similarity of word shingles ---------------------------------------------------

#: Near-duplicates share this part of their distinct five-word shingles or more.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints have so many longs; each holds SEGMENTS segments of WIDTH bits.
LONGS, SEGMENTS, WIDTH = 3, 3, 21
#: Points of a segment's ball that are looked up, its own value among them, out of those that flip some of its so many narrowest bits.
POINTS, NARROW = 18, 8
#: Sets of so many shingles or fewer, where a shingle moves many bits at once, are looked up as they are without any one of them, too.
FEW = 12
#: Bits in which fingerprints may differ for their texts' exact similarity to be looked at: at similarity 0.8 of them differ 29 with a deviation of 5, without any 96 with one of 7.
FAR = 56
#: Rows from which buckets of the sorted lookup are taken together.
SCANNED = 1 << 16
#: Members and shingles of a block, in which all pairs are verified in one task; larger buckets are more blocks; blocks that meet each other have MEETING members.
MEMBERS, MEETING, SHINGLES = 64, 256, 2_000_000
#: Blocks of a bucket that all meet each other, so that no member is in more; of larger buckets members meet in their rarest shingles.
MEETINGS = 16
#: Rounds in which a large bucket's unconnected parts are dealt into blocks anew, before all its blocks or its members' rarest shingles meet.
ROUNDS = 2
#: Shingles that this many members of a block share or fewer are counted pair by pair, others by products of matrices.
RARE = 12
_FLIPS = (np.arange(1 << NARROW)[:, None] >> np.arange(NARROW)) & 1


def bit_counts(sets: list[np.ndarray], longs: int = LONGS) -> np.ndarray:
    """Rows of longs x 64 counts: in how many of a set's hashes each bit is set. Sums of up to 255 hashes are taken eight bits at a time, in the bytes of a long."""
    sizes = np.array([len(h) for h in sets], np.int64)
    out = np.zeros((len(sets), longs * 64), np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([sets[i] for i in some])
    ends = np.cumsum(sizes[some])
    cuts = np.concatenate([np.arange(e - n, e, 255) for e, n in zip(ends, sizes[some], strict=True)])
    of = np.repeat(some, -(-sizes[some] // 255))
    step = BLOCK // 255
    for i in range(0, len(cuts), step):
        at, own = cuts[i : i + step], of[i : i + step]
        rows = flat[at[0] : cuts[i + step] if i + step < len(cuts) else len(flat)]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for k in range(longs):
            h = _spread(rows, k)
            sums = np.stack([np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0101010101010101), at - at[0]).astype("<u8").view(np.uint8).reshape(-1, 8) for b in range(8)], axis=2)
            out[own[heads], 64 * k : 64 * k + 64] += np.add.reduceat(sums.reshape(len(at), 64), heads, axis=0, dtype=np.int64)
    return out


def prints_and_points(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sets' fingerprints (LONGS longs) and the values looked up for each, the number of the segment above their bits; a segment's own value is the first of its points."""
    segment = np.arange(LONGS * SEGMENTS, dtype=np.int64) << WIDTH
    parts = lambda x: x.reshape(-1, LONGS, 64)[:, :, : SEGMENTS * WIDTH].reshape(-1, LONGS * SEGMENTS, WIDTH)
    values = lambda bits: parts(bits).astype(np.int64) @ (np.int64(1) << np.arange(WIDTH)) + segment
    counts, sizes = bit_counts(sets), np.array([len(h) for h in sets], np.int64)[:, None]
    bits = 2 * counts > sizes
    # The odds that a bit does not differ at SIMILARITY, by how far its majority is from an even one: log odds of the normal distribution.
    x = 1.94 * np.abs(2 * counts - sizes) / np.sqrt(np.maximum(sizes, 1))
    odds = parts(1.5976 * x + 0.0706 * x**3)
    narrow = np.argsort(odds, axis=2, kind="stable")[:, :, :NARROW]
    best = np.argsort(np.take_along_axis(odds, narrow, 2) @ _FLIPS.T, axis=2, kind="stable")[:, :, :POINTS]
    masks = np.take_along_axis((np.int64(1) << narrow) @ _FLIPS.T, best, 2)
    points = list((values(bits)[:, :, None] ^ masks).reshape(len(sets), -1))
    few = [i for i, h in enumerate(sets) if 1 < len(h) <= FEW]
    less = [np.delete(sets[i], k) for i in few for k in range(len(sets[i]))]
    if less:
        own = values(2 * bit_counts(less) > np.array([len(h) for h in less])[:, None])
        for i, more in zip(few, np.split(own, np.cumsum([len(sets[i]) for i in few])[:-1]), strict=True):
            points[i] = np.concatenate([points[i], np.setdiff1d(more, points[i])])
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), points


def _kind(h: np.ndarray) -> int:
    """The name of a set of hashes."""
    return xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), 42) - (1 << 63)


def signatures(docs: DataFrame, text_col: str, columns: tuple[str, ...] = ("prints", "segs", "full")) -> DataFrame:
    """docs' ids with text_key (the text's hash), kind (the name of its set of distinct shingles) and, of these, the columns asked for: prints (the
    fingerprint's longs), segs (the values looked up, each at its place) and full (the hashes of the distinct shingles)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                sets = [np.unique(shingle_hashes(words_of(t.as_py()), SHINGLE)) for t in part.column(2)]
                own = {"full": [h.view(np.int64) for h in sets]}
                if "segs" in columns:
                    prints, points = prints_and_points(sets)
                    own |= {"prints": list(prints.view(np.int64)), "segs": points}
                arrays = [pa.array([_kind(h) for h in sets], pa.int64()), *(pa.array(own[c], pa.list_(pa.int64())) for c in columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["id", "text_key", "kind", *columns])

    schema = ", ".join(["id long, text_key long, kind long", *(f"{c} array<long>" for c in columns)])
    return docs.select("id", F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def near_in_buckets(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For rows sorted by bucket: the first row that steps of at most FAR bits between rows of its bucket reach, -1 if none is near. prints: a row of unsigned longs each."""
    n = len(keys)
    first, i = np.arange(n), np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, n))
    met, crowded = np.zeros(n, bool), np.repeat(sizes > CROWD, sizes)
    near, d, i = [], 1, i[~crowded]
    while len(i):
        i = i[i + d < n]
        i = i[keys[i] == keys[i + d]]
        near.append(np.stack([i, i + d])[:, np.bitwise_count(prints[i] ^ prints[i + d]).sum(1, dtype=np.int64) <= FAR])
        d += 1
    a, b = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)
    met[a] = met[b] = True
    while (first[a] != first[b]).any():
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, a, least)
        np.minimum.at(first, b, least)
    for s, m in zip(starts[sizes > CROWD], sizes[sizes > CROWD], strict=True):
        left = np.arange(s, s + m)
        while len(left):
            head, reached, left = left[0], [left[0]], left[1:]
            while reached and len(left):
                close = np.bitwise_count(prints[left] ^ prints[reached.pop()]).sum(1, dtype=np.int64) <= FAR
                new, left = left[close], left[~close]
                first[new], met[new] = head, True
                met[head] |= len(new) > 0
                reached += new.tolist()
    return np.where(met, first, -1)


def spanned(first: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows and the first row that each reaches (-1: none): pairs of names, as few as connect what rows, and rows of one name, connect: each with the least that it reaches."""
    own = np.flatnonzero(first >= 0)
    known, at = np.unique(names[np.concatenate([first[own], own])], return_inverse=True)
    a, b = np.split(at, 2)
    least = np.arange(len(known))
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        for x in (a, b, least[a], least[b]):
            np.minimum.at(least, x, low)
        least = least[least]
    far = np.flatnonzero(least != np.arange(len(known)))
    return known[least[far]], known[far]


def met(kinds: DataFrame) -> DataFrame:
    """Rows seg, key, kind: the group (seg, key) of each of kinds (kind, prints, segs) that meets others in a looked-up value and is within FAR bits there, and of chains of them.

    A kind is in one group, however many values it meets others in. Rows lie sorted by value; a bucket's are held in one task, without their sets, and only what spans its groups is a row.
    They are dealt by the values' upper bits, which most points of a segment share, so that a kind's rows lie side by side and compress.
    """

    def run(batches):
        held = []

        def groups(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, names, *longs = np.concatenate(rows, axis=1)
            pairs = spanned(near_in_buckets(keys, np.stack(longs, axis=1).view(np.uint64)), names)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])

        for b in batches:
            rows = np.stack([c.to_numpy() for c in b.columns])
            ends = np.flatnonzero(rows[0] != rows[0, -1]) if b.num_rows else []
            if len(ends) and sum(r.shape[1] for r in held) >= SCANNED:
                cut_at = ends[-1] + 1
                yield groups([*held, rows[:, :cut_at]])
                held, rows = [], rows[:, cut_at:]
            if rows.shape[1]:
                held.append(rows)
        if held:
            yield groups(held)

    rows = kinds.select(F.explode("segs").alias("key"), "kind", *(F.col("prints")[k].alias(f"print{k}") for k in range(LONGS)))
    dealt = rows.repartition(F.shiftright("key", WIDTH - 8)).sortWithinPartitions("key")
    return components(dealt.mapInArrow(run, "a long, b long")).select(F.lit(0).alias("seg"), F.col("root").alias("key"), F.col("node").alias("kind"))


def common_shingles(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles each pair of members shares; flat: their sets, one after another."""
    m = len(sizes)
    member = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, member = flat[order], member[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(starts, len(flat)))
    out = np.zeros((m, m), np.float32)
    for c in range(2, RARE + 1):
        own = starts[counts == c]
        if len(own):
            of = member[own[:, None] + np.arange(c)]
            for i, j in combinations(range(c), 2):
                np.add.at(out, (of[:, i], of[:, j]), 1)
    many = np.flatnonzero(counts > RARE)
    for k in range(0, len(many), 2048):
        own = many[k : k + 2048]
        has = np.zeros((m, len(own)), np.float32)
        for col, s in enumerate(own):
            has[member[starts[s] : starts[s] + counts[s]], col] = 1
        out += np.triu(has @ has.T, 1)
    return np.maximum(out, out.T)


def linked(kinds: np.ndarray, roots: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect what the links between members of different roots connect: one less than members at most."""
    m = len(kinds)
    if m == 2:
        common = len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))
        return [(int(kinds[0]), int(kinds[1]))] if roots[0] != roots[1] and common >= (sizes.sum() - common) * similarity - 1e-9 else []
    common = common_shingles(flat, sizes)
    near = (common >= (sizes[:, None] + sizes[None, :] - common) * similarity - 1e-6) & (roots[:, None] != roots[None, :])
    out, left = [], np.ones(m, bool)
    for s in range(m):
        if left[s] and near[s].any():
            left[s], reached = False, [s]
            while reached:
                i = reached.pop()
                new = np.flatnonzero(near[i] & left)
                left[new] = False
                out += [(int(kinds[i]), int(kinds[j])) for j in new]
                reached += new.tolist()
    return out


def _edges(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges a, b from rows block, kind, root, full: all pairs of a block are verified by their exact Jaccard similarity in one task."""

    def run(batches):
        group, kinds, roots, sets = None, [], [], []

        def close() -> list[tuple[int, int]]:
            if len(set(roots)) < 2:
                return []
            sizes = np.array([len(s) for s in sets])
            return linked(np.array(kinds), np.array(roots), np.concatenate(sets), sizes, similarity)

        for b in batches:
            out = []
            flat, ends = b.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(b.column(3)).to_numpy())])
            for i, (block, kind, root) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                if block != group:
                    out += close()
                    group, kinds, roots, sets = block, [], [], []
                if not kinds or kinds[-1] != kind:
                    kinds.append(kind)
                    roots.append(root)
                    sets.append(flat[ends[i] : ends[i + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
        out = close() if kinds else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    dealt = rows.select("block", "kind", "root", "full").repartition("block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(kinds: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, rounds: int = ROUNDS, rarest: bool = False) -> DataFrame:
    """Edges a, b that connect exactly those of kinds that share a bucket and have the similarity, and chains of them.

    kinds: kind, segs, of which each place and value is a bucket; or seg, key, kind, a row for each bucket of a kind. sets_of gives the rows kind, full of some kinds.
    A bucket is a block, or blocks of bounded size if it is a large one; all pairs of a block are verified where it lies and only what connects them is a row.
    Each kind's largest bucket comes first, as the others of near copies are mostly parts of it: of those, only what still holds several parts is verified too.
    Parts of large buckets that are connected already become one member, which is dealt anew,
    and at the end the blocks of buckets that still have several parts meet each other, if they are MEETINGS at most. Members of larger ones meet in the rarest of
    their shingles instead (_rarest), where all blocks of a bucket meet (rarest). Rounds and order change the work alone.
    """
    small_batches(kinds.sparkSession)
    table = cut(kinds.select("kind", F.posexplode("segs").alias("seg", "key")) if "segs" in kinds.columns else kinds)
    shared = cut(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seg", "key"))
    table = cut(table.join(shared, ["seg", "key"]))
    sets = cut(sets_of(table.select("kind").distinct()).select("kind", "full", F.size("full").alias("n")))
    table = table.join(sets.select("kind", "n"), "kind")

    def blocks_of(rows: DataFrame, size: int) -> DataFrame:
        """The blocks that the buckets of rows need."""
        n = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.ceil(F.sum("n") / F.lit(SHINGLES)))
        return rows.groupBy("seg", "key").agg(n.alias("blocks"), F.count(F.lit(1)).alias("members"))

    def place(seed: int) -> Column:
        return F.pmod(F.xxhash64("kind", F.lit(seed)), F.col("blocks"))

    def apart(members: DataFrame) -> DataFrame:
        """The rows of buckets that hold several roots."""
        several = members.groupBy("seg", "key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("seg", "key")
        return cut(members.join(several, ["seg", "key"]))

    with_sets = lambda rows: rows.join(sets.select("kind", "full"), "kind")
    in_blocks = lambda rows, root: rows.select("kind", root.alias("root"), F.xxhash64("seg", "key", place(0)).alias("block"))
    table = cut(table.join(blocks_of(table, MEMBERS), ["seg", "key"]))
    largest = cut(table.groupBy("kind").agg(F.max(F.struct("members", F.xxhash64("seg", "key").alias("h"), "seg", "key")).alias("m")).select("m.seg", "m.key").distinct())
    edges = cut(_edges(with_sets(in_blocks(table.join(largest, ["seg", "key"]), F.col("kind"))), similarity))
    others = cut(table.join(largest, ["seg", "key"], "left_anti"))
    if not others.isEmpty():
        others = apart(_rooted(others, edges))
        edges = cut(edges.unionByName(_edges(with_sets(in_blocks(others, F.col("root"))), similarity)))
    many = cut(table.filter("blocks > 1").select("seg", "key", "kind", "n"))
    if many.isEmpty():
        return edges
    for k in range(1, rounds + 1):
        members = _rooted(many, edges)
        pick = F.min(F.struct(F.xxhash64("kind", F.lit(-k)).alias("h"), F.col("kind").alias("kind"), F.col("n").alias("n")))
        one = cut(members.groupBy("seg", "key", "root").agg(pick.alias("m")).select("seg", "key", "root", "m.kind", "m.n"))
        rows = one.join(blocks_of(one, MEMBERS), ["seg", "key"]).select("kind", "root", F.xxhash64("seg", "key", place(k), F.lit(k)).alias("block"))
        edges = cut(edges.unionByName(_edges(with_sets(rows), similarity)))
    left = apart(_rooted(many, edges))
    left = cut(left.join(blocks_of(left, MEETING), ["seg", "key"]))
    own = left if rarest else left.filter(F.col("blocks") <= MEETINGS)
    own = own.withColumn("i", place(rounds + 1)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = own.select("kind", "root", F.xxhash64("seg", "key", F.least("i", "j"), F.greatest("i", "j"), F.lit(rounds + 1)).alias("block"))
    edges = cut(edges.unionByName(_edges(with_sets(rows), similarity)))
    left = left.filter(F.col("blocks") > MEETINGS)
    if rarest or left.isEmpty():
        return edges
    left = apart(_rooted(_rarest(left, sets, similarity), edges))
    return cut(edges.unionByName(similar(left.select("seg", "key", "kind"), lambda wanted: sets.join(wanted, "kind", "left_semi").select("kind", "full"), similarity, 0, True)))


def _rarest(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows seg, key, kind: buckets in which all pairs of members (seg, key, kind) of the similarity meet. sets: kind, full, n.

    Of two such sets, both ordered by how many members of the bucket hold a shingle, the first n - ceil(n x similarity) + 1 of each share one.
    """
    each = cut(members.select("seg", "key", "kind").join(sets, "kind").select("seg", "key", "kind", "n", F.explode("full").alias("shingle")))
    often = each.groupBy("seg", "key", "shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met_again = each.join(often, ["seg", "key", "shingle"]).groupBy("seg", "key", "kind", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1 - (F.col("n") - F.size("shared"))
    rows = met_again.filter(first > 0).select("seg", "key", "kind", F.explode(F.slice("shared", F.lit(1), first.cast("int"))).alias("s"))
    return cut(rows.select("seg", F.xxhash64("key", "s.shingle").alias("key"), "kind"))


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (kind) with root, of what edges connect to them."""
    roots = components(edges).withColumnRenamed("node", "kind")
    return cut(members.join(roots, "kind", "left").withColumn("root", F.coalesce("root", "kind")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Rows id, component_id: one for each document. Kinds are the distinct sets of shingles; copies of a text are one kind."""
    return _grouped(docs, id_col, text_col, similarity).select("id", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Rows id, fp, component_id; text_key, the text's hash, tells the rows of one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    each = cut(signatures(rows, "text", ("prints", "segs")).withColumnRenamed("kind", "fp"))
    kinds = cut(each.groupBy(F.col("fp").alias("kind")).agg(F.first("prints").alias("prints"), F.first("segs").alias("segs"), F.min(F.struct("text_key", "id")).alias("of")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Of kinds that meet another alone, from one of their texts: whole sets take more room than the texts."""
        of = kinds.join(wanted, "kind").select(F.col("of.text_key").alias("own_key"), F.col("of.id").alias("own_id"))
        own = rows.join(of, (F.xxhash64("text") == F.col("own_key")) & F.col("id").eqNullSafe(F.col("own_id")), "left_semi")
        return signatures(own, "text", ("full",)).select("kind", "full").dropDuplicates(["kind"])

    return group(each.select("id", "text_key", "fp"), similar(met(kinds), sets_of, similarity))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each near-duplicate group: that of the smallest doc_id stays.

    Rows go by doc_id and text: another text of the same doc_id, or without one, is in a group of its own.
    """
    gone = _grouped(docs, id_col, text_col, similarity).filter(~F.col("id").eqNullSafe(F.col("component_id")))
    key, text_key = fresh("gone_id", docs.columns), fresh("gone_text", docs.columns)
    gone = cut(gone.select(F.col("id").alias(key), F.col("text_key").alias(text_key)).distinct())
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text_key)), "left_anti")
