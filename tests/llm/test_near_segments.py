"""Near copies are looked up by segments of SimHash fingerprints, held against the complete distance."""

import numpy as np
import pytest

from folioflow.llm import simhash


def hashes(rng, n):
    return rng.integers(0, 1 << 64, n, dtype=np.uint64)


def test_fingerprints_are_majorities_and_segments_their_own_points():
    rng = np.random.default_rng(1)
    sets = [hashes(rng, n) for n in (1, 5, 0, 254, 255, 256, 700, 66000, 3)]
    prints, points = simhash.prints_and_points(sets)
    for h, row, own in zip(sets, prints, points, strict=True):
        assert (row == simhash.majority(h, simhash.LONGS)).all()
        for k in range(simhash.LONGS * simhash.SEGMENTS):
            at, s = divmod(k, simhash.SEGMENTS)
            value = int(row[at]) >> (s * simhash.WIDTH) & ((1 << simhash.WIDTH) - 1)
            assert own[k * simhash.POINTS] == (k << simhash.WIDTH) + value
        assert len(set(own.tolist())) == len(own)


@pytest.mark.parametrize(("common", "more"), [(4, (0, 1)), (8, (1, 1)), (8, (0, 2)), (24, (3, 3)), (80, (0, 20)), (160, (20, 20))])
def test_sets_of_similarity_four_fifths_meet(common, more):
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(3000):
        both = hashes(rng, common)
        pairs.append([np.concatenate([both, hashes(rng, n)]) for n in more])
    (a, x), (b, y) = (simhash.prints_and_points([p[k] for p in pairs]) for k in (0, 1))
    far = np.bitwise_count(a ^ b).sum(1, dtype=int) > simhash.FAR
    lost = sum(bool(f) or not set(p.tolist()) & set(q.tolist()) for f, p, q in zip(far, x, y, strict=True))
    assert lost <= 5


@pytest.mark.parametrize("crowd", [0, 4, 128])
def test_buckets_hold_chains_of_near_fingerprints(monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 400))
    centres = rng.integers(0, 1 << 64, (3, simhash.LONGS), dtype=np.uint64)
    prints = centres[rng.integers(0, 3, 400)]
    for row in prints:
        for b in rng.choice(simhash.LONGS * 64, rng.integers(0, 70), replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    first = list(range(400))
    for i in range(400):
        for j in range(i):
            if keys[i] == keys[j] and first[i] != first[j] and np.bitwise_count(prints[i] ^ prints[j]).sum(dtype=int) <= simhash.FAR:
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if f == old else f for f in first]
    got = simhash.near_in_buckets(keys, prints)
    parts = lambda f: {frozenset(i for i in range(400) if f[i] == r) for r in set(f)}
    alone = {p for p in parts(first) if len(p) == 1}
    assert {frozenset([i]) for i in range(400) if got[i] < 0} == alone
    assert parts([g if g >= 0 else -i - 1 for i, g in enumerate(got)]) == parts(first)


def test_groups_of_a_table_are_named_by_their_members(spark):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        own = hashes(rng, 100)
        sets += [own, np.concatenate([own[2:], hashes(rng, 1)]), hashes(rng, 100)]
    prints, points = simhash.prints_and_points(sets)
    rows = [(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(prints.view(np.int64), points, strict=True))]
    got = {}
    for r in simhash.met(spark.createDataFrame(rows, "kind long, prints array<long>, segs array<long>")).collect():
        got.setdefault(r.key, set()).add(r.kind)
    assert sorted(map(sorted, got.values())) == [[3 * k, 3 * k + 1] for k in range(40)]


def test_a_member_of_a_large_group_is_one_row(spark):
    rng = np.random.default_rng(5)
    own = hashes(rng, 100)
    sets = [np.concatenate([np.delete(own, rng.integers(0, 100, 3)), hashes(rng, 3)]) for _ in range(200)] + [hashes(rng, 100) for _ in range(50)]
    prints, points = simhash.prints_and_points(sets)
    rows = [(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(prints.view(np.int64), points, strict=True))]
    got = simhash.met(spark.createDataFrame(rows, "kind long, prints array<long>, segs array<long>")).collect()
    assert sorted(r.kind for r in got) == list(range(200)) and len({r.key for r in got}) == 1


def test_pairs_span_what_rows_and_names_connect():
    rng = np.random.default_rng(6)
    for _ in range(50):
        names, first = rng.integers(0, 60, 80) * 7, np.full(80, -1)
        for i in rng.choice(80, rng.integers(0, 60), replace=False):
            first[i] = first[j] if first[j := rng.integers(0, i + 1)] >= 0 else j
        want, got = (_Parts() for _ in range(2))
        for i in np.flatnonzero(first >= 0):
            want.join(int(names[first[i]]), int(names[i]))
        pairs = list(zip(*(x.tolist() for x in simhash.spanned(first, names)), strict=True))
        for a, b in pairs:
            assert a < b
            got.join(a, b)
        assert want.parts() == got.parts() and len(pairs) == sum(len(p) - 1 for p in want.parts())


class _Parts:
    def __init__(self):
        self.of = {}

    def join(self, a, b):
        both = self.of.get(a, {a}) | self.of.get(b, {b})
        self.of |= dict.fromkeys(both, both)

    def parts(self):
        return {frozenset(p) for p in self.of.values() if len(p) > 1}


@pytest.mark.parametrize("meetings", [1, 16])
def test_a_large_group_of_unlike_members_keeps_its_links(spark, monkeypatch, meetings):
    for name, value in (("MEMBERS", 8), ("MEETING", 8), ("MEETINGS", meetings)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(7)
    common, rows = hashes(rng, 60).view(np.int64), []
    for k in range(60):  # members share 0.6 at most, but for every third one's copy, which has 0.8 or just less
        own = np.concatenate([common, hashes(rng, 30 + k % 5).view(np.int64)])
        rows.append((2 * k, np.unique(own).tolist()))
        if k % 3 == 0:
            n = len(own)
            lost = (n - -(-8 * 2 * n // 18)) + (k % 2)
            rows.append((2 * k + 1, np.unique(np.concatenate([own[: n - lost], hashes(rng, lost).view(np.int64)])).tolist()))
    sets = {k: set(v) for k, v in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 5 < len(want) < 20 and all(b == a + 1 for a, b in want)
    table = spark.createDataFrame(rows, "kind long, full array<long>")
    members = table.selectExpr("0 as seg", "0L as key", "kind")
    got = simhash.similar(members, lambda wanted: table.join(wanted, "kind"))
    assert {(r.a, r.b) for r in got.collect()} == want
