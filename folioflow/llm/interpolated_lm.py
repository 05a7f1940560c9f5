"""Language-model scores by deleted interpolation of word bigrams, words and a uniform share.

P(w | v) = a2 ML(w | v) + a1 ML(w) + a0 / (V + 1), with weights a by the frequency bucket of v, learned by expectation-
maximisation on the counts of a held-out fold of the training documents, against the counts of the rest.

Texts are cut into blocks of about BLOCK_TOKENS tokens, written once: word hashes, tokens, documents. Each block asks for
the counts of its distinct words and bigrams, packed as sorted hashes by hash range; a range adds up what all blocks
send and answers each block with counts in the order it asked. So no token is ever a row, no word is hot (a block
asks for it once), and nothing but the bounded statistics of the weights reaches the driver. Words are known by
64 bits of hash.

Defined results: null and empty texts are the end token alone; a null doc_id is the empty id; rows that repeat are
documents of their own; without a training document all counts are 0; without a held-out fold the weights
are FALLBACK; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, fold, small_batches

#: Tokens of a block, which bounds a worker's memory, and distinct hashes that one range adds up.
BLOCK_TOKENS, RANGE_HASHES = 2_000_000, 1_500_000
#: Weights (bigram, word, uniform) where no held-out count says otherwise.
FALLBACK = (0.4, 0.5, 0.1)
#: Steps of expectation-maximisation, and the steps of a factor of two in which its ratios are counted.
ROUNDS, OCTAVE = 80, 8
_ABSENT = -(1 << 20)
#: The end of a text; it stands before the first word too. No word is empty.
END = np.uint64(xxhash.xxh64_intdigest(b"", 1))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by their bytes' planes, which puts the many zero bytes side by side."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
    return out


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = parts.values, parts.offsets.to_numpy()
    real = pc.not_equal(flat, "")
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), upto[offsets[1:]] - upto[offsets[:-1]]


class _Block:
    """Documents in the making, of one kind (of the held-out fold or not)."""

    def __init__(self):
        self.words, self.sizes, self.ids, self.held, self.n = [], [], [], [], 0

    def add(self, words: pa.Array, sizes: np.ndarray, ids: list, held: list) -> None:
        self.words.append(words)
        self.sizes.append(sizes)
        self.ids += ids
        self.held += held
        self.n += len(words) + len(ids)

    def payload(self) -> tuple[bytes, int]:
        coded = pa.chunked_array(self.words, pa.string()).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in names), np.uint64, len(names))
        sizes = np.concatenate(self.sizes).astype(np.int64)
        ids = np.full(int((sizes + 1).sum()), len(names), np.int32)  # the end's own number
        ends = np.cumsum(sizes + 1) - 1
        mask = np.ones(len(ids), bool)
        mask[ends] = False
        ids[mask] = coded.indices.to_numpy()
        known = np.array([i is not None for i in self.ids])
        doc_ids = np.array([i or 0 for i in self.ids], np.int64)
        return _pack(np.append(hashes, END), ids, (sizes + 1).astype(np.int64), doc_ids, known, np.array(self.held, bool)), len(ids)


class _Tokens:
    """A block read back, with its distinct words and bigrams in order of their hashes."""

    def __init__(self, payload: bytes):
        hashes, self.ids, self.sizes, self.doc_ids, self.known, self.held = _unpack(payload)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.words, self.w = hashes[order], rank[self.ids]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        self.v[self.starts] = rank[len(hashes) - 1]
        pairs, at = np.unique(self.v.astype(np.int64) * len(order) + self.w, return_inverse=True)
        first, second = self.words[pairs // len(order)], self.words[pairs % len(order)]
        z = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0xD1B54A32D192ED03))
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(32)
        order = np.argsort(z)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.bigrams, self.at = z[order], rank[at]

    def train(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct words and bigrams in documents that aren't held out from training."""
        own = np.repeat(~self.held, self.sizes)
        return np.bincount(self.w[own], minlength=len(self.words)).astype(np.uint32), np.bincount(self.at[own], minlength=len(self.bigrams)).astype(np.uint32)


def _edges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in sorted hashes."""
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])


def _blocks(docs: DataFrame, stash: Tables) -> DataFrame:
    """block, deleted (whether of the held-out fold of training), entries (distinct words and bigrams, at most), payload."""

    def run(batches):
        from pyspark import TaskContext

        made, at = {False: _Block(), True: _Block()}, TaskContext.get().partitionId()
        count = 0

        def close(kind: bool):
            nonlocal count
            payload, n = made[kind].payload()
            made[kind], count = _Block(), count + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{at}-{count}"]), pa.array([kind]), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=["block", "deleted", "entries", "payload"])

        for b in batches:
            part = b.column(3).to_numpy(zero_copy_only=False)
            for kind in (False, True):
                rows = b.filter(pa.array((part == 3) == kind))
                for i in range(0, rows.num_rows, 256):
                    piece = rows.slice(i, 256)
                    words, sizes = _tokens(piece.column(1))
                    made[kind].add(words, sizes, piece.column(0).to_pylist(), piece.column(2).to_pylist())
                    if made[kind].n >= BLOCK_TOKENS:
                        yield close(kind)
        for kind in (False, True):
            if made[kind].ids:
                yield close(kind)

    return stash.write(docs.mapInArrow(run, "block string, deleted boolean, entries long, payload binary"), "blocks")


def _sums(hashes: list[np.ndarray], counts: list[np.ndarray], deleted: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each asked hash its place among the distinct ones; of each of those its count in all blocks, and in those of the held-out fold.

    A block's own counts are bounded by its tokens; sums are of all blocks and take 64 bits, exact below 2^53.
    """
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    n, held = np.concatenate(counts).astype(np.float64), np.repeat(np.array(deleted, np.float64), [len(h) for h in hashes])
    return at, np.bincount(at, n, len(every)).astype(np.uint64), np.bincount(at, n * held, len(every)).astype(np.uint64)


def _answers(blocks: DataFrame, stash: Tables) -> DataFrame:
    """block, r, pack: the counts that a block asked range r for. A row without a block has the range's tokens and types."""
    ranges = max(1, -(-int(blocks.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]) // RANGE_HASHES))

    def ask(batches):
        for b in batches:
            for block, deleted, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = _Tokens(payload.as_py())
                uni, bi = t.train()
                u, v = _edges(t.words, ranges), _edges(t.bigrams, ranges)
                rows = [r for r in range(ranges) if u[r + 1] > u[r] or v[r + 1] > v[r]]
                packs = [_pack(np.diff(t.words[u[r] : u[r + 1]], prepend=np.uint64(0)), uni[u[r] : u[r + 1]], np.diff(t.bigrams[v[r] : v[r + 1]], prepend=np.uint64(0)), bi[v[r] : v[r + 1]]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([block] * len(rows)), pa.array([deleted] * len(rows)), pa.array(packs, pa.binary())], names=["r", "block", "deleted", "pack"])

    def add(table: pa.Table) -> pa.Table:
        blocks, deleted = table.column("block").to_pylist(), table.column("deleted").to_pylist()
        asked = [_unpack(p.as_py()) for p in table.column("pack")]
        out, stats = [[] for _ in blocks], []
        for k in (0, 2):
            hashes = [np.cumsum(a[k]) for a in asked]
            at, total, apart = _sums(hashes, [a[k + 1] for a in asked], deleted)
            i = 0
            for own, h in zip(out, hashes, strict=True):
                own += [total[at[i : i + len(h)]], apart[at[i : i + len(h)]]]
                i += len(h)
            if not k:
                stats = [int(total.sum()), int(apart.sum()), int((total > 0).sum())]
        r = table.column("r")[0].as_py()
        packs = [_pack(*own) for own in out]
        m = len(blocks) + 1
        return pa.table({"block": pa.array([*blocks, None], pa.string()), "r": pa.array([r] * m, pa.int32()), "pack": pa.array([*packs, None], pa.binary()), "tokens": pa.array([0] * (m - 1) + [stats[0]], pa.int64()), "apart": pa.array([0] * (m - 1) + [stats[1]], pa.int64()), "types": pa.array([0] * (m - 1) + [stats[2]], pa.int64())})

    asked = blocks.select("block", "deleted", "payload").mapInArrow(ask, "r int, block string, deleted boolean, pack binary")
    return stash.write(asked.groupBy("r").applyInArrow(add, "block string, r int, pack binary, tokens long, apart long, types long"), "answers")


def _counts(payload: bytes, answers: pa.Table) -> tuple[_Tokens, list[np.ndarray]]:
    """A block with the counts of its words and bigrams: all training, and the held-out fold's."""
    t = _Tokens(payload)
    rows = sorted(zip(answers.column("r").to_pylist(), answers.column("pack"), strict=True), key=lambda x: x[0])
    packs = [_unpack(p.as_py()) for _, p in rows]
    return t, [np.concatenate([p[k] for p in packs]).astype(np.float64) for k in range(4)]


def bucket(context: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context: by powers of two, 0 for one that was never seen."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _steps(p: np.ndarray, uniform: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(OCTAVE * np.log2(np.maximum(p, 1e-300) / uniform)), _ABSENT).astype(np.int64)


def learn(rows: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, float, float]]:
    """Weights by bucket from (bucket, step of the bigram's ratio, step of the word's, count)."""
    out: dict[int, tuple[float, float, float]] = {}
    data = np.array(sorted(rows), np.float64).reshape(-1, 4)
    for b in np.unique(data[:, 0]):
        own = data[data[:, 0] == b]
        ratios = np.stack([*(np.where(own[:, k] > _ABSENT, 2.0 ** (own[:, k] / OCTAVE), 0.0) for k in (1, 2)), np.ones(len(own))])
        a = np.array(FALLBACK) if b else np.array([0.0, 0.8, 0.2])
        for _ in range(ROUNDS):
            share = a[:, None] * ratios
            got = (share / share.sum(0) * own[:, 3]).sum(1) + 0.5 * (a > 0)
            a = got / got.sum()
        out[int(b)] = tuple(a)
    return out


def weights_for(learned: dict[int, tuple[float, float, float]], buckets: np.ndarray) -> np.ndarray:
    """Weights of the buckets; one that no held-out token had takes those of the nearest lower one."""
    table, last = np.zeros((80, 3)), np.array(FALLBACK)
    table[0] = learned.get(0, (0.0, 0.8, 0.2))
    for b in range(1, 80):
        last = np.array(learned[b]) if b in learned else last
        table[b] = last
    return table[buckets]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, deleted: int = 3) -> DataFrame:
    """Rows doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one for each document.

    Documents of fold held_out take no part in training; those of fold deleted are trained on, and are the held-out counts of the weights.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stash = Tables(spark)
    part = fold(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (part == held_out).alias("held"), F.when(part == deleted, F.lit(3)).otherwise(F.lit(0)).alias("part"))
    blocks = _blocks(rows, stash)
    answers = _answers(blocks, stash)
    total, apart, types = (int(x) for x in answers.filter("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "apart", "types")]).first())
    uniform, rest = 1.0 / (types + 1), total - apart
    counts = answers.filter("block is not null").select("block", "r", "pack")

    def ratios(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t, (uni, uni_apart, bi, bi_apart) = _counts(left.column("payload")[0].as_py(), right)
        own, pair = uni - uni_apart, bi - bi_apart
        context = own[t.v]
        p2 = np.divide(pair[t.at], context, out=np.zeros(len(t.v)), where=context > 0)
        keys = np.stack([bucket(context), _steps(p2, uniform), _steps(own[t.w] / rest, uniform)], 1)
        kinds, n = np.unique(keys, axis=0, return_counts=True)
        return pa.table({"b": kinds[:, 0], "x": kinds[:, 1], "y": kinds[:, 2], "n": n.astype(np.int64)})

    learned: dict[int, tuple[float, float, float]] = {}
    if apart and rest:
        of = blocks.filter("deleted").select("block", "payload")
        left, right = of.groupBy("block"), counts.join(of.select("block"), "block", "left_semi").groupBy("block")
        seen = left.cogroup(right).applyInArrow(_present(ratios, "b x y n"), "b long, x long, y long, n long")
        learned = learn([tuple(r) for r in seen.groupBy("b", "x", "y").agg(F.sum("n").alias("n")).collect()])

    def scores(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t, (uni, _, bi, _) = _counts(left.column("payload")[0].as_py(), right)
        c, context = uni[t.w], uni[t.v]
        a = weights_for(learned, bucket(context))
        p = a[:, 2] * uniform
        if total:
            p += a[:, 0] * np.divide(bi[t.at], context, out=np.zeros(len(c)), where=context > 0) + a[:, 1] * c / total
        add = lambda x: np.add.reduceat(x, t.starts)
        ids = pa.array(t.doc_ids, mask=~t.known)
        return pa.table({"doc_id": ids, "held_out": pa.array(t.held), "n_tokens": t.sizes, "n_known": add((c > 0).astype(np.int64)), "base_score": add(np.log10((c + 1) / (total + types + 1))), "score": add(np.log10(p))})

    scored = blocks.select("block", "payload").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_present(scores, "doc_id held_out n_tokens n_known base_score score"), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = cut(scored.withColumn("train_tokens", F.lit(total).cast("long")))
    stash.remove()
    return out


def _present(f, names: str):
    """f for the groups that have a block; the others, blocks of another kind, give no rows."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            return f(key, left, right)
        kinds = {"held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({n: pa.array([], kinds.get(n, pa.int64())) for n in names.split()})

    return run
