"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser (spaces to the meta symbol, one before the text) and the pieces are compiled into a trie of arcs, with
byte arcs for characters that no piece has. A text is composed with it part by part: no piece goes over the start of a run of
meta symbols or over a character that stands in no longer piece, so the lattices of such parts are independent, and
the path of a part seen before is reused.

Weights: in a model of merges the arc of a piece after another one is free if merging their joint surface gives just
these two pieces, and infinite if not. Exactly one path through a lattice is finite, and it is the merges' own result;
one finite path at most leads to each position, so that the tropical shortest path is searched depth first, longest arcs
first, and no position is left twice. Costs of minus the pieces' scores, as in unigram models, would find other
segmentations than merges do and are used for unigram models alone.

Defined results: a null text has null ids and no round trip; an empty text has no ids; U+2581 in a text decodes to a space, as in
the format itself; rows that repeat are encoded alike; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, small_batches

META = "▁"
#: Parts of texts whose paths a worker keeps in either half of a memo, and the longest of them.
MEMO_MOST, MEMO_CHARS = 400_000, 64
#: Pairs of pieces of which a worker keeps whether the one follows the other.
PAIRS_MOST = 2_000_000
#: Kinds of pieces in the model format, and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


class _Memo(dict):
    """What make gives for a key, kept for short keys. A full memo becomes the old half, of which what is met again is kept on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_MOST:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _Followers(dict):
    """Whether a piece follows seen, the piece before it."""

    def __init__(self, follows, seen):
        super().__init__()
        self.follows, self.seen = follows, seen

    def __missing__(self, piece):
        ok = self[piece] = self.follows(self.seen, piece)
        return ok


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or spec.trainer_spec.model_type not in (UNIGRAM, MERGES):
            raise ValueError("only identity normalisers that keep white space, and models of merges or unigrams, are compiled")
        self.dummy, self.merges = norm.add_dummy_prefix, spec.trainer_spec.model_type == MERGES
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (NORMAL, USER)}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown = next((i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN), 0)
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.encode() if p.type != UNKNOWN else " ⁇ ".encode() for p in spec.pieces]
        long = [p for p in self.ids if len(p) > 1]
        self.longest = max(map(len, long), default=1)
        inner = sorted({c for p in long for c in p} - {META})
        # A piece with a meta symbol after another character would go over the start of a part.
        self.apart = not any(META in p.lstrip(META) for p in long)
        chars = "".join(map(re.escape, inner))
        self.parts = re.compile(f"{META}+[{chars}]*|[{chars}]+|[^{chars}]" if chars else "(?s:.)", re.S)
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        # The next shorter piece that a piece begins with; its first character in any case, as that has bytes at least.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.ids), p[0]) for p in long}
        self.pairs: dict[str, _Followers] = {}
        self.n_pairs = 0
        self.joins: dict[str, tuple[str, str] | None] = {}
        self.coded = _Memo(self.code)
        self.memo = _Memo(self.emit)

    def merge(self, chars: str) -> list[str]:
        """The merges' result on chars: the best scored pair that is a piece is joined first, of equals the leftmost. A heap of pairs keeps it n log n."""
        pieces, scores, n = list(chars), self.scores, len(chars)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [(-scores[w], i, w) for i in range(n - 1) if (w := chars[i : i + 2]) in scores]
        heapq.heapify(pairs)
        while pairs:
            _, i, w = heapq.heappop(pairs)
            j = after[i]
            if not pieces[i] or j >= n or pieces[i] + pieces[j] != w:
                continue  # one of the two was joined meanwhile
            pieces[i], pieces[j], after[i] = w, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (joint := pieces[k] + pieces[after[k]]) in scores:
                    heapq.heappush(pairs, (-scores[joint], k, joint))
        return [p for p in pieces if p]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of piece joins; None if it is a character, or if merging its characters doesn't give it."""
        if piece not in self.joins:
            out, two = list(piece), None
            while len(out) > 1:
                best = max(((self.scores[out[i] + out[i + 1]], -i) for i in range(len(out) - 1) if out[i] + out[i + 1] in self.scores), default=None)
                if best is None:
                    two = None
                    break
                i = -best[1]
                two = (out[i], out[i + 1])
                out[i : i + 2] = [out[i] + out[i + 1]]
            self.joins[piece] = two
        return self.joins[piece]

    def order(self, piece: str) -> float:
        """When merging makes piece: characters are there from the start."""
        return -1.0 if len(piece) == 1 else -self.scores[piece]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the joint surface gives left and right.

        It does if no merge goes over their border. What stands at either side of it is unwound, the later one first:
        a merge over the border at any of these states would have come before the one that is unwound.
        """
        if (len(left) > 1 and self.halves(left) is None) or (len(right) > 1 and self.halves(right) is None):
            return False
        scores, limit = self.scores, float("inf")
        while True:
            score = scores.get(left + right)
            if score is not None and -score < limit:
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            # Of equal merges the left one comes first, so right's own counts as just after its order.
            if len(right) == 1 or (len(left) > 1 and self.order(left) > self.order(right)):
                limit, left = self.order(left), self.halves(left)[1]
            else:
                limit, right = self.order(right) + 0.5, self.halves(right)[0]

    def path(self, part: str) -> list[str]:
        """The tropical shortest path through the lattice of part."""
        if len(part) == 1:
            return [part]
        if self.merges and META * 2 in part:
            return self.merge(part)  # runs of the meta symbol have equal scores, which pairs alone don't order
        if self.merges:
            return self._one_finite(part)
        last, out, j = self._cheapest(part), [], len(part)
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def allowed(self, seen: str, piece: str) -> bool:
        """Whether the arc of piece is free after seen, or at the start of a part."""
        self.n_pairs += 1
        return self.follows(seen, piece) if seen else len(piece) == 1 or self.halves(piece) is not None

    def _one_finite(self, part: str) -> list[str]:
        """The one finite path. Where the arc of a piece is not free the next shorter piece is taken, and where there is none the piece before is given up."""
        n, trie, longest, pairs, shorter = len(part), self.trie, self.longest, self.pairs, self.shorter
        if self.n_pairs >= PAIRS_MOST:
            pairs.clear()
            self.n_pairs = 0
        path, i, seen = [], 0, ""
        while i < n:
            node, piece = trie, part[i]
            for c in part[i : i + longest]:
                node = node.get(c)
                if node is None:
                    break
                piece = node.get("", piece)
            free = pairs.get(seen)
            if free is None:
                free = pairs[seen] = _Followers(self.allowed, seen)
            while not free[piece]:
                piece = shorter.get(piece)
                while piece is None:
                    last = path.pop()
                    i -= len(last)
                    free, piece = pairs[path[-1] if path else ""], shorter.get(last)
            path.append(piece)
            i += len(piece)
            seen = piece
        return path

    def _cheapest(self, part: str) -> list[str]:
        """For each position the last arc of the path of least cost to it, minus the pieces' scores."""
        n = len(part)
        cost, last = [0.0] + [float("inf")] * n, [""] * (n + 1)
        for i in range(n):
            node, j = self.trie, i
            for c in part[i : i + self.longest + 1]:
                node, j = node.get(c) if node else None, j + 1
                piece = node.get("") if node else None
                if piece is None and j == i + 1:
                    piece = c
                w = cost[i] - self.scores.get(piece, -1e6) if piece else float("inf")
                if w < cost[j]:
                    cost[j], last[j] = w, piece
                if node is None:
                    break
        return last

    def code(self, piece: str) -> bytes:
        """The ids of a piece, or of the bytes of a character that is none, as an array's bytes."""
        if piece in self.ids:
            return array("i", [self.ids[piece]]).tobytes()
        return array("i", [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]).tobytes()

    def emit(self, part: str) -> bytes:
        """The ids of a part, as an array's bytes."""
        return b"".join(map(self.coded.__getitem__, self.path(part)))

    def encode(self, text: str) -> array:
        ids = array("i")
        if text:
            normal = (META if self.dummy else "") + text.replace(" ", META)
            parts = self.parts.findall(normal) if self.apart else [normal]
            ids.frombytes(b"".join(map(self.memo.__getitem__, parts)))
        return ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(META, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The model's transducer, compiled once in a worker."""
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids, n_pieces and round_trip (the decoded ids are the text). model: the bytes of a model file, a few hundred KB."""
    small_batches(docs.sparkSession)
    names = [fresh(c, docs.columns) for c in ("ids", "n_pieces", "round_trip")]
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])
    at, columns = docs.columns.index(text_col), [docs.columns.index(f.name) for f in kept]

    def run(batches):
        fst = transducer(model)
        for b in batches:
            flat, ends, counts, same = array("i"), [0], [], []
            for t in b.column(at):
                text = t.as_py()
                ids = fst.encode(text or "")
                flat.extend(ids)
                ends.append(len(flat))
                counts.append(None if text is None else len(ids))
                same.append(None if text is None else fst.decode(ids) == text.replace(META, " "))
            offsets = pa.array(ends, pa.int32(), mask=np.array([*(c is None for c in counts), False]))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in columns), ids, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """rows with decoded: the text of their ids (null: null)."""
    small_batches(rows.sparkSession)
    name = fresh("decoded", rows.columns)
    at = rows.columns.index(ids_col)

    def run(batches):
        fst = transducer(model)
        for b in batches:
            texts = [None if x.as_py() is None else fst.decode(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
