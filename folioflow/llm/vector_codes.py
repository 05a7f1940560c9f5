"""Product codes of vectors: integer codebooks by rounds of assignment and means, with Exponion search for the nearest entry.

Components become floor(scale * x); a vector is cut into equal consecutive parts, each of which has a codebook of its own. In a round every part looks
for its nearest entry, beginning with the entry it had before, at distance d: an entry that is as near lies within 2 d of that one, so that its list of the
other entries, sorted by distance, is scanned up to that radius alone. As a nearer entry at distance b is found, the radius shrinks to d + b. Distances are exact
integers (in doubles as long as they stay below 2^53, else in Python's integers), and equal ones go to the lower index, so that the result is that of a full search.

A round is one pass over a written table: a task adds up what its entries got, and emits a row of sums for each of them beside its rows. The sums are added up by
entry in Spark; only codebooks, whose size is set by parameters, reach the driver and the tasks.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, as are those whose length is not that of the kept vector
with the smallest id. Repeated ids are rows of their own; the codebook starts from distinct ids, of a repeated one from its smallest vector; a null id comes last. With fewer kept ids than entries
codebooks are smaller. A length that parts do not divide leaves the last parts one shorter. Components beyond 2^62 are held at that, and an error beyond a long fails. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, sized

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a neighbour list that are looked at together.
STRIDE = 32
#: Arrow batches are put together up to these, so that the rows of one entry are looked up at once.
BATCH_ROWS, BATCH_BYTES = 16384, 16 << 20
#: Sums below it are exact in doubles.
_EXACT = 1 << 53
_MOST = 1 << 62


def cuts(dims: int, parts: int) -> list[slice]:
    """Equal consecutive parts; what is left over goes to the first ones."""
    ends = [(p * dims + parts - 1) // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def usable(dims: int | None = None):
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & (F.size(v) == dims if dims is not None else F.lit(True))


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x)."""
    flat = np.floor(np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * scale)
    return np.clip(flat, -_MOST, _MOST).astype(np.int64).reshape(-1, dims)


def fits(dims: int, *arrays: np.ndarray) -> bool:
    most = max([1, *(max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size)])
    return 4 * max(dims, 1) * most * most < _EXACT


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, exact in their type."""
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]


class Book:
    """A part's entries and, of each entry, all entries in order of distance."""

    def __init__(self, entries: np.ndarray, narrow: bool):
        self.entries = entries.astype(np.float64 if narrow else object)
        far = distances(self.entries, self.entries)
        self.order = np.array([sorted(range(len(far)), key=row.__getitem__) for row in far], dtype=np.int64).reshape(len(far), -1)
        self.radius = np.take_along_axis(far, self.order, 1)
        self.narrow = narrow

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the index of its nearest entry and the squared distance, found from the entry it had before."""
        x = x.astype(self.entries.dtype)
        best, found = before.copy(), ((x - self.entries[before]) ** 2).sum(1)
        by = np.argsort(before, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(before[by])) + 1) if len(by) else []:
            self._search(int(before[rows[0]]), x, rows, best, found)
        return best, found

    def _reach(self, own, other):
        """A squared radius that holds every entry within other of a row at the squared distance own: (own + other)^2 of the roots, rounded up."""
        if self.narrow:
            return (np.sqrt(own) + np.sqrt(other)) ** 2 * (1 + 1e-12) + 1e-6
        return 2 * (own + other)  # never less than the square of the roots' sum

    def _search(self, entry: int, x: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        order, radius, own = self.order[entry], self.radius[entry], found[rows]
        for at in range(0, len(order), STRIDE):
            live = self._reach(own, found[rows]) >= radius[at]
            rows, own = rows[live], own[live]
            if not len(rows):
                return
            some = np.sort(order[at : at + STRIDE])  # equal distances go to the lower index
            far = distances(x[rows], self.entries[some])
            k = far.argmin(1)
            near, index = far[np.arange(len(rows)), k], some[k]
            better = (near < found[rows]) | ((near == found[rows]) & (index < best[rows]))
            found[rows[better]], best[rows[better]] = near[better], index[better]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= BATCH_ROWS or sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def assign(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], dims: int, scale: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows id, label, v, codes, error and, but in the last pass, rows of sums: part, entry, sums, n."""
    parts = cuts(dims, len(books))
    sums = [np.zeros((len(b), s.stop - s.start), dtype=object) for b, s in zip(books, parts, strict=True)]
    counts = [np.zeros(len(b), dtype=np.int64) for b in books]
    made: dict[tuple[int, bool], Book] = {}
    for batch in gathered(batches):
        n, x = batch.num_rows, whole_numbers(batch.column("v"), dims, scale)
        old, codes, error = batch.column("codes"), [], np.zeros(n, dtype=object)
        had = np.zeros((n, len(books)), dtype=np.int64) if old.null_count else old.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
        for p, (entries, s) in enumerate(zip(books, parts, strict=True)):
            narrow = fits(s.stop - s.start, x[:, s], entries)
            book = made.get((p, narrow)) or made.setdefault((p, narrow), Book(entries, narrow))
            best, found = book.nearest(x[:, s], had[:, p])
            codes.append(best)
            error += found.astype(np.int64) if narrow else found
            if not last:
                got = np.zeros(sums[p].shape, dtype=np.int64 if narrow else object)
                np.add.at(got, best, x[:, s] if narrow else x[:, s].astype(object))
                sums[p] += got
                counts[p] += np.bincount(best, minlength=len(entries))
        flat = pa.array(np.stack(codes, 1).astype(np.int16).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(books)), flat)
        none = lambda kind: pa.nulls(n, kind)
        wide = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), lists, pa.array(error.astype(np.int64)), none(pa.int32()), none(pa.int32()), none(wide), none(pa.int64())], names=_NAMES)
    if last or not any(c.any() for c in counts):
        return
    got = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
    m = len(got)
    kinds = batch.schema
    added = pa.array([[str(t) for t in sums[p][e]] for p, e in got], pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(m, kinds.field("id").type), pa.nulls(m, kinds.field("label").type), pa.nulls(m, kinds.field("v").type), pa.nulls(m, pa.list_(pa.int16())), pa.nulls(m, pa.int64()), pa.array([p for p, _ in got], pa.int32()), pa.array([int(e) for _, e in got], pa.int32()), added, pa.array([int(counts[p][e]) for p, e in got])],
        names=_NAMES,
    )


_NAMES = ["id", "label", "v", "codes", "error", "part", "entry", "sums", "n"]


def moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """The entries' means, rounded down; entries that got nothing stay. Sums come as decimals of 38 digits, one row for each entry."""
    place = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "t")).groupBy("part", "entry", "at").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in place.collect():
        out[r.part][r.entry, r.at] = int(r.t) // r.n
    return out


def start(kept: DataFrame, entries: int, parts: int, scale: int) -> list[np.ndarray]:
    """Each part's codebook: that part of the vectors of the smallest ids. Repeated ids are passed over by looking beyond the last one found."""
    firsts: dict = {}
    left = kept.select("id", "v").filter("id is not null")
    while len(firsts) < entries:
        rows = left.orderBy("id", "v").limit(entries).collect()
        for r in rows:
            if len(firsts) < entries:
                firsts.setdefault(r.id, r.v)
        if len(rows) < entries:
            break
        left = left.filter(F.col("id") > F.lit(rows[-1].id))
    if len(firsts) < entries:
        firsts |= {None: r.v for r in kept.select("id", "v").filter("id is null").orderBy("v").limit(1).collect()}
    rows = np.array([whole_numbers(pa.array([v]), len(v), scale)[0] for v in firsts.values()])
    return [rows[:, s] for s in cuts(rows.shape[1], parts)]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows id, label, codes (an index for each part), error; and the final codebooks. entries is at most 32767."""
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("v"))
    first = rows.filter(usable()).orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    out_schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, codes array<short>, error long, part int, entry int, sums array<string>, n long"
    if first is None or first.n == 0:
        return spark.createDataFrame([], out_schema).select("id", "label", "codes", "error"), []
    dims = first.n
    kept = rows.filter(usable(dims))
    books = start(kept, entries, parts, scale)
    now, stash = kept.withColumn("codes", F.lit(None).cast("array<short>")), Tables(spark)
    for k in range(rounds + 1):
        done = now.mapInArrow(partial(assign, books=books, dims=dims, scale=scale, last=k == rounds), out_schema)
        if k == rounds:
            return stash.write(done.select("id", "label", "codes", "error"), "codes"), books
        both = stash.write(done.withColumn("sum", F.col("part").isNotNull()), f"round{k}")
        books = moved(books, both.filter("sum"))
        now = both.filter("not sum").select("id", "label", "v", "codes")
        if k:
            stash.remove(f"round{k - 1}")
    raise AssertionError


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def report(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", **how) -> DataFrame:
    """Rows id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together) and the codebooks' digest."""
    coded, books = compress(vectors, id_col=id_col, label_col=label_col, **how)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sized(sums, 64), F.col("label").eqNullSafe(F.col("of")))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
