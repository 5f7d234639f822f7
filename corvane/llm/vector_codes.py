"""Codes of vectors by product quantisation in whole numbers, with segment-mean lower bounds.

A component ``x`` counts as ``floor(256 * x)``. A vector is cut into equal parts, each with a codebook
of its own. The nearest entry of a part is found from coarse to fine: sums and residual norms of
blocks (one block, two, four, ...) bound the squared distance from below,

    |x - y|^2  >=  sum over blocks of (mean x - mean y)^2 * size + (|residual x| - |residual y|)^2,

and entries whose bound is above an exact distance that is already known drop out; those left get exact
integer distances. Bounds are in floating point and give way by more than their error, so no
entry is lost by rounding. Vectors with components so large that a square would leave 64 bits are
compared in Python's integers.

Codebooks are bounded (parts x entries x length of a part) and travel in the tasks; sums for new
entries are made in each task and added by Spark; nothing that grows with the table reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise

_LIMB = 30


def _limit(step: int) -> int:
    """Components below this keep all sums and squares over a part of ``step`` below 2^62."""
    return (1 << 30) // step


def quantised(values: np.ndarray, step: int) -> np.ndarray:
    """``floor(256 * x)``: int64, or Python integers where a component is too large for parts of ``step``."""
    scaled = values.astype(np.float64)
    with np.errstate(over="ignore"):
        low = np.floor(scaled * 256.0)
    if low.size and not np.abs(low).max() < _limit(step):
        return np.array([_floor256(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)
    return low.astype(np.int64)


def _floor256(x: float) -> int:
    top, bottom = float(x).as_integer_ratio()
    return 256 * top // bottom


def _blocks(length: int, n: int) -> np.ndarray:
    return np.arange(n) * length // n


def _levels(length: int) -> list[np.ndarray]:
    """Starts of the blocks of each level, coarse to fine; a block has two components or more."""
    out, n = [], 1
    while n == 1 or 2 * n <= length:
        out.append(_blocks(length, n))
        n *= 2
    return out


def _summary(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, residual norms (times the root of the size) and sizes of the blocks of each row."""
    size = np.diff(np.append(starts, x.shape[1]))
    total = np.add.reduceat(x, starts, axis=1)
    spread = size * np.add.reduceat(x * x, starts, axis=1) - total * total  # exact
    return total.astype(np.float64), np.sqrt(spread.astype(np.float64)), size.astype(np.float64)


def _bound(a: tuple, b: tuple, size: np.ndarray) -> np.ndarray:
    """A lower bound of squared distances, less what rounding may have added."""
    (sa, ra), (sb, rb) = a, b
    gap = np.maximum(np.abs(ra - rb) - 1e-12 * (ra + rb), 0.0)
    return ((((sa - sb) ** 2 + gap**2) / size).sum(axis=-1)) * (1 - 1e-12)


class Codebook:
    """The entries of one part, with their block summaries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.wide = entries.dtype == object
        self.levels = _levels(entries.shape[1])
        self.summaries = [] if self.wide else [_summary(entries, s) for s in self.levels]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and exact squared distance of each row's nearest entry; ties go to the lower index."""
        if self.wide or x.dtype == object:
            return self._nearest_wide(x)
        n = len(x)
        rows = entry = None
        for (total, norm, size), starts in zip(self.summaries, self.levels, strict=True):
            mine = _summary(x, starts)
            if rows is None:
                low = _bound((mine[0][:, None], mine[1][:, None]), (total[None], norm[None]), size)
                at = low.argmin(axis=1)
                best = self._exact(x, at)
                rows, entry = np.nonzero(low <= best[:, None])
            else:
                low = _bound((mine[0][rows], mine[1][rows]), (total[entry], norm[entry]), size)
                left = low <= best[rows]
                rows, entry = rows[left], entry[left]
        d = x[rows] - self.entries[entry]
        d = (d * d).sum(axis=1)
        # rows ascend, and each has a survivor, the entry of its best distance
        first = np.searchsorted(rows, np.arange(n))
        least = np.minimum.reduceat(d, first) if n else d
        hit = np.flatnonzero(d == least[rows])
        row, where = np.unique(rows[hit], return_index=True)
        return entry[hit[where]], least

    def _exact(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = x - self.entries[at]
        return (d * d).sum(axis=1)

    def _nearest_wide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, error = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=object)
        entries = [[int(v) for v in e] for e in self.entries]
        for i, r in enumerate(x):
            r = [int(v) for v in r]
            error[i], code[i] = min((sum((a - b) ** 2 for a, b in zip(r, e, strict=True)), k) for k, e in enumerate(entries))
        return code, error


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def kept_vectors(vectors: DataFrame, vector_col: str, parts: int) -> Column:
    """Whether a row's vector can be coded: no null, no component null, NaN or infinite, a length that ``parts`` divides."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite, F.lit(False))


def encode(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the final codebooks.

    Gives ``vec_id, code, error, label_error`` (two hex digits a part; squared distances, summed over parts;
    those summed over equal labels, nulls together) for each row that :func:`kept_vectors` keeps. Rows whose length isn't that of the
    row with the smallest id are dropped like rows without a vector. Codebooks start as the parts of the vectors
    of smallest id; of repeated ids the smaller vector comes first, and rows without an id are coded but start nothing while
    there are others. With fewer rows than ``entries`` the codebooks are smaller. Sums beyond 64 bits are null. An empty table gives
    no rows. Other columns, whatever their names, are ignored.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    rows = vectors.where(kept_vectors(vectors, vector_col, parts)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")
    )
    by_id = (F.col("id").asc_nulls_last(), "v")
    first = rows.select(F.size("v").alias("n"), "id", "v").orderBy(*by_id).limit(1).collect()
    length = first[0].n if first else parts
    rows = rows.where(F.size("v") == length)
    start = [r.v for r in rows.select("id", "v").orderBy(*by_id).limit(entries).collect()]
    step = length // parts
    seed = quantised(np.array(start, dtype=np.float64).reshape(-1, length), step)
    books = [seed[:, p * step : (p + 1) * step] for p in range(parts)]
    if start:
        for _ in range(rounds):
            books = _moved(rows, books, length)
    return _coded(rows, books, length), books


def _moved(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Codebooks whose used entries are the floored means of the parts nearest to them."""
    step = length // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in books]
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            x = quantised(_matrix(batch.column(0), length), step)
            for p, t in enumerate(tables):
                mine = x[:, p * step : (p + 1) * step]
                code, _ = t.nearest(mine)
                count[p] += np.bincount(code, minlength=len(count[p]))
                some = np.zeros(total[p].shape, dtype=mine.dtype)
                np.add.at(some, code, mine)
                total[p] += some
        out = []
        for p, c in enumerate(count):
            for e in np.flatnonzero(c):
                out.append((p, int(e), -1, 0, int(c[e])))
                for i, s in enumerate(total[p][e]):
                    # in limbs of 30 bits, so that sums of sums fit a long whatever their size
                    sign, s, limb = (-1 if s < 0 else 1), abs(int(s)), 0
                    while s:
                        out.append((p, int(e), i, limb, sign * (s & ((1 << _LIMB) - 1))))
                        s, limb = s >> _LIMB, limb + 1
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "place", "limb", "s"])

    moved = [b.astype(object) for b in books]
    count: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int, int], int] = {}
    partial = rows.select("v").mapInArrow(sums, "part int, entry int, place int, limb int, s long")
    for part, entry, place, limb, s in partial.groupBy("part", "entry", "place", "limb").agg(F.sum("s").alias("s")).collect():
        if place < 0:
            count[part, entry] = s
        else:
            total[part, entry, place] = total.get((part, entry, place), 0) + (s << (_LIMB * limb))
    for (part, entry), n in count.items():
        for i in range(step):
            moved[part][entry, i] = total.get((part, entry, i), 0) // n
    narrow = all(abs(int(v)) < _limit(step) for b in moved for v in b.ravel())
    return [b.astype(np.int64) for b in moved] if narrow else moved


def _coded(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    step = length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(max(256, len(books[0])))])
        for batch in batches:
            x = quantised(_matrix(batch.column(1), length), step)
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), dtype=object)
            for p, t in enumerate(tables):
                c, e = t.nearest(x[:, p * step : (p + 1) * step])
                code += digits[c].astype(object)
                error += e
            error = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = materialise(rows.select("id", "v", "label").mapInArrow(run, "vec_id long, label string, code string, error long"), "codes")
    sums = (
        coded.groupBy("label")
        .agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("error").isNull()).alias("lost"))
        .select(F.col("label").alias("of"), F.expr("CASE WHEN lost = 0 AND s < 9223372036854775808 THEN cast(s AS long) END").alias("label_error"))
    )
    # one row a label; a few are sent to all, many are joined, where a common label's rows can be split
    sums = materialise(sums, "label-errors")
    few = sums.limit(100_001).count() <= 100_000
    out = coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["of"]))
    return out.select("vec_id", "code", "error", "label_error")


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()
