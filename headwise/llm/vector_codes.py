"""Vector code compression: product codes whose nearest entries are found exactly in an integer Walsh-Hadamard basis.

A component x becomes the integer floor(1024 x). Vectors are cut into equal consecutive parts, and each part position has
a codebook that starts as that part of the vectors of smallest ids; rounds assign every part to its nearest entry and
replace an entry by the floored mean of its parts. Parts and entries are padded with zeros to a power of two and go
through the Walsh-Hadamard transform with its rows ordered by sequency (number of sign changes). The transform keeps
distances up to the factor of its length, so squared differences are summed coefficient by coefficient, slow ones first,
and an entry is given up as soon as its sum exceeds the whole distance of a candidate that is already known. All of it is
integer arithmetic; the scale divides the final sums exactly.

Rows are assigned where they lie. A round sends one row of sums for each used entry of a task; the driver holds the
codebooks only, whose size is parts x entries x part length.

Edge cases: rows whose vector is null, or holds a null, not finite or too large component (1024 |x| above ``LARGEST`` over
the padded part length, where a distance would leave the range of a long), take no part; shorter vectors, and lengths that the number of parts does
not divide, are continued by zeros; an empty vector is all zeros; equal ids are ordered by their vectors, null ids come
last, and equal rows get equal codes; fewer rows than entries make a smaller codebook; null labels are one label; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import slices, written

SCALE = 1024
#: Integer components times the padded part length stay below this, so that scaled squared distances fit a long.
LARGEST = 1 << 29
#: Rows that are compared with all entries at a time, and coefficients between two eliminations.
AT_ONCE = 512
STEP = 4


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes: the bit-reversed Gray code."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(size, dtype=np.int64))


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, zero-padded to a power of two, coefficients in sequency order."""
    n, m = x.shape
    size = padded(m)
    out = np.zeros((n, size), dtype=np.int64)
    out[:, :m] = x
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency_order(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower one of ties, and the squared distance; both sides transformed."""
    size, first = rows.shape[1], min(STEP, rows.shape[1])
    sums = np.zeros((len(rows), len(entries)), dtype=np.int64)
    for s in range(first):
        apart = rows[:, s, None] - entries[None, :, s]
        sums += apart * apart
    best = sums.argmin(axis=1)
    rest = rows[:, first:] - entries[best, first:]
    bound = sums[np.arange(len(rows)), best] + (rest * rest).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    total = sums[row, entry]
    for s in range(first, size, STEP):
        apart = rows[row, s : s + STEP] - entries[entry, s : s + STEP]
        total += (apart * apart).sum(axis=1)
        left = total <= bound[row]  # the candidate itself always stays
        row, entry, total = row[left], entry[left], total[left]
    starts = np.searchsorted(row, np.arange(len(rows)))
    low = np.minimum.reduceat(total, starts) if len(rows) else total
    hits = np.nonzero(total == low[row])[0]
    return entry[hits[np.unique(row[hits], return_index=True)[1]]], low // size


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of one length, continued by zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


class Codebooks:
    """Entries of all part positions, parts x entries x part length, and their transforms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.spectra = [transform(e) for e in entries]

    def assign(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Part, index and squared distance of each row, for each part position."""
        size = self.entries.shape[2]
        for p, spectra in enumerate(self.spectra):
            part = rows[:, p * size : (p + 1) * size]
            yield part, *nearest(transform(part), spectra)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def padded(length: int) -> int:
    """The power of two that a part of this length is continued to."""
    return 1 << max(0, length - 1).bit_length()


def integers(df: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, int]:
    """Id, label and integer components of the rows that take part, and the length of a part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = df.where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))  # null: dropped
    length = -(-int(finite.agg(F.max(F.size(vector))).first()[0] or 0) // parts)
    kept = finite.where(F.forall(vector, lambda x: F.abs(x) * SCALE <= LARGEST // padded(length)))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    whole = F.transform(vector, lambda x: F.floor(x * SCALE).cast("int"))
    return written(kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), whole.alias("x")), "vector-integers"), length


def compress(
    df: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """Code (two hex digits a part), error, error summed over equal labels, and the digest of the codebooks."""
    rows, length = integers(df, parts, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # a codebook's size
    start = matrix(pa.array([r.x for r in first], pa.list_(pa.int32())), parts * length)
    books = Codebooks(start.reshape(len(first), parts, length).transpose(1, 0, 2).copy())
    for _ in range(rounds if first and length else 0):
        books = Codebooks(_moved(rows, books))
    codes = written(_coded(rows, books), "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _moved(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries after one round: floored means of the parts that are nearest to each."""
    parts, entries, length = books.entries.shape
    names = [f"c{i}" for i in range(length)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, length), dtype=np.int64)
        count = np.zeros(parts * entries, dtype=np.int64)
        for batch in slices(batches, AT_ONCE):
            for p, (part, index, _) in enumerate(books.assign(matrix(batch.column(0), parts * length))):
                np.add.at(total, index + p * entries, part)
                count += np.bincount(index + p * entries, minlength=parts * entries)
        slot = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot]), *(pa.array(total[slot, i]) for i in range(length))], names=["slot", "n", *names])

    schema = ", ".join(f"{c} long" for c in ("slot", "n", *names))
    moved = books.entries.reshape(parts * entries, length).copy()
    for r in rows.select("x").mapInArrow(sums, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():  # one row an entry
        moved[r.slot] = [r[c] // r.n for c in names]
    return moved.reshape(parts, entries, length)


def _coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    parts, _, length = books.entries.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            index, error = np.zeros((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p, (_, found, apart) in enumerate(books.assign(matrix(batch.column("x"), parts * length))):
                index[:, p] = found
                error += apart
            codes = pa.array([r.tobytes().hex() for r in index], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = dict(rows.dtypes)["label"]
    return rows.mapInArrow(code, f"vec_id long, label {label}, code string, error long")
