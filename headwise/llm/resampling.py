"""Target-distribution importance resampling, with features counted once for each distinct line.

A text's words are its runs of letters A-Z (lower-cased), digits and characters outside ASCII; its features are the single
words and the pairs of neighbouring words, each in the bucket that its CRC-32 says. The gain of a bucket is the log ratio
of its smoothed frequencies in the target texts and in the corpus, a text's weight the mean gain of its features, and the
texts with the highest weights plus Gumbel noise, drawn from a hash of the id, are taken.

Newlines separate words, so a text falls apart into lines without cutting a feature, except for pairs whose words lie in
different lines. The buckets of each distinct line are computed once and kept; corpus counts are those buckets times the
line's occurrences, a text's gain the sum of its lines' gains, and the pairs across lines are added text by text. Words
and checksums come from the bytes of a batch as arrays, one step for each byte place of all words at once.

What grows with the corpus is shuffled by line, by text or by rank; the driver holds one number for each bucket. Equal
lines are counted before they are shuffled, so a line that a third of all texts hold is one row of each task, and its
occurrences meet its gain in a join that adaptive execution splits. The draw sorts by ranges of (score, id, row) and adds
the sizes of the ranges before.

Edge cases: a null text has no words; a text without words has the weight 0; a null id is hashed as the empty text, and
ranks after other ids of its score; rows of equal scores and ids are ranked in the order in which they are read;
repeated rows and ids count and are drawn as rows of their own; empty tables give the corpus (or the target) no features; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import by_bytes, row_bytes, text_of, written

BUCKETS = 10_000
#: Bytes of text whose words are arrays at a time.
AT_ONCE = 1 << 21
#: Longer words get their checksum one by one.
LONG = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_steps() -> np.ndarray:
    """What a byte does to the state of the reflected CRC-32."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, np.uint32(0xEDB88320) ^ (steps >> np.uint32(1)), steps >> np.uint32(1))
    return steps


_STEPS = _crc_steps()
_BEGIN = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _STEPS[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes from starts to ends, each from its own state before them."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, left, out = starts[order], -lengths[order], state[order]
    for i in np.nonzero(left < -LONG)[0]:
        word = data[at[i] : at[i] - left[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i] ^ _BEGIN)) ^ 0xFFFFFFFF
    first = np.searchsorted(left, -LONG)
    for j in range(-int(left[first]) if first < len(left) else 0):
        n = np.searchsorted(left, -j)  # words longer than j bytes
        out[first:n] = _step(out[first:n], data[at[first:n] + j])
    back = np.empty_like(out)
    back[order] = out
    return back


@dataclass
class Words:
    """Words of all rows of a batch: lower-cased bytes, places, the row of each, and whether the next is in the same row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, offsets = row_bytes(texts)
        data = _LOWER[data]
        inside = _IN_WORD[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
        starts, ends = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
        return cls(data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)

    def paired(self) -> np.ndarray:
        """Words that the next word of the same row follows."""
        return np.nonzero(self.row[:-1] == self.row[1:])[0]

    def first_states(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        starts = self.starts[of]
        return crc_states(self.data, starts, self.ends[of], np.full(len(starts), _BEGIN))

    def pair_states(self, first: np.ndarray, states: np.ndarray) -> np.ndarray:
        """States after each of these words (with its own state), a blank and the next word."""
        return crc_states(self.data, self.starts[first + 1], self.ends[first + 1], _step(states, np.uint32(32)))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of values as one binary for each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bucket_type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _line_key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


_TEXTS = "row long, doc_id long, words long, across binary, lines array<binary>"
_LINES = "line binary, n long, buckets binary"


@dataclass
class Segments:
    """A corpus in lines: for each text its words, the buckets of pairs across lines and its lines' keys; for each distinct
    line its occurrences and buckets."""

    texts: DataFrame
    lines: DataFrame
    buckets: int

    def histogram(self) -> np.ndarray:
        """Features of all texts by bucket: those of a line times its occurrences, and the pairs across lines."""
        size, kind = self.buckets, _bucket_type(self.buckets)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, dtype=np.int64)
            for batch in batches:
                data, offsets = row_bytes(batch.column("found"))
                n = np.repeat(batch.column("n").to_numpy(), np.diff(offsets) // kind.itemsize)
                np.add.at(total, data.view(kind), n)
            found = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

        rows = self.lines.select("n", F.col("buckets").alias("found")).unionAll(self.texts.select(F.lit(1).cast("long"), "across"))
        out = np.zeros(size, dtype=np.int64)
        for r in rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
            out[r.bucket] = r.n
        return out

    def gains(self, gains: np.ndarray) -> DataFrame:
        """For each text (row) its id, words and the sum of its features' gains."""
        kind = _bucket_type(self.buckets)

        def of_rows(column: pa.Array) -> pa.Array:
            data, offsets = row_bytes(column)
            sums = np.concatenate(([0], np.cumsum(gains[data.view(kind)])))
            return pa.array(np.diff(sums[offsets // kind.itemsize]))

        def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("line"), of_rows(b.column("buckets"))], names=["line", "gain"])

        def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("words"), of_rows(b.column("across"))], names=["row", "doc_id", "words", "gain"])

        by_line = self.lines.select("line", "buckets").mapInArrow(of_lines, "line binary, gain long")
        parts = self.texts.select("row", F.explode("lines").alias("line")).join(by_line, "line")
        whole = self.texts.select("row", "doc_id", "words", "across").mapInArrow(of_texts, "row long, doc_id long, words long, gain long")
        none = F.lit(None).cast("long")
        both = whole.unionByName(parts.select("row", none.alias("doc_id"), none.alias("words"), "gain"))
        return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("words").alias("words"), F.sum("gain").alias("gain"))


def segment(df: DataFrame, buckets: int = BUCKETS, id_col: str | None = "doc_id", text_col: str = "text") -> Segments:
    """Cut texts into lines and find the buckets of each distinct line and of the pairs across lines."""
    kind = _bucket_type(buckets)

    def bucket(states: np.ndarray) -> np.ndarray:
        return ((states ^ _BEGIN) % np.uint32(buckets)).astype(kind)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", AT_ONCE):
            words = Words.of(b.column("text"))
            breaks = np.cumsum(words.data == 10)
            first = words.paired()
            first = first[breaks[words.starts[first]] < breaks[words.starts[first + 1]]]
            across = bucket(words.pair_states(first, words.first_states(first)))
            per_row = np.bincount(words.row[first], minlength=b.num_rows)
            keys = [[_line_key(x) for x in t.encode().split(b"\n") if x] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    b.column("doc_id"),
                    pa.array(np.bincount(words.row, minlength=b.num_rows).astype(np.int64)),
                    _binary(across, per_row),
                    pa.array(keys, pa.list_(pa.binary())),
                ],
                names=["row", "doc_id", "words", "across", "lines"],
            )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "line", AT_ONCE):
            words = Words.of(b.column("line"))
            states, first = words.first_states(), words.paired()
            counts = np.bincount(words.row, minlength=b.num_rows)
            found = np.empty(len(states) + len(first), dtype=kind)
            place = np.arange(len(states)) + np.searchsorted(first, np.arange(len(states)))
            found[place] = bucket(states)
            found[place[first] + 1] = bucket(words.pair_states(first, states[first]))
            keys = pa.array([_line_key(x.encode()) for x in b.column("line").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, b.column("n"), _binary(found, np.maximum(2 * counts - 1, 0))], names=["line", "n", "buckets"])

    doc_id = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    rows = df.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), text_of(text_col).alias("text"))
    kept = written(rows.mapInArrow(texts, _TEXTS), "resampling-texts")
    line = F.explode(F.split(text_of(text_col), "\n"))
    distinct = df.select(line.alias("line")).where("line != ''").groupBy("line").agg(F.count("*").alias("n"))
    return Segments(kept, written(distinct.mapInArrow(lines, _LINES), "resampling-lines", codec="zstd"), buckets)


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed frequencies, floored, for each bucket."""
    size, of_target, of_corpus = len(corpus), float(target.sum()), float(corpus.sum())
    ratio = ((float(t) + 1) * (of_corpus + size) / ((float(s) + 1) * (of_target + size)) for t, s in zip(target, corpus, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def resample(
    df: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Features, weight and score of every text, and the rank of those that are drawn (null for others)."""
    corpus = segment(df, buckets, id_col, text_col)
    wanted = segment(target, buckets, None, target_text_col)
    by_row = corpus.gains(gains(wanted.histogram(), corpus.histogram()))
    features = F.greatest(F.col("words") * 2 - 1, F.lit(0))
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(gain - pmod(gain, greatest(n_features, 1))) div greatest(n_features, 1)"))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    scored = by_row.withColumn("n_features", features).withColumn("weight", weight.cast("long"))
    scored = scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))))
    scored = written(scored.select("row", "doc_id", "n_features", "weight", "score", (F.col("words") >= min_words).alias("may")), "resampling-scores")
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    placed = written(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", place), "resampling-order")
    # One row for each range: how many rows lie before it.
    part = F.shiftright("place", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"), F.sum(F.col("may").cast("long")).alias("may_n"))
    before = written(sizes.select(F.col("part").alias("of_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), "may_n"), "resampling-ranges")
    drawn = percent * int(before.agg(F.sum("may_n")).first()[0] or 0) // 100
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(before.select("of_part", "before"), F.shiftright("place", 33) == F.col("of_part"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))
