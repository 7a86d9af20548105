"""Packing of documents into fixed windows at target token proportions, by deficit round robin over source queues.

Each source is a queue of tokens; its documents follow one another in it and may be cut anywhere. A round adds a queue's
quantum to its deficit, and the queue sends whole portions of ``portion`` tokens while the deficit covers one; what is
left over stays for the next round. Portions follow one another without gaps and windows are cut from that stream, so
only the last window is not full. Quanta are proportions of a window in fixed point, so after any number of rounds w a
queue has sent ``portion * floor(w * quantum / portion)`` tokens, or all it has: deficits at any round, and with them the
place of any token, follow from w alone. Partitions therefore pack apart, and carry deficits over windows and partition
borders without talking to each other.

With no target given, the proportions are the queues' own, so all queues end at about the same round. The largest
``queues - 1`` sources have queues of their own, all others share one, so the table of quanta has a fixed size.

Edge cases: a null text is empty and has the end id alone; a null source is a source; repeated rows and ids are packed
as they are; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import at_most, by_bytes, row_bytes, slices, small_table, text_of, written
from headwise.llm.tokens import library_tokens

AT_ONCE = 1 << 21
#: Binary places of a quantum: deficits stay exact integers.
FINE = 12


@dataclass(frozen=True)
class Schedule:
    """Deficit round robin in closed form: sizes and quanta of the queues, in their order in a round."""

    sizes: tuple[int, ...]
    quanta: tuple[int, ...]
    portion: int

    @classmethod
    def of(cls, sizes: list[int], shares: list[float], window: int, portion: int) -> Schedule:
        """Quanta for these shares of a window; every queue gets at least the smallest step."""
        total = sum(shares)
        return cls(tuple(sizes), tuple(max(1, round(window * s / total * (1 << FINE))) for s in shares), portion)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent after these rounds; one row for each round number."""
        quanta, sizes = np.array(self.quanta, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        portions = rounds[:, None] * quanta[None, :] // (self.portion << FINE)
        return np.minimum(portions * self.portion, sizes[None, :])

    def places(self, queue: int, first: int, count: int) -> np.ndarray:
        """Where portions first, first + 1, ... of a queue begin in the stream of all queues."""
        k = np.arange(first, first + count, dtype=np.int64)
        need = (k + 1) * (self.portion << FINE)
        rounds = -(-need // self.quanta[queue]) - 1  # the round whose quantum completes the portion
        # The last portion may be shorter than the others; it goes when a whole one would.
        before, after = self.sent(rounds), self.sent(rounds + 1)
        in_round = (after[:, :queue] - before[:, :queue]).sum(axis=1)
        return before.sum(axis=1) + in_round + k * self.portion - before[:, queue]


_TOKENS = "doc_id long, source string, part int, in_part long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue int"


def tokenized(df: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Token ids of each document, and the tokens of its source before it in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, sent = library_tokens(vocabulary), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in by_bytes(batches, "text", AT_ONCE):
            ids = tokens.encode(batch.column("text"), end)
            sizes, before = np.diff(row_bytes(ids)[1]) // 4, []
            for source, n in zip(batch.column("source").to_pylist(), sizes.tolist(), strict=True):
                before.append(sent.get(source, 0))
                sent[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(before, pa.int64()),
                    pa.array(sizes),
                    ids,
                ],
                names=["doc_id", "source", "part", "in_part", "n_tokens", "ids"],
            )

    narrow = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.col(f"`{source_col}`").cast("string").alias("source")
    )
    return written(narrow.mapInArrow(encode, _TOKENS), "tokens")


def weights(own: list[tuple[str | None, int]], rest: int, shares: dict[str | None, float]) -> list[float]:
    """Shares of the sources with queues of their own, and of all others together where there are any.

    Targets are shares of a window; sources without one divide what the targets leave in proportion to their tokens.
    """
    free = sum(n for s, n in own if s not in shares) + rest
    given = sum(shares[s] for s, _ in own if s in shares)
    left = max(0.0, 1.0 - given) / free if free else 0.0
    return [float(shares[s]) if s in shares else left * n for s, n in own] + ([left * rest] if rest else [])


def pack(
    df: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    window: int = 1024,
    portion: int = 256,
    queues: int = 256,
    shares: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of all documents with their places: sequence and offset, and the ids of each piece (u32, little-endian).

    ``shares`` gives target proportions of a window to some sources, which then have queues of their own; the others
    divide what is left in the data's proportions, and follow at the smallest step where nothing is left.
    """
    tokens = tokenized(df, vocabulary, end_id, id_col, text_col, source_col)
    by_part = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    parts = written(by_part, "source-parts")
    shares = shares or {}
    if len(shares) >= queues:
        raise ValueError("there are more targets than queues of their own")
    targeted = F.lit(False)
    for source in shares:
        targeted = targeted | F.col("source").eqNullSafe(F.lit(source))
    by_source = parts.groupBy("source").agg(F.sum("n").alias("n"))
    own = [(r.source, int(r.n)) for r in by_source.orderBy(targeted.desc(), F.desc("n"), F.asc_nulls_first("source")).limit(queues - 1).collect()]  # fewer rows than queues
    total = int(parts.agg(F.sum("n")).first()[0] or 0)
    rest = total - sum(n for _, n in own)
    sizes = [n for _, n in own] + ([rest] if rest else [])
    plan = Schedule.of(sizes, weights(own, rest, shares) or [1.0], window, portion)
    numbers = small_table(df.sparkSession, [{"own_source": s, "own_queue": i} for i, (s, _) in enumerate(own)], "own_source:string,own_queue:int")
    numbered = parts.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("own_source")), "left").withColumn("queue", F.coalesce("own_queue", F.lit(len(own))))
    # Tokens of a queue before each partition's share of it: a row for each source and partition.
    ordered = Window.partitionBy("queue").orderBy("part", F.asc_nulls_first("source"))
    before = written(
        numbered.select(
            F.col("source").alias("of_source"), F.col("part").alias("of_part"), "queue", (F.sum("n").over(ordered) - F.col("n")).alias("before")
        ),
        "queue-parts",
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "queue", "first", "ids")), strict=True)
            for run in at_most(list(rows), lambda r: len(r[3]), AT_ONCE):
                out: list[list] = [[] for _ in range(8)]
                for doc_id, queue, first, ids in run:
                    n = len(ids) // 4
                    k = first // portion
                    count = (first + n - 1) // portion - k + 1
                    place = plan.places(queue, k, count)
                    starts = np.maximum(np.arange(k, k + count) * portion, first)
                    at = place + starts - np.arange(k, k + count) * portion
                    ends = np.minimum((np.arange(k, k + count) + 1) * portion, first + n)
                    # Portions that meet in the stream are one run; runs are cut at window borders.
                    for a, s, length in _runs(at, starts - first, ends - starts, window):
                        for column, value in zip(out, (doc_id, s, length, ids[4 * s : 4 * (s + length)], n, a // window, a % window, queue), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    placed = tokens.join(before, tokens["source"].eqNullSafe(before["of_source"]) & (tokens["part"] == before["of_part"]))
    return placed.select("doc_id", "queue", (F.col("before") + F.col("in_part")).alias("first"), "ids").mapInArrow(pieces, _PIECES)


def _runs(at: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """Stream place, start in the document and length of each piece: joined where they meet, cut at windows."""
    joined: list[list[int]] = []
    for a, s, n in zip(at.tolist(), start.tolist(), length.tolist(), strict=True):
        if joined and joined[-1][0] + joined[-1][2] == a:
            joined[-1][2] += n
        else:
            joined.append([a, s, n])
    for a, s, n in joined:
        while n:
            step = min(n, window - a % window)
            yield a, s, step
            a, s, n = a + step, s + step, n - step
