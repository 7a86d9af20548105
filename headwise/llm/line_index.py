"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without white space at its ends and with A-Z in lower case; short lines have none. The index
holds, as tables under the shared folder, the documents it has taken in, the documents that hold each key, an exact count
of those documents for each key with the largest of them, and for each shard of keys a cuckoo filter of 16-bit
fingerprints in buckets of four. Each key in the counts has one fingerprint, so a filter can say for certain that a key
is new: keys of a batch that it does not know are appended without a look at the counts, only the rest meets them in a
join. Deleting documents lowers the counts and takes the fingerprints of keys that no document holds any more out of the
filters, which gives back the index as it was. Every step writes new tables and returns a new index; the old one stays
valid. Shards grow with the keys: filters that would be too full are built anew from the counts over twice as many.

Keys are 128-bit hashes of the lines, counted before they are shuffled, so a line that a third of all documents hold is
one row of each task; its documents lie in files and meet its count in a join that adaptive execution splits. A task
holds one filter and a batch of keys at a time. The driver holds one row for each shard.

Edge cases: a null or empty text is one empty line and has no key; repeated rows and rows of equal ids are one document,
which holds the keys of all its rows; a null id is one document, smaller than all others; documents that the index has
already are not taken in again (delete them first), and ids it does not have are not deleted; an empty table changes nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm.common import by_bytes, fresh, row_bytes, text_of, written

#: Fixed values of the contract: white space at the ends of a line, code points of a key, documents that make it common.
WHITE = b" \t\n\x0b\x0c\r"
SHORTEST = 20
COMMON = 3

AT_ONCE = 1 << 21
#: Keys that a filter is made for; its table has twice as many places, and shards hold half as many keys in the mean.
KEYS = 1 << 17
SLOTS = 4
_KEY = "k1 long, k2 long"
_COUNT = f"{_KEY}, n long, largest long"
_NO_ID = -(1 << 63)


class Cuckoo:
    """A cuckoo filter over arrays of 64-bit hashes: lookups, insertions and deletions of whole batches."""

    def __init__(self, data: bytes | None = None, keys: int = KEYS):
        buckets = 1 << max(4, (2 * keys // SLOTS - 1).bit_length())
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16) if data is None else np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()

    def data(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and fingerprint (never 0, which is an empty place)."""
        h = hashes.astype(np.uint64)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return (h & np.uint64(len(self.table) - 1)).astype(np.int64), mark

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint; its own second bucket is the first one."""
        spread = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ ((spread & np.uint64(len(self.table) - 1)).astype(np.int64) | 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bucket, mark = self.places(hashes)
        there = (self.table[bucket] == mark[:, None]).any(axis=1)
        return there | (self.table[self.other(bucket, mark)] == mark[:, None]).any(axis=1)

    def _put(self, bucket: np.ndarray, mark: np.ndarray, taken: bool, new: np.ndarray) -> np.ndarray:
        """For each request one place of its bucket that is empty (or, with ``taken``, holds its mark) gets the new value, as far as there are such places; which were served."""
        served = np.zeros(len(bucket), dtype=bool)
        wanted = mark if taken else np.zeros_like(mark)
        rival = bucket * (1 << 16) + wanted  # requests for the same places take turns
        for _ in range(SLOTS):
            left = np.nonzero(~served)[0]
            _, first = np.unique(rival[left], return_index=True)
            one = left[first]
            match = self.table[bucket[one]] == wanted[one, None]
            can = match.any(axis=1)
            self.table[bucket[one[can]], match[can].argmax(axis=1)] = new[one[can]]
            served[one[can]] = True
            if not can.any():
                break
        return served

    def add(self, hashes: np.ndarray, patience: int = 500) -> None:
        """One more fingerprint for each hash; raises where the table is too full."""
        bucket, mark = self.places(hashes)
        for try_other in (False, True):
            at = self.other(bucket, mark) if try_other else bucket
            served = self._put(at, mark, False, mark)
            bucket, mark = bucket[~served], mark[~served]
        for turn in range(patience):
            if not len(bucket):
                return
            # One request a bucket swaps with a fingerprint there, which goes on to its other bucket.
            _, one = np.unique(bucket, return_index=True)
            slot = (turn * 7 + one) % SLOTS
            out = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = mark[one]
            mark[one] = out
            bucket[one] = self.other(bucket[one], out)
            served = self._put(bucket, mark, False, mark)
            bucket, mark = bucket[~served], mark[~served]
        if len(bucket):
            raise OverflowError("the filter is too full")

    def remove(self, hashes: np.ndarray) -> None:
        """One fingerprint less for each hash, which must have been added; equal ones are the same."""
        bucket, mark = self.places(hashes)
        gone = np.zeros_like(mark)
        while len(bucket):
            before = len(bucket)
            for try_other in (False, True):
                at = self.other(bucket, mark) if try_other else bucket
                served = self._put(at, mark, True, gone[: len(mark)])
                bucket, mark = bucket[~served], mark[~served]
            if len(bucket) == before:
                raise KeyError("a hash was never added")


def line_keys(text: bytes, shortest: int = SHORTEST) -> list[bytes | None]:
    """The key of each line as 16 bytes; None for short lines."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(WHITE).lower()  # of bytes: A-Z only
        short = len(key) < shortest or (len(key) < 4 * shortest and len(key.decode()) < shortest)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def holders(df: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents and the keys that they hold, each once: doc (long, the smallest one for null), k1, k2."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", AT_ONCE):
            found = [b"".join({k for k in line_keys(t.encode(), shortest) if k}) for t in b.column("text").to_pylist()]
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            counts = np.array([len(k) // 16 for k in found], dtype=np.int64)
            docs = np.repeat(b.column("doc").to_numpy(), np.maximum(counts, 1))
            # A document without keys is a row with null keys, so that the index knows it.
            row, none = np.zeros((len(docs), 2), dtype=np.int64), np.repeat(counts == 0, np.maximum(counts, 1))
            row[~none] = halves
            yield pa.RecordBatch.from_arrays([pa.array(docs), *(pa.array(row[:, i], mask=none) for i in range(2))], names=["doc", "k1", "k2"])

    return df.select(doc_of(id_col).alias("doc"), text_of(text_col).alias("text")).mapInArrow(keys, f"doc long, {_KEY}")


def doc_of(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int")


def through_filters(keys: DataFrame, filters: DataFrame, shards: int, capacity: int, change: bool) -> DataFrame:
    """Run keys through the filters of their shards, a shard's filter first and its keys in batches after it.

    Without ``change``: the keys with ``known``, false where the filter says for certain that it has not got the key. With
    it: the filters after keys with ``n`` above 0 were added and the others removed; shards without a key keep theirs.
    """
    parts = min(shards, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(None).cast("long")
    rows = keys.select(shard_of(shards).alias("shard"), F.lit(1).alias("kind"), "k1", "k2", "n", "largest", F.lit(None).cast("binary").alias("data"))
    heads = filters.select("shard", F.lit(0).alias("kind"), none.alias("k1"), none.alias("k2"), none.alias("n"), none.alias("largest"), "data")
    dealt = rows.unionAll(heads).repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Cuckoo | None = None
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
            starts = [0, *(np.nonzero(place[1:] != place[:-1])[0] + 1).tolist(), len(place)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part, (shard, kind) = batch.slice(a, b - a), divmod(int(place[a]), 2)
                if shard != at:
                    if held is not None and change:
                        yield head(at, held)
                    at, held = shard, Cuckoo(keys=capacity)
                if kind == 0:
                    held = Cuckoo(part.column("data")[0].as_py())
                    continue
                hashes = part.column("k1").to_numpy()
                if change:
                    more = part.column("n").to_numpy() > 0
                    held.remove(hashes[~more])
                    held.add(hashes[more])
                else:
                    columns = [part.column(c) for c in ("k1", "k2", "n", "largest")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(held.has(hashes))], names=["k1", "k2", "n", "largest", "known"])
        if held is not None and change:
            yield head(at, held)

    def head(shard: int, held: Cuckoo) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held.data()], pa.binary())], names=["shard", "data"])

    return dealt.mapInArrow(look, "shard int, data binary" if change else f"{_COUNT}, known boolean")


@dataclass(frozen=True)
class LineIndex:
    """Tables of the index: ``docs`` (doc), ``refs`` (doc, k1, k2), ``counts`` (k1, k2, n, largest), ``filters`` (shard, data)."""

    docs: DataFrame
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    capacity: int = KEYS

    @classmethod
    def empty(cls, spark: SparkSession, capacity: int = KEYS) -> LineIndex:
        def none(schema: str) -> DataFrame:
            return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])

        return cls(none("doc long"), none(f"doc long, {_KEY}"), none(_COUNT), none("shard int, data binary"), 1, capacity)

    def insert(self, held: DataFrame) -> LineIndex:
        """Take in the documents of ``holders`` that the index has not got."""
        held = written(held.join(self.docs, "doc", "left_anti").distinct(), "line-refs")
        refs = held.where("k1 IS NOT NULL")
        batch = written(refs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("largest")), "line-keys")
        index = self._with_room(batch.count())
        seen = written(through_filters(batch, index.filters, index.shards, index.capacity, change=False), "line-seen")
        new = seen.where("NOT known").select("k1", "k2", "n", "largest", F.lit(True).alias("added"))
        maybe = seen.where("known").select("k1", "k2", F.col("n").alias("more"), F.col("largest").alias("later"))
        total = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        merged = index.counts.join(maybe, ["k1", "k2"], "full").select(
            "k1", "k2", total.cast("long").alias("n"), F.greatest("largest", "later").alias("largest"), F.col("n").isNull().alias("added")
        )
        counts = written(merged.unionByName(new), "line-counts")
        filters = written(through_filters(counts.where("added"), index.filters, index.shards, index.capacity, change=True), "line-filters")
        docs = written(held.select("doc").distinct(), "line-docs")
        return replace(index, docs=self.docs.unionByName(docs), refs=self.refs.unionByName(refs), counts=counts.drop("added"), filters=filters)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take out the documents of these ids."""
        gone = written(ids.select(doc_of(id_col).alias("doc")).distinct(), "line-gone")
        lost = written(self.refs.join(gone, "doc").groupBy("k1", "k2").agg(F.count("*").alias("less")), "line-lost")
        refs = written(self.refs.join(gone, "doc", "left_anti"), "line-refs")
        # Only keys that lose a document look for their largest one again.
        now = refs.join(lost, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc").alias("now"))
        left = self.counts.join(lost.join(now, ["k1", "k2"], "left"), ["k1", "k2"], "left")
        largest = F.when(F.col("less").isNull(), F.col("largest")).otherwise(F.col("now"))
        counts = written(left.select("k1", "k2", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), largest.alias("largest")), "line-counts")
        filters = written(through_filters(counts.where("n = 0"), self.filters, self.shards, self.capacity, change=True), "line-filters")
        docs = written(self.docs.join(gone, "doc", "left_anti"), "line-docs")
        return replace(self, docs=docs, refs=refs, counts=counts.where("n > 0"), filters=filters)

    def _with_room(self, more: int) -> LineIndex:
        """The index with shards for so many more keys: where there are too few, filters are built anew from the counts."""
        shards, total = self.shards, self.counts.count() + more
        while 2 * total > shards * self.capacity:
            shards *= 2
        if shards == self.shards:
            return self
        return replace(self, shards=shards, filters=written(through_filters(self.counts, self.filters.limit(0), shards, self.capacity, change=True), "line-filters"))

    def dropped(self, common: int = COMMON) -> DataFrame:
        """Keys that documents lose: those that ``common`` documents hold, in all but the largest of them."""
        often = self.counts.where(F.col("n") >= common).select("k1", "k2", "largest")
        return self.refs.join(often, ["k1", "k2"]).where("doc != largest").select("doc", "k1", "k2")


def without_dropped(df: DataFrame, dropped: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines whose keys their documents lose, with ``n_lines`` before and ``n_dropped``; columns of these names are replaced."""
    own, lost, keys, text = fresh(df, "own_doc", "lost_doc", "lost_keys", "whole_text")
    rest = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped", text_col.lower())]
    lists = dropped.groupBy(F.col("doc").alias(lost)).agg(F.flatten(F.collect_list(F.array("k1", "k2"))).alias(keys))  # a document's own keys
    joined = df.withColumn(own, doc_of(id_col)).join(lists, F.col(own) == F.col(lost), "left")
    no_keys = F.array().cast("array<bigint>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text, AT_ONCE):
            texts, lines, gone = [], [], []
            for whole, halves in zip(b.column(text).to_pylist(), b.column(keys).to_pylist(), strict=True):
                data = whole.encode()
                all_lines = data.split(b"\n")
                packed = np.array(halves, dtype="<i8").tobytes()
                going = {packed[i : i + 16] for i in range(0, len(packed), 16)}
                kept = [x for x, k in zip(all_lines, line_keys(data, shortest), strict=True) if k not in going] if going else all_lines
                texts.append(b"\n".join(kept).decode())
                lines.append(len(all_lines))
                gone.append(len(all_lines) - len(kept))
            found = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *found], names=[*rest, text_col, "n_lines", "n_dropped"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{text_col}` string", "n_lines long", "n_dropped long"])
    out = joined.select(*[F.col(f"`{c}`") for c in rest], text_of(text_col).alias(text), F.coalesce(keys, no_keys).alias(keys)).mapInArrow(cut, schema)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c in (*rest, text_col)], "n_lines", "n_dropped")


def dedup(df: DataFrame, batches: int = 2, common: int = COMMON, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take in all documents in batches of their ids, and drop the common lines of the whole."""
    held = written(holders(df, shortest, id_col, text_col), "line-all-holders")
    index = LineIndex.empty(df.sparkSession)
    for i in range(batches):
        index = index.insert(held.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i))
    return without_dropped(df, index.dropped(common), shortest, id_col, text_col)
