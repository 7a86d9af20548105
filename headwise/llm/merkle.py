"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's bytes are cut into units (sentences, lines, and at most ``UNIT`` bytes of an unbroken run). A line end, or a unit
whose checksum says so, ends a paragraph; a blank line, or a paragraph whose checksum says so, ends a section. Since the
cuts follow the content, an edit moves only the cuts next to it. A leaf is the digest of a paragraph, a section the
digest of its leaves, the root the digest of its sections. A fingerprint holds the root and the branches, so equal roots
mean equal texts, ``changed`` opens only sections that differ, and ``likeness`` is the share of bytes in common leaves.

Edge cases: a null text is empty, and its tree has no leaf; two empty texts are alike (1), an empty and another are not
(0); rows of equal ids follow one another by text; a null id comes first; the only document is its own next one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import text_of

#: Longest unit in bytes.
UNIT = 400
#: A unit ends its paragraph with one chance in so many, a paragraph its section.
UNITS, PARAGRAPHS = 4, 8
_UNITS = re.compile(rb"[^.!?\n]{1,%d}[.!?]* ?\n*|[.!?\n]+" % UNIT)
_digest = partial(hashlib.blake2b, digest_size=8)

Section = tuple[bytes, list[tuple[bytes, int]]]


def tree(text: str) -> tuple[str, list[Section]]:
    """Root (hex) and sections: digest, and digest and bytes of each paragraph."""
    sections: list[Section] = []
    leaves: list[tuple[bytes, int]] = []
    held = b""

    def close() -> None:
        nonlocal leaves
        if leaves:
            sections.append((_digest(b"".join(d + struct.pack("<I", n) for d, n in leaves)).digest(), leaves))
            leaves = []

    for unit in _UNITS.findall(text.encode()):
        held += unit
        line = unit.endswith(b"\n")
        if line or zlib.crc32(unit) % UNITS == 0:
            leaves.append((_digest(held).digest(), len(held)))
            if unit.endswith(b"\n\n") or zlib.crc32(held) % PARAGRAPHS == 0:
                close()
            held = b""
    if held:
        leaves.append((_digest(held).digest(), len(held)))
    close()
    root = hashlib.blake2b(b"".join(d for d, _ in sections), digest_size=16).hexdigest()
    return root, sections


def fingerprint(text: str) -> str:
    """The tree as text: root, and the branches in base 64."""
    root, sections = tree(text)
    out = [struct.pack("<I", len(sections))]
    for digest, leaves in sections:
        out += [digest, struct.pack("<I", len(leaves)), *(d + struct.pack("<I", n) for d, n in leaves)]
    return root + ":" + base64.b64encode(b"".join(out)).decode()


def branches(mark: str) -> tuple[str, list[Section]]:
    """Root and sections of a fingerprint."""
    root, _, packed = mark.partition(":")
    data, at, sections = base64.b64decode(packed), 4, []
    for _ in range(struct.unpack_from("<I", data)[0]):
        digest, (n,) = data[at : at + 8], struct.unpack_from("<I", data, at + 8)
        at += 12
        leaves = [(data[i : i + 8], struct.unpack_from("<I", data, i + 8)[0]) for i in range(at, at + 12 * n, 12)]
        at += 12 * n
        sections.append((digest, leaves))
    return root, sections


def likeness(a: str, b: str) -> float:
    """Bytes in leaves that both trees have, as a share of the bytes of both; whole sections are matched first."""
    (root_a, left), (root_b, right) = branches(a), branches(b)
    if root_a == root_b:
        return 1.0
    total = sum(n for s in (left, right) for _, leaves in s for _, n in leaves)
    same = 0
    there = Counter(d for d, _ in right)
    rest_left = []
    for digest, leaves in left:
        if there[digest] > 0:
            there[digest] -= 1
            same += sum(n for _, n in leaves)
        else:
            rest_left += leaves
    rest_right = Counter()
    for digest, leaves in reversed(right):
        if there[digest] > 0:
            there[digest] -= 1
            rest_right.update(leaves)
    for leaf, count in Counter(rest_left).items():
        same += leaf[1] * min(count, rest_right[leaf])
    return 2.0 * same / total if total else 1.0


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the first text whose paragraphs the second does not have; equal branches are not opened."""
    (root_a, left), (root_b, right) = branches(a), branches(b)
    if root_a == root_b:
        return []
    known = {d for d, _ in right}
    inside = {leaf for _, leaves in right for leaf in leaves}
    at, out = 0, []
    for digest, leaves in left:
        for leaf in leaves:
            if digest not in known and leaf not in inside:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + leaf[1])
                else:
                    out.append((at, at + leaf[1]))
            at += leaf[1]
    return out


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIRST = -(1 << 63)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare with the edited text and the next document.

    Ids are cut into ranges of about equal numbers of rows; the first document of each range also goes to the range
    before (the first of all to the last range), so that each range finds every next document in itself. The texts are
    shuffled once. The driver holds one bound for each range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_FIRST))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key.alias("key"), text_of(text_col).alias("text"))
    keys = docs.select("key")
    cuts = keys.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(ids), side="right"), pa.int32())

    first_ids = {r[0]: r[1] for r in keys.groupBy(range_of("key").alias("range")).agg(F.min("key")).collect()}
    order = sorted(first_ids)
    also = {first_ids[r]: order[i - 1] for i, r in enumerate(order)}  # first id of a range -> the range before

    @F.arrow_udf("int")
    def range_before(ids: pa.Array) -> pa.Array:
        return pa.array([also.get(i) for i in ids.to_pylist()], pa.int32())

    own = F.struct(range_of("key").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(range_before("key").alias("range"), F.lit(True).alias("guest"))
    dealt = docs.select("*", F.inline(F.array(own, guest))).where(F.col("range").isNotNull())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for doc_id, text, in_range, is_guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if in_range != at:
                    before, at = None, in_range
                if is_guest and before is None:
                    continue
                mark = fingerprint(text)
                if before is not None:
                    last_id, last_text, last_mark = before
                    changed_text = edited(last_text, text)
                    changed_mark = fingerprint(changed_text)
                    row = (
                        last_id,
                        len(last_text),
                        hashlib.sha256(changed_text.encode()).hexdigest(),
                        last_mark,
                        changed_mark,
                        likeness(last_mark, changed_mark),
                        likeness(last_mark, mark),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += len(last_mark)
                before = None if is_guest else (doc_id, text, mark)
                if size > 1 << 22:
                    yield _rows(out)
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield _rows(out)

    placed = dealt.select("doc_id", "text", "range", "guest", "key").repartitionById(ranges, F.col("range"))
    ordered = placed.sortWithinPartitions("range", "guest", "key", "text").select("doc_id", "text", "range", "guest")
    return ordered.mapInArrow(compare, _RESULT)


def _rows(columns: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
