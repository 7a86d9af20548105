"""Ids of whole batches of texts, from those of their distinct pieces.

A text without two white spaces in a row falls apart at its blanks into pieces whose ids do not depend on each other.
Arrow cuts a batch at its blanks, numbers the distinct pieces and lays their ids one after another, so that Python sees
each distinct piece of a batch at most once; short pieces of earlier batches are remembered in arrays. Texts with white
spaces that meet, or with a special token, are encoded whole.

Edge cases: the empty text has no ids; texts without a blank are one piece; a piece of any length is encoded whole, long
ones are not remembered; ties and repeated rows need no rule, since a text's ids depend on it alone; nulls are the
caller's to replace.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from headwise.llm.common import row_bytes

#: Pieces that a worker remembers (about 40 bytes each), and bytes of the longest among them; neither changes a result.
REMEMBERED = 800_000
LONGEST_REMEMBERED = 15
#: Marks that are words of their own after letters.
MARKS = ".,!?;:"
#: All that Python calls white space, for Arrow's patterns.
SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@dataclass
class Keys:
    """Short pieces as two numbers, their bytes and their length, so that equal keys are equal pieces."""

    low: np.ndarray
    high: np.ndarray
    short: np.ndarray

    @classmethod
    def of(cls, pieces: pa.Array) -> Keys:
        data, offsets = row_bytes(pieces)
        lengths = np.diff(offsets)
        short = lengths <= LONGEST_REMEMBERED
        packed = np.zeros((len(pieces), 16), dtype=np.uint8)
        packed[(np.arange(16) < lengths[:, None]) & short[:, None]] = data[np.repeat(short, lengths)]
        packed[:, 15] = np.where(short, lengths, 0)
        halves = packed.view("<u8")
        return cls(halves[:, 0], halves[:, 1], short)

    def take(self, at: np.ndarray) -> Keys:
        return Keys(self.low[at], self.high[at], self.short[at])

    def spread(self) -> np.ndarray:
        x = (self.low ^ (self.high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(20)


class Known:
    """Ids by short piece: an open-addressing table in arrays, looked up and filled for whole batches; emptied when full."""

    def __init__(self, most: int):
        self.most = most
        self.slots = 1 << max(6, (most + most // 4 - 1).bit_length())  # at least a fifth of them stay empty
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.uint64)
        self.entry = np.zeros(self.slots, dtype=np.int32)  # place of the ids plus 1
        self.ends = np.zeros(self.most + 1, dtype=np.int32)
        self.ids = np.zeros(4 * self.most, dtype="<u4")
        self.size = 0

    def find(self, keys: Keys) -> np.ndarray:
        """Place of each piece, -1 where it is not remembered."""
        out = np.full(len(keys.low), -1, dtype=np.int64)
        left = np.nonzero(keys.short)[0]
        slot = (keys.spread()[left] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            there = self.entry[slot]
            same = (self.low[slot] == keys.low[left]) & (self.high[slot] == keys.high[left]) & (there > 0)
            out[left[same]] = there[same] - 1
            on = (there > 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these places begin, and how many they are."""
        return self.ends[places].astype(np.int64), (self.ends[places + 1] - self.ends[places]).astype(np.int64)

    def add(self, keys: Keys, ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember ids (those of a piece from one of its ends to the next) of pieces that are not there yet."""
        new = np.nonzero(keys.short & (self.find(keys) < 0))[0]
        sizes = np.diff(ends)[new]
        if self.size + len(new) > self.most or self.ends[self.size] + sizes.sum() > len(self.ids):
            self.clear()
            if len(new) > self.most or sizes.sum() > len(self.ids):
                return
        steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        begin = int(self.ends[self.size])
        self.ids[begin : begin + len(steps)] = ids[np.repeat(ends[:-1][new], sizes) + steps]
        self.ends[self.size + 1 : self.size + len(new) + 1] = begin + np.cumsum(sizes)
        number = np.arange(self.size + 1, self.size + len(new) + 1)
        self.size += len(new)
        slot = (keys.spread()[new] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(new):
            free = self.entry[slot] == 0
            self.entry[slot[free]] = number[free]  # of several for one place the last one stays
            won = free & (self.entry[slot] == number)
            self.low[slot[won]], self.high[slot[won]] = keys.low[new[won]], keys.high[new[won]]
            new, number, slot = new[~won], number[~won], (slot[~won] + 1) & (self.slots - 1)


class Pieces:
    """Ids as little-endian unsigned 32-bit integers; a vocabulary says how pieces and whole texts are encoded."""

    touching = staticmethod(re.compile(r"\A\s|\s\Z|\s\s|\A\Z").search)

    def __init__(self, special: list[str]):
        self.special = special
        self.known = Known(REMEMBERED)
        self.marks = dict(zip(MARKS, self._whole(list(MARKS)), strict=True))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with a blank before it; none of them touches white space or holds a special token."""
        raise TypeError("a vocabulary encodes pieces")

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as they are."""
        raise TypeError("a vocabulary encodes texts")

    def _ids(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct pieces as binary; none where one touches white space or holds a special token."""
        keys = Keys.of(distinct)
        entry = self.known.find(keys)
        (starts, sizes), held = self.known.of(np.maximum(entry, 0)), self.known.ids  # learning may empty the memory
        new = np.nonzero(entry < 0)[0]
        taken = distinct.take(pa.array(new))
        spaced = pc.match_substring_regex(taken, SPACE).to_numpy(zero_copy_only=False) | (pc.binary_length(taken).to_numpy() == 0)
        names = taken.to_numpy(zero_copy_only=False).tolist()
        apart = np.zeros(len(new), dtype=bool)
        apart[spaced] = [self.touching(names[i]) is not None for i in np.nonzero(spaced)[0].tolist()]
        for token in self.special:
            apart |= pc.match_substring(taken, token).to_numpy(zero_copy_only=False)
        ids = [b""] * len(new)
        plain = np.nonzero(~apart)[0].tolist()
        for i, x in zip(plain, self._apart([names[i] for i in plain]), strict=True):
            ids[i] = x
        learned, ends = row_bytes(pa.array(ids, pa.binary()))
        learned, ends = learned.view("<u4"), ends // 4
        sizes[new] = np.diff(ends)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(offsets[-1], dtype="<u4")
        for rows, source, first in ((np.nonzero(entry >= 0)[0], held, starts), (new, learned, None)):
            begin, n = offsets[rows], sizes[rows]
            at = first[rows] if first is not None else ends[:-1]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(begin, n) + steps] = source[np.repeat(at, n) + steps]
        self.known.add(keys.take(new), learned, ends)
        return pa.Array.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(out)])

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces: a mark after letters is a word of its own, so the letters may be known without it."""
        marked = [i for i, x in enumerate(pieces) if x[-1] in MARKS and x[:-1].isalpha()]
        words = list({pieces[i][:-1] for i in marked})
        keys = Keys.of(pa.array(words, pa.string()))
        entry = self.known.find(keys)
        found = np.nonzero(entry >= 0)[0]
        starts, sizes = self.known.of(entry[found])
        ids = {words[i]: self.known.ids[a : a + n].tobytes() for i, a, n in zip(found.tolist(), starts.tolist(), sizes.tolist(), strict=True)}
        rest = dict.fromkeys(pieces)
        for i in marked:
            del rest[pieces[i]]
        fresh = [w for w in words if w not in ids and w not in rest]
        others = [*rest, *fresh]
        ids.update(zip(others, self._pieces(others), strict=True))
        if fresh:
            learned, ends = row_bytes(pa.array([ids[w] for w in fresh], pa.binary()))
            self.known.add(Keys.of(pa.array(fresh, pa.string())), learned.view("<u4"), ends // 4)
        for i in marked:
            x = pieces[i]
            ids[x] = ids[x[:-1]] + self.marks[x[-1]]
        return [ids[x] for x in pieces]

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text (a string column without nulls) as binary, with those of ``end`` after them."""
        n = len(texts)
        cut = pc.split_pattern(texts, " ")
        flat = cut.flatten()
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        rest_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets) - 1)
        after_first = np.ones(len(flat), dtype=bool)
        after_first[offsets[:-1]] = False
        rest = flat.filter(pa.array(after_first)).dictionary_encode()
        ids, index = self._ids(rest.dictionary), rest.indices.to_numpy()
        # Texts that the library gets whole.
        heads = flat.take(pa.array(offsets[:-1])).to_pylist()
        whole = np.array([h[-1:].isspace() for h in heads], dtype=bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        none = pc.binary_length(ids).to_numpy() == 0
        whole[rest_of[none[index]]] = True
        for i in np.nonzero(whole)[0].tolist():
            heads[i] = texts[i].as_py()
        # Each text's row of values: its head, its other pieces, the end.
        left = np.nonzero(~whole[rest_of])[0]
        counts = 1 + np.bincount(rest_of[left], minlength=n) + bool(end)
        starts = np.concatenate(([0], np.cumsum(counts)))
        place = np.empty(starts[-1], dtype=np.int32)
        place[starts[:-1]] = len(ids) + np.arange(n)
        place[starts[rest_of[left]] + 1 + left - (offsets[:-1] - np.arange(n))[rest_of[left]]] = index[left]
        if end:
            place[starts[1:] - 1] = len(ids) + n
        values = pa.concat_arrays([ids, pa.array([*self._whole(heads), end], pa.binary())]).take(pa.array(place))
        ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends[starts].copy()), values.buffers()[2]])
