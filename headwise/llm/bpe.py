"""Byte-level BPE: encode with a priority queue of merge ranks over a linked symbol list, decode by concatenation.

Edge cases: a null text is the empty text and gives no ids; ids outside the vocabulary are an error; empty tables give
empty results; other columns pass through, and one that has the result's name is replaced. Every row is encoded by itself, so repeated rows and
ties need no rule, and one long word of n bytes takes O(n log n) steps.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import give_back, row_bytes, sole_memory, text_of, text_runs
from headwise.llm.pieces import Pieces

#: Distinct words inside pieces that a worker remembers; the memory is bounded, the results do not depend on it.
REMEMBERED = 100_000
LONGEST_REMEMBERED = 48
#: Bytes that are encoded or decoded at a time.
AT_ONCE = 1 << 22

#: Above any symbol id; two ids make one number.
PAIR = 1 << 32

# The pre-tokenizer pattern of the published byte-level vocabulary. White space is written out, because
# the Unicode property differs from Python's \s in the separators U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself where it is printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge the best-ranked neighbours, leftmost first among equals, until none is left.

    ``ranks`` maps a pair (left * PAIR + right) to its rank and ``merged`` a rank to the symbol it makes. Neighbours are
    linked by index. A queue entry holds rank and place as one number; it is stale, and skipped, when the pair that
    starts at its place has another rank by then.
    """
    n = len(symbols)
    ids, after = list(symbols), list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    at = [rank_of(a * PAIR + b, -1) for a, b in zip(ids, ids[1:])]
    at.append(-1)
    queue = [r * n + i for i, r in enumerate(at) if r >= 0]
    if not queue:
        return ids
    heapify(queue)
    while queue:
        rank, i = divmod(heappop(queue), n)
        if at[i] != rank:
            continue
        new, gone = merged[rank], after[i]
        ids[i], ids[gone], at[gone] = new, -1, -1
        after[i] = right = after[gone]
        at[i] = -1
        if right < n:
            before[right] = i
            if (r := rank_of(new * PAIR + ids[right], -1)) >= 0:
                at[i] = r
                heappush(queue, r * n + i)
        left = before[i]
        if left >= 0:
            at[left] = r = rank_of(ids[left] * PAIR + new, -1)
            if r >= 0:
                heappush(queue, r * n + left)
    return [x for x in ids if x >= 0]


class _Remembered(dict):
    """A bounded memory of encoded pieces: text to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, piece: str) -> bytes:
        ids = self.compute(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe(Pieces):
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocab[c] for c in letters]
        self.ranks, self.merged = {}, []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a] * PAIR + vocab[b]] = rank
            self.merged.append(vocab[a + b])
        added = spec.get("added_tokens", [])
        if any(t.get(way) for t in added for way in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in what is beside them are not supported")
        self.special_ids = {t["content"]: t["id"] for t in added}
        strings = {i: bytes(as_byte[c] for c in token) for token, i in vocab.items()}
        strings |= {i: token.encode() for token, i in self.special_ids.items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.binary())
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special_ids, key=len, reverse=True))) + ")").split if self.special_ids else None
        self.words = _Remembered(self._word)
        super().__init__(list(self.special_ids))

    def _word(self, word: str) -> bytes:
        ids = merge_symbols([self.of_byte[b] for b in word.encode()], self.ranks, self.merged)
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(" " + chunk)
        return b"".join(map(self.words.__getitem__, self.find(" " + chunk)))

    def _ordinary(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return list(map(self._chunk, pieces))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode_one, texts))

    def encode_one(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        if self.cut and any(token in text for token in self.special_ids):
            parts = self.cut(text)
            return b"".join(self.special_ids[p].to_bytes(4, "little") if p in self.special_ids else self._ordinary(p) for p in parts if p)
        return self._ordinary(text) if text else b""

    def decode(self, rows: pa.Array) -> pa.Array:
        """The text of each row's ids."""
        data, offsets = row_bytes(rows)
        strings = self.strings.take(pa.array(data.view("<u4")))
        if strings.null_count:
            raise ValueError("an id is not in the vocabulary")
        whole, places = row_bytes(strings)
        ends = places[offsets // 4]
        return pa.array([whole[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


@lru_cache(maxsize=1)
def _byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder of a vocabulary."""
    sole_memory("byte bpe", _byte_bpe.cache_clear)
    return _byte_bpe(path)


def encode_column(text: Column, path: str) -> Column:
    """Token ids of a text as binary: little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        one = byte_bpe(path)
        out = [one.encode(texts.slice(a, n)) for a, n in text_runs(texts, AT_ONCE)]
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of token ids in that binary form."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        one = byte_bpe(path)
        out = [one.decode(rows.slice(a, n)) for a, n in text_runs(rows, AT_ONCE)]
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return decode(ids)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of each text; a null text has none. A column of the name ``ids`` is replaced."""
    return df.withColumn(ids, encode_column(text_of(text), path))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's token ids; null ids give the empty text. A column of the name ``text`` is replaced."""
    return df.withColumn(text, decode_column(F.coalesce(F.col(f"`{ids}`"), F.lit(b"")), path))
