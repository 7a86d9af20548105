import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from headwise.llm import pieces, token_file, tokens
from headwise.llm.common import scratch_path
from headwise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=700), st.data())
def test_round_trip_and_random_access(ids, data):
    reader = token_file.Reader(token_file.pack(np.array(ids, dtype=np.uint32)))
    assert reader.read().tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert reader.read(a, b).tolist() == ids[a:b]


def test_one_outlier_does_not_widen_its_block():
    ids = np.arange(128, dtype=np.uint32) % 16
    wide = ids.copy()
    wide[77] = 50_000
    assert len(token_file.pack(wide)) - len(token_file.pack(ids)) < 8


def test_library_ids_by_pieces(monkeypatch):
    library, random_ = Tokenizer.from_file(PATH), random.Random(3)
    letters = [*"ab  \n\t'sé1.,　\x1c😀", "<|endoftext|>", "x" * 60]
    texts = ["".join(random_.choice(letters) for _ in range(random_.randint(0, 14))) for _ in range(2000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for bound in (pieces.REMEMBERED, 300, 20):
        monkeypatch.setattr(pieces, "REMEMBERED", bound)
        one = tokens.LibraryTokens(PATH)
        for end in (b"", b"\x07\0\0\0"):
            got = [b for k in range(0, 2000, 97) for b in one.encode(pa.array(texts[k : k + 97]), end).to_pylist()]
            assert [list(memoryview(b).cast("I")) for b in got] == [[*w, *[7] * bool(end)] for w in want]
    assert len(one.encode(pa.array([], pa.string()))) == 0


def test_edge_rows(spark, monkeypatch):
    rows = [(3, "b a"), (None, "x"), (1, None), (2, ""), (2, ""), (9, "word " * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    folder = scratch_path(spark, "test")
    token_file.write(df, folder, PATH)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_file.read(spark, folder).collect() if r.doc_id is not None)
    want = expected(rows, Tokenizer.from_file(PATH))
    assert got == sorted(w for w in want if w[0] is not None)
    empty = scratch_path(spark, "test")
    token_file.write(df.limit(0), empty, PATH)
    assert token_file.read(spark, empty).count() == 0


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_files"](spark, small).collect()]
    assert sorted(got) == sorted(expected(rows, Tokenizer.from_file(PATH)))
