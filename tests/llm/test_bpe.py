import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from headwise.llm import bpe
from headwise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"ab  \n\t'sréñ1२½.,!— 　\x1c\x85​😀", " 's", "<|endoftext|>", "  ", "\n \n", "中文"]


def ids_of(text):
    return ids_of_all(bpe.byte_bpe(PATH), [text])[0]


def ids_of_all(one, texts):
    return [list(memoryview(b).cast("I")) for b in one.encode(pa.array(texts, pa.string())).to_pylist()]


def test_equals_the_library_on_random_texts():
    library, random_ = Tokenizer.from_file(PATH), random.Random(5)
    texts = ["".join(random_.choice(LETTERS) for _ in range(random_.randint(0, 16))) for _ in range(3000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    one = bpe.byte_bpe(PATH)
    for k in range(0, 3000, 300):
        assert ids_of_all(one, texts[k : k + 300]) == want[k : k + 300]
    assert [list(memoryview(one.encode_one(t)).cast("I")) for t in texts] == want
    packed = pa.array([b"".join(i.to_bytes(4, "little") for i in ids) for ids in want], pa.binary())
    assert one.decode(packed).to_pylist() == [library.decode(ids, skip_special_tokens=False) for ids in want]
    with pytest.raises(Exception, match="vocabulary|out of bounds"):
        one.decode(pa.array([(10**6).to_bytes(4, "little")], pa.binary()))


def test_very_long_word_and_forgotten_memory(monkeypatch):
    library, text = Tokenizer.from_file(PATH), "abcde" * 20_000
    assert ids_of(text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    for _ in range(2):
        assert ids_of_all(bpe.ByteBpe(PATH), ["one two's three one.two"]) == [library.encode("one two's three one.two", add_special_tokens=False).ids]


def test_edge_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", None)], "doc_id long, text string, decoded_ string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in got) == ["", "", "", "a b"] and len(got) == 4
    assert bpe.encode(df.limit(0), PATH).count() == 0
    clash = bpe.encode(df.withColumnRenamed("decoded_", "IDS"), PATH)
    assert clash.columns == ["doc_id", "text", "ids"] and clash.count() == 4


def test_query_against_the_library(spark, small):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op1_bpe_round_trip"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
