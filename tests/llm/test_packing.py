import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from headwise.llm import packing
from headwise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def simulated(sizes, quanta, portion):
    """Deficit round robin step by step: place of each portion of each queue."""
    deficit, sent, place, at = [0] * len(sizes), [0] * len(sizes), defaultdict(list), 0
    while any(s < n for s, n in zip(sent, sizes, strict=True)):
        for q, size in enumerate(sizes):
            deficit[q] += quanta[q]
            while deficit[q] >= portion << packing.FINE:
                deficit[q] -= portion << packing.FINE
                if sent[q] < size:
                    n = min(portion, size - sent[q])
                    place[q].append(at)
                    sent[q] += n
                    at += n
    return place


def test_closed_form_equals_the_rounds():
    random_ = random.Random(2)
    for _ in range(25):
        sizes = [random_.randint(1, 5000) for _ in range(random_.randint(1, 6))]
        plan = packing.Schedule.of(sizes, [random_.random() + 0.01 for _ in sizes], 256, 64)
        for q, want in simulated(sizes, plan.quanta, 64).items():
            assert plan.places(q, 0, len(want)).tolist() == want


def checked(rows, docs, library, window=1024):
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc_id, found in pieces.items():
        assert sum(p[1] for p in found) == sum(map(len, ids[doc_id]))
        if len(ids[doc_id]) == 1:
            (want,), at = ids[doc_id], 0
            for start, length, crc, n in sorted(found):
                assert start == at and n == len(want)
                assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want[start : start + length]))
                at += length
    last = max(windows)
    assert sorted(windows) == list(range(last + 1))
    for w, found in windows.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at == window or w == last


def test_query_and_proportions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = QUERIES["op10_mixture_packing"](spark, small).collect()
    checked(rows, [(r.doc_id, r.text) for r in docs], Tokenizer.from_file(PATH))
    # At any point of the stream a queue is within two portions of its target.
    total = sum(r.length for r in rows)
    share, sent = defaultdict(int), defaultdict(int)
    for r in rows:
        share[r.queue] += r.length
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        sent[r.queue] += r.length
        at += r.length
        assert all(abs(sent[q] - at * share[q] / total) <= 256 * len(share) for q in share)


def test_edge_rows(spark):
    rows = [(1, None, None, 1), (2, "", "a", 2), (2, "", "a", 2), (None, "x y", "b", 3), (5, "word " * 4000, "a", 4)] + [(10 + i, "few words here", f"s{i}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, queue int").repartition(5)
    for queues in (256, 4):
        got = packing.pack(df, PATH, queues=queues)
        got = got.selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
        checked(got, [(r[0], r[1]) for r in rows], Tokenizer.from_file(PATH))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_targets_for_some_sources(spark):
    assert packing.weights([("a", 700_000), ("b", 300_000), ("c", 500_000)], 0, {"a": 0.7, "b": 0.3}) == [0.7, 0.3, 0.0]
    assert packing.weights([("a", 10), ("c", 30)], 10, {"a": 0.5}) == [0.5, 0.375, 0.125]
    assert packing.weights([("a", 10), (None, 30)], 0, {}) == [0.25, 0.75]
    random_ = random.Random(1)
    sources = ["small", None, *(f"s{i}" for i in range(8))]
    rows = [(i, "word " * random_.randint(5, 60), sources[i % 10] if i % 3 else "big") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(df, PATH, window=512, portion=16, queues=4, shares={"small": 0.25, None: 0.125})
    got = got.selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset", "queue").collect()
    checked(got, [(r[0], r[1]) for r in rows], Tokenizer.from_file(PATH), 512)
    of = {r[0]: r[2] for r in rows}
    total = sum(r.length for r in got if of[r.doc_id] == "small")
    sent, at = 0, 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        at += r.length
        sent += r.length * (of[r.doc_id] == "small")
        if sent == total:
            break
        assert abs(sent - 0.25 * at) <= 512 * 0.25 + 2 * 16  # a round sends a queue's part of a window at once
    assert {r.queue for r in got if of[r.doc_id] == "small"}.isdisjoint({r.queue for r in got if of[r.doc_id] != "small"})
