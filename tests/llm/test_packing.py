import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aA'ésS.,!? \n\t\x85\xa0\x1c1éÀßİΣ<|>", max_size=40))
def test_cached_ids_are_the_tokenizers(text):
    ids = np.frombuffer(packing.token_ids(PATH).of(text), "<u4").tolist()
    assert ids == plain_ids(text)


def plain_ids(text, t=plain()):
    return t.encode(text, add_special_tokens=False).ids


def test_ids_of_whole_documents():
    import pyarrow.parquet as pq

    t = plain()
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        assert np.frombuffer(packing.token_ids(PATH).of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def unfold(table):
    """(length, rank) -> (sequence, offset)."""
    return [(int(w), int(r + i), int(s + i // e), int(o + i % e * w)) for w, r, s, e, o, n in table for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=14))
def test_plan_is_gapless_and_whole(histogram):
    table, sequences = packing.plan(histogram, 30)
    rows = unfold(table)
    assert sorted((w, r) for w, r, _, _ in rows) == sorted((w, r) for w, n in histogram.items() for r in range(n))
    by = {}
    for w, _, s, o in rows:
        by.setdefault(s, []).append((o, w))
    assert sorted(by) == list(range(sequences))
    for parts in by.values():
        at = 0
        for o, w in sorted(parts):
            assert o == at
            at += w
        assert at <= 30


def optimum(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        left = np.bincount(items, minlength=21)
        bins = packing.Bins(20)
        fixed = packing.reduce_by_dominance(left, bins)
        rest = [x for x in range(20, 0, -1) for _ in range(left[x])]
        assert fixed + optimum(rest, 20) == optimum(items, 20), items


def test_pack(spark):
    long = "word " * 9000
    rows = [(1, "a b", 9), (2, None, 9), (3, "", 9), (4, long, 9), (1, "a b", 9), (5, "x" * 3000, 9)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length long"), PATH).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    t = plain()
    want = []
    for doc, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_worker_keeps_few_parts():
    """What a worker remembers between tasks is bounded: its memory counts for the executor that it belongs to."""
    ids = packing.TokenIds(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(300_000):
        ids.of(str(i))
    assert len(ids) + len(ids.old) <= 2 * packing.KEPT <= 262_144
