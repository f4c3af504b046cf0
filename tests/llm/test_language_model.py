import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(rows):
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    return {(i, x): (zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), n, sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for i, x in rows}


@pytest.fixture(scope="module")
def documents():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return [*zip(t["doc_id"], t["text"], strict=True), (9001, None), (9002, ""), (9003, "Á\xa0B c\x1fD\x0be"), (9003, "again"), (9003, "again")]


@pytest.mark.parametrize("head", [40])
def test_base_and_gain(spark, documents, head):
    want = base(documents)
    df = spark.createDataFrame([(i, x, "n") for i, x in documents], "doc_id long, text string, word string")
    got = lm.scores(df, head=head).collect()
    assert len(got) == len(documents)
    left = Counter((i, *want[i, x][:4]) for i, x in documents)
    for r in got:
        key = (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)
        assert left[key] > 0
        left[key] -= 1
        assert any(abs(r.base_score - want[i, x][4]) < 1e-6 for i, x in documents if i == r.doc_id)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_scores(rows, model, end):
    """The model's definition, word by word: classes, hashed features and softmax in plain loops over the trained weights."""
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    raw = {t: b"" if t is None else t.encode() for t in train}
    order = sorted(train, key=lambda t: (-train[t], raw[t]))
    placed = list(dict.fromkeys([b"", *(raw[t] for t in order)]))[: lm.HEAD_WORDS]
    lex = lm.Lexicon.of(placed)
    others, kinds = Counter(), Counter()
    for t, c in train.items():
        if raw[t] not in lex.place:
            others[lex.of_class(raw[t])] += c
            kinds[lex.of_class(raw[t])] += 1
    m = lambda x: int(lm._mixed(np.array([x & 0xFFFFFFFF], np.uint32))[0])
    out = {}
    for i, x in rows:
        total, before, skipped = 0.0, end, end
        for t in tokens(x):
            word = b"" if t is None else t.encode()
            code = lex.code(word)
            k = code // lm.PLACES if code < lm.HEAD_WORDS else lex.of_class(word)
            place = code % lm.PLACES + 1 if code < lm.HEAD_WORDS else 0
            one, two = m(before), m(skipped ^ 0x5BD1E995)
            g, (own_g, own_k) = k // lm.SIDE, (lm.ROWS[1][0] // lm.SIDE, lm.ROWS[2][0] // lm.CLASSES)
            hashes = [[one, two, m(one + two * 3)], [g * own_g + m(one ^ (g * int(lm._K)) & 0xFFFFFFFF) % own_g], [k * own_k + m(one ^ (k * int(lm._K)) & 0xFFFFFFFF) % own_k]]
            priors = [model.priors[0][0], model.priors[1][k // lm.SIDE], model.priors[2][k]]
            for s, outcome in enumerate((k // lm.SIDE, k % lm.SIDE, place)):
                z = priors[s].astype(float) + sum(model.tables[s][j][h % lm.ROWS[s][j]].astype(float) for j, h in enumerate(hashes[s]))
                p = np.exp(z - z.max())
                total += math.log10(p[outcome] / p.sum())
            if not place:
                total += math.log10(train[t] + 0.1) - math.log10(others[k] + 0.1 * (kinds[k] + 1))
            before, skipped = code, before
        out[i, x] = total
    return out


def test_score_against_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{min(int(z), 400)}" for z in rng.zipf(1.3, rng.integers(0, 90)))) for i in range(120)]
    kept, small = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.append((small(*a, **k), a[2])) or kept[0][0])
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    model, end = kept[0]
    want = plain_scores(rows, model, end)
    assert max(np.abs(t).max() for tables in model.tables for t in tables) > 0.01
    for r in got:
        assert any(abs(r.score - want[i, x]) < 1e-3 + 1e-5 * r.n_tokens for i, x in rows if i == r.doc_id)


def test_every_context_has_a_distribution():
    """The places of a class and its other words: shares of all known words and one unknown sum to 1 after any two words."""
    rng = np.random.default_rng(0)
    words = [f"{chr(97 + i % 26)}{i}".encode() for i in range(3000)]
    lex = lm.Lexicon.of([b"", *words[:2000]])
    places, others = np.zeros((lm.CLASSES, lm.PLACES)), np.zeros(lm.CLASSES)
    for at in lex.place.values():
        places[at // lm.PLACES, at % lm.PLACES] = rng.integers(1, 50)
    for w in words[2000:]:
        others[lex.of_class(w)] += 2
    weights = lm.Weights(lm.priors(places, others))
    for tables in weights.tables:
        for t in tables:
            t += rng.normal(0, 0.5, t.shape).astype(np.float32)
    every = np.array([lex.code(w) for w in [b"", *words[:2000]]] + [lm.HEAD_WORDS + k for k in range(lm.CLASSES)], np.int32)
    for before, skipped in ((every[0], every[5]), (every[-1], every[900])):
        codes = np.concatenate([[skipped, before, c] for c in every]).astype(np.int32)
        x = lm.features(codes, np.arange(0, len(codes), 3), int(every[0]))
        assert abs((10 ** weights.log10(x)[2::3]).sum() - 1) < 1e-4


def test_words_before_count(spark):
    """Texts with the same words in another order are told apart, and longest words and texts pass."""
    rows = [(i, "the cat sat on the mat while the dog ran to the door " * 4) for i in range(400)]
    rows += [(1000, "cat the on sat mat the while dog the to ran door the " * 4), (1001, "x" * 100_000), (1002, "the cat " * 100_000)]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].score > got[1000].score + 10 and abs(got[1].base_score - got[1000].base_score) < 1e-6
    assert got[1002].n_tokens == 200_001 and all(math.isfinite(r.score) for r in got.values())


def test_empty_and_all_held_out(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = lm.scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0)] * 2 and all(math.isfinite(r.score) for r in rows)


def test_tokens_come_without_an_object_for_each_word():
    """Different words of many texts are told at once, by the rule of words; a null or blank text is its end alone."""
    import pyarrow as pa

    from tessera.llm.text import words

    texts = [None, "", " ", "\r\n", " \t\x0b lead  trail\n", "\x1c\x1fÁ\xa0B É x\x85y \x0c Z", "a\x00b A", "a a b"]
    got = []
    for known, index, ends in lm._tokens(pa.array(texts)):
        all_of = known.take(pa.array(index)).to_pylist()
        got += [all_of[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    assert got == [[*words(x), lm.END] for x in texts]
    assert list(lm._tokens(pa.array([], pa.string()))) == []


def test_partial_counts_are_those_of_words(spark, monkeypatch):
    from tessera.llm.text import words

    rows = [(i, f" W{i % 7} x{i} \t y\n" if i % 5 else None) for i in range(300)]
    want = Counter(w for i, x in rows if zlib.crc32(str(i).encode()) % 10 for w in [*words(x), lm.END])
    got = Counter()
    for r in lm.counted(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[bytes(r.word)] += r.n
    assert got == want
