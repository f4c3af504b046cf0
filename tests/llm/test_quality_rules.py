import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality_rules

SF = "/root/testdata/sf0.1"


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    return [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|<漢\x85\x1c  ", max_size=60)))
def test_counts_against_brute_force(text):
    assert quality_rules.counted(text)[:5] == (brute(text) if text else [0] * 5) or not brute(text)[0]


def test_symbols_need_no_words():
    assert quality_rules.counted("  \n")[:5] == [0] * 5 and brute("  \n") == [0] * 5


def test_long_text():
    text = "漢" * 1_000_000 + " " + "a b c " * 200_000
    assert quality_rules.counted(text)[:5] == brute(text)


def test_covering_finds_planted_conjunctions():
    rng = np.random.default_rng(1)
    x = {k: rng.uniform(size=6000) for k in "abcd"}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.3)) | (x["c"] > 0.95)
    rules = quality_rules.covered(x, bad, rng.uniform(size=6000) < 2 / 3)
    told = np.logical_or.reduce([r.of(x) for r in rules])
    assert 2 <= len(rules) <= 8 and (told == bad).mean() > 0.97 and bad[told].mean() > 0.9


def test_covering_of_noise_finds_little():
    rng = np.random.default_rng(2)
    x = {k: rng.uniform(size=3000) for k in "abc"}
    assert quality_rules.covered(x, rng.uniform(size=3000) < 0.1, rng.uniform(size=3000) < 0.6) == []


def test_expression_equals_rules(spark):
    c = quality_rules.Condition
    rules = [quality_rules.Rule((c("words", True, 3.5), c("upper", False, 0.25))), quality_rules.Rule((c("digits", True, 0.1),))]
    rng = np.random.default_rng(3)
    x = {"words": rng.integers(0, 8, 300).astype(float), "upper": rng.choice([0, 0.25, 0.5], 300), "digits": rng.choice([0, 0.1, 0.2], 300)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], list(x))
    want = np.where(rules[0].of(x), 1, np.where(rules[1].of(x), 2, 0)).tolist()
    assert [r.at for r in df.select(quality_rules.decided(rules).alias("at")).collect()] == want


def test_query_on_whole_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judged(docs, labels).toPandas()
    texts = docs.select("doc_id", "text").toPandas()
    assert len(got) == len(texts)
    told = got.sort_values("doc_id").merge(texts, on="doc_id")
    for row in told.itertuples():
        own = brute(row.text)
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == own
        assert (row.rule is None) == (row.kept or row.base_failed)
        assert row.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (row.kept and row.base_failed)
    held = told.merge(labels.toPandas()[["doc_id", "quality"]], on="doc_id")
    import zlib

    held = held[[zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    clean = good[~good.base_failed]
    assert clean.kept.mean() > 0.97 and (~bad.kept).mean() > 0.6


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, long), (3, long), (3, long), (4, "a b c " * 30), (5, "# \n#\n#")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, label string, words double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1)] if labelled else [], "doc_id long, quality int")
    got = quality_rules.judged(docs, labels)
    assert sorted(r.kept for r in got.collect()) == [False] * 4 + [True] * 3
    assert {r.doc_id: r.n_dup_lines for r in got.collect()}[5] == 1
    assert quality_rules.judged(docs.limit(0), labels).count() == 0
