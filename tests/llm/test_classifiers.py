import random
import zlib

import numpy as np
import pytest

from tessera.llm import quality, toxicity

BAD = ["scumbag", "moronic", "idiocy"]


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    say = lambda n: [f"{rng.choice('bcdfglm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice(['', 'le', 'on', 'ing'])}" for _ in range(n)]
    rows = []
    for i in range(400):
        ws, toxic, good = say(rng.randint(5, 150)), rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(1 + len(ws) // 40):
                ws.insert(rng.randrange(len(ws)), rng.choice(BAD))
        text = " ".join(ws) + "." if good else rng.choice(["!! ".join(ws).upper(), " ".join(ws[:3] * 20 + [w for w in ws if w in BAD]), "### ".join(ws)])
        rows.append((i, text, int(good), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t, _, _ in rows] + [(1000, None, "x", 9), (1001, "", "x", 9), (3, "", "x", 9)], "doc_id long, text string, label string, score int")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(0, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize(("module", "column", "threshold"), [(toxicity, 3, 0.7), (quality, 2, 0.5)])
def test_held_out(spark, corpus, module, column, threshold):
    docs, labels = tables(spark, corpus)
    got = module.scored(docs, labels).collect()
    assert len(got) == len(corpus) + 3
    truth = {r[0]: r[column] for r in corpus}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert auc(np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])) > 0.93
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    flipped = flipped.withColumn("quality", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("quality")).otherwise(toxicity.F.col("quality")))
    again = {(r.doc_id, round(r.score, 9)) for r in module.scored(docs, flipped).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_rows(spark, corpus, module):
    docs, labels = tables(spark, corpus[:6])
    assert module.scored(docs.limit(0), labels).count() == 0
    assert module.scored(docs, labels.limit(0)).count() == 9


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.ones(5))
    assert np.allclose(y, [0.1, 1.1 / 3, 0.9]) and np.allclose(x, [0, 2, 4])


def plain_toxicity(m, text):
    """The network in plain loops: embeddings, each filter at each place, the maximum, the logit, the calibration."""
    n = toxicity.Numbers()
    ids = n.of(text)
    embedded = [m.word[n.word[i]] + m.start[n.start[i]] for i in ids]
    logit, column = m.base, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            j, best = k * toxicity.FILTERS + f, 0.0
            for at in range(len(embedded) - width + 1):
                z = m.bias[j] + sum(float(embedded[at + o] @ m.taps[:, column + o * toxicity.FILTERS + f]) for o in range(width))
                best = max(best, z)
            logit += best * m.out[j]
        column += width * toxicity.FILTERS
    spoken = [n.language[i] for i in ids if n.language[i]]
    by = max(sorted(set(spoken)), key=spoken.count) if spoken else 0
    a, b = m.scale.get(by) or m.scale[-1]
    return 1 / (1 + np.exp(-(a * logit + b)))


def test_toxicity_against_plain_loops(spark, corpus, monkeypatch):
    docs, labels = tables(spark, corpus)
    kept, real = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: kept.append(real(*a)) or kept[0])
    got = toxicity.scored(docs, labels).collect()
    texts = {r[0]: r[1] for r in corpus} | {1000: None, 1001: ""}
    for r in got[:60] + [x for x in got if x.doc_id >= 1000]:
        if r.doc_id != 3:
            assert abs(r.score - plain_toxicity(kept[0], texts[r.doc_id])) < 1e-4


def test_sample_is_bounded(spark, corpus):
    docs, labels = tables(spark, corpus)
    again = docs.unionByName(docs.where("doc_id < 200").withColumn("text", toxicity.F.repeat("text", 3)))
    texts, marks = toxicity.sampled(again, labels, "toxic", most=30)
    assert len(texts) == len(marks) == 60 and sum(marks) == 30
    few, _ = toxicity.sampled(again, labels, "toxic", most=30, size=3000)
    assert 0 < len(few) < 60 and few == texts[: len(few)] and sum(len(t or "") for t in few) <= 3000


def test_quality_against_plain_sums(spark, corpus):
    """Features, normal equations, ridge, bins and isotonic fit over all learnable rows at once."""
    docs, labels = tables(spark, corpus)
    truth = {r[0]: r[2] for r in corpus}
    rows = [(i, t) for i, t, *_ in corpus] + [(1000, None), (1001, ""), (3, "")]
    learn = [(quality.statistics(t), truth[i]) for i, t in rows if i in truth and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([a for a, _ in learn]), np.array([b for _, b in learn], float)
    f = quality.Fourier(x.mean(0), x.std(0))
    z = f.of(x)
    w = np.linalg.solve(z.T @ z + quality.RIDGE * np.diag([*[1.0] * (z.shape[1] - 1), 1e-6]), z.T @ y)
    at = z @ w
    bins = np.clip((at + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    own = sorted(set(bins.tolist()))
    c, v = quality.isotonic(np.array([at[bins == b].mean() for b in own]), np.array([y[bins == b].mean() for b in own]), np.array([float((bins == b).sum()) for b in own]))
    want = {}
    for i, t in rows:
        s = f.of(np.array([quality.statistics(t)])) @ w
        want.setdefault(i, []).append(float(0.98 * np.interp(s, c, v)[0] + 0.02 / (1 + np.exp(-np.clip(4 * s - 2, -50, 50)))[0]))
    for r in quality.scored(docs, labels).collect():
        assert any(abs(r.score - s) < 2e-3 for s in want[r.doc_id])


@pytest.mark.parametrize("module", [toxicity, quality])
def test_very_long_text(spark, corpus, module):
    docs, labels = tables(spark, corpus[:80])
    more = docs.unionByName(spark.createDataFrame([(7000, "word and " * 200_000, "x", 1), (7001, "y" * 1_000_000, "x", 1)], docs.schema))
    got = {r.doc_id: r.score for r in module.scored(more, labels).collect()}
    assert 0 <= got[7000] <= 1 and 0 <= got[7001] <= 1
