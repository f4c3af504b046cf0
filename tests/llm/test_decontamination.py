import hashlib
import random
import re

from tessera.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, size=10):
    ws = [(i, WORD.findall(lower(t))) for i, t in items]
    wins = [(i, tuple(w[k : k + s])) for i, w in ws if w for s in [min(size, len(w))] for k in range(len(w) - s + 1)]
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, ids = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= {str(i)} if i is not None else set()
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["É\xa0t", "ÉT", "Ab3"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", ", -", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(3, None), (5, "w1 w2 w3 w4 w5"), (None, text(12))]
    docs = [(i, text(rng.choice([0, 3, 30, 200])) + " " + (rng.choice(items)[1] or "") + " " + text(4)) for i in range(60)] + [(1, None), (2, ""), (7, "..."), (8, "w1"), (8, "w1")]
    cols = "doc_id long, text string, size int, item_id int"
    got = decontamination.contamination(spark.createDataFrame([(*d, 1, 2) for d in docs], cols), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)
    assert any(r[3] > 1 for r in brute(docs, items))


def test_filter_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "x"), (None, "d e", "y")], "doc_id long, text string, bad string")
    items = spark.createDataFrame([(1, "A b")], "item_id long, text string")
    assert sorted(map(str, (r.doc_id for r in decontamination.decontaminated(docs, items).collect()))) == ["2", "None"]
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    """Null ids, an id with a clean and a hit text, a window in very many items, and a long text."""
    rows = [(None, "a b c", "x"), (1, "a b c", "x"), (1, "clean words", "x"), (None, "clean too", "y"), (2, "z " * 50_000 + "A, b", "y"), (3, None, "z"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    items = spark.createDataFrame([(i, "a b") for i in range(500)], "item_id long, text string")
    left = decontamination.decontaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "clean too"), (1, "clean words"), (3, ""), (3, "")]
    assert {r.n_items for r in decontamination.contamination(docs, items).where("contaminated").collect()} == {500}
