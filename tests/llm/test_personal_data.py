import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import personal_data as pd_

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                k == 0
                or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                or k == 2 and 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
                or k == 3 and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.25@+-() %é", max_size=40) | st.lists(st.sampled_from(["4753376719988201", "a.b@c.d", "+1 (724) 555-7058", "10.2.3.255", "..", " ", "@", "9"]), max_size=6).map("".join))
def test_base_spans(text):
    assert pd_.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    assert pd_.base_spans("1" * 200_000 + "@" + "a" * 200_000 + "@" * 50_000) == []


DOCS = [(i, f"call +1 (724) 555-{7000 + i} or {70 + i}.1.2.3 and a{i}@m.com with 4753376719988201 now 12 of {i}.") for i in range(40)]
DOCS += [(100, "x +1 (269) 555-3296 4524132264652876 end"), (101, None), (102, ""), (103, "version 1.2. or 7"), (103, "a@b.c"), (None, "a@b.c")]


def test_field_adds_what_patterns_miss(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in DOCS], "doc_id long, text string, spans int")
    found = pd_.spans(df)
    rows = {(r.doc_id, len(r.spans)): r.spans for r in found.collect()}
    text = dict(DOCS)[100]
    assert [(s.kind, text[s.start : s.end], s.base) for s in rows[100, 2]] == [("phone", "+1 (269) 555-3296", False), ("card", "4524132264652876", False)]
    assert all(s.base for (i, _), v in rows.items() if i != 100 for s in v)
    digest = pd_.digest(found).collect()
    assert len(digest) == len(DOCS)
    for r in digest:
        options = [brute(t or "") for i, t in DOCS if i == r.doc_id]
        told = [",".join(f"{pd_.KINDS[k]}:{s}:{e}" for s, k, e in o) for o in options]
        assert r.base_sha256 in [hashlib.sha256(t.encode()).hexdigest() for t in told]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) in [tuple(sum(k == x for _, k, _ in o) for x in range(4)) for o in options]


def test_redacted(spark):
    df = spark.createDataFrame([(1, "mail a@b.c, or 10.0.0.1", 23), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert sorted(tuple(r) for r in pd_.redacted(df).collect())[0] == (1, "mail <email>, or <ip>", 21)
    assert pd_.redacted(df).count() == 3 and pd_.spans(df.limit(0)).count() == 0


def test_repeated_mentions_agree():
    counts = sum((c for c in [_counts(t) for _, t in DOCS if t]))
    field = pd_.Field(counts)
    text = "see k9@m.com and k9@localhost"
    assert pd_.KINDS[field.added(text, pd_.Graph(text, pd_.base_spans(text)))[0][1]] == "email"


def _counts(text):
    import numpy as np

    n = np.zeros(pd_.CELLS)
    for t in (text, f"{text} again {text}"):
        pd_.Graph(t, pd_.base_spans(t)).counts(n)
    return n


def exact(field, g):
    """Label probabilities by summing over all labellings of tokens and hidden nodes."""
    import itertools

    import numpy as np

    n, total = len(g.tokens) + g.hidden, 0.0
    out = np.zeros((n, pd_.LABELS))
    for labels in itertools.product(range(pd_.LABELS), repeat=n):
        if any(o and labels[i] != o for i, o in enumerate(g.observed)):
            continue
        log = sum(field.shape[g.shapes[i], labels[i]] for i in range(len(g.tokens)) if not g.observed[i])
        log += sum(field.chain[labels[i], labels[j]] for i, j in g.chain) + sum(field.skip[labels[i], labels[j]] for i, j in g.mentions)
        p = np.exp(log)
        total += p
        for i, x in enumerate(labels):
            out[i, x] += p
    return out / total


def test_marginals_are_exact_on_trees_and_near_on_loops():
    import numpy as np

    field = pd_.Field(sum(_counts(t) for _, t in DOCS if t))
    for text, most in (("a1 b2 c3", 1e-3), ("see k9@m.com or k9@localhost. then k9@there", 1e-3), ("x 7245557001 y +1 724-555-7001 1724", 1e-3), ("b7 k9@there b8 then k9@where b9", 0.05)):
        g = pd_.Graph(text, pd_.base_spans(text))
        assert np.abs(field.marginals(g) - exact(field, g)).max() < most
    g = pd_.Graph("k9@m.com " + "then k9@there " * 300, pd_.base_spans("k9@m.com " + "then k9@there " * 300))
    p = field.marginals(g)[: len(g.tokens), 1]
    assert abs(p[-1] - p[1:-1]).max() < 1e-3  # the last mention hears of the first as the second does


def test_one_long_document():
    import time
    import tracemalloc

    field = pd_.Field(sum(_counts(t) for _, t in DOCS if t))
    text = " ".join(f"{i} 724555{i % 500:04d}" for i in range(100_000))
    tracemalloc.start()
    began = time.time()
    field.added(text, pd_.Graph(text, []))
    assert time.time() - began < 120 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_long_words_take_linear_time():
    import time

    for text in ("1 " + "漢" * 1_000_000, "漢" * 1_000_000 + "1", "a@" * 300_000, "1-" * 500_000, "+1(" * 300_000, "1." * 400_000):
        began = time.time()
        pd_.Graph(text, pd_.base_spans(text))
        assert time.time() - began < 4, text[:8]


def test_tokens_are_words_with_a_digit_or_at():
    text = "ab c1d\u3000@x yz 12 q\n5,"
    graph = pd_.Graph(text, [])
    assert [text[a:b] for a, b in graph.tokens] == ["c1d", "@x", "12", "5"]


def test_shapes_are_whole():
    assert pd_._shape("-" * 90 + "1") != pd_._shape("-" * 91 + "1")
