import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import conversations

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired) by all edits of ``rows`` (role, text, fault), one at a time; states are the initials so far."""
    best = {"": (0, "", ())}

    def legal(x):
        return re.fullmatch(r"s?(ua)*u?", x) is not None

    def short(x):  # all that matters for what may follow
        return x if len(x) < 2 else x[:1] + "." + x[-1]

    def better(now, key, entry):
        if key not in now or entry[:2] < now[key][:2]:
            now[key] = entry

    def inserted(best):
        out = {}
        for key, entry in best.items():
            todo = [(key, entry)]
            for _ in range(3):
                better(out, *todo[0])
                k, (c, a, t) = todo[0]
                nxt = "u" if not k or k[-1] in "sa" else "a"
                full = (k.replace(".", "") if len(k) < 3 else k[-1]) + nxt
                todo = [(k + nxt if len(k + nxt) < 2 else k[0] + "." + nxt, (c + 3, a + "I", (*t, ("user" if nxt == "u" else "assistant", ""))))] if full else []
        return out

    for role, text, fault in rows:
        now = {}
        for k, (c, a, t) in inserted(best).items():
            better(now, k, (c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            for new, edit, more in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                i = new[:1]
                ok = (not k and i in ("s", "u")) or (k and k[-1] in "sa" and i == "u") or (k and k[-1] == "u" and i == "a")
                if ok:
                    better(now, k + i if len(k + i) < 2 else k[0] + "." + i, (c + more + extra, a + edit, (*t, (new, text))))
        best = now
    ends = [e for k, e in inserted(best).items() if not k or k[-1] == "a"]
    return min(ends, key=lambda e: e[:2])


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        convs[conv] += [(turn is not None, turn or 0, role, text)] * (2 if way == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort()
        faults, seen = [], set()
        for _, _, role, text in own:
            letters = BLANK.findall(text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest([(r, t, f) for (_, _, r, t), f in zip(own, faults, strict=True)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def made(n, longest):
    rng = random.Random(5)
    texts = ["Yes.", "What?", "no end", " \t\n", "", "Fine!  ", "a. b", None, "é. ", "x" * 40]
    rows = []
    for conv in [*range(n), None]:
        turns = [None, None, *range(longest)] if conv == 3 else range(rng.randint(1, longest))
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "urn"]), rng.choice(texts)) for t in turns if rng.random() < 0.9]
    rows += [(500, t, "user", "Same.") for t in range(90)] + [(501, 1, "user", "Same.")] * 30 + [(502, t, "ua"[t % 2], f"{t}.") for t in range(200)] + [(503, None, "user", "a")] * 4
    return rows


@pytest.mark.parametrize("parts", [None, 200, 3000])
def test_against_brute_force(spark, monkeypatch, parts):
    if parts:  # conversations over several parts
        monkeypatch.setattr(conversations, "PART_BYTES", parts)
        monkeypatch.setattr(conversations, "BATCH", 3)
    rows = made(40, 9)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn int, role string, text string, n string, first int")
    got = sorted((tuple(r) for r in conversations.audited(conversations.damaged(df)).collect()), key=str)
    assert got == brute(rows)


def test_equals_sql(spark):
    import duckdb

    from tessera.llm import queries

    rows = [r for r in made(12, 8) if r[0] is not None and r[0] < 500]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int32"}))
    theirs = con.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.oracle_sql()['op12_conversation_repair']})").fetchall()
    assert sorted(tuple(r) for r in conversations.audited(conversations.damaged(df)).collect()) == sorted(theirs)


def test_rows_of_the_repaired_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PART_BYTES", 150)
    rows = [("a", 1, "system", "S."), ("a", 2, "user", "U."), ("a", 3, "user", "V."), ("b", 1, "assistant", "Hello."), ("b", 2, "assistant", "Hello."), ("c", 1, "user", " ")]
    got = conversations.repaired(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).orderBy("conv_id", "part", "seq").collect()
    assert [tuple(r)[:1] + tuple(r)[3:] for r in got] == [
        ("a", "K", "system", "S."), ("a", "K", "user", "U."), ("a", "R", "assistant", "V."),
        ("b", "I", "user", ""), ("b", "K", "assistant", "Hello."), ("b", "D", None, None), ("c", "D", None, None),
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert conversations.audited(conversations.damaged(df)).count() == 0 and conversations.repaired(df).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaoSUAOx"), st.integers(1, 9)), max_size=6))
def test_runs_against_single_rows(runs):
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    rows = [("user" if s == "x" else roles[s.lower()], "t", "blank" if s == "x" else "truncated" if s.isupper() else "") for s, n in runs for _ in range(n)]
    rest = conversations.rests(runs, conversations._ENDS)
    edits, state = conversations.unrolled(runs, rest, 0)
    audit = "".join(edits) + conversations._FINISH[state]
    assert (rest[0][0], audit) == cheapest(rows)[:2]


def test_long_runs():
    """A million equal rows: some twenty products of cached powers, and 2**14 is the greatest that is cached."""
    n = 1_000_003
    for symbol, edit in (("u", "KR"), ("x", "D")):
        runs = [(symbol, n)]
        rest = conversations.rests(runs, conversations._ENDS)
        (edits,), state = conversations.unrolled(runs, rest, 0)
        assert rest[0][0] == (4 * n if symbol == "x" else 3 * (n // 2) + 3) and set(edits) <= set(edit + "I")


def test_all_edits_of_short_rows():
    """The reference itself against all strings of edits."""
    for symbols in product("suoU", repeat=2):
        roles = {"s": "system", "u": "user", "o": "tool"}
        rows = [(roles[s.lower()], "t", "truncated" if s.isupper() else "") for s in symbols]
        best = None
        for n in range(2, 7):
            for edits in product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) != 2:
                    continue
                for guess in product("ua", repeat=sum(e in "IR" for e in edits)):
                    i, g, cost, out = 0, iter(guess), 0, ""
                    for e in edits:
                        if e == "I":
                            out, cost = out + next(g), cost + 3
                            continue
                        role, _, fault = rows[i]
                        i += 1
                        out += {"D": "", "K": role[0]}[e] if e != "R" else next(g)
                        cost += {"D": 4, "K": 0, "R": 3}[e] + (3 if fault and e != "D" else 0)
                    if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, "".join(edits)) < best):
                        best = (cost, "".join(edits))
        assert best == cheapest(rows)[:2]
