import random

from tessera.llm import language_id as li

WORDS = {"en": "the of and was with house water green".split(), "fr": "le la des être avec maison verte été".split(), "de": "der die und über mit haus grün größe".split()}


def test_fusion(spark):
    rng = random.Random(0)
    say = lambda x, n=30: " ".join(rng.choice(WORDS[x]) for _ in range(n))
    rows = [(i, say(x), x, None, f"{x}.site.example") for i, x in enumerate(["en", "fr", "de"] * 40)]
    rows += [(200, say("fr"), "en", None, "fr.site.example"), (201, None, "en", None, None), (202, "", "de", "de", "x"), (203, "12 --", "en", None, None), (204, say("de"), None, None, None)]
    rows += [(205, "zzz", None, None, "fr.site.example"), (206, say("en", 3000), "en", "en", None), (206, say("en"), "en", "en", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, declared string, suffix string, host string, posterior int")
    got = {r.id: r for r in li.identified(df).collect()}
    assert li.identified(df).count() == len(rows)
    assert all(got[i].language == x and got[i].accepted for i, x in enumerate(["en", "fr", "de"] * 40))
    assert got[200].language == "fr" and got[204].language == "de" and got[205].language == "fr" and got[206].language == "en"
    assert [got[i].accepted for i in (201, 202, 203)] == [False] * 3
    assert li.identified(df.limit(0)).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = li.identified(li.of_documents(docs)).join(docs, li.F.col("id") == docs.doc_id).collect()
    assert len(got) == docs.count() and sum(r.accepted for r in got) >= 0.98 * len(got) and sum(r.language == r.lang for r in got) >= 0.95 * len(got)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert li.identified(li.of_pages(pages)).where("accepted").count() >= 0.95 * pages.count()
    assert li.identified_rows(docs).columns == docs.columns


def test_each_page_by_its_own_text(spark):
    page = lambda x: f"<html lang={x}><body><p>{' '.join(WORDS[x] * 5)}</p></body></html>"
    rows = [(i, f"http://a.example/{i}", page(x)) for i, x in enumerate(["en", "fr", "de"] * 10)]
    rows += [(7, "http://a.example/again", page("fr"))] * 2 + [(7, "http://a.example/again", page("de")), (None, "http://a.example/n", page("de")), (None, None, None)]
    got = li.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and sum(r.id is None for r in got) == 2
    assert all(r.text == " ".join(WORDS[r.declared] * 5) for r in got if r.declared)


def test_every_language_regions_and_none(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = lambda n: ["".join(rng.choice(letters) for _ in range(9)) for _ in range(n)]
    own = {f"{a}{b}": junk(20) for a in "uvwxy" for b in "abcdefgh"}  # 40 languages
    rows = []
    for k, (x, words) in enumerate(own.items()):
        for j in range(4 if k else 60):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(40)), [x, f"{x}-us", f"{x.upper()}_GB", x][j % 4]))
    n = len(rows)
    rows += [(n + i, " ".join(junk(60)), None) for i in range(10)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id long, text string, declared string, suffix string, host string")
    got = {r.id: r for r in li.identified(df).collect()}
    assert all(got[i].language == rows[i][2][:2].lower() and got[i].accepted for i in range(n))
    assert not any(got[n + i].accepted for i in range(10))


def test_posterior_against_plain_sums(spark):
    """All evidence by hand: bucket counts, tempered likelihoods, smoothed priors of host, parent, declaration and suffix."""
    import math
    import re
    import zlib
    from collections import Counter

    rng = random.Random(5)
    say = lambda x: " ".join(rng.choice(WORDS[x]) for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(90):
        x = rng.choice(["en", "fr", "de"])
        rows.append((i, say(x), rng.choice([x, x, None, "en"]), rng.choice([x, None, "com"]), rng.choice([f"{x}.a.example", "b.example", None, "solo"])))
    rows += [(100, "12 13", "en", None, None), (101, None, None, "fr", "b.example")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {r.id: r for r in li.identified(df).collect()}

    def buckets(t):
        ws = [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode()) if any(c > 96 for c in w)]
        return [zlib.crc32(w) % li.BUCKETS for w in ws] + [zlib.crc32(w[-3:], 1) % li.BUCKETS for w in ws]

    langs = [x for x, _ in sorted(Counter(r[2] for r in rows if r[2]).items(), key=lambda p: (-p[1], p[0]))]
    n = {x: Counter(b for r in rows if r[2] == x for b in buckets(r[1])) for x in langs}
    whole = sum(n.values(), Counter())
    common = lambda b: (whole[b] + 0.1) / (whole.total() + 0.1 * li.BUCKETS)
    like = lambda x, b: math.log((n[x][b] + 200 * common(b)) / (n[x].total() + 200))
    said = {r[0]: {x: sum(like(x, b) for b in buckets(r[1])) / li.TEMPER for x in langs} for r in rows if buckets(r[1])}
    text = {i: max(langs, key=v.get) for i, v in said.items()}
    seen, parent = Counter(text.values()), lambda h: None if h is None else ".".join(h.split(".")[-2:]) if "." in h else ""
    prior = {x: (seen[x] + 1) / (len(text) + len(langs)) for x in langs}

    def share(column, value, to):
        own = Counter(text[r[0]] for r in rows if r[0] in text and value is not None and column(r) == value)
        return {x: (own[x] + li.STRENGTH * to[x]) / (own.total() + li.STRENGTH) for x in langs}

    for r in rows:
        if r[0] not in said:
            assert got[r[0]].text_language is None and not got[r[0]].accepted
            continue
        of_parent = share(lambda q: parent(q[4]), parent(r[4]), prior)
        of_host = share(lambda q: q[4], r[4], of_parent)
        logs = {x: math.log(of_host[x]) + said[r[0]][x] for x in langs}
        for k in (2, 3):
            if r[k] is not None:
                given = share(lambda q, k=k: q[k], r[k], prior)
                logs = {x: v + math.log(given[x] / prior[x]) for x, v in logs.items()}
        none = math.log(li.NONE) - len(buckets(r[1])) * math.log(li.BUCKETS) / li.TEMPER
        best = max(langs, key=logs.get)
        posterior = 1 / (sum(math.exp(v - logs[best]) for v in logs.values()) + math.exp(none - logs[best]))
        assert got[r[0]].language == best and abs(got[r[0]].posterior - posterior) < 1e-4, (r, got[r[0]], best, posterior)


def test_rows_keep_their_own_fate(spark):
    say = lambda x: " ".join(WORDS[x] * 6)
    rows = [(1, say("en"), "en", "s", 1), (1, "12 34", "en", "s", 2), (None, say("fr"), "fr", "s", 3), (None, None, "fr", None, 4), (2, say("de") * 3000, "de", "t", 5), (2, "", None, None, 6), (3, say("de"), "de", "t", 7), (3, say("de"), "de", "t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int")
    assert sorted(r.id for r in li.identified_rows(df).collect()) == [1, 3, 5, 7, 7] and li.identified_rows(df).columns == df.columns
    assert li.identified_rows(df.limit(0)).count() == 0


def test_pages_travel_in_bounded_batches(spark):
    """However many rows a batch could have, a worker gets some megabytes at once and holds few texts as strings."""
    import pyarrow as pa

    from tessera.llm import text

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        page = spark.createDataFrame([(1, "http://a.b/en/x", "<p>" + " ".join(WORDS["en"] * 6) + "</p>")], "page_id long, url string, html string")
        assert li.identified(li.of_pages(page)).count() == 1 and spark.conf.get(name) == str(text.BATCH_BYTES)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    whole = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["x"])
    cut = list(text.pieces(iter([whole])))
    assert max(b.num_rows for b in cut) == text.PIECE and sum((b.column(0).to_pylist() for b in cut), []) == list(range(1000))
