import corpus_pipeline
import pytest
from tests_llm_brute import brute_components, brute_hits

from tessera.staging import staged


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first = None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = staged(stage(spark, docs, sf), name)
        after = {r.doc_id for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "ngram_jaccard_join":
            assert after == {c for _, c in brute_components(before)}
        if name == "benchmark_decontamination":
            assert after == {i for i, t in before if not brute_hits(t, items)}
        if name in ("personal_data", "best_fit_packing"):
            assert after == {i for i, _ in before}
        first = first or before
    total = docs.groupBy("sequence_id").sum("length").collect()
    assert len(total) <= 1.01 * sum(r[1] for r in total) / 4096 + 1


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids and texts, repeated ids and rows, empty and very long texts, benchmark passages under a null id, more columns."""
    folder = tmp_path_factory.mktemp("odd")
    say = lambda n, k: " ".join(f"the {w} of" for w in [f"{'abcdefgh'[(i * k) % 8]}{'xyz'[i % 3]}orld" for i in range(n)])
    leak = "never before had such a thing been seen by any of them at all"
    rows = [(1, say(30, 1)), (1, say(40, 3)), (2, say(30, 1) + " the end"), (None, say(30, 1).upper()), (None, f"{say(9, 5)} {leak} {say(5, 7)}"), (3, say(20_000, 5)), (4, None), (None, None), (5, ""), (6, say(25, 7)), (6, say(25, 7)), (7, f"the mail of the house is a@b.c, {say(12, 3)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, label int, row string")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, odd), name)
        counts.append(sorted((r.doc_id or 0) for r in docs.collect()))
    # language: wordless rows go; join: one of {1, 2, null} and of the repeated row; benchmark: the row with the passage
    assert counts[0] == [0, 0, 1, 1, 2, 3, 6, 6, 7] and counts[1] == [0, 1, 1, 3, 6, 7]
    assert counts[2] == [1, 1, 3, 6, 7] and counts[3] == counts[2] and sorted(set(counts[4])) == [1, 3, 6, 7]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_empty_table(spark, odd, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    got = stage(spark, docs, odd)
    assert got.count() == 0 and (name == "best_fit_packing" or got.columns == docs.columns)


def test_texts_are_read_in_small_batches(spark):
    """The Parquet reader's rows at once are bounded too, where the session sets no bound of its own."""
    from tessera.llm import text

    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        text.bounded(spark)
        assert spark.conf.get(name) == str(text.READ_ROWS) and text.READ_ROWS <= 1024
        spark.conf.set(name, "77")
        text.bounded(spark)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
