"""Language identification by Bayesian fusion of evidence.

For each language L: ``log P(text | L) / temper + log P(declared | L) + log P(suffix | L) + log P(L | host)``.
Text likelihoods are hashed counts of words and word endings by declared language over all documents. What a
declaration or an address suffix says of L, and the priors of hosts, come from grouped counts against the language
the text alone shows; a host's prior is smoothed towards that of its parent domain, and that towards all hosts.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import attached
from tessera.llm.rows import keyed, settled
from tessera.llm.text import bounded, pieces, words
from tessera.staging import staged

BUCKETS = 1 << 15
TEMPER, SMOOTH, STRENGTH, ACCEPTED = 4.0, 0.5, 20.0, 0.5
#: Prior of a text in none of the declared languages, all buckets alike, and languages that a task counts at once.
NONE, HELD = 0.01, 64
#: Words, and bytes of them, whose buckets a task remembers before it begins anew: some 25 MB.
MET, MET_BYTES = 1 << 17, 1 << 23


class Features(dict):
    """Running numbers of the words a task has met, with the hash buckets of each word and of its ending."""

    def __init__(self):
        super().__init__()
        self.word, self.ending, self.size = array("i"), array("i"), 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.word)
        lettered = word.isalpha() or any(c > 96 for c in word)
        self.word.append(zlib.crc32(word) % BUCKETS if lettered else -1)
        self.ending.append(zlib.crc32(word[-3:], 1) % BUCKETS)
        self.size += len(word)
        return n

    def of(self, text: str | None) -> np.ndarray:
        """Buckets of the words that hold a letter or anything beyond ASCII."""
        if len(self) > MET or self.size > MET_BYTES:
            self.clear()
            self.__init__()
        ws = words(text)
        at = np.fromiter(map(self.__getitem__, ws), np.int32, len(ws))
        word = np.frombuffer(self.word, np.int32).take(at) if len(at) else at
        own = word >= 0
        return np.concatenate([word[own], np.frombuffer(self.ending, np.int32).take(at[own])]) if own.any() else at[:0]


def likelihoods(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """All declared languages, and log P(bucket | language): BUCKETS numbers for each."""
    named = docs.where("declared is not null and declared <> ''").groupBy("declared").count()
    languages = [r["declared"] for r in named.orderBy(F.desc("count"), "declared").collect()]
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, totals = Features(), {}

        def told() -> Iterator[pa.RecordBatch]:
            for i, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at + i * BUCKETS), pa.array(total[at])], names=["cell", "n"])
            totals.clear()

        for batch in pieces(batches):
            for text, declared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if declared in number:
                    if number[declared] not in totals:
                        if len(totals) == HELD:
                            yield from told()
                        totals[number[declared]] = np.zeros(BUCKETS, np.int64)
                    totals[number[declared]] += np.bincount(features.of(text), minlength=BUCKETS)
        yield from told()

    counts = np.zeros(max(len(languages), 1) * BUCKETS)
    for r in docs.select("text", "declared").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(-1, BUCKETS)
    common = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * BUCKETS)
    return languages, np.log((counts + 200 * common) / (counts.sum(1, keepdims=True) + 200))


def identified(docs: DataFrame, *carried: str) -> DataFrame:
    """(id, language, posterior, text_language, accepted) of each row of ``docs(id, text, declared, suffix, host)``.

    The last three are strings and may be null, which is no evidence. A text without a word with letters, null and
    empty ones included, has null text_language; it is not accepted, nor is one whose best language has a posterior
    under ACCEPTED among all languages and none of them. Region and script tags (en-us) count as their language. With no declared language at all nothing is accepted. One row for each row, repeated ids included.
    An empty table gives no rows. Other columns are not looked at; those named are carried along.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("string").alias(c) for c in ("text", "declared", "suffix", "host")), *carried)
    tag = F.lower(F.trim("declared"))
    docs = docs.withColumn("declared", F.regexp_replace(tag, r"^([a-z]{2,3})[-_].*$", "$1"))
    bounded(docs.sparkSession)
    languages, table = likelihoods(docs)
    known, languages = bool(languages), languages or ["und"]
    shared = docs.sparkSession.sparkContext.broadcast(table.T.astype(np.float32).copy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(), shared.value
        for batch in pieces(batches):
            said, best, none = [], [], []
            for text in batch.column(1).to_pylist():
                at = features.of(text)
                if len(at) and known:
                    logs = rows[at].sum(axis=0, dtype=np.float64) / TEMPER
                    said.append((logs - logs.max()).tolist())
                    none.append(float(-len(at) * np.log(BUCKETS) / TEMPER - logs.max()))
                    best.append(languages[int(logs.argmax())])
                else:
                    said.append(None)
                    none.append(None)
                    best.append(None)
            columns = [batch.column(0), *(batch.column(i) for i in (2, 3, 4)), pa.array(said, pa.list_(pa.float64())), pa.array(best, pa.string()), pa.array(none, pa.float64()), *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "declared", "suffix", "host", "said", "text_language", "none", *carried])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema[5:])
    told = staged(docs.mapInArrow(score, "id long, declared string, suffix string, host string, said array<double>, text_language string, none double" + more), "text-evidence")
    names = F.array(*map(F.lit, languages)).cast("array<string>")
    parent = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -2)).when(F.col("host").isNotNull(), F.lit(""))
    seen = told.where("text_language is not null").withColumn("parent", parent)
    n_all = {r["text_language"]: r["count"] for r in seen.groupBy("text_language").count().collect()}  # one for each language
    total = sum(n_all.values())
    base = [(n_all.get(x, 0) + 1.0) / (total + len(languages)) for x in languages]
    prior = F.array(*map(F.lit, base)).cast("array<double>")

    full = told.withColumn("parent", parent)

    def counted(by: str) -> DataFrame:
        """(by, n): how often each language was seen beside a value, in the languages' order; many: rows with the value."""
        of = [F.count_if(F.col("text_language") == x).alias(f"n{i}") for i, x in enumerate(languages)]
        n = full.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_key")).agg(F.count("*").alias("many"), *of)
        return n.select("_key", "many", F.array(*(F.col(f"n{i}").cast("double") for i in range(len(languages)))).cast("array<double>").alias(f"by_{by}"))

    def smoothed(n: F.Column, to: F.Column) -> F.Column:
        whole = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, to, lambda x, p: (x + STRENGTH * p) / (whole + STRENGTH))

    def given(value: F.Column) -> F.Column:
        """log P(value | L) up to a constant, from P(L | value) / P(L)."""
        none = F.transform(prior, lambda p: F.lit(0.0))
        return F.coalesce(F.zip_with(smoothed(value, prior), prior, lambda x, p: F.log(x / p)), none)

    rows = told.count()
    found = full
    for by in ("declared", "suffix", "host", "parent"):
        # rows without a value match nothing; a key of their own spreads them over tasks
        own = F.concat(F.lit("\x00"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
        keyed = found.withColumn("_key", F.coalesce(F.col(by), own))
        found = attached(keyed, staged(counted(by), f"seen-by-{by}"), "_key", own, rows).drop("_key")
    of_parent = F.coalesce(smoothed(F.col("by_parent"), prior), prior)
    of_host = F.coalesce(smoothed(F.col("by_host"), of_parent), of_parent)
    logs = F.transform(of_host, lambda p: F.log(p))
    for other in (F.col("said"), given(F.col("by_declared")), given(F.col("by_suffix"))):
        logs = F.zip_with(logs, other, lambda a, b: a + b)
    top = F.array_max(F.col("logs"))
    others = F.exp(F.col("none") + F.lit(float(np.log(NONE))) - F.col("top"))
    weight = F.aggregate(F.col("logs"), others, lambda a, x: a + F.exp(x - F.col("top")))
    out = found.withColumn("logs", logs).withColumn("top", top).withColumn("posterior", 1 / weight)
    language = F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int"))
    return out.select("id", language.alias("language"), "posterior", "text_language", F.coalesce((F.col("posterior") >= ACCEPTED) & F.lit(known), F.lit(False)).alias("accepted"), *carried)


def of_documents(documents: DataFrame, *carried: str) -> DataFrame:
    """Evidence of ``documents(doc_id, text, lang, source)``: lang is the declaration, source the host."""
    return documents.select(F.col("doc_id").alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lower("source").alias("host"), *carried)


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of ``pages(page_id, url, html)``: the html element's language, the address's host, its last label and a language in its path."""
    from tessera.llm.html_text import extracted

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]*)", 1))
    path = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    none = lambda c: F.when(c != "", c)
    about = pages.select("page_id", "url", "html", none(declared).alias("declared"), none(host).alias("host"), none(path).alias("path"))
    about = about.withColumn("suffix", F.coalesce("path", none(F.substring_index("host", ".", -1))))
    return extracted(about, "declared", "suffix", "host").select(F.col("page_id").alias("id"), "text", "declared", "suffix", "host")


def identified_rows(documents: DataFrame) -> DataFrame:
    """``documents`` without the rows whose language is not accepted; each row by its own evidence, whatever its id.

    Rows without a word with letters go, null and empty texts among them. An empty table gives no rows; other columns are kept.
    """
    rows, key = keyed(documents)
    bad = identified(of_documents(rows, key), key).where("not accepted")
    return settled(rows, key, bad.groupBy(F.col(key).alias("key")).agg(F.lit(False).alias("once"), F.count("*").alias("many")))
