"""N-gram Jaccard join by signature trees.

Two documents link when the Jaccard similarity of their shingle sets is at least ``percent`` percent. Equal sets are
one class from the start. Of a class only a prefix of its shingles, in one order for all, can be the first it shares
with a linked class (a similarity of s leaves at most a share 1-s of a set unshared), so classes meet in the buckets of
their prefix shingles. The order puts shingles that a bounded sample of documents shows to be frequent last; any order
gives the same links.

1. In each bucket a signature tree finds the pairs that may link. A forest of them is kept: pairs already connected
   through others are pruned with whole nodes, so a bucket gives fewer pairs than it has classes.
2. The components of these pairs are families: no link leaves one. Each class of a family brings its shingle set once;
   the dual traversal runs again, and pairs not yet linked through others are compared exactly.
3. The components of the links are the result.

Large buckets and families are cut into parts, and every two parts meet in a task of their own, so no task holds more
than two parts; each pair meets in at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.components import attached, components
from tessera.llm.signature_tree import candidates, signature
from tessera.llm.rows import keyed, settled
from tessera.llm.text import grams, hashed, words
from tessera.staging import staged

WORDS, PERCENT = 5, 80
#: Documents in the sample that shows which shingles are frequent, how often one must occur there, and how many are kept.
SAMPLE, OFTEN, FREQUENT = 4000, 3, 1 << 17
#: Classes of a bucket in one part, of small buckets in one home, shingles of a family in one part, and sets that are tried without a tree.
BUCKET, HOME, VOLUME, FEW = 2048, 1024, 500_000, 12


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Distinct hashes of runs of ``k`` words, sorted; of the whole sequence if there are fewer words; none if none."""
    ws = words(text)
    return np.unique(grams(hashed(ws), min(k, len(ws)))) if ws else np.zeros(0, np.uint64)


def _digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that a sample of at most about SAMPLE documents holds often."""
    n = docs.count()
    share = min(1.0, SAMPLE / max(n, 1))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, k).view(np.int64))], names=["shingle"])

    picked = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counts = picked.mapInArrow(told, "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()  # FREQUENT longs at most
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))


def _prefix(members: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order, one of which any linked set must share."""
    late = np.zeros(len(members), bool)
    if len(often):
        late = often[np.minimum(np.searchsorted(often, members), len(often) - 1)] == members
    ordered = np.concatenate([members[~late], members[late]])
    n = len(members)
    return ordered[: n - -(-percent * n // 100) + 1]


#: Texts whose shingles are held at once.
SLICE = 1024


def described(docs: DataFrame, often, k: int, percent: int) -> DataFrame:
    """(row, doc_id, n, digest, signature, prefix, key) of every row; prefix: 8 bytes for each shingle; key: carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        # the sets of SLICE texts are held at once
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            columns = [
                pa.array(np.arange(row, row + len(sets)), pa.int64()),
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary()),
                pa.array([_prefix(s, often.value, percent).tobytes() for s in sets], pa.binary()),
                batch.column(2),
            ]
            row += len(sets)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "digest", "signature", "prefix", "key"])

    return docs.mapInArrow(run, "row long, doc_id long, n long, digest binary, signature binary, prefix binary, key " + docs.schema["key"].dataType.simpleString())


def _tokens(classes: DataFrame, among=None) -> DataFrame:
    """(token, row) for the prefix shingles, or for those that a filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = batch.column(0), [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
            if not parts:
                continue
            number, token = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)
            if among is not None:
                ok = bloom.may_hold(among.value, token)
                token, number = token[ok], number[ok]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(rows.to_numpy()[number])], names=["token", "row"])

    return classes.select("row", "prefix").mapInArrow(run, "token long, row long")


class Forest(dict):
    """Disjoint sets; the root of a set is its least row."""

    def root(self, x: int) -> int:
        at = x
        while (up := self.get(at, at)) != at:
            at = up
        while (up := self.get(x, x)) != at:
            self[x] = at
            x = up
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Groups of rows with equal first ``keys`` columns, of batches sorted by them; each column as a list."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        ids, at, n = list(zip(*columns[:keys], strict=True)), 0, batch.num_rows
        while at < n:
            end = at + 1
            while end < n and ids[end] == ids[at]:
                end += 1
            group = [c[at:end] for c in columns]
            if held and tuple(c[0] for c in held[:keys]) == ids[at]:
                held = [a + b for a, b in zip(held, group, strict=True)]
            else:
                if held:
                    yield held
                held = group
            at = end
    if held:
        yield held


def _may_link(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """The bound of a signature tree for two sets, without a tree."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * min(len(a), len(b))
    while x.bit_length() > n or y.bit_length() > n:
        x, y = (x & ((1 << n) - 1)) | (x >> n), (y & ((1 << n) - 1)) | (y >> n)
    overlap = min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count())
    return (100 + percent) * overlap >= percent * (na + nb)


def _likely(rows: list[int], sizes: list[int], marks: list[bytes], forest: Forest, percent: int) -> Iterator[tuple[int, int]]:
    """Positions of the pairs, not connected before this call, that may link; few sets are tried directly."""
    if len(rows) <= FEW:
        for i in range(len(rows)):
            for j in range(i):
                if forest.root(rows[i]) != forest.root(rows[j]) and _may_link(sizes[i], marks[i], sizes[j], marks[j], percent):
                    yield i, j
    else:
        roots = np.array([forest.root(r) for r in rows])
        if (roots != roots[0]).any():
            i, j = candidates(np.array(sizes), marks, roots, percent)
            yield from zip(i.tolist(), j.tolist(), strict=True)


def _parted(df: DataFrame, parts: F.Column) -> DataFrame:
    """Rows at each meeting (i, j) of their part with another."""
    cut = df.withColumn("_of", F.greatest(parts, F.lit(1)).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("row"), F.col("_of")).cast("int"))
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    return met.withColumn("i", F.least("_mine", "_other")).withColumn("j", F.greatest("_mine", "_other")).drop("_mine", "_other")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the pairs that may link."""
    # two hashes of 64 bits in any order of the members; sums of the row numbers themselves would agree by chance
    who = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"who{k}") for k in (0, 1)]
    buckets = _tokens(classes).groupBy("token").agg(F.count("*").alias("many"), F.min("row").alias("least"), *who)
    buckets = buckets.where("many > 1").groupBy("many", "least", "who0", "who1").agg(F.min("token").alias("token"))  # like members, one traversal
    # buckets with the same least class go to as many homes as their members ask for
    homes = buckets.groupBy("least").agg(F.ceil(F.sum("many") / HOME).alias("homes"))
    # no more buckets have one least class than it has prefix shingles
    buckets = staged(buckets.join(homes, "least").select("token", "many", "least", "homes"), "buckets")
    among = classes.sparkSession.sparkContext.broadcast(bloom.built(buckets.select("token"), buckets.count()))
    placed = _parted(_tokens(classes, among).join(buckets, "token"), F.ceil(F.col("many") / BUCKET))
    # small buckets with the same least class mostly hold one family, and share what is connected
    home = F.when(F.col("_of") == 1, F.xxhash64("least", F.pmod(F.xxhash64("token"), "homes"))).otherwise(F.xxhash64("token", "i", "j"))
    full = placed.select("token", "i", "j", "row", home.alias("home")).join(classes.select("row", "n", "signature"), "row")
    laid = full.select("home", "token", "i", "j", "row", "n", "signature").repartition("home").sortWithinPartitions("home", "token", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, home, out = Forest(), None, []
        for group in _grouped(batches, 4):
            if group[0][0] != home:
                home = group[0][0]
                forest.clear()
            rows = group[4]
            out += [(rows[i], rows[j]) for i, j in _likely(rows, group[5], group[6], forest, percent) if forest.join(rows[i], rows[j])]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return laid.mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a forest of the links, found within the components of the candidate pairs."""
    family = components(pairs).withColumnRenamed("node", "row")
    family = staged(family.join(classes.select("row", "doc_id", "n", "digest"), "row"), "families")
    members = family.count()
    ids = docs.sparkSession.sparkContext.broadcast(bloom.built(family.select(F.coalesce("doc_id", F.lit(0))), members))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(bloom.may_hold(ids.value, batch.column(0).fill_null(0).to_numpy()))
            if len(at):
                sets = [shingles(t, k) for t in batch.column(1).take(pa.array(at)).to_pylist()]
                columns = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "members"])

    size = family.groupBy("label").agg(F.sum("n").alias("_total"), F.count("*").alias("many"))
    sized = attached(family, size, "label", -1 - F.col("row"), members)
    placed = _parted(sized, F.ceil(F.col("_total") / VOLUME)).select("digest", "label", "i", "j", "row")
    full = docs.mapInArrow(again, "digest binary, members binary").join(placed.hint("merge"), "digest")
    laid = full.select("label", "i", "j", "row", "members").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            sets = {r: np.frombuffer(m, np.uint64) for r, m in zip(group[3], group[4], strict=True)}  # a row may come twice
            rows, own = list(sets), list(sets.values())
            sizes, marks, forest, out = [len(s) for s in own], [signature(s) for s in own], Forest(), []
            for i, j in _likely(rows, sizes, marks, forest, percent):
                if forest.root(rows[i]) != forest.root(rows[j]):
                    x, y = (own[i], own[j]) if sizes[i] < sizes[j] else (own[j], own[i])
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if (100 + percent) * both >= percent * (sizes[i] + sizes[j]):
                        forest.join(rows[i], rows[j])
                        out.append((rows[i], rows[j]))
            if out:
                yield _edges(out)

    return laid.mapInArrow(run, "a long, b long")


def _members(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, doc_id, n, label, component_id) of each row of ``docs(doc_id, text, key)``; label: one number for each component."""
    often = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))
    all_rows = staged(described(docs, often, k, percent), "described")
    thin = all_rows.select("row", "key", "doc_id", "n", "digest")
    # a class: its least row and id, and how many copies it has
    reps = staged(thin.where("n > 0").groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count("*").alias("many")), "representatives")
    classes = staged(all_rows.join(reps.select("row").hint("merge"), "row", "left_semi"), "classes")  # one plan at every size
    links = _links(_candidates(classes, percent), classes, docs, k, percent)
    found = components(links).withColumnRenamed("node", "row")
    labelled = staged(reps.join(found, "row", "left").withColumn("label", F.coalesce("label", "row")), "labelled")
    counts = labelled.agg(F.count("*").alias("classes"), F.sum("many").alias("rows")).first()
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count("*").alias("many"))
    told = attached(labelled, least, "label", -1 - F.col("row"), counts["classes"]).select("digest", "label", "component_id", "many")
    own = F.concat(F.lit(b"\0"), F.col("row").cast("string").cast("binary"))  # no digest, which has 16 bytes and no such start
    some = thin.withColumn("digest", F.when(F.col("n") > 0, F.col("digest")).otherwise(own))
    full = attached(some, told, "digest", own, counts["rows"] or 0)
    alone = F.col("label").isNull()
    return full.select("key", "doc_id", "n", F.when(alone, F.col("row")).otherwise(F.col("label")).alias("label"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def joined(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs(doc_id, text)``.

    component_id: the least doc_id that links reach, its own included. A null, empty or wordless text has no shingle
    and links with nothing, itself apart. Each of several rows with one id is taken by its own text. A null id counts
    as greater than any other. An empty table gives no rows. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("key"))
    return _members(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def kept_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, a null id last; of several rows of that id any one, but always the same.

    Rows without a word stay. Rows that are equal in every column count as one document: one of them stays. An empty
    table gives no rows; other columns are kept as they are.
    """
    rows, key = keyed(docs)
    found = _members(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(key).alias("key")), k, percent)
    found = staged(found.select("key", "doc_id", "label"), "members")
    # equal rows are of one component, or wordless: then each is a component, and one of them stays all the same
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    chosen = found.groupBy("label").agg(F.min_by("key", order).alias("chosen"), F.count("*").alias("many"))
    members = attached(found, chosen, "label", -1 - F.monotonically_increasing_id(), found.count())
    decided = members.groupBy("key").agg(F.max(F.col("key") == F.col("chosen")).alias("once"), F.count("*").alias("many"))
    return settled(rows, key, decided.where("not once or many > 1"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""
