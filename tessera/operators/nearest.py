"""Exact nearest rows by counts of k-mers, and the sampling that reads them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rna
from tessera.operators.sequences import capped_copies
from tessera.operators.statistics import cumulative
from tessera.staging import staged

#: Bytes of packs that travel to a Python worker at once: by default 10000 packs would, however large.
BATCH_BYTES = 1 << 24
#: Rows of a pack, pivots, and salts of a class's rows.
ROWS, PIVOTS, SALTS = 1024, 12, 16
#: Packs that ask are held in so many groups at least, and in one so many at most: a pack that is asked goes to a group once, not to each of its packs.
GROUPS, TOGETHER = 32, 64
_PACKS = "block long, least array<double>, most array<double>, low array<double>, high array<double>, ids array<long>, pack binary"
_NEAR = "a long, b long, d2 double"


def counted(seq: str, ks: tuple[int, ...]) -> np.ndarray:
    """Counts of all k-mers over the four letters, one k after the other; windows with another letter count for none."""
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(rna.BASES.encode(), np.uint8)] = np.arange(4)
    code = table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    parts = []
    for k in ks:
        n = max(len(code) - k + 1, 0)
        at, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            at, ok = at * 4 + code[j : j + n], ok & (code[j : j + n] >= 0)
        parts.append(np.bincount(at[ok], minlength=4**k))
    return np.concatenate(parts).astype(np.int32)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; whole numbers, so exact in double precision."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)


def _away(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(x, pivots), 0))


def _placed(ks: tuple[int, ...], pivots: np.ndarray):
    """(c, at, away, v): each row's counts, its nearest pivot and how far that is."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [counted(s, ks) for s in batch.column("seq").to_pylist()]
            d = _away(np.stack(v).astype(float), pivots)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at]), pa.array([x.tobytes() for x in v])], ["c", "at", "away", "v"])

    return place


def _packs(pivots: np.ndarray, n: int):
    """Packs of neighbouring rows: where their distances from each pivot lie, and those of any row that one of theirs may have among its n nearest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                blob = part.column("v").to_pylist()
                wide = np.frombuffer(b"".join(blob), np.int32).reshape(len(blob), -1).astype(float)
                away, reach = _away(wide, pivots), np.full(len(wide), np.inf)
                if len(wide) > n:
                    d = _squares(wide, wide)
                    np.fill_diagonal(d, np.inf)
                    reach = np.sqrt(np.partition(d, n - 1, axis=1)[:, n - 1]) * (1 + 1e-9) + 1e-6 * (1 + away.max())  # rounding
                sides = [away.min(0), away.max(0), (away - reach[:, None]).min(0), (away + reach[:, None]).max(0)]
                one = [[block], *([x.tolist()] for x in sides), [part.column("c").to_pylist()], [b"".join(blob)]]
                kinds = [pa.int64(), *[pa.list_(pa.float64())] * 4, pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], ["block", "least", "most", "low", "high", "ids", "pack"])
                block += 1

    return pack


def _merged(d2: np.ndarray, ids: np.ndarray, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of both by distance, then id, as many as ``best`` has; columns of ``d2`` are in the order of ``ids``."""
    n, some, d2 = best.shape[1], [], d2.copy()
    for _ in range(min(n, d2.shape[1])):
        at = d2.argmin(1)
        some.append((d2[np.arange(len(d2)), at], ids[at]))
        d2[np.arange(len(d2)), at] = np.inf
    far = np.stack([x for x, _ in some] + list(best.T), 1)
    name = np.stack([x for _, x in some] + list(who.T), 1)
    order = np.lexsort((name, far), axis=1)[:, :n]
    return np.take_along_axis(far, order, 1), np.take_along_axis(name, order, 1)


def _best(n: int, pivots: np.ndarray):
    """(a, b, d2) of each row's ``n`` nearest. Packs that ask stay, a group of them at once, those that are asked stream past; rows come by (group, asked).

    Of a pack that asks only rows are compared whose n-th distance so far reaches the asked pack on every pivot.
    """

    def told(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, best, who in held.values():
            ok = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[ok.ravel()]), pa.array(who[ok]), pa.array(best[ok])], ["a", "b", "d2"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["group"] != group:
                    yield from told(held)
                    group, held = row["group"], {}
                ids, x = np.array(row["ids"]), np.frombuffer(row["pack"], np.int32).reshape(len(row["ids"]), -1).astype(float)
                if not row["asked"]:
                    held[row["block"]] = [ids, x, _away(x, pivots), np.full((len(ids), n), np.inf), np.zeros((len(ids), n), np.int64)]
                    continue
                order = np.argsort(ids)  # ties to the smaller id
                ids, x, low, high = ids[order], x[order], np.array(row["least"]), np.array(row["most"])
                for block in row["asks"]:
                    own = held[block]
                    reach = (np.sqrt(own[3][:, -1]) * (1 + 1e-9) + 1e-6 * (1 + own[2].max()))[:, None]  # rounding
                    near = np.flatnonzero(((own[2] - reach <= high) & (own[2] + reach >= low)).all(1))
                    d = _squares(own[1][near], x)
                    if block == row["block"]:
                        d[own[0][near][:, None] == ids[None]] = np.inf
                    some = (d <= own[3][near][:, -1:]).any(1)
                    near = near[some]
                    own[3][near], own[4][near] = _merged(d[some], ids, own[3][near], own[4][near])
        yield from told(held)

    return best


def _pairs(packs: DataFrame) -> DataFrame:
    """(block, block_b): packs that must be compared: on every pivot the second one's distances reach into what the first one asks for.

    They meet in cells of the distance from the one pivot that tells most packs apart; only numbers are moved here.
    """
    pivots = len(packs.select(F.max("least")).first()[0] or [])
    if not pivots:
        return packs.select("block", F.col("block").alias("block_b"))
    told = packs.agg(
        *(F.min(F.get("least", F.lit(p))).alias(f"a{p}") for p in range(pivots)), *(F.max(F.get("most", F.lit(p))).alias(f"b{p}") for p in range(pivots)),
        *(F.avg(F.least(F.get("high", F.lit(p)), F.lit(1e300)) - F.greatest(F.get("low", F.lit(p)), F.lit(-1e300))).alias(f"w{p}") for p in range(pivots)),
    ).first()
    best = min(range(pivots), key=lambda p: told[f"w{p}"] / max(told[f"b{p}"] - told[f"a{p}"], 1e-9))
    low, high = told[f"a{best}"], told[f"b{best}"]
    width = max(min(told[f"w{best}"], high - low), (high - low) / 4096, 1e-6)
    cell = lambda x: F.floor((F.greatest(F.least(x, F.lit(high)), F.lit(low)) - low) / width)
    cells = lambda a, b: F.explode(F.sequence(cell(F.get(a, F.lit(best))), cell(F.get(b, F.lit(best))))).alias("cell")
    asks = packs.select("block", "low", "high", cells("low", "high"))
    held = packs.select(F.col("block").alias("block_b"), "least", "most", cells("least", "most"))
    inside = F.forall(F.arrays_zip("low", "high", "least", "most"), lambda x: (x["least"] <= x["high"]) & (x["most"] >= x["low"]))
    return asks.join(held, "cell").where(inside).select("block", "block_b").distinct()


def nearest_by_kmers(df: DataFrame, key: str, seq: str, tag: str, ks: tuple[int, ...], n: int) -> DataFrame:
    """(key, tag, near): the ``n`` nearest other rows as (d2, key, tag), by squared distance of k-mer counts, ties to the smaller key; exact.

    Equal sequences are one class, of which the first ``n + 1`` keys are candidates. Classes are packed by their nearest
    pivot and the distance from it; pivots are a fixed number of classes, and nothing at all (whose distance tells
    lengths apart). The n-th distance within a pack bounds the true one, and by the triangle inequality distances from
    a pivot differ by no more than the distance of two rows, so packs beyond that on any pivot are never compared. Rows
    without a sequence or a key take no part.
    """
    ks, bound = tuple(sorted(ks)), "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, None) is None:
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))  # stays in the session
    z = df.select(F.col(key).cast("long").alias("key"), F.col(seq).alias("seq"), F.col(tag).alias("tag")).where("key is not null and seq is not null")
    z = staged(z.withColumn("digest", F.sha2("seq", 256)), "rows")  # texts meet their labels once
    heads = F.array_sort(F.collect_list(F.struct("key", "tag"))).alias("heads")  # n + 1 at most
    classes = capped_copies(z, "key", "seq", n + 1).groupBy("digest").agg(F.min("key").alias("c"), F.first("seq").alias("seq"), heads)
    classes = staged(classes, "classes")
    some = classes.select("c", "seq").orderBy(F.xxhash64("c"), "c").limit(PIVOTS)
    none = np.zeros((1, sum(4**k for k in ks)))
    vectors = some.mapInArrow(_placed(ks, none), "c long, at int, away double, v binary").select("v").collect()  # PIVOTS small rows
    pivots = np.concatenate([none, *(np.frombuffer(r["v"], np.int32).astype(float)[None] for r in vectors)])
    in_order = classes.select("c", "seq").mapInArrow(_placed(ks, pivots), "c long, at int, away double, v binary")
    in_order = staged(in_order, "counts").repartitionByRange("at", "away", "c").sortWithinPartitions("at", "away", "c")
    packs = staged(in_order.mapInArrow(_packs(pivots, n), _PACKS), "packs")
    count = packs.count()
    groups = max(GROUPS, -(-count // TOGETHER))
    number = cumulative(packs.select("block").withColumn("_one", F.lit(1)), [], "block", ["_one"])
    part = staged(number.select("block", F.floor((F.col("cum__one") - 1) * groups / count).alias("group")), "groups")
    pairs = _pairs(packs).join(part, "block").groupBy("group", "block_b").agg(F.collect_list("block").alias("asks"))  # of one group
    own = packs.select("block", "least", "most", "ids", "pack")
    asked = pairs.withColumnRenamed("block_b", "block").join(part.withColumnRenamed("group", "_home"), "block").join(own, "block").withColumn("asked", F.when(F.col("_home") == F.col("group"), 1).otherwise(2)).drop("_home")
    met = own.join(part, "block").withColumn("asked", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    met = met.repartitionByRange(groups, "group").sortWithinPartitions("group", "asked", "block")
    best = staged(met.mapInArrow(_best(n, pivots), _NEAR), "nearest")
    entry = lambda d2: F.transform("heads", lambda x: F.struct(d2.alias("d2"), x["key"].alias("key"), x["tag"].alias("tag")))
    others = best.join(classes.select(F.col("c").alias("b"), "heads"), "b").select(F.col("a").alias("c"), entry(F.col("d2")).alias("x"))
    both = others.unionByName(classes.select("c", entry(F.lit(0.0)).alias("x")))
    near = both.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, n + 1).alias("near"))  # n + 1 lists of n + 1 at most
    near = near.join(classes.select("c", "digest"), "c").select("digest", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = z.select("key", "tag", "digest", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    found = rows.join(near, ["digest", "salt"])
    return found.select("key", "tag", F.slice(F.filter("near", lambda x: x["key"] != F.col("key")), 1, n).alias("near"))


def edited(df: DataFrame, key: str, seq: str, label: str, ks: tuple[int, ...], n: int = 3) -> DataFrame:
    """(key, label): rows of the larger class go unless their ``n`` nearest rows all are of it; of classes of one size, the lesser is taken for the larger."""
    most = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).first()
    if most is None:
        return df.select(key, label)
    near = nearest_by_kmers(df, key, seq, label, ks, n)
    stays = ~F.col("tag").eqNullSafe(F.lit(most[0])) | F.forall("near", lambda x: x["tag"].eqNullSafe(F.lit(most[0])))
    return near.where(stays).select(F.col("key").alias(key), F.col("tag").alias(label))
