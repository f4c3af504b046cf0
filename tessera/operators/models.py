"""Sampling, folds, and the audit of a classifier."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import features
from tessera.operators.statistics import cumulative, distributed_index, two_sample
from tessera.staging import staged


#: Groups, one row each, that one window may number.
FEW_GROUPS = 100_000


def undersampled(df: DataFrame, positive: Column, key: str, ratio: int = 10, seed: int = 42) -> DataFrame:
    """All positives, and ``min(ratio * positives, negatives)`` negatives in seeded-hash order: an exact, repeatable sample."""
    n = df.agg(F.count_if(positive).alias("p")).first()["p"]
    negatives = distributed_index(df.where(~positive), [], seed, key, "_i").where(F.col("_i") < ratio * n).drop("_i")
    return df.where(positive).unionByName(negatives)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold: per label, rows in seeded-hash order are dealt out in turn."""
    return distributed_index(df, [label], seed, key, "_i").withColumn("fold", F.col("_i") % k).drop("_i")


def group_folds(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """Adds fold: a group is in one fold only; groups, largest first within their main label, are dealt out back and forth."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), (F.avg(F.col(label)) >= 0.5).alias("main"))
    g = staged(g, "groups")
    if g.count() <= FEW_GROUPS:
        turn = F.row_number().over(Window.partitionBy("main").orderBy(F.desc("n"), group)) - 1
    else:  # by ranges
        ordered = g.withColumn("_o", F.struct((-F.col("n")).alias("n"), F.col(group).alias("g"))).withColumn("_one", F.lit(1))
        g, turn = cumulative(ordered, ["main"], "_o", ["_one"]), F.col("cum__one") - 1
    lap = F.floor(turn / k)
    fold = F.when(lap % 2 == 0, turn % k).otherwise(k - 1 - turn % k).cast("int")
    return df.join(g.withColumn("fold", fold).select(group, "fold"), group)


def forest(features: list[str], label: str, trees: int = 200, depth: int = 30, seed: int = 42) -> Pipeline:
    model = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), model])


#: Rows times trees of one fit, whose nodes the driver holds.
GROWN = 2_000_000


def forests(df: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 30, seed: int = 42) -> Iterator[tuple[int, PipelineModel]]:
    """(trees, model): a forest in groups of trees, each fitted when it is asked for; the more rows, the fewer trees at once, as grown trees have nodes in proportion to rows.

    A forest's score is the mean of its trees' shares, so the groups' scores, weighted by their trees, have the whole forest's as their mean.
    """
    at_once = max(1, GROWN // max(df.count(), 1))
    for at in range(0, trees, at_once):
        n = min(at_once, trees - at)
        yield n, forest(features, label, n, depth, seed + at).fit(df)


def scored(model, df: DataFrame) -> DataFrame:
    """Adds score: the probability of class 1, 0 if the model has never seen it."""
    p = vector_to_array("_p")
    return model.transform(df).withColumn("score", F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).drop("_x", "_p", "_y", "_r")


def out_of_fold(df: DataFrame, features: list[str], label: str, k: int, **forest_options) -> DataFrame:
    """Scores of each fold by a model of the others; ``df`` has fold."""
    parts = [scored(forest(features, label, **forest_options).fit(df.where(F.col("fold") != f)), df.where(F.col("fold") == f)) for f in range(k)]
    return reduce(DataFrame.unionByName, parts)


def evaluated(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, accuracy): exact with ties, and at 0.5."""
    auc = two_sample(df, [], score, F.col(label) == 1).select("auc")
    right = ((F.col(score) >= 0.5).cast("int") == F.col(label).cast("int")).cast("double")
    return auc.crossJoin(df.agg(F.avg(right).alias("accuracy")))  # one row each


def permuted(df: DataFrame, block: list[str], key: str, seed: int) -> DataFrame:
    """The block's columns by one shared random permutation of rows, the others in place."""
    a = distributed_index(df, [], seed, key, "_i")
    b = distributed_index(df.select(key, *block), [], seed + 1, key, "_i").drop(key)
    return a.drop(*block).join(b, "_i").drop("_i")


def block_importance(model, df: DataFrame, blocks: dict[str, list[str]], label: str, key: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(block, repeat, drop): how much the AUC falls when a block of columns is permuted, the block's columns by one shared permutation.

    All permutations are one table, a copy of the rows for each block and repeat: every copy takes the block's values from the
    row that a seeded order of that copy puts in its place. They are scored and ranked in one pass each.

    ``model`` may be ``forests``: each of its groups scores all rows and copies, and is let go before the next is fitted.
    """
    df = staged(distributed_index(df, [], seed, key, "_place"), "rows")
    columns = sorted({c for b in blocks.values() for c in b})
    copies = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.lit(r).alias("repeat")) for b in blocks for r in range(repeats)))).alias("_c")
    own = df.select("*", copies).select(*df.columns, "_c.*")
    donor = df.select(key, *(F.col(c).alias(f"_d_{c}") for c in columns), copies).select("*", "_c.*").withColumn("_k", F.xxhash64("block", "repeat", key)).drop("_c", key)
    donor = distributed_index(donor, ["block", "repeat"], seed + 1, "_k", "_place").drop("_k")
    met = own.join(donor, ["block", "repeat", "_place"])
    moved = {c: F.when(F.col("block").isin([b for b, of in blocks.items() if c in of]), F.col(f"_d_{c}")).otherwise(F.col(c)) for c in columns}
    copied = met.select("block", "repeat", *((moved[c] if c in moved else F.col(c)).alias(c) for c in df.columns if c != "_place"))
    table = staged(copied.unionByName(df.drop("_place"), allowMissingColumns=True).withColumn("_row", F.monotonically_increasing_id()), "permuted")
    parts, weight = [], 0
    for n, group in [(1, model)] if hasattr(model, "transform") else model:
        parts.append(staged(scored(group, table).select("_row", (F.col("score") * n).alias("score")), "scores"))
        weight += n
    # rounded, as equal rows' shares may be summed in any order
    score = F.round(F.sum("score") / weight, 12).alias("score")
    full = staged(table.select("_row", "block", "repeat", label).join(reduce(DataFrame.unionByName, parts).groupBy("_row").agg(score), "_row"), "scores")
    whole = two_sample(full.where("block is null"), [], "score", F.col(label) == 1).select(F.col("auc").alias("_whole"))
    each = two_sample(full.where("block is not null"), ["block", "repeat"], "score", F.col(label) == 1)
    return each.join(F.broadcast(whole)).select("block", "repeat", (F.col("_whole") - F.col("auc")).alias("drop"))  # one row


#: Trees grown by one task on one copy of the table; values of a binned table that a task may hold; rows of a piece; rows that bins are cut by.
TREES, BINNED, PIECE, CUT_BY = 5, 1 << 27, 8192, 1 << 16
#: A leaf's share of class 1 as a whole number, so that sums don't depend on their order.
SHARE = 1 << 24


def grown(bins: np.ndarray, positive: np.ndarray, weight: np.ndarray, tried: int, depth: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, left, share) of a classification tree's nodes: by Gini, ``tried`` random features a node, level by level.

    ``bins``: rows by features, bytes; a row goes to ``left`` if its bin is ``cut`` at most, else to ``left + 1``; a leaf's feature is -1.
    ``weight``: how often a row was drawn, 127 times at most.
    """
    width, flat = bins.shape[1], bins.ravel()
    rows = np.flatnonzero(weight)
    drawn = ((weight[rows].astype(np.int64) << 1) | positive[rows]).astype(np.int64)
    node, size, made, parts = np.zeros(len(rows), np.int64), 1, 1, []
    for level in range(depth + 1):
        count = (drawn >> 1).astype(float)
        total, ones = np.bincount(node, count, size), np.bincount(node, count * (drawn & 1), size)
        feature, cut, left = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int64)
        parts.append((feature, cut, left, np.divide(ones, total, out=np.zeros(size), where=total > 0)))
        mixed = np.flatnonzero((ones > 0) & (ones < total)) if level < depth else np.zeros(0, np.int64)
        if not len(mixed):
            break
        place = np.full(size, -1)
        place[mixed] = np.arange(len(mixed))
        node, total, ones = place[node], total[mixed], ones[mixed]
        own = node >= 0
        node, rows, drawn = node[own], rows[own], drawn[own]
        before, before_1 = np.cumsum(total) - total, np.cumsum(ones) - ones
        least = (ones**2 + (total - ones) ** 2) / total
        best, best_f, best_b = least + 1e-9 * total, np.full(len(mixed), -1), np.zeros(len(mixed), np.int64)
        some = np.argsort(draw.random((len(mixed), width)), axis=1)[:, :tried]
        for j in range(some.shape[1]):
            f = some[:, j]
            x = np.sort((((node << 8) | flat[rows * width + f[node]]) << 8) | drawn)  # by node, then bin; the row's weight and class ride along
            key, n = x >> 8, (x >> 1) & 127
            so_far, so_far_1 = np.cumsum(n), np.cumsum(n * (x & 1))
            ends = np.flatnonzero((key[1:] != key[:-1]) & (key[1:] >> 8 == key[:-1] >> 8))
            if not len(ends):
                continue
            at = key[ends] >> 8
            a, a1 = so_far[ends] - before[at], so_far_1[ends] - before_1[at]
            b, b1 = total[at] - a, ones[at] - a1
            score = (a1**2 + (a - a1) ** 2) / a + (b1**2 + (b - b1) ** 2) / b
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            most = np.maximum.reduceat(score, first)
            hit = np.flatnonzero(score == np.repeat(most, np.diff(np.r_[first, len(at)])))
            hit = hit[np.r_[True, at[hit][1:] != at[hit][:-1]]]
            better = hit[score[hit] > best[at[hit]]]
            best[at[better]], best_f[at[better]], best_b[at[better]] = score[better], f[at[better]], key[ends[better]] & 255
        split = np.flatnonzero(best_f >= 0)
        child = np.full(len(mixed), -1)
        child[split] = 2 * np.arange(len(split))
        feature[mixed[split]], cut[mixed[split]], left[mixed[split]] = best_f[split], best_b[split], made + child[split]
        own = child[node] >= 0
        node, rows, drawn = node[own], rows[own], drawn[own]
        node = child[node] + (flat[rows * width + best_f[node]] > best_b[node])
        size, made = 2 * len(split), made + 2 * len(split)
        if not size:
            break
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shares(tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of each row, in units of 1 / SHARE."""
    feature, cut, left, share = tree
    width, flat = bins.shape[1], bins.ravel()
    at, going = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(going):
        now = at[going]
        f = feature[now]
        inner = f >= 0
        going, now, f = going[inner], now[inner], f[inner]
        at[going] = left[now] + (flat[going * width + f] > cut[now])
    return np.rint(share * SHARE).astype(np.int32)[at]


def _pieces(features: list[str], label: str, edges: list[np.ndarray]):
    """Binned rows that follow each other, as one row: (start, bins, positive); missing values lie in the last bin."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("_place").to_numpy(zero_copy_only=False)
            bins = np.stack([np.searchsorted(e, batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.uint8) for f, e in zip(features, edges, strict=True)], axis=1) if len(place) else None
            positive = (batch.column(label).to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
            cuts = np.flatnonzero(np.r_[True, np.diff(place) != 1]) if len(place) else []
            for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(place[a])]), pa.array([bins[a:b].tobytes()]), pa.array([positive[a:b].tobytes()])], ["start", "bins", "positive"])

    return pack


def _importance_task(rows: int, width: int, blocks: list[list[int]], repeats: int, trees: int, depth: int, seed: int):
    """(copy, start, shares, positive): sums of a group's trees over all rows, copy 0, and over each copy with a permuted block; groups come whole, by their pieces."""
    copies = [None, *((b, r) for b in range(len(blocks)) for r in range(repeats))]

    def scored(group: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        held.sort()
        bins, positive = (np.frombuffer(b"".join(x[i] for x in held), np.uint8) for i in (1, 2))
        bins = bins.reshape(-1, width)
        assert len(bins) == len(positive) == rows
        forest = []
        for t in range(group * TREES, min((group + 1) * TREES, trees)):
            draw = np.random.default_rng([seed, 1, t])
            forest.append(grown(bins, positive, np.minimum(draw.poisson(1.0, rows), 127), int(np.ceil(np.sqrt(width))), depth, draw))
        for i, copy in enumerate(copies):
            own = bins
            if copy:
                own, of = bins.copy(), blocks[copy[0]]
                own[:, of] = bins[np.random.default_rng([seed, 2, *copy]).permutation(rows)][:, of]
            total = sum(shares(tree, own) for tree in forest)
            for at in range(0, rows, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at]), pa.array([total[at : at + PIECE].tobytes()]), pa.array([positive[at : at + PIECE].tobytes()])], ["copy", "start", "shares", "positive"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if held and x["group"] != group:
                    yield from scored(group, held)
                    held = []
                group = x["group"]
                held.append((x["start"], x["bins"], x["positive"]))
        if held:
            yield from scored(group, held)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(copy, start, shares, positive) with the groups' shares added up; rows come by copy and start."""
    now, total = None, None

    def done() -> pa.RecordBatch:
        n = len(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, now[0], np.int32)), pa.array(total), pa.array(np.frombuffer(now[2], np.uint8).astype(np.int32))], ["copy", "score", "positive"])

    for batch in batches:
        for x in batch.to_pylist():
            own = np.frombuffer(x["shares"], np.int32).astype(np.int64)
            if now is not None and now[:2] == (x["copy"], x["start"]):
                total += own
                continue
            if now is not None:
                yield done()
            now, total = (x["copy"], x["start"], x["positive"]), own
    if now is not None:
        yield done()


def forest_importance(df: DataFrame, features: list[str], blocks: dict[str, list[str]], label: str, key: str, repeats: int = 5, trees: int = 200, depth: int = 30, seed: int = 42) -> DataFrame:
    """(block, repeat, drop): how much a forest's AUC falls when a block of columns is permuted, the block's columns by one shared permutation.

    A task grows ``TREES`` trees on bootstrap draws of the whole table and scores all rows and copies by them, so neither trees nor copies
    ever leave it; features are bytes there, cut at 255 quantiles of ``CUT_BY`` rows at most. A table of more than ``BINNED`` such bytes has its forest
    fitted by levels over all tasks instead (``forests``), which takes a pass for each.
    """
    df = staged(distributed_index(df.where(F.col(label).isNotNull()), [], seed, key, "_place"), "rows")
    rows = df.count()
    if rows * len(features) > BINNED:
        return block_importance(forests(df.drop("_place"), features, label, trees, depth, seed), df.drop("_place"), blocks, label, key, repeats, seed)
    some = df.where(F.col("_place") < CUT_BY).select(*(F.col(f).cast("double") for f in features)).toPandas()
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, 257)[1:-1], method="lower")) if len(x := some[f].dropna().to_numpy()) else np.zeros(0) for f in features]
    run = df.select("_place", label, *features).withColumn("_piece", F.floor(F.col("_place") / PIECE)).repartition("_piece").sortWithinPartitions("_place").drop("_piece")
    pieces = staged(run.mapInArrow(_pieces(features, label, edges), "start long, bins binary, positive binary"), "pieces")
    groups = -(-trees // TREES)
    dealt = pieces.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionByRange(groups, "group").sortWithinPartitions("group")
    task = _importance_task(rows, len(features), [[features.index(c) for c in of] for of in blocks.values()], repeats, trees, depth, seed)
    parts = dealt.mapInArrow(task, "copy int, start long, shares binary, positive binary")
    full = parts.repartition("copy", "start").sortWithinPartitions("copy", "start").mapInArrow(_added, "copy int, score long, positive int")
    each = two_sample(staged(full, "scores").withColumn("score", F.col("score") / (trees * SHARE)), ["copy"], "score", F.col("positive") == 1).select("copy", "auc")
    each = staged(each, "aucs")  # a row for each copy
    whole = each.where("copy = 0").select(F.col("auc").alias("_whole"))
    names = F.element_at(F.array(*(F.lit(b) for b in blocks)), (F.floor((F.col("copy") - 1) / repeats) + 1).cast("int"))
    told = each.where("copy > 0").join(F.broadcast(whole))
    return told.select(names.alias("block"), ((F.col("copy") - 1) % repeats).alias("repeat"), (F.col("_whole") - F.col("auc")).alias("drop"))


def importance_summary(drops: DataFrame) -> DataFrame:
    """(block, repeats, mean, deviation) of the drops over repeats; the deviation is the population's."""
    return drops.groupBy("block").agg(F.count("*").alias("repeats"), F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("deviation"))


#: Letters shuffled at once, and orders of exits that are tried for all sequences before a sequence's last exits are drawn by a walk.
LETTERS, TRIES = 1 << 18, 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _last_exits(exits: dict[int, list[int]], end: int, seed: int) -> dict[int, int]:
    """The place of one exit of each letter but ``end``, so that these lead to ``end`` from everywhere: each such choice is as likely as any other.

    Wilson's walk: from a letter outside the tree take exits at random until the tree is met; the last one taken from each letter on the way is kept.
    Steps grow with the exits, as a walk that leaves each letter as often as it is entered meets any letter.
    """
    draw, joined, last = random.Random(seed), {end}, {}
    for letter in exits:
        now = letter
        while now not in joined:
            last[now] = draw.randrange(len(exits[now]))
            now = exits[now][last[now]]
        now = letter
        while now not in joined:
            joined.add(now)
            now = exits[now][last[now]]
    return last


def shuffled(codes: list[np.ndarray], seeds: np.ndarray, tries: int = TRIES) -> tuple[list[np.ndarray], np.ndarray]:
    """A shuffle of each sequence of small numbers, and whether it kept the count of every pair of neighbours.

    The exits of each letter are put in a random order until the last ones form a tree into the last letter; then the
    walk that takes exits in this order uses all of them and ends there. Exits are put in order for all
    sequences at once. Where no order fits within ``tries``, the last exits are drawn as such a tree, which any sequence has.
    Under two letters, and without any try, only the letters' counts are kept. The result depends on a sequence and its seed alone.
    """
    rows, kinds = len(codes), int(max((c.max() for c in codes if len(c)), default=0)) + 1
    n = np.array([len(c) for c in codes])
    out, kept = [c.copy() for c in codes], n >= 2
    some = np.flatnonzero(kept)
    if len(some):
        flat = np.concatenate([codes[i] for i in some]).astype(np.int64)
        row = np.repeat(np.arange(len(some)), n[some])
        first = np.concatenate([[0], np.cumsum(n[some])])[:-1]
        place = np.arange(len(flat)) - first[row]
        edge = np.flatnonzero(place < n[some][row] - 1)  # each letter but the last has an exit, to the next
        source, target, owner = flat[edge], flat[edge + 1], row[edge]
        end = flat[first + n[some] - 1]
        cell = owner * kinds + source
        starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(some) * kinds))])
        order, open_ = np.zeros(len(edge), np.int64), np.ones(len(some), bool)
        base = _mixed(seeds[some].astype(np.uint64))
        for attempt in range(tries + (tries > 0)):  # the last order is that of all exits but the drawn ones
            todo = np.flatnonzero(open_[owner])
            if not len(todo):
                break
            with np.errstate(over="ignore"):
                keys = _mixed(base[owner[todo]] + np.uint64(0x9E3779B97F4A7C15) * (place[edge[todo]].astype(np.uint64) + np.uint64(1)) + np.uint64(attempt) * np.uint64(0xD6E8FEB86659FD93))
            bits = np.uint64(max(int(len(some) * kinds).bit_length(), 1))
            order[todo] = todo[np.argsort((cell[todo].astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits))]  # by cell, then key
            # rows keep their own stretch of ``order``, as cells are sorted by row
            if attempt == tries:
                break
            last = np.full((len(some), kinds), -1)
            full = np.flatnonzero(starts[1:] > starts[:-1])
            last.ravel()[full] = target[order[starts[full + 1] - 1]]
            at = np.where(last >= 0, np.arange(kinds)[None], end[:, None])
            for _ in range(kinds):
                step = np.take_along_axis(last, at, 1)
                at = np.where((at == end[:, None]) | (step < 0), at, step)
            open_ &= ~(at == end[:, None]).all(1)
        exits = target[order]
        for k in np.flatnonzero(open_) if tries else ():
            of = {c: exits[starts[k * kinds + c] : starts[k * kinds + c + 1]].tolist() for c in range(kinds)}
            for c, at in _last_exits({c: x for c, x in of.items() if x}, int(end[k]), int(base[k])).items():
                where = [starts[k * kinds + c] + at, starts[k * kinds + c + 1] - 1]
                exits[where] = exits[where[::-1]]
        for k in range(len(some)) if tries else ():
            at = [exits[starts[c] : starts[c + 1]].tolist() for c in range(k * kinds, (k + 1) * kinds)]
            exit_of, now = [iter(x).__next__ for x in at], int(flat[first[k]])
            out[some[k]] = np.array([now, *[now := exit_of[now]() for _ in range(n[some[k]] - 1)]], codes[some[k]].dtype)
        kept[some] = tries > 0
    for i in range(rows):
        if not kept[i]:
            with np.errstate(over="ignore"):
                out[i] = codes[i][np.argsort(_mixed(_mixed(seeds[i : i + 1].astype(np.uint64)) + np.arange(n[i], dtype=np.uint64)), kind="stable")]
    return out, kept


def null_model(df: DataFrame, key: str, seq: str, n: int, seed: int = 42) -> DataFrame:
    """(key, shuffle, sequence, mode): ``n`` shuffles of each sequence that keep its dinucleotides (mode 'dinuc'), or under two letters its letters ('mono'); seeded by key.

    A null sequence is an empty one.
    """
    key_text, salt = F.col(key).cast("string"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shuffle")
    expanded = df.select(key_text.alias("key"), F.coalesce(seq, F.lit("")).alias("sequence"), salt).withColumn("seed", F.xxhash64(F.lit(seed), "key", "shuffle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            seeds, at = batch.column(3).to_numpy(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= LETTERS):
                    size, stop = size + len(texts[stop]), stop + 1
                plain = np.frombuffer("".join(texts[at:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
                code = np.zeros(int(plain.max(initial=0)) + 1, np.int64)
                code[plain] = 1
                letters = np.flatnonzero(code).astype(np.uint32)
                code[letters] = np.arange(len(letters))
                ends = np.cumsum([len(t) for t in texts[at:stop]])
                made, kept = shuffled(np.split(code[plain], ends[:-1]), seeds[at:stop])
                written = [letters[m].tobytes().decode("utf-32-le", "surrogatepass") for m in made]
                part = batch.slice(at, stop - at)
                modes = pa.array(["dinuc" if k else "mono" for k in kept])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(written, pa.string()), modes], names=["key", "shuffle", "sequence", "mode"])
                at = stop

    return expanded.mapInArrow(run, "key string, shuffle int, sequence string, mode string")


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has, in seeded-hash order."""
    n = min(r["count"] for r in df.groupBy(label).count().collect())  # one row for each label
    return distributed_index(df, [label], seed, key, "_i").where(F.col("_i") < n).drop("_i")


def inventory(df: DataFrame, which: str, label: str) -> DataFrame:
    """(position, feature, block, rows, missing_1, missing_0): each feature of a set that ``df`` has, with its nulls by class, in one pass."""
    names = features.feature_columns(df.columns, which)
    if not names:
        raise ValueError(f"no column of the feature set {which!r}")
    block = {c: b for b, columns in features.BLOCKS.items() for c in columns} | dict.fromkeys(features.MELTING, "melting")
    gone = lambda c, x: F.count_if(F.col(c).isNull() & (F.col(label) == x))
    each = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(block.get(c, "other")).alias("block"), F.count("*").alias("rows"), gone(c, 1).alias("missing_1"), gone(c, 0).alias("missing_0")) for i, c in enumerate(names)]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))
