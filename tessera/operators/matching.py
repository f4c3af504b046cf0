"""Matching two classes on length and composition, one to one."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import cumulative
from tessera.staging import staged


def standardised(df: DataFrame, columns: list[str], floor: float = 1e-9) -> DataFrame:
    """Adds z_<column>: by the pooled mean and population deviation."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    full = df.join(F.broadcast(stats))  # one row
    return full.select(*df.columns, *((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(floor)) for c in columns)).toDF(*df.columns, *(f"z_{c}" for c in columns))


#: Points of a cell that a level may begin with, levels that are counted, and salts of copies.
_CELL, _LEVELS, _SALTS = 64, 12, 64


def _slopes(rows: DataFrame, distance: dict[str, str]) -> dict[str, float]:
    """How much a distance column grows with its gate column at least; 0 where it isn't a line of it, so that nothing is concluded."""
    names = list(distance)
    corner = lambda f, c: f(F.struct(F.col(c).cast("double").alias("x"), F.col(distance[c]).cast("double").alias("z")))
    ends = rows.agg(*(corner(f, c).alias(f"{n}_{c}") for c in names for n, f in (("a", F.min), ("b", F.max)))).first()
    slope, off = {}, []
    for c in names:
        a, b = ends[f"a_{c}"], ends[f"b_{c}"]
        known = a is not None and None not in (*a, *b) and b[0] > a[0]
        slope[c] = (b[1] - a[1]) / (b[0] - a[0]) if known else 0.0
        line = F.lit(a[1] if known else 0.0) + (F.col(c) - F.lit(a[0] if known else 0.0)) * slope[c]
        off.append(F.max(F.abs(F.col(distance[c]) - line)).alias(c))
    worst = rows.agg(*off).first()
    return {c: abs(slope[c]) * (1 - 1e-9) if worst[c] is not None and worst[c] <= 1e-9 * max(1.0, abs(slope[c])) else 0.0 for c in names}


def candidates(left: DataFrame, right: DataFrame, key: str, within: dict[str, float], distance: dict[str, str], k: int, digits: int | None = None) -> DataFrame:
    """(a, b, cost): for each left row the ``k`` right rows nearest by the distance columns, among those within the gates; ties to the smaller b.

    With ``digits``, costs are rounded before they are compared, so that equal ones tie whatever the last bits of their sums.

    ``distance`` names, for each gate column, the column whose difference counts. Equal points are one, of which the first
    ``k`` rows can be wanted; equal askers ask once. Cells are cut finer and finer until few points share one. A point
    asks its own cell and those around it, level by level from the finest: once its k-th distance is below all that
    such a block of cells leaves out, it has its nearest and stops. At the coarsest level cells are as wide as the
    gates, so the block holds all that is allowed. Rows with a missing value take no part.
    """
    names = list(within)
    columns = [*names, *distance.values()]
    known = " and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns)
    point = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    r, a = (side.where(known).select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(c) for c in columns), point.alias("pt")) for side in (right, left))
    r, a = staged(r, "points"), staged(a, "askers")
    slope = _slopes(r.unionByName(a), distance)

    salted = r.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("pt", "_salt").orderBy("id"))).where(F.col("_r") <= k)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("pt").orderBy("id"))).where(F.col("_r") <= k)
    points = staged(few.groupBy("pt").agg(*(F.first(c).alias(c) for c in columns), F.array_sort(F.collect_list("id")).alias("ids")), "distinct_points")

    def cell(c: str, level: int) -> F.Column:
        return F.floor(F.col(c) / F.lit(within[c] * (1 + 1e-9) / 2**level))  # wider by a trifle: a difference in doubles may be rounded down to the gate

    crowd = points.select(F.explode(F.array(*(F.struct(F.lit(n).alias("level"), *(cell(c, n).alias(f"g_{c}") for c in names)) for n in range(_LEVELS)))).alias("x")).select("x.*")
    most = {x["level"]: x["most"] for x in crowd.groupBy("level", *(f"g_{c}" for c in names)).count().groupBy("level").agg(F.max("count").alias("most")).collect()}
    level = next((n for n in range(_LEVELS) if most.get(n, 0) <= _CELL), _LEVELS - 1) if min(slope.values()) > 0 else 0

    slack = 0.0 if digits is None else 10.0**-digits
    left_over, found = staged(a.groupBy("pt").agg(*(F.first(c).alias(c) for c in columns)), "distinct_askers"), None
    while True:
        asked = left_over.select(F.col("pt").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns), *(F.array(*(cell(c, level) + d for d in (-1, 0, 1))).alias(f"g_{c}") for c in names))
        for c in names:
            asked = asked.withColumn(f"g_{c}", F.explode(f"g_{c}"))
        near = asked.join(points.select("*", *(cell(c, level).alias(f"g_{c}") for c in names)), [f"g_{c}" for c in names])
        for c in names:
            near = near.where(F.abs(F.col(f"a_{c}") - F.col(c)) <= within[c])
        cost = F.sqrt(sum((F.pow(F.col(f"a_{z}") - F.col(z), 2) for z in distance.values()), F.lit(0.0)))
        cost = cost if digits is None else F.round(cost, digits)
        each = near.select("a", cost.alias("cost"), F.explode("ids").alias("b"))
        best = each.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("cost", "b"))).where(F.col("_r") <= k)
        best = staged(best, "nearest")
        sure = min(within[c] / 2**level * slope[c] for c in names)  # what lies outside the block is at least that far
        done = best.groupBy("a").agg(F.count("*").alias("n"), F.max("cost").alias("cost")).where((F.col("n") >= k) & (F.col("cost") < sure - slack)).select("a")
        done = left_over.select(F.col("pt").alias("a")) if level == 0 else staged(done, "settled")
        now = best.join(done, "a", "left_semi")
        found = now if found is None else found.unionByName(now)
        if level == 0:
            break
        left_over = staged(left_over.join(done.withColumnRenamed("a", "pt"), "pt", "left_anti"), "distinct_askers")
        if left_over.isEmpty():
            break
        level -= 1
    return a.select(F.col("id").alias("_id"), F.col("pt").alias("a")).join(found, "a").select(F.col("_id").alias("a"), "b", "cost")


#: Below this share of what is left, a round that decides so little also follows chains.
_SLOW = 0.25


def along_chains(pointers: DataFrame, known: DataFrame) -> DataFrame:
    """(n, yes) for each n of ``pointers(n, f)`` whose chain ends at ``known(n, yes)``: the opposite of what holds for f.

    Pointers lead to what comes earlier, so chains end. Each pass doubles the way that every pointer leads.
    """
    hops = staged(pointers.select("n", F.col("f").alias("to"), F.lit(True).alias("odd")), "chains")
    while True:
        far = hops.select(F.col("n").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        longer = hops.join(far, "to", "left")
        moved = staged(longer.select("n", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), F.col("_to").isNotNull().alias("moved")), "chains")
        hops = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return hops.join(known.select(F.col("n").alias("to"), "yes"), "to").select("n", (F.col("yes") != F.col("odd")).alias("yes"))


def _chained(left: DataFrame, best_a: DataFrame, best_b: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that are taken because all on the chain of their only cheaper neighbours is decided by an edge of ``new``."""
    order = F.struct("cost", "a", "b")
    second_a = left.join(best_a, ["a", "b", "cost"], "left_anti").groupBy("a").agg(F.min(order).alias("x")).select("x.*")
    second_b = left.join(best_b, ["a", "b", "cost"], "left_anti").groupBy("b").agg(F.min(order).alias("x")).select("x.*")
    edge = F.struct("a", "b").alias("n")
    at_b = best_a.join(second_b, ["a", "b", "cost"], "left_semi").join(best_b.select("b", F.struct("a", "b").alias("f")), "b").select(edge, "f")
    at_a = best_b.join(second_a, ["a", "b", "cost"], "left_semi").join(best_a.select("a", F.struct("a", "b").alias("f")), "a").select(edge, "f")
    told = along_chains(at_b.unionByName(at_a), new.select(edge, F.lit(True).alias("yes"))).where("yes")
    return told.join(left.withColumn("n", F.struct("a", "b")), "n").select("a", "b", "cost")


def greedy(edges: DataFrame) -> DataFrame:
    """(a, b, cost): edges taken cheapest first, each end once; ties by a, then b.

    Each round takes all edges that are the cheapest at both ends; these are what a sequential pass would take, too. An
    edge with one cheaper neighbour is taken if and only if that one isn't: where rounds decide little, as on a path of rising
    costs, such chains are followed by doubling pointers, a path of n edges in log n passes. There is no limit of rounds;
    each takes the cheapest edge that is left, at least.
    """
    taken = None
    left = staged(edges.groupBy("a", "b").agg(F.min("cost").alias("cost")), "edges")
    order, n, slow = F.struct("cost", "a", "b"), left.count(), False
    while n:
        best_a = left.groupBy("a").agg(F.min(order).alias("x")).select("x.a", "x.b", "x.cost")
        best_b = left.groupBy("b").agg(F.min(order).alias("x")).select("x.a", "x.b", "x.cost")
        if slow:
            best_a, best_b = staged(best_a, "best"), staged(best_b, "best")
        new = staged(best_a.join(best_b, ["a", "b", "cost"], "left_semi").select("a", "b", "cost"), "matched")
        if slow:
            new = staged(new.unionByName(_chained(left, best_a, best_b, new)), "matched")
        taken = new if taken is None else taken.unionByName(new)
        left = staged(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti").select("a", "b", "cost"), "edges")
        before, n = n, left.count()
        slow = before - n < _SLOW * before
    return left if taken is None else taken


#: Edges whose rows bid together in one task.
PART = 1 << 18


def auction(edges: DataFrame, epsilon: float, shrink: float = 8.0, place: str | None = None) -> DataFrame:
    """(a, b, cost, price): a one-to-one assignment on sparse edges, as many rows as can be matched, at a cost within ``epsilon`` for each row of the least.

    A row may stay alone at a cost above that of any assignment. Rows bid in rounds: a free one takes the column of best value
    (minus cost minus price) from whoever has it, and raises its price by how much it beats the second best, plus a step. The step
    begins large and shrinks by phases down to ``epsilon``; prices are kept over phases. At the end of a phase columns that nobody
    has but that still have a price bid back, for the rows that gain most, or give the price up. Each bid moves a price or a gain by a step
    at least, so both parts end; there is no limit of rounds. ``assignment_gap`` certifies the cost.

    Rows are laid out in parts of at most ``PART`` edges, in the order of ``place`` (a column of the row, the same or close for rows that
    want the same columns), and again half a part further. A task settles the columns that only rows of its part want, at the
    other columns' prices; rounds over all parts are left for the rest.
    """
    most = F.min("cost").cast("double").alias("cost")
    placed = staged(edges.groupBy("a", "b").agg(most, F.min(place if place else F.xxhash64("a")).alias("_place")), "edges")
    edges = placed.select("a", "b", "cost")
    layouts = _layouts(placed)
    alone = alone_cost(edges)
    spark = edges.sparkSession
    shape = f"b {edges.schema['b'].dataType.simpleString()}, price double, a {edges.schema['a'].dataType.simpleString()}, cost double"
    state = spark.createDataFrame([], shape)  # columns with a price or an owner
    if alone is None:
        return edges.select("a", "b", "cost", F.lit(0.0).alias("price"))
    step = max(alone / 4, epsilon)
    while True:
        state = _forward(edges, layouts, staged(state.select("b", "price", *(F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("a", "cost"))), "prices"), alone, step)
        state = _backward(edges, layouts, state, alone, step)
        if step <= epsilon:
            break
        step = max(step / shrink, epsilon)
    return state.where("a is not null").select("a", "b", "cost", "price")


def alone_cost(edges: DataFrame) -> float | None:
    """What a row that stays alone is taken to cost: more than all rows' dearest edges."""
    most = edges.agg(F.max("cost").alias("c"), F.countDistinct("a").alias("n")).first()
    return None if most["c"] is None else 1.0 + (most["n"] + 1) * max(float(most["c"]), 0.0)


def assignment_gap(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """(rows, cost, bound): the assignment's cost, alone rows included, and what no assignment can cost less than, by the prices' dual."""
    alone = alone_cost(edges) or 0.0
    gain = F.max(-F.col("cost") - F.coalesce("price", F.lit(0.0)))
    rows = edges.join(matched.select("b", "price"), "b", "left").groupBy("a").agg(F.greatest(gain, F.lit(-alone)).alias("gain")).agg(F.count("*").alias("rows"), F.sum("gain").alias("gains"))
    own = matched.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("prices"))
    both = rows.join(F.broadcast(own))  # one row each
    return both.select("rows", (F.col("cost") + (F.col("rows") - F.col("n")) * alone).alias("cost"), (-F.col("gains") - F.col("prices")).alias("bound"))


def _two_best(df: DataFrame, by: str, value: str, other: str) -> DataFrame:
    """Each ``by``'s row of greatest ``value`` (ties to the smaller ``other``), with the second greatest value."""
    w = Window.partitionBy(by).orderBy(F.desc(value), other)
    top = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    full = F.struct(*(F.col(c) for c in df.columns))
    both = top.groupBy(by).agg(F.max(F.when(F.col("_r") == 1, full)).alias("x"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("second"))
    return both.select("x.*", "second")


def _layouts(placed: DataFrame) -> list[DataFrame]:
    """(part, a, b, cost, mine): the edges by parts of their rows; mine: all that want the column are of the part. Two layouts, or one if one part holds all."""
    rows = placed.groupBy("a").agg(F.count("*").alias("n"), F.min("_place").alias("p")).select(F.struct("p", "a").alias("o"), "n")
    rows = staged(cumulative(rows, [], "o", ["n"]).select("o.a", (F.col("cum_n") - F.col("n")).alias("at"), "n"), "order")
    out = []
    for shift in (0, PART // 2):
        edges = placed.join(rows.select("a", F.floor((F.col("at") + shift) / PART).alias("part")), "a")
        own = edges.groupBy("b").agg((F.min("part") == F.max("part")).alias("mine"))
        out.append(staged(edges.join(own, "b").select("part", "a", "b", "cost", "mine"), "layout"))
        if rows.where(F.col("at") >= PART).isEmpty():
            break
    return out


def _settled(layout: DataFrame, state: DataFrame, alone: float, step: float, back: bool) -> DataFrame:
    """The state after all bids that need no other part: forward bids of free rows, or ``back`` of empty columns with a price."""
    kind = {c: layout.schema[c].dataType for c in "ab"}
    full = layout.join(state.select("b", "price", F.col("a").alias("_owner")), "b", "left")
    full = full.select("part", "a", "b", "cost", "mine", F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce(F.col("_owner") == F.col("a"), F.lit(False)).alias("has"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = (table.column(c).combine_chunks().dictionary_encode() for c in "ab")
        row, column = (x.indices.to_pylist() for x in (a, b))
        cost, mine, price, has = (table.column(c).to_pylist() for c in ("cost", "mine", "price", "has"))
        wants, wanted = [[] for _ in a.dictionary], [[] for _ in b.dictionary]
        prices, own, owner, taken = [0.0] * len(wanted), [False] * len(wanted), [None] * len(wanted), [None] * len(wants)
        for i, c, x, m, p, h in zip(row, column, cost, mine, price, has, strict=True):
            wants[i].append((c, x))
            wanted[c].append((i, x))
            prices[c], own[c] = p, m
            if h:
                owner[c], taken[i] = (i, x), (c, x)
        changed = _back(wanted, prices, own, owner, taken, alone, step) if back else _bid(wants, prices, own, owner, taken, alone, step)
        at = sorted(changed)
        got = [owner[c] for c in at]
        return pa.table({"b": b.dictionary.take(pa.array(at, pa.int64())), "price": pa.array([prices[c] for c in at], pa.float64()), "a": a.dictionary.take(pa.array([o and o[0] for o in got], pa.int64())), "cost": pa.array([o and o[1] for o in got], pa.float64())})

    shape = f"b {kind['b'].simpleString()}, price double, a {kind['a'].simpleString()}, cost double"
    changed = staged(full.groupBy("part").applyInArrow(run, shape), "changed")
    return staged(state.join(changed.select("b"), "b", "left_anti").unionByName(changed.where("a is not null or price > 0")), "prices")


def _bid(wants: list, prices: list, own: list, owner: list, taken: list, alone: float, step: float) -> set[int]:
    """Bids of a part's free rows one after the other, while the column they want is the part's own; the columns that changed."""
    changed, free = set(), deque(i for i, x in enumerate(taken) if x is None)
    while free:
        i = free.popleft()
        best, second, at, paid = -float("inf"), -alone, None, 0.0
        for c, x in wants[i]:
            v = -x - prices[c]
            if v > best:
                best, second, at, paid = v, max(second, best), c, x
            elif v > second:
                second = v
        if best < -alone or not own[at]:
            continue  # stays alone, or is left for a round over all parts
        if owner[at] is not None:
            taken[owner[at][0]] = None
            free.append(owner[at][0])
        prices[at] += best - second + step
        owner[at], taken[i] = (i, paid), (at, paid)
        changed.add(at)
    return changed


def _back(wanted: list, prices: list, own: list, owner: list, taken: list, alone: float, step: float) -> set[int]:
    """Bids of a part's own columns that have a price and no owner; the columns that changed."""
    changed, empty = set(), deque(c for c in range(len(wanted)) if own[c] and owner[c] is None and prices[c] > 0)
    while empty:
        c = empty.popleft()
        best, second, at, paid = -float("inf"), -float("inf"), None, 0.0
        for i, x in wanted[c]:
            v = -x + (alone if taken[i] is None else taken[i][1] + prices[taken[i][0]])
            if v > best:
                best, second, at, paid = v, best, i, x
            elif v > second:
                second = v
        changed.add(c)
        if best <= step:
            prices[c] = 0.0
            continue
        if taken[at] is not None:
            before = taken[at][0]
            owner[before] = None
            changed.add(before)
            if own[before] and prices[before] > 0:
                empty.append(before)
        prices[c] = max(0.0, second - step)
        owner[c], taken[at] = (at, paid), (c, paid)
    return changed


def _forward(edges: DataFrame, layouts: list[DataFrame], state: DataFrame, alone: float, step: float) -> DataFrame:
    """Rounds of bids of free rows, until each has a column or would rather be alone."""
    out = None  # rows that stay alone
    while True:
        for layout in layouts:
            state = _settled(layout, state, alone, step, False)
        free = edges.join(state.where("a is not null").select("a"), "a", "left_anti")
        free = free if out is None else free.join(out, "a", "left_anti")
        valued = free.join(state.select("b", "price"), "b", "left").withColumn("v", -F.col("cost") - F.coalesce("price", F.lit(0.0)))
        bids = staged(_two_best(valued, "a", "v", "b"), "bids")
        if bids.isEmpty():
            return state
        gave_up = bids.where(F.col("v") < -alone)
        second = F.greatest(F.coalesce("second", F.lit(-alone)), F.lit(-alone))
        offers = bids.where(F.col("v") >= -alone).withColumn("price", F.coalesce("price", F.lit(0.0)) + F.col("v") - second + step)
        if offers.isEmpty():
            return state
        won = offers.groupBy("b").agg(F.max_by(F.struct("a", "cost", "price"), F.struct("price", -F.hash("a"), "a")).alias("x")).select("b", "x.price", "x.a", "x.cost")
        state = staged(state.join(won.select("b"), "b", "left_anti").unionByName(won), "prices")
        if not gave_up.isEmpty():
            out = staged(gave_up.select("a") if out is None else out.unionByName(gave_up.select("a")), "alone")


def _backward(edges: DataFrame, layouts: list[DataFrame], state: DataFrame, alone: float, step: float) -> DataFrame:
    """Rounds of bids of columns that have a price and no owner; a row goes to the one it gains most by, and its own column is left."""
    while True:
        for layout in layouts:
            state = _settled(layout, state, alone, step, True)
        empty = state.where("a is null and price > 0").select("b", "price")
        gains = state.where("a is not null").select("a", (-F.col("cost") - F.col("price")).alias("gain"))
        met = edges.join(empty, "b").join(gains, "a", "left").withColumn("v", -F.col("cost") - F.coalesce("gain", F.lit(-alone)))
        bids = staged(_two_best(met.select("b", "a", "cost", "v"), "b", "v", "a"), "bids")
        if bids.isEmpty():
            return state
        given_up = bids.where(F.col("v") <= step).select("b")
        price = F.greatest(F.lit(0.0), F.coalesce("second", F.lit(float("-inf"))) - step)
        offers = bids.where(F.col("v") > step).withColumn("price", price)
        won = offers.groupBy("a").agg(F.max_by(F.struct("b", "price", "cost"), F.struct(F.col("v") - F.col("price"), -F.hash("b"), "b")).alias("x")).select("x.b", "x.price", "a", "x.cost")
        won = staged(won, "won")
        left = state.join(won.select("b"), "b", "left_anti").join(given_up, "b", "left_anti")
        moved = left.join(won.select(F.col("a").alias("_a")), F.col("a") == F.col("_a"), "left")
        gone = F.col("_a").isNotNull()
        kept = moved.select("b", "price", F.when(~gone, F.col("a")).alias("a"), F.when(~gone, F.col("cost")).alias("cost"))
        state = staged(kept.unionByName(won.select("b", "price", "a", "cost")), "prices")


def first_independent(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, kept): a node is kept when no kept node before it is its neighbour; ``edges(a, b)``: a is before b.

    Each round decides the nodes whose earlier neighbours are all decided, or one of them kept. A node with one undecided
    earlier neighbour is the opposite of it: where rounds decide little, such chains are followed by doubling
    pointers. There is no limit of rounds; each decides the first node that is left, at least.
    """
    edges = staged(edges.select("a", "b").distinct(), "edges")
    state = staged(nodes.select(F.col(key).alias("n")).join(edges.select(F.col("b").alias("n")).distinct(), "n", "left_anti").withColumn("kept", F.lit(True)), "decided")
    left = staged(edges.select(F.col("b").alias("n")).distinct(), "undecided")
    n, slow = left.count(), False
    while n:
        seen = edges.join(left, F.col("b") == F.col("n")).drop("n").join(state.toDF("a", "kept"), "a", "left")
        unknown = F.col("kept").isNull()
        said = seen.groupBy("b").agg(F.count_if(unknown).alias("open"), F.min(F.when(unknown, F.col("a"))).alias("first"), F.max(F.coalesce("kept", F.lit(False))).alias("hit"))
        said = staged(said, "said") if slow else said
        new = staged(said.where("open = 0 or hit").select(F.col("b").alias("n"), (~F.col("hit")).alias("kept")), "new")
        if slow:
            chains = along_chains(said.where("open = 1 and not hit").select(F.col("b").alias("n"), F.col("first").alias("f")), new.withColumnRenamed("kept", "yes"))
            new = staged(new.unionByName(chains.toDF("n", "kept")), "new")
        state = staged(state.unionByName(new), "decided")
        left = staged(left.join(new.select("n"), "n", "left_anti"), "undecided")
        before, n = n, left.count()
        slow = before - n < _SLOW * before
    return state.withColumnRenamed("n", key)


def escalated(left: DataFrame, right: DataFrame, matched: DataFrame, key: str, length: str, within: dict[str, float], distance: dict[str, str], k: int, factor: float = 1.5) -> DataFrame:
    """Matches for the rows that were left over: gates wider by ``factor``, partners at least as long as the leftovers' median, used rows excluded."""
    rest = left.join(matched.select(F.col("a").alias(key)), key, "left_anti")
    floor = rest.agg(F.percentile(length, 0.5).alias("_floor"))
    free = right.join(matched.select(F.col("b").alias(key)), key, "left_anti").join(F.broadcast(floor)).where(F.col(length) >= F.col("_floor")).drop("_floor")  # one row
    return greedy(candidates(rest, free, key, {c: w * factor for c, w in within.items()}, distance, k))
