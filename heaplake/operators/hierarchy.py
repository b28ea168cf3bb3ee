"""Parent links to full hierarchies: contract, solve the quotient, expand.

Nodes are placed in buckets of bounded size; a small group (the tree of one dump) lies in one bucket whole. Within a
bucket all parent chains are followed at once by pointer doubling: each node learns its fragment exit (the first ancestor
in another bucket), or its root, or the circle it runs into. The exits form a smaller forest whose links are fragments;
it is solved by the same step with other buckets, and its solution is joined back to the fragments. In groups of more
than one bucket nodes are placed by random mating (a "tail" goes to the bucket of its parent if that is a "head"), so
about a quarter of all links becomes local whatever the shape, and even one endless chain shrinks by a constant factor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_few, materialise

#: Nodes that one task holds.
CAPACITY = 1_500_000
#: Ids of paths that a task holds at a time (64 MB).
_PIECE = 1 << 23

#: ``dist``: links from node to parent, or, where parent is null, to ``top``, the last node of the path; ``low``: the
#: smallest id before parent; ``seg``: the ids before parent; ``cycle``: the circle that the path is known to run into.
_LEVEL = "tree string, grp long, node long, parent long, dist long, top long, low long, cycle long, on_cycle boolean"
_LEVEL_WITH_PATHS = _LEVEL + ", seg array<long>"
_KEY = ["tree", "grp", "node"]


def _ints(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A long column's values (0 where null) and where it isn't null. Never by way of floats, which round large ids."""
    column = table.column(name).combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _nullable(values: np.ndarray, given: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=~given)


class _Links:
    """Local positions of the nodes of one bucket and of their parents (``end``: not in this bucket)."""

    def __init__(self, table: pa.Table):
        n = self.end = table.num_rows
        trees = table.column("tree").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("int64")
        groups, at = np.unique(_ints(table, "grp")[0], return_inverse=True)
        groups = trees * len(groups) + at
        node = _ints(table, "node")[0]
        self.up, self.linked = _ints(table, "parent")
        ids, at = np.unique(np.concatenate([node, self.up]), return_inverse=True)
        own = groups * np.int64(len(ids)) + at[:n]
        up = np.where(self.linked, groups * np.int64(len(ids)) + at[n:], -1)
        order = np.argsort(own, kind="stable")
        spot = np.minimum(np.searchsorted(own[order], up), n - 1)
        self.parent = np.append(np.where(own[order][spot] == up, order[spot], n), n)


def _joined_segments(segs: pa.ListArray, links: _Links, rows: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, int, pa.ListArray]]:
    """Pieces (from, to, a list per node) of at most some ``_PIECE`` values: for ``rows`` the segments met on ``steps``
    links upward, joined in order; null for the others."""
    start, length = segs.offsets.to_numpy()[:-1].astype("int64"), np.diff(segs.offsets.to_numpy()).astype("int64")
    flat = segs.values.to_numpy(zero_copy_only=False)
    # values per node: as many as on its path, summed by doubling
    jump, sums = links.parent.copy(), np.append(length, 0)
    wanted = np.zeros(links.end + 1, "int64")
    wanted[rows] = steps
    sizes = np.zeros(links.end, "int64")
    at, bit = np.arange(links.end + 1), 1
    while bit <= (int(steps.max()) if len(steps) else 0):
        moving = (wanted & bit) != 0
        sizes += np.where(moving[:-1], sums[at][:-1], 0)
        at = np.where(moving, jump[at], at)
        sums, jump = sums + sums[jump], jump[jump]
        bit *= 2
    begin = 0
    while begin < links.end:
        ends = np.cumsum(sizes[begin:])
        end = begin + max(1, int(np.searchsorted(ends, _PIECE, side="right")))
        mine = rows[(rows >= begin) & (rows < end)]
        here, togo, active, whose, met = mine.copy(), wanted[mine].copy(), np.arange(len(mine)), [], []
        while len(active):
            whose.append(active)
            met.append(here[active])
            here[active] = links.parent[here[active]]
            togo[active] -= 1
            active = active[togo[active] > 0]
        owner = np.concatenate(whose) if whose else np.empty(0, "int64")
        source = np.concatenate(met) if met else np.empty(0, "int64")
        order = np.argsort(owner, kind="stable")
        source = source[order]
        n = length[source]
        values = flat[np.repeat(start[source] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        given = np.isin(np.arange(begin, end), mine)
        offsets = np.append(0, np.cumsum(sizes[begin:end]))
        yield begin, end, pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~given, False)), pa.array(values, pa.int64()))
        begin = end


def _solve_bucket(batches: Iterator[pa.RecordBatch], paths: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """Every node's fragment within its bucket. ``whole``: an absent parent does not exist and ends the path."""
    table = pa.Table.from_batches(list(batches))
    links = _Links(table)
    n = end = links.end
    jump, last = links.parent.copy(), np.arange(n + 1)
    hops = np.append(_ints(table, "dist")[0], 0)
    low = np.append(_ints(table, "low")[0], np.iinfo("int64").max)
    steps = np.append(np.ones(n, "int64"), 0)
    reach = 1
    while reach <= n and (jump[:n] != end).any():
        moving = jump != end
        hops = hops + np.where(moving, hops[jump], 0)
        steps = steps + np.where(moving, steps[jump], 0)
        low = np.where(moving, np.minimum(low, low[jump]), low)
        last = np.where(moving, last[jump], last)
        jump = jump[jump]
        reach *= 2
    stuck = jump[:n] != end  # after more than n links still on the way: the links run in a circle
    on = np.zeros(n, bool)
    on[jump[:n][stuck]] = True  # after so many links exactly the nodes of circles are reached, and low covers each circle
    tip = last[:n]
    absent = links.linked[tip]
    cycles, known = (x[tip] for x in _ints(table, "cycle"))
    free = np.flatnonzero(~stuck & ~known)
    out = [
        *[table.column(c) for c in _KEY],
        _nullable(links.up[tip], absent & ~stuck & (not whole)),
        pa.array(hops[:n] - (absent & ~stuck & whole), pa.int64()),
        pa.array(_ints(table, "top")[0][tip], pa.int64()),
        pa.array(low[:n], pa.int64()),
        _nullable(np.where(stuck, low[np.where(stuck, jump[:n], end)], cycles), stuck | known),
        pa.array(on),
    ]
    names = [c.split()[0] for c in (_LEVEL_WITH_PATHS if paths else _LEVEL).split(", ")]
    solved = pa.table(out, names=names[: len(out)])
    if not paths:
        yield from solved.to_batches()
        return
    for begin, end, lists in _joined_segments(table.column("seg").combine_chunks(), links, free, steps[free]):
        piece = solved.slice(begin, end - begin).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=names)


def _bucket_solver(paths: bool, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _solve_bucket(batches, paths, whole)

    return run


def _mark_bucket(table: pa.Table) -> pa.Table:
    """Spread each given circle id (column ``mark``) upward along the local links."""
    links = _Links(table)
    ids, known = (x.copy() for x in _ints(table, "mark"))
    front = np.flatnonzero(known)
    while len(front):
        above = links.parent[front]
        new = (above < links.end) & ~known[np.minimum(above, links.end - 1)]
        ids[above[new]] = ids[front[new]]
        known[above[new]] = True
        front = np.unique(above[new])
    return table.select(_KEY).append_column("ring", pa.array(ids, pa.int64())).filter(pa.array(known))


def _place(level: DataFrame, capacity: int, round_: int) -> tuple[DataFrame, bool]:
    """``level`` with a column ``bucket`` of at most ``capacity`` nodes, and whether every group lies in one bucket whole.

    Loads are counted, not estimated: buckets are doubled until none is too full.
    """
    sizes = materialise(level.groupBy("tree", "grp").count(), "sizes")
    total, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    buckets = max(1, -(-total // capacity), min(total // 20_000, 4 * level.sparkSession.sparkContext.defaultParallelism))
    small = capacity if largest <= capacity else capacity // 4

    def home(n: int) -> Column:
        return F.pmod(F.xxhash64("tree", "grp", F.lit(n)), F.lit(n))

    def fullest(placed: DataFrame) -> int:
        return placed.groupBy("bucket").agg(F.sum("count").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    while fullest(sizes.where(F.col("count") <= small).withColumn("bucket", home(buckets))) > capacity:
        buckets *= 2
    if largest <= capacity:
        return level.withColumn("bucket", home(buckets)), True
    big = sizes.where(F.col("count") > small).select("tree", "grp", F.ceil(F.col("count") / capacity).alias("least"))
    # the children of a node with very many stay where they are: all of them would be one bucket's load
    crowded = level.where("parent is not null").groupBy("tree", "grp", "parent").count().where(F.col("count") > capacity // 8).select("tree", "grp", "parent", F.lit(True).alias("crowded"))
    joined = join_few(join_few(level, big, ["tree", "grp"], "left"), materialise(crowded, "crowded"), ["tree", "grp", "parent"], "left")
    joined = materialise(joined, "sized")
    times = 2
    while True:
        parts = F.col("least") * times

        def spot(v: str, parts: Column = parts) -> Column:
            block = F.shiftright(F.col(v), 9) if capacity >= 100_000 else F.col(v)  # neighbouring ids together, where a bucket holds many such blocks
            return F.xxhash64("tree", "grp", F.pmod(F.xxhash64(block, F.lit(round_)), parts))

        def head(v: str) -> Column:
            return F.pmod(F.xxhash64(F.col(v), F.lit(round_ + 1_000)), F.lit(2)) == 0

        mated = F.when(F.col("parent").isNotNull() & F.col("crowded").isNull() & ~head("node") & head("parent"), spot("parent")).otherwise(spot("node"))
        placed = joined.withColumn("bucket", F.when(F.col("least").isNull(), home(buckets)).otherwise(mated))  # a part of a big group is a bucket of its own
        if fullest(placed.withColumn("count", F.lit(1))) <= capacity or times > 256:
            return placed.drop("least", "crowded"), False
        times *= 2


def _solve(level: DataFrame, capacity: int, paths: bool, round_: int) -> DataFrame:
    """The rows of ``level`` with every path followed to its end: parent is null everywhere."""
    placed, whole = _place(level, capacity, round_)
    if not whole:
        placed = materialise(placed, "placed")
    fragments = placed.groupBy("bucket").applyInArrow(_bucket_solver(paths, whole), _LEVEL_WITH_PATHS if paths else _LEVEL)
    if whole:
        return fragments
    fragments = materialise(fragments, "fragments")
    exits = fragments.where("parent is not null").select("tree", "grp", F.col("parent").alias("node")).distinct()
    quotient = materialise(fragments.join(exits, _KEY, "left_semi").withColumn("on_cycle", F.lit(False)), "quotient")
    solved = materialise(_solve(quotient, capacity, paths, round_ + 1), "solved")

    # circles that only the quotient shows: the fragments between their exits lie on them too
    rings = solved.where("on_cycle").select(*_KEY, F.col("cycle").alias("mark"))
    on_ring = placed.select(*_KEY, "parent", "bucket").join(rings, _KEY, "left").groupBy("bucket").applyInArrow(_mark_bucket, "tree string, grp long, node long, ring long")
    far = solved.select("tree", "grp", F.col("node").alias("parent"), *[F.col(c).alias(f"s_{c}") for c in ("dist", "top", "cycle", *(["seg"] if paths else []))], F.lit(True).alias("there"))
    spread = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))  # many fragments may share an exit
    joined = fragments.withColumn("salt", F.pmod(F.hash("node"), F.lit(8))).join(spread, ["tree", "grp", "parent", "salt"], "left").join(on_ring, _KEY, "left")
    there, open_ = F.col("there").isNotNull(), F.col("parent").isNotNull()
    cycle = F.coalesce("ring", "cycle", "s_cycle")
    return joined.select(
        *_KEY,
        F.lit(None).cast("long").alias("parent"),
        (F.col("dist") + F.when(there, F.col("s_dist")).when(open_, F.lit(-1)).otherwise(0)).alias("dist"),
        F.when(there, F.col("s_top")).otherwise(F.col("top")).alias("top"),
        "low",
        cycle.alias("cycle"),
        (F.col("on_cycle") | F.col("ring").isNotNull()).alias("on_cycle"),
        *([F.when(cycle.isNull(), F.when(there, F.concat("seg", "s_seg")).otherwise(F.col("seg"))).alias("seg")] if paths else []),
    )


def links(df: DataFrame, tree: str, group: str, node: str, parent: str, delivered: str) -> DataFrame:
    """The parent links of one table in the common form that :func:`hierarchy` takes."""
    return df.select(
        F.lit(tree).alias("tree"), F.col(group).cast("long").alias("grp"), F.col(node).cast("long").alias("node"),
        F.col(parent).cast("long").alias("parent"), F.col(delivered).cast("timestamp").alias("delivered"),
    )


def hierarchy(rows: DataFrame, capacity: int = CAPACITY, paths: bool = False, max_path_values: int = 1 << 36) -> DataFrame:
    """Every node of every tree with its root, depth, path and, where its path runs into a circle, that circle's id.

    ``rows`` comes from :func:`links` (several tables may be united). Returns tree, grp, node, root, depth, path (from the
    node to its root, null unless ``paths``), cycle_id (smallest id on the circle) and on_cycle.

    Defined cases: repeated deliveries of a node are one, the first decides (of equal times the smallest parent; a null
    time comes first). Rows without group or node are skipped. A parent that is null, 0 or no node of the same tree and
    group ends the path, the node is a root of depth 0. A node that is its own parent is a circle of one. Nodes on or
    leading into a circle have no root, depth or path. ``capacity`` bounds the nodes that one task holds.

    Paths hold as many ids as the sum of all depths, quadratic in the length of a chain. Where a group is larger than
    ``capacity`` that sum is found first (without paths the work is linear), and more than ``max_path_values`` ids are a
    ValueError instead of a full disk. A task writes paths in pieces of bounded size.
    """
    at = F.coalesce(F.unix_micros("delivered"), F.lit(-(1 << 62)))
    first = rows.where("grp is not null and node is not null").groupBy("tree", "grp", "node").agg(F.min(F.struct(at.alias("at"), "parent")).alias("f"))
    parent = F.when(F.col("f.parent") != 0, F.col("f.parent"))
    level = first.select(
        *_KEY,
        parent.alias("parent"),
        F.when(parent.isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("node").alias("top"),
        F.col("node").alias("low"),
        F.lit(None).cast("long").alias("cycle"),
        F.lit(False).alias("on_cycle"),
        *([F.array("node").alias("seg")] if paths else []),
    )
    if paths:
        level = materialise(level, "links")
        _refuse_endless_paths(level.drop("seg"), capacity, max_path_values)
    solved = _solve(level, capacity, paths, 0)
    free = F.col("cycle").isNull()
    return solved.select(
        *_KEY, F.when(free, F.col("top")).alias("root"), F.when(free, F.col("dist")).alias("depth"),
        F.when(free, F.col("seg") if paths else F.lit(None).cast("array<long>")).alias("path"), F.col("cycle").alias("cycle_id"), "on_cycle",
    )


def _refuse_endless_paths(level: DataFrame, capacity: int, most: int) -> None:
    largest = level.groupBy("tree", "grp").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if not largest["n"] or largest["n"] * largest["most"] <= most:  # no shape of these groups has more
        return
    ids = _solve(level, capacity, False, 0).where("cycle is null").agg(F.sum(F.col("dist") + 1)).first()[0] or 0
    if ids > most:
        raise ValueError(f"the paths hold {ids:,} ids, more than max_path_values={most:,}: ask for depth and root without paths")


# --- sums over subtrees --------------------------------------------------------------------------------------------


def sum_subtrees(parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each node's weight and those of all nodes below it. ``parent``: places, -1 at roots. Nodes on circles keep their own."""
    total, waiting = weight.astype("int64"), np.bincount(parent[parent >= 0], minlength=len(parent))
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        above = parent[ready]
        ready, above = ready[above >= 0], above[above >= 0]
        np.add.at(total, above, total[ready])
        np.subtract.at(waiting, above, 1)
        above = np.unique(above)
        ready = above[waiting[above] == 0]
    return total


def _sums(table: pa.Table) -> pa.Table:
    links = _Links(table)
    total = sum_subtrees(np.where(links.parent[:-1] == links.end, -1, links.parent[:-1]), _ints(table, "weight")[0])
    return table.select(_KEY).append_column("total", pa.array(total, pa.int64()))


def _tips(table: pa.Table) -> pa.Table:
    """The top node of each node's fragment in its bucket, and the sum below each node within the bucket."""
    links = _Links(table)
    n = links.end
    tip = _climb(links.parent, n)
    total = _ints(_sums(table), "total")[0]
    node = _ints(table, "node")[0]
    return table.select([*_KEY, "parent"]).append_column("tip", pa.array(node[tip], pa.int64())).append_column("total", pa.array(total, pa.int64()))


def _climb(parent: np.ndarray, n: int) -> np.ndarray:
    """The last place before ``n`` on each way upward; places on circles stay anywhere on them."""
    jump, last, reach = parent.copy(), np.arange(n + 1), 1
    while reach <= n and (jump[:n] != n).any():
        last = np.where(jump != n, last[jump], last)
        jump = jump[jump]
        reach *= 2
    return last[:n]


_SUMS = "tree string, grp long, node long, total long"


def subtree_sums(rows: DataFrame, capacity: int = CAPACITY, round_: int = 0) -> DataFrame:
    """tree, grp, node and total: the weights of a node and of everything below it.

    ``rows``: tree, grp, node (unique), parent (null or absent at roots) and weight. Groups up to ``capacity`` are added up
    in one task; larger ones fragment by fragment: local sums, then the sums of the smaller forest of fragments, whose
    totals are added where they hang and carried upward within each fragment. Work is linear in the nodes whatever their
    depth, and no row holds a path. Nodes on circles keep what hangs on them outside the circle or less.
    """
    level = rows.select(*_KEY, "parent", F.col("weight").cast("long").alias("weight"))
    placed, whole = _place(level, capacity, round_)
    if whole:
        return placed.groupBy("bucket").applyInArrow(_sums, _SUMS)
    placed = materialise(placed, "placed")
    parts = materialise(placed.groupBy("bucket").applyInArrow(_tips, "tree string, grp long, node long, parent long, tip long, total long"), "tips")
    tips = parts.where("node = tip")
    over = parts.select("tree", "grp", F.col("node").alias("parent"), F.col("tip").alias("above"))
    hung = materialise(tips.join(over, ["tree", "grp", "parent"], "left").select(*_KEY, "parent", "above", "total"), "fragments")
    totals = subtree_sums(hung.select(*_KEY, F.col("above").alias("parent"), F.col("total").alias("weight")), capacity, round_ + 1)
    more = hung.where("above is not null").join(totals.select(*_KEY, F.col("total").alias("whole")), _KEY).groupBy("tree", "grp", F.col("parent").alias("node")).agg(F.sum("whole").alias("more"))
    added = placed.join(more, _KEY, "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0))).drop("more")
    return materialise(added.groupBy("bucket").applyInArrow(_sums, _SUMS), "sums")


def descendants(solved: DataFrame, of: Sequence[int] | None = None) -> DataFrame:
    """One row per node and ancestor from a :func:`hierarchy` with paths: all descendants of every node.

    With ``of`` only the descendants of those nodes. Nodes on or leading into circles have none and are none.
    """
    pairs = solved.where("path is not null").select("tree", "grp", F.col("node"), F.posexplode("path").alias("distance", "ancestor")).where("distance > 0")
    return pairs if of is None else pairs.where(F.col("ancestor").isin(list(of)))
