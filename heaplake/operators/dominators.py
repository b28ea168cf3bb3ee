"""Immediate dominators from one virtual root, and retained sizes.

Graphs of up to ``capacity`` objects and references are solved by one task with arrays (a fixpoint over reverse
post-order). Larger ones are taken apart until every part is that small:

1. An object with one referrer is dominated by it. Such objects form trees; subtrees from which nothing else is referred
   to are done, and chains without branches are drawn together, so a list of any length is one link (:func:`_reduced`).
2. What is left is coloured by the roots that reach it, on the heads of these trees only. What one root alone reaches is a
   region of its own, dominated by that root; objects that several roots reach and that are referred to from such a
   region have no dominator but the virtual root, and are the roots of the shared rest (:func:`_split`).
3. Regions of up to ``capacity`` are solved side by side, many to a task; larger ones are taken apart again, with the
   objects that their root refers to as roots.

Retained sizes are sums over the dominator tree, fragment by fragment; see :func:`heaplake.operators.hierarchy.subtree_sums`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_few, materialise
from . import hierarchy as trees
from .hierarchy import sum_subtrees  # noqa: F401 - used with solve_dominators on arrays

#: Objects and references that one task may hold: some 100 MB of arrays and lists.
CAPACITY = 1_000_000
_FOUND = "object_id long, dominator_id long"


def solve_dominators(nodes: np.ndarray, source: np.ndarray, target: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reachable ids and their immediate dominators (0: the virtual root).

    ``source`` and ``target`` are ids of existing nodes. Iterates the intersection of predecessors' dominators in reverse
    post-order until nothing changes.
    """
    ids = np.unique(nodes)
    n = len(ids)
    s, t, r = np.searchsorted(ids, source), np.searchsorted(ids, target), np.searchsorted(ids, np.unique(roots))
    order = np.argsort(s, kind="stable")
    start, out = np.searchsorted(s[order], np.arange(n + 1)).tolist(), t[order].tolist()
    state, post = [0] * n, []
    for root in r.tolist():
        if state[root]:
            continue
        stack = [(root, start[root])]
        state[root] = 1
        while stack:
            v, at = stack.pop()
            while at < start[v + 1] and state[out[at]]:
                at += 1
            if at == start[v + 1]:
                post.append(v)
            else:
                w = out[at]
                state[w] = 1
                stack.append((v, at + 1))
                stack.append((w, start[w]))
    top = n  # the virtual root has the highest number
    number = [-1] * n + [len(post)]
    for i, v in enumerate(post):
        number[v] = i
    back = np.argsort(t, kind="stable")
    first, into = np.searchsorted(t[back], np.arange(n + 1)).tolist(), s[back].tolist()
    idom: list[int] = [-1] * n + [top]
    for root in r.tolist():
        idom[root] = top
    fixed = set(r.tolist())
    changed = True
    while changed:
        changed = False
        for v in reversed(post):
            if v in fixed:
                continue
            new = -1
            for u in into[first[v] : first[v + 1]]:
                if number[u] < 0 or idom[u] < 0:
                    continue
                if new < 0:
                    new = u
                    continue
                while new != u:
                    while number[new] < number[u]:
                        new = idom[new]
                    while number[u] < number[new]:
                        u = idom[u]
            if new != idom[v]:
                idom[v] = new
                changed = True
    reached = np.array(post, dtype="int64")
    found = np.array([idom[v] for v in post], dtype="int64")
    return ids[reached] if n else reached, np.where(found == top, 0, ids[np.minimum(found, n - 1)]) if n else found


def _region_solver(table: pa.Table) -> pa.Table:
    """The dominators within some whole regions; what has none there has the region's own object."""
    kind, region, a, b = (table.column(c).combine_chunks() for c in ("kind", "region", "a", "b"))
    kind, region, a, b = kind.to_numpy(), region.to_numpy(), a.to_numpy(), b.fill_null(0).to_numpy()
    node = kind == 0
    at, idom = solve_dominators(a[node], a[kind == 1], b[kind == 1], a[kind == 2])
    order = np.argsort(a[node])
    own = region[node][order][np.searchsorted(a[node][order], at)] if len(at) else at
    return pa.table({"object_id": pa.array(at, pa.int64()), "dominator_id": pa.array(np.where(idom == 0, own, idom), pa.int64())})


def _solved(work: DataFrame, edges: DataFrame, sizes: DataFrame, capacity: int) -> DataFrame:
    """Regions of up to ``capacity`` each, many to a task; the loads of tasks are counted and none is above ``capacity``."""
    buckets = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // max(1, capacity // 2)))

    def spot(n: int) -> Column:
        return F.pmod(F.xxhash64("region", F.lit(n)), F.lit(n))

    while buckets > 1 and (sizes.groupBy(spot(buckets).alias("bucket")).agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0) > max(capacity, 1):
        buckets *= 2
    none = F.lit(None).cast("long").alias("b")
    rows = (
        work.select(F.lit(0).cast("byte").alias("kind"), "region", F.col("node").alias("a"), none)
        .unionByName(edges.select(F.lit(1).cast("byte").alias("kind"), "region", "a", "b"))
        .unionByName(work.where("root").select(F.lit(2).cast("byte").alias("kind"), "region", F.col("node").alias("a"), none))
    )
    return rows.groupBy(spot(buckets).alias("bucket")).applyInArrow(_region_solver, _FOUND)


def _forest(work: DataFrame, edges: DataFrame) -> DataFrame:
    """``work`` with ``only`` (the one referrer of what isn't a root) and ``shared`` (several referrers)."""
    referrers = edges.groupBy("region", F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("a"))
    one = ~F.col("root") & (F.col("n") == 1)
    return work.join(referrers, ["region", "node"], "left").select("region", "node", "root", F.when(one, F.col("a")).alias("only"), (~F.col("root") & F.coalesce(F.col("n") > 1, F.lit(False))).alias("shared"))


def _tops(rows: DataFrame, parent: str, out: str) -> DataFrame:
    """region, node and the last node upward along ``parent``; nodes on circles are left out (nothing leads there)."""
    linked = rows.select(F.lit("heads").alias("tree"), F.col("region").alias("grp"), "node", F.col(parent).alias("parent"), F.lit(None).cast("timestamp").alias("delivered"))
    return trees.hierarchy(linked).where("root is not null").select(F.col("grp").alias("region"), "node", F.col("root").alias(out))


def _reduced(work: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A smaller graph with the same dominators of shared objects, and region, node, only and top of all with one referrer.

    Kept are roots, shared objects, and in the trees of objects with one referrer those that refer to shared objects or
    are the last that lead to several of them.
    """
    forest = materialise(_forest(work, edges), "forest")
    shared = forest.where("shared").select("region", F.col("node").alias("b"))
    crossing = materialise(edges.join(shared, ["region", "b"], "left_semi").select("region", "a", "b"), "crossing")
    exits = crossing.select("region", F.col("a").alias("node")).distinct().withColumn("exit", F.lit(True))
    weighed = materialise(forest.join(exits, ["region", "node"], "left").withColumn("exit", F.coalesce("exit", F.lit(False))), "exits")
    below = trees.subtree_sums(weighed.select(F.lit("exits").alias("tree"), F.col("region").alias("grp"), "node", F.col("only").alias("parent"), F.col("exit").cast("long").alias("weight")))
    below = below.select(F.col("grp").alias("region"), "node", "total")
    kept = materialise(weighed.join(below, ["region", "node"]).where("root or shared or (only is not null and total > 0)").drop("total"), "kept")
    branches = kept.where("only is not null").groupBy("region", F.col("only").alias("node")).agg(F.count("*").alias("branches"))
    marked = kept.join(branches, ["region", "node"], "left").withColumn("passing", F.col("only").isNotNull() & ~F.col("exit") & (F.coalesce("branches", F.lit(0)) == 1))
    marked = materialise(marked.withColumn("next", F.when(F.col("passing"), F.col("only"))), "marked")
    nearest = _tops(marked, "next", "above").select("region", F.col("node").alias("only"), "above")
    links = marked.where("only is not null and not passing").join(nearest, ["region", "only"]).select("region", F.col("above").alias("a"), F.col("node").alias("b"))
    single = forest.where("only is not null").join(_tops(forest, "only", "top"), ["region", "node"]).select("region", "node", "only", "top")
    return marked.where("not passing").select("region", "node", "root"), crossing.unionByName(links), materialise(single, "single")


def _split(work: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions one level further apart: the next objects and references, and the dominators of the roots."""
    forest = materialise(_forest(work, edges), "forest")
    tops = materialise(_tops(forest, "only", "top"), "tops")
    shared = forest.where("shared").select("region", F.col("node").alias("b"))
    between = edges.join(shared, ["region", "b"], "left_semi").join(tops.select("region", F.col("node").alias("a"), "top"), ["region", "a"])
    between = materialise(between.where("top <> b").select("region", "top", "b").distinct(), "between")

    # colours of the heads: the root that reaches one, or several; a colour changes twice at most
    front = materialise(work.where("root").select("region", F.col("node").alias("top"), F.col("node").alias("colour"), F.lit(False).alias("several")), "colours")
    seen = front
    while n := front.count():
        sent = join_few(between, front, ["region", "top"], rows=n).groupBy("region", F.col("b").alias("top")).agg(F.min("colour").alias("colour"), F.max("colour").alias("_most"), F.max("several").alias("_several"))
        sent = sent.select("region", "top", "colour", (F.col("_several") | (F.col("colour") != F.col("_most"))).alias("several"))
        held = seen.select("region", "top", F.col("colour").alias("_own"), F.col("several").alias("_had"))
        news = sent.join(held, ["region", "top"], "left").where("_own is null or (not _had and (several or colour <> _own))")
        front = materialise(news.select("region", "top", "colour", (F.col("several") | F.coalesce(F.col("colour") != F.col("_own"), F.lit(False))).alias("several")), "front")
        seen = materialise(seen.join(front, ["region", "top"], "left_anti").unionByName(front), "colours")

    state = work.join(tops, ["region", "node"]).join(seen, ["region", "top"]).select("region", "node", "root", F.when(~F.col("several"), F.col("colour")).alias("colour"))
    state = materialise(state, "state")
    there = edges.join(state.where("not root").select("region", F.col("node").alias("b"), F.col("colour").alias("cb")), ["region", "b"])
    there = there.join(state.select("region", F.col("node").alias("a"), F.col("colour").alias("ca")), ["region", "a"])
    home = F.coalesce("cb", "region")
    enters = F.when(F.col("cb").isNull(), F.col("ca").isNotNull()).otherwise(F.col("a") == F.col("cb"))
    there = materialise(there.select(home.alias("region"), "a", "b", enters.alias("enters")), "inside")
    entered = there.where("enters").select("region", F.col("b").alias("node")).distinct().withColumn("root", F.lit(True))
    following = state.where("not root").select(F.coalesce("colour", "region").alias("region"), "node").join(entered, ["region", "node"], "left")
    done = state.where("root").select(F.col("node").alias("object_id"), F.col("region").alias("dominator_id"))
    return following.withColumn("root", F.coalesce("root", F.lit(False))), there.where("not enters").select("region", "a", "b"), done


def _divided(work: DataFrame, edges: DataFrame, capacity: int) -> DataFrame:
    """The dominators of all regions; every round takes the regions above ``capacity`` one level further apart."""
    found = []
    while True:
        roots = work.where("root").select("region", F.col("node").alias("b"))
        work, edges = materialise(work, "work"), materialise(edges.join(roots, ["region", "b"], "left_anti").select("region", "a", "b"), "inner")
        sizes = work.groupBy("region").count().unionByName(edges.groupBy("region").count()).groupBy("region").agg(F.sum("count").alias("size"))
        sizes = materialise(sizes, "sizes")
        large = sizes.where(F.col("size") > capacity).select("region")
        if not large.limit(1).count():
            return reduce(DataFrame.unionByName, [*found, _solved(work, edges, sizes, capacity)])
        few = [join_few(df, large, ["region"], "left_anti") for df in (work, edges)]
        found.append(materialise(_solved(*few, sizes.where(F.col("size") <= capacity), capacity), "regions"))
        work, edges, done = _split(*[join_few(df, large, ["region"], "left_semi") for df in (work, edges)])
        found.append(done)


def dominators(nodes: DataFrame, refs: DataFrame, gc_root: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """object_id and dominator_id of every object that the roots reach; 0 for roots and for what several roots share.

    ``nodes``: object_id (repeats allowed). References from or to objects that aren't there are left out. With more than
    ``capacity`` references and objects the graph is taken apart, and no task holds more than that of it. Rounds then grow
    with the depth of shared objects among the heads, not with chains; a region that stays above ``capacity`` (one circle
    of mutual references that large) loses only its roots in a round.
    """
    node = nodes.select(F.col("object_id").alias("node")).distinct()
    known = materialise(node.join(gc_root.select(F.col("object_id").alias("node"), F.lit(True).alias("root")).distinct(), "node", "left").select(F.lit(0).cast("long").alias("region"), "node", F.coalesce("root", F.lit(False)).alias("root")), "objects")
    edge = refs.select(F.col("from_object_id").alias("a"), F.col("to_object_id").alias("b")).where("a <> b").distinct()
    inner = edge.join(known.where("not root").select(F.col("node").alias("b")), "b", "left_semi").join(known.select(F.col("node").alias("a")), "a", "left_semi")
    edges = materialise(inner.select(F.lit(0).cast("long").alias("region"), "a", "b"), "references")  # a root needs no dominator, so what refers to it doesn't count
    size = known.count() + edges.count()
    if size <= capacity:
        return _solved(known, edges, known.sparkSession.createDataFrame([(0, size)], "region long, size long"), capacity)
    work, links, single = _reduced(known, edges)
    found = materialise(_divided(work, links, capacity), "dominators")
    # of the smaller graph only what is shared or a root counts: who has one referrer is dominated by it, if its tree is reached
    first = known.where("root").select(F.col("node").alias("top")).unionByName(found.select(F.col("object_id").alias("top"))).distinct()
    own = found.join(single.select(F.col("node").alias("object_id")), "object_id", "left_anti")
    return own.unionByName(single.join(first, "top", "left_semi").select(F.col("node").alias("object_id"), F.col("only").alias("dominator_id")))


def retained_sizes(idom: DataFrame, shallow: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """object_id and retained_bytes: the shallow bytes of everything that an object dominates, itself included.

    Trees above ``capacity`` are added up fragment by fragment, with work linear in the objects whatever their depth.
    """
    sizes = shallow.groupBy("object_id").agg(F.min("shallow").alias("shallow"))
    rows = idom.select("object_id", "dominator_id").join(sizes, "object_id", "left").select(
        F.lit("dominators").alias("tree"), F.lit(0).cast("long").alias("grp"), F.col("object_id").alias("node"), F.nullif("dominator_id", F.lit(0).cast("long")).alias("parent"),
        F.coalesce("shallow", F.lit(0).cast("long")).alias("weight"),
    )
    sums = trees.subtree_sums(materialise(rows, "owned"), max(8, capacity))
    return sums.select(F.col("node").alias("object_id"), F.col("total").alias("retained_bytes"))


def dominatees(idom: DataFrame, retained: DataFrame, object_id: int) -> DataFrame:
    """The objects that one object directly dominates, with their retained sizes, largest first."""
    return idom.where(F.col("dominator_id") == object_id).join(retained, "object_id").orderBy(F.desc("retained_bytes"), "object_id").select("object_id", "retained_bytes")


def top_retained(retained: DataFrame, n: int = 50) -> DataFrame:
    return retained.orderBy(F.desc("retained_bytes"), "object_id").limit(min(n, 1_000))
