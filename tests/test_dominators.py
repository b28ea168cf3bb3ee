"""Dominators of random graphs with circles, several roots per object and long lists, against their definition."""

import random

import pytest
from pyspark.sql import functions as F

from heaplake.operators import dominators as dom


def brute(nodes, edges, roots):
    """By removal: d dominates v if v can't be reached without d."""
    out = {}

    def reach(without):
        seen, stack = set(), [r for r in roots if r in nodes and r != without]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                stack += [w for w in out[v] if w in nodes and w != without]
        return seen

    out = {v: [b for a, b in edges if a == v] for v in nodes}
    everything = reach(None)
    over = {v: set() for v in everything}
    for d in everything:
        for v in everything - reach(d) - {d}:
            over[v].add(d)
    return {v: max(over[v], key=lambda d: len(over[d]), default=0) for v in everything}


def graph(seed):
    rng = random.Random(seed)
    n = 60
    nodes = set(range(1, n + 1)) | {-(1 << 62), (1 << 62) + 5}
    edges = [(rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for _ in range(rng.choice([60, 75, 110]))]
    edges += [(i, i + 1) for i in range(20, 40)]  # a list
    edges += [(i + 1, i) for i in range(30, 40)]  # linked both ways in part
    edges += [(1, -(1 << 62)), (-(1 << 62), (1 << 62) + 5), (2, 999), (998, 3), (7, 7)]
    return nodes, edges, [1, 2, 20, 997, rng.randrange(1, n + 1)] if seed % 2 else [1]


def frames(spark, nodes, edges, roots):
    return (
        spark.createDataFrame([(v, "x") for v in [*nodes, *list(nodes)[:5]]], "object_id long, region string"),
        spark.createDataFrame([(b, a, "f") for a, b in [*edges, *edges[:9]]], "to_object_id long, from_object_id long, kind string"),
        spark.createDataFrame([(r, t) for r in roots for t in ("a", "b")], "object_id long, root_type string"),
    )


@pytest.mark.parametrize(("seed", "capacity"), [(1, 10**6), (2, 25), (3, 25)])
def test_against_the_definition(spark, seed, capacity):
    nodes, edges, roots = graph(seed)
    got = dom.dominators(*frames(spark, nodes, edges, roots), capacity=capacity).collect()
    want = brute(nodes, edges, roots)
    assert len(got) == len(want) and {r["object_id"]: r["dominator_id"] for r in got} == want


def test_a_long_list_that_ends_in_shared_objects(spark):
    n = 200_000
    links = spark.range(1, n).select((F.col("id") + 1).alias("to_object_id"), F.col("id").alias("from_object_id"))
    more = spark.createDataFrame([(n + 1, n), (n + 2, n), (n + 3, n + 1), (n + 3, n + 2), (n + 4, n // 2), (n + 4, n + 3)], "to_object_id long, from_object_id long")
    nodes = spark.range(1, n + 5).select(F.col("id").alias("object_id"))
    root = spark.createDataFrame([(1,)], "object_id long")
    got = dom.dominators(nodes, links.unionByName(more), root, capacity=1_000)
    rows = {r["object_id"]: r["dominator_id"] for r in got.where(F.col("object_id") > n - 3).collect()}
    assert rows == {n - 2: n - 3, n - 1: n - 2, n: n - 1, n + 1: n, n + 2: n, n + 3: n, n + 4: n // 2}
    assert got.count() == n + 4
    sizes = dom.retained_sizes(got, nodes.withColumn("shallow", F.lit(2).cast("long")), capacity=50_000)
    assert {r["object_id"]: r["retained_bytes"] for r in sizes.where("object_id in (1, 2, 150000)").collect()} == {1: 2 * (n + 4), 2: 2 * (n + 3), 150_000: 2 * (n - 150_000 + 4)}


def test_nothing(spark):
    assert dom.dominators(*[f.where("false") for f in frames(spark, *graph(0))]).count() == 0
    assert dom.dominators(*[f.where("false") for f in frames(spark, *graph(0))], capacity=0).count() == 0
