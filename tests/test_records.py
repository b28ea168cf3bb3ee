"""The record-quality operators against brute force, and their defined cases."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heaplake.operators import hierarchy as trees
from heaplake.operators import references as refs
from heaplake.operators import skew, snapshots

T0 = datetime(2025, 1, 1)


def minutes(n):
    return None if n is None else T0 + timedelta(minutes=n)


# --- references ----------------------------------------------------------------------------------------------------


def orphans(spark, records, parents, **kw):
    schema = "dump_id long, record_id long, key long, ingested_at timestamp, dump_ts timestamp, period int"
    r = spark.createDataFrame([(*x[:3], minutes(x[3]), T0, 1) for x in records], schema)
    p = spark.createDataFrame([(*x[:2], minutes(x[2]), "x") for x in parents], "dump_id long, id long, ingested_at timestamp, key string")
    left = refs.references(r, "t", "dump_id", "record_id", "key", "ingested_at", "dump_ts")
    return refs.orphan_references(left, refs.targets(p, "dump_id", "id", "ingested_at"), **kw)


def brute_orphans(records, parents):
    low = -(10**9)
    first, seen = {}, {}
    for d, i, k, t in records:
        if d is not None and i is not None:
            at = (low if t is None else t, (k is not None, k or 0))
            if (d, i) not in first or at < first[d, i][0]:
                first[d, i] = (at, k)
    for d, k, t in parents:
        if d is not None and k is not None:
            seen[d, k] = min(seen.get((d, k), 10**9), low if t is None else t)
    return {(d, i, k) for (d, i), ((t, _), k) in first.items() if k and seen.get((d, k), 10**9) > t}


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [0, 1, 7, 8, 63, 64, 512, 513, -1, -8, -(1 << 63), (1 << 63) - 1, 1 << 40]
    records = [(rng.choice([1, 2]), rng.randrange(60), rng.choice([*ids, None]), rng.choice([*range(40), None])) for _ in range(300)]
    parents = [(rng.choice([1, 2]), rng.choice([*ids, None]), rng.choice([*range(40), None])) for _ in range(25)]
    records += [(None, 1, 7, 1), (1, None, 7, 1)]
    got = orphans(spark, records, parents, period_seconds=rng.choice([60, 600, 10**6]), salts=3)
    assert sorted((r["scope"], r["record_id"], r["key"]) for r in got.collect()) == sorted(brute_orphans(records, parents))


def test_orphan_reasons_and_empty_tables(spark):
    got = orphans(spark, [(1, 1, 5, 10), (1, 2, 6, 10), (1, 3, 7, 10)], [(1, 5, 10), (1, 6, 11)])
    assert {(r["record_id"], r["reason"]) for r in got.collect()} == {(2, "late"), (3, "missing")}
    report = refs.orphan_report(got).collect()
    assert [tuple(r) for r in report] == [("t", "2025-01", 2, 1, 2)]
    assert orphans(spark, [], [(1, 5, 10)]).count() == 0
    assert orphans(spark, [(1, 1, 5, 10)], []).count() == 1


def test_hot_missing_key(spark):
    got = orphans(spark, [(1, i, 77, 1) for i in range(500)], [(1, 78, 1)])
    assert got.count() == 500


def test_dictionary_of_text_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "k string")
    assert {tuple(r) for r in refs.dictionary_encode(df, "k").collect()} == {("a", 0), ("b", 1), ("c", 2)}


# --- snapshots -----------------------------------------------------------------------------------------------------


SNAP = "process_id long, dump_id long, dump_ts timestamp, tag short, object_id long, position long, class_id long, payload binary, ingested_at timestamp, _n string, change_kind string"


def snap(spark, rows):
    return spark.createDataFrame([(p, d, minutes(t), tag, o, pos, 1, None if pay is None else bytearray(pay), minutes(i), "x", "y") for p, d, t, tag, o, pos, pay, i in rows], SNAP)


def brute_changes(rows):
    dumps, best = defaultdict(dict), {}
    for p, d, t, tag, o, pos, pay, i in rows:
        if p is None or d is None:
            continue
        dumps[p][d] = min(dumps[p].get(d, t), t)
        if o is not None:
            key = (pos is None, pos or 0, i, tag, pay is not None, pay or b"")
            if (p, d, o) not in best or key < best[p, d, o][0]:
                best[p, d, o] = (key, tag, pay)
    out = set()
    for p, ds in dumps.items():
        order = sorted(ds, key=lambda d: (ds[d], d))
        for a, b in zip(order, order[1:]):
            x, y = ({o: v[1:] for (q, d, o), v in best.items() if q == p and d == s} for s in (a, b))
            out |= {(p, b, o, "removed" if o not in y else "added" if o not in x else "changed") for o in x.keys() | y.keys() if x.get(o) != y.get(o)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_changes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pays = [None, b"", b"a", b"b", b"L" * 100, b"M" * 100]
    rows = [(rng.choice([1, 2]), d := rng.randrange(5), (7 * d) % 5, rng.choice([32, 33]), rng.choice([*range(8), None]), rng.choice([1, 2, 2, None]), rng.choice(pays), rng.randrange(9)) for _ in range(250)]
    got = snapshots.snapshot_changes(snap(spark, rows))
    assert sorted((r["process_id"], r["dump_id"], r["object_id"], r["change_kind"]) for r in got.collect()) == sorted(brute_changes(rows))


def test_changes_cases(spark):
    rows = [(1, 10, 0, 33, 5, 1, None, 0), (1, 11, 1, 33, 5, 9, b"", 0), (1, 12, 2, 33, 5, 9, b"", 0), (1, 12, 2, 33, 5, 3, b"", 5), (None, 1, 0, 33, 5, 1, b"", 0), (1, 12, 2, 33, None, 1, b"", 0)]
    got = snapshots.snapshot_changes(snap(spark, rows), unchanged=True)
    assert {(r["dump_id"], r["change_kind"], r["position1"], r["position2"]) for r in got.collect()} == {(11, "changed", 1, 9), (12, "unchanged", 9, 3)}
    assert snapshots.snapshot_changes(snap(spark, [])).count() == 0
    assert snapshots.snapshot_changes(snap(spark, rows[:1])).count() == 0


def test_changes_with_a_hot_key(spark):
    rows = [(1, d, d, 33, 5, i + 1, b"x" if i else bytes([d]), 0) for d in (1, 2) for i in range(400)] + [(1, d, d, 33, o, 1, b"s", 0) for d in (1, 2) for o in range(6, 60)]
    df = snap(spark, rows)
    assert skew.hot_keys(df, ["object_id"], 0.3).collect()[0]["object_id"] == 5
    assert [(r["object_id"], r["change_kind"]) for r in snapshots.snapshot_changes(df).collect()] == [(5, "changed")]


# --- hierarchies ---------------------------------------------------------------------------------------------------


def solve(spark, rows, **kw):
    df = spark.createDataFrame([(g, n, p, minutes(t), "x", 1) for g, n, p, t in rows], "g long, n long, p long, at timestamp, tree string, cycle long")
    return {(r["grp"], r["node"]): r for r in trees.hierarchy(trees.links(df, "t", "g", "n", "p", "at"), **kw).collect()}


def brute_tree(rows):
    first = {}
    for g, n, p, t in rows:
        if g is not None and n is not None:
            at = (-1 if t is None else t, p is not None, p or 0)
            if (g, n) not in first or at < first[g, n][0]:
                first[g, n] = (at, p)
    up = {k: p for k, (_, p) in first.items()}
    out = {}
    for g, n in up:
        path = [n]
        while True:
            p = up[g, path[-1]]
            if not p or (g, p) not in up:
                out[g, n] = (path[-1], len(path) - 1, path, None, False)
                break
            if p in path:
                ring = path[path.index(p) :]
                out[g, n] = (None, None, None, min(ring), n in ring)
                break
            path.append(p)
    return out


@pytest.mark.parametrize(("seed", "capacity"), [(0, 10**6), (1, 10**6), (2, 40), (3, 40), (4, 25)])
def test_trees_against_brute_force(spark, seed, capacity):
    rng = random.Random(seed)
    big = 31 << 56
    rows = [(1, big + i, rng.choice([None, 0, big + i - 1, big + rng.randrange(120), big + 999, big + i]) if i % 9 == 0 else big + max(0, i - rng.choice([1, 1, 1, 2, 5])), rng.choice([None, 1, 2])) for i in range(100)]
    rows += [(2, i + 1, i, 1) for i in range(30)] + [(3, 1, 2, 1), (3, 2, 3, 1), (3, 3, 1, 1), (3, 4, 1, 1), (3, 5, 5, 1)]
    rows += rng.sample(rows, 20) + [(None, 1, 2, 1), (1, None, 2, 1)]
    got, want = solve(spark, rows, capacity=capacity, paths=True), brute_tree(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        assert (r["root"], r["depth"], r["path"], r["cycle_id"], r["on_cycle"]) == w, k


@pytest.mark.parametrize("capacity", [10**6, 50])
def test_one_long_chain_and_a_long_circle(spark, capacity):
    rows = [(1, i, i - 1, 1) for i in range(1, 301)] + [(2, i, i % 200 + 1, 1) for i in range(1, 201)]
    got = solve(spark, rows, capacity=capacity)
    assert all(got[1, i]["depth"] == i - 1 and got[1, i]["root"] == 1 for i in range(1, 301))
    assert all(got[2, i]["on_cycle"] and got[2, i]["cycle_id"] == 1 for i in range(1, 201))


def test_descendants_and_empty_tree(spark):
    df = spark.createDataFrame([(1, 1, 0, None), (1, 2, 1, None), (1, 3, 2, None), (1, 4, 4, None)], "g long, n long, p long, at timestamp")
    solved = trees.hierarchy(trees.links(df, "t", "g", "n", "p", "at"), paths=True)
    assert sorted((r["ancestor"], r["node"], r["distance"]) for r in trees.descendants(solved).collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert trees.descendants(solved, [2]).count() == 1
    assert trees.hierarchy(trees.links(df.where("false"), "t", "g", "n", "p", "at")).count() == 0


# --- heavy keys ----------------------------------------------------------------------------------------------------


def test_eager_join_equals_joined_rows(spark):
    rng = random.Random(5)
    keys = [1] * 30 + [2, 3, None, 4]
    left = spark.createDataFrame([(rng.choice(keys), rng.choice([1, 2, None]), "x") for _ in range(80)], "k int, a int, row_count string")
    right = spark.createDataFrame([(rng.choice([*keys, 5]), rng.choice([5, None])) for _ in range(50)], "k int, b int")
    plain = left.join(right, "k").groupBy("k").agg(F.count("*").alias("pair_count"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    eager = skew.eager_join_aggregate(left, right, ["k"], {"a": "a"}, {"b": "b"}).select("k", "pair_count", "a", "b")
    assert sorted(map(tuple, eager.collect())) == sorted(map(tuple, plain.collect()))
    full = skew.eager_join_aggregate(left, right, ["k"], {"a": "a"}, {"b": "b"}, how="full")
    assert full.agg(F.sum("left_rows"), F.sum("right_rows")).first()[:] == (80, 50)
    assert skew.eager_join_aggregate(left.where("false"), right, ["k"], {"a": "a"}, {"b": "b"}).count() == 0


def test_heavy_keys(spark):
    rows = [("t", 1)] * 5 + [("t", None)] * 90 + [("t", 2)] * 4 + [("t", 3)] + [("u", 9)]
    df = spark.createDataFrame(rows, "s string, k long").withColumn("total_rows", F.lit("x"))
    assert {(r["s"], r["k"]) for r in skew.heavy_keys(df, "s", "k", 0.05).collect()} == {("t", 1), ("u", 9)}
    assert skew.heavy_keys(df.where("false"), "s", "k", 0.05).count() == 0


def test_first_delivery_counts(spark):
    df = spark.createDataFrame([(1, minutes(2), 5), (1, minutes(1), 7), (1, minutes(1), 6), (None, None, 1), (2, None, None)], "k long, ingested_at timestamp, v long")
    assert sorted(map(tuple, skew.once(df, ["k"], "ingested_at", "v").collect()), key=str) == [(1, 6), (2, None), (None, 1)]
    totals = skew.roll_up(skew.key_states(df, ["k"], {"v": "v"}), [], ["row_count", "v"]).first()
    assert tuple(totals) == (5, 19) and Counter(df.columns)["v"] == 1


def test_later_snapshots_are_added_to_the_kept_layout(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2]), d, d, 33, rng.randrange(40) * 999, 1, bytes([rng.randrange(2)]), 0) for d in range(4) for _ in range(60)]
    kept = snapshots.keep_snapshots(snap(spark, [r for r in rows if r[1] in (0, 2)]), path=str(tmp_path / "kept"))
    snapshots.keep_snapshots(snap(spark, [r for r in rows if r[1] in (1, 3)]), to=kept)  # one of them lies between those that are there
    got = snapshots.kept_changes(kept)
    assert sorted((r["process_id"], r["dump_id"], r["object_id"], r["change_kind"]) for r in got.collect()) == sorted(brute_changes(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_o" not in plan.split("BroadcastExchange")[0], plan  # the kept rows don't move


def test_more_snapshots_than_are_broadcast(spark):
    rows = [(1, d, d, 33, o, 1, bytes([d % 2 * (o % 3)]), 0) for d in range(6) for o in range(30)]
    got = snapshots.snapshot_changes(snap(spark, rows), max_snapshots=2)
    assert sorted((r["process_id"], r["dump_id"], r["object_id"], r["change_kind"]) for r in got.collect()) == sorted(brute_changes(rows))


def test_orphans_of_hot_and_deleted_keys(spark):
    records = [(1, i, 77 if i % 3 else 78, 1) for i in range(300)]
    r = refs.references(spark.createDataFrame([(*x[:3], minutes(x[3]), T0) for x in records], "d long, i long, k long, at timestamp, ts timestamp"), "t", "d", "i", "k", "at", "ts")
    p = refs.targets(spark.createDataFrame([(1, 78, minutes(0), True), (1, 79, minutes(0), None)], "d long, k long, at timestamp, gone boolean"), "d", "k", "at", ~F.col("gone"))
    got = refs.orphan_references(r, p, hot_rows=150, salts=4)
    assert Counter((x["key"], x["reason"]) for x in got.collect()) == {(77, "missing"): 200, (78, "deleted"): 100}
    assert {tuple(x) for x in refs.orphan_reasons(got).collect()} == {("t", "2025-01", "missing", 200), ("t", "2025-01", "deleted", 100)}


def test_products_beyond_64_bits(spark):
    left = spark.range(3).select(F.lit(1).alias("k"), F.lit(2**61).alias("a"))
    right = spark.range(50).select(F.lit(1).alias("k"))
    row = skew.eager_join_aggregate(left, right, ["k"], {"a": "a"}, {}).first()
    assert (row["pair_count"], row["a"]) == (150, 150 * 2**61)


@pytest.mark.parametrize("capacity", [10**6, 60])
def test_subtree_sums(spark, capacity):
    rng = random.Random(3)
    up = {1: {i: max(0, i - rng.choice([1, 1, 1, 7, 40])) for i in range(1, 500)}, 2: {i: 1 if i > 1 else 0 for i in range(1, 300)}, 3: {5: 4}}
    rows = [(g, n, p or None, n * 10**6) for g, links in up.items() for n, p in links.items()]
    df = spark.createDataFrame(rows, "grp long, node long, parent long, weight long").withColumn("tree", F.lit("t"))
    want = {(g, n): n * 10**6 for g, n, *_ in rows}
    for g, links in up.items():
        for n in links:
            p = links[n]
            while p in links:
                want[g, p] += n * 10**6
                p = links[p]
    assert {(r["grp"], r["node"]): r["total"] for r in trees.subtree_sums(df, capacity).collect()} == want
    assert trees.subtree_sums(df.where("false"), capacity).count() == 0


def test_a_star_and_a_million_links(spark):
    star = [(1, i, 1 if i > 1 else 0, 1) for i in range(1, 400)] + [(1, 1000 + i, i, 1) for i in range(1, 400)]
    got = solve(spark, star, capacity=80, paths=True)
    assert got[1, 1399]["path"] == [1399, 399, 1] and len(got) == len(star)
    chain = spark.range(1, 1_000_001).select(F.lit("t").alias("tree"), F.lit(1).cast("long").alias("grp"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit(None).cast("timestamp").alias("delivered"))
    with pytest.raises(ValueError, match="max_path_values"):
        trees.hierarchy(chain, paths=True)
    assert trees.hierarchy(chain).agg(F.max("depth"), F.countDistinct("root")).first()[:] == (999_999, 1)
