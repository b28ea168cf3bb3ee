"""Queries of the record-quality operators: references (p1), snapshots (p2), hierarchies (p3), heavy keys (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as trees
from ..operators import references as refs
from ..operators import skew, snapshots
from ..session import materialise, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    class_dump = table(spark, d, "class_dump", "dump_id", "dump_ts", "class_id", "super_class_id", "unloaded_at", "ingested_at")
    obj_array = table(spark, d, "obj_array", "dump_id", "dump_ts", "array_id", "element_class_id", "ingested_at")
    gc_root = table(spark, d, "gc_root", "dump_id", "dump_ts", "position", "object_id", "ingested_at")
    sub_record = table(spark, d, "sub_record", "dump_id", "object_id", "ingested_at")
    to_class = refs.references(class_dump, "class_dump", "dump_id", "class_id", "super_class_id", "ingested_at", "dump_ts").unionByName(
        refs.references(obj_array, "obj_array", "dump_id", "array_id", "element_class_id", "ingested_at", "dump_ts")
    )
    to_object = refs.references(gc_root, "gc_root", "dump_id", "position", "object_id", "ingested_at", "dump_ts")
    loaded = F.col("unloaded_at").isNull() | (F.col("unloaded_at") > F.col("dump_ts"))
    classes = refs.targets(class_dump, "dump_id", "class_id", "ingested_at", loaded)
    objects = refs.targets(sub_record, "dump_id", "object_id", "ingested_at")
    return refs.orphan_references(to_class, classes).unionByName(refs.orphan_references(to_object, objects))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", F.col("scope").alias("dump_id"), "record_id", F.col("key").alias("missing_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return refs.orphan_report(_orphans(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return refs.orphan_reasons(_orphans(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "sub_record")).select("process_id", "dump_id", "object_id", "change_kind")


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    """DiffEntry and CommonEntry rows of every pair of consecutive snapshots."""
    rows = snapshots.snapshot_changes(table(spark, d, "sub_record"), unchanged=True)
    entry = F.when(F.col("change_kind").isin("added", "removed"), F.col("change_kind")).otherwise("common")
    return rows.select(
        "process_id", "dump_id", "object_id", F.col("tag").cast("int").alias("tag"), entry.alias("entry"),
        F.when(entry == "common", F.col("change_kind") == "changed").alias("changed"), "position1", "position2",
    )


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots.snapshot_changes(table(spark, d, "sub_record"), unchanged=True)
    return rows.groupBy("process_id", "dump_id").agg(*[F.count(F.when(F.col("change_kind") == k, 1)).alias(k) for k in ("added", "removed", "changed", "unchanged")])


def _links(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "dominator", "dump_id", "object_id", "dominator_id", "ingested_at")
    classes = table(spark, d, "class_dump", "dump_id", "class_id", "super_class_id", "ingested_at")
    return trees.links(objects, "dominator", "dump_id", "object_id", "dominator_id", "ingested_at").unionByName(
        trees.links(classes, "class_dump", "dump_id", "class_id", "super_class_id", "ingested_at")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    solved = trees.hierarchy(_links(spark, d))
    return solved.where("on_cycle").select("tree", F.col("grp").alias("dump_id"), F.col("node").alias("node_id"), "cycle_id")


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    solved = trees.hierarchy(_links(spark, d), paths=True)
    return solved.select(
        "tree", F.col("grp").alias("dump_id"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth",
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "cycle_id",
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = trees.descendants(trees.hierarchy(_links(spark, d), paths=True))
    return pairs.select("tree", F.col("grp").alias("dump_id"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("node_id"), F.col("distance").cast("long").alias("distance"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Both tables are reduced to states of their classes and joined; shares are rolled up from the joined states."""
    tables = [table(spark, d, name, "class_id") for name in ("histogram", "class_diff")]
    both = materialise(skew.eager_join_aggregate(*tables, ["class_id"], {}, {}, how="full"), "states")
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("table_name"), F.col(n).alias("row_count")) for name, n in (("histogram", "left_rows"), ("class_diff", "right_rows"))]))
    states = both.select("class_id", sides.alias("s")).select("s.table_name", "class_id", "s.row_count").where("row_count > 0")
    return skew.heavy_states(states, "table_name", "class_id", 0.05).select("table_name", "class_id")


_DIFFS = ("count_removed", "count_added", "count_common_unchanged", "count_common_changed")


def _counters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The records of both tables, each delivery once."""
    histogram = skew.once(table(spark, d, "histogram"), ["dump_id", "batch_no"], "ingested_at", "class_id", "instance_count", "shallow_bytes")
    diff = skew.once(table(spark, d, "class_diff"), ["dump_id1", "dump_id2", "batch_no"], "ingested_at", "class_id", *_DIFFS)
    return histogram, diff


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    histogram, diff = _counters(spark, d)
    sums = {"instance_count": "instance_count", "shallow_bytes": "shallow_bytes"}
    both = skew.eager_join_aggregate(histogram, diff, ["class_id"], sums, {c: c for c in _DIFFS}, how="full")
    return both.where("class_id is not null").drop("pair_count")


def p5_join(spark: SparkSession, d: str) -> DataFrame:
    """Per class the aggregate over all pairs of a histogram row and a class_diff row, formed from states only."""
    histogram, diff = _counters(spark, d)
    sums = {"instance_count": "instance_count", "shallow_bytes": "shallow_bytes"}
    joined = skew.eager_join_aggregate(histogram, diff, ["class_id"], sums, {c: c for c in _DIFFS})
    return joined.select(*[c if c in ("class_id", "left_rows", "right_rows") else F.col(c).cast("long").alias(c) for c in joined.columns])


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects per bucket over all dumps: each object of a dump counts once in each bucket that it was delivered in."""
    objects = table(spark, d, "sub_record", "dump_id", "object_id", "class_id").distinct()
    return skew.key_states(objects, ["class_id"], {}).select("class_id", F.col("row_count").alias("objects"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_reasons, p2_found, p2_entries, p2_counts, p3_found, p3_nodes, p3_descendants, p5_found, p5_totals, p5_join, p5_objects)}

_P1 = """
with c as (select dump_id, class_id, min(ingested_at) t0, min(dump_ts) ts, any_value(super_class_id) ref, any_value(unloaded_at) gone, any_value(dump_ts) own
             from class_dump group by 1, 2),
     a as (select dump_id, array_id, min(ingested_at) t0, min(dump_ts) ts, any_value(element_class_id) ref from obj_array group by 1, 2),
     g as (select dump_id, position, min(ingested_at) t0, min(dump_ts) ts, any_value(object_id) ref from gc_root group by 1, 2),
     o as (select dump_id, object_id, min(ingested_at) t0 from sub_record group by 1, 2),
     v as (select dump_id, class_id, t0 from c where gone is null or gone > own),
     f as (select 'class_dump' ref_table, c.dump_id, c.class_id record_id, c.ref missing_id, c.ts, v.t0 is not null late
             from c left join v on v.dump_id = c.dump_id and v.class_id = c.ref where c.ref <> 0 and (v.t0 is null or v.t0 > c.t0)
           union all
           select 'obj_array', a.dump_id, a.array_id, a.ref, a.ts, v.t0 is not null
             from a left join v on v.dump_id = a.dump_id and v.class_id = a.ref where a.ref <> 0 and (v.t0 is null or v.t0 > a.t0)
           union all
           select 'gc_root', g.dump_id, g.position, g.ref, g.ts, o.t0 is not null
             from g left join o on o.dump_id = g.dump_id and o.object_id = g.ref where g.ref <> 0 and (o.t0 is null or o.t0 > g.t0))
"""

_P2 = """
with s as (select process_id, dump_id, min(dump_ts) ts from sub_record group by 1, 2),
     p as (select process_id, dump_id, lag(dump_id) over (partition by process_id order by ts, dump_id) prev from s),
     r as (select process_id, dump_id, object_id, position, tag, payload from sub_record
            qualify row_number() over (partition by process_id, dump_id, object_id order by position, ingested_at, tag, payload) = 1),
     j as (select p.process_id, p.dump_id, coalesce(b.object_id, a.object_id) object_id, a.object_id is null no_a, b.object_id is null no_b,
                  a.position position1, b.position position2, a.tag tag1, b.tag tag2, a.payload payload1, b.payload payload2
             from (select r.*, n.dump_id later from r join p n on n.process_id = r.process_id and n.prev = r.dump_id) a
             full join (select r.*, p.prev from r join p on p.process_id = r.process_id and p.dump_id = r.dump_id where p.prev is not null) b
               on b.process_id = a.process_id and b.dump_id = a.later and b.object_id = a.object_id
             join p on p.process_id = coalesce(b.process_id, a.process_id) and p.dump_id = coalesce(b.dump_id, a.later)),
     e as (select *, case when no_a then 'added' when no_b then 'removed'
                          when tag1 is distinct from tag2 or payload1 is distinct from payload2 then 'changed' else 'unchanged' end change_kind from j)
"""

_P3 = """
with recursive n as (
       select 'dominator' tree, dump_id, object_id node_id, any_value(nullif(dominator_id, 0)) parent from dominator group by 1, 2, 3
       union all
       select 'class_dump', dump_id, class_id, any_value(nullif(super_class_id, 0)) from class_dump group by 1, 2, 3),
     l as (select n.tree, n.dump_id, n.node_id, q.node_id parent from n left join n q on q.tree = n.tree and q.dump_id = n.dump_id and q.node_id = n.parent),
     d as (select tree, dump_id, node_id, node_id root_id, 0::bigint depth, cast(node_id as varchar) path from l where parent is null
           union all
           select l.tree, l.dump_id, l.node_id, d.root_id, d.depth + 1, l.node_id || '>' || d.path
             from d join l on l.tree = d.tree and l.dump_id = d.dump_id and l.parent = d.node_id),
     x as (select l.* from l anti join d using (tree, dump_id, node_id)),
     w as (select tree, dump_id, node_id, parent hop, node_id lowest, 1 steps from x
           union
           select w.tree, w.dump_id, w.node_id, x.parent, least(w.lowest, x.node_id), steps + 1
             from w join x on x.tree = w.tree and x.dump_id = w.dump_id and x.node_id = w.hop where w.hop <> w.node_id and steps < 2000),
     c as (select tree, dump_id, node_id, min(lowest) cycle_id from w where hop = node_id group by 1, 2, 3)
"""

SQL = {
    "p1_found": _P1 + "select ref_table, dump_id, record_id, missing_id from f",
    "p1_report": _P1
    + """select ref_table, strftime(ts at time zone 'UTC', '%Y-%m') "month", count(*) orphan_references, count(*) filter (late) late_references,
         count(distinct (dump_id, missing_id)) missing_keys from f group by 1, 2""",
    "p1_reasons": _P1
    + """select ref_table, strftime(ts at time zone 'UTC', '%Y-%m') "month", case when late then 'late'
         when ref_table <> 'gc_root' and exists (select 1 from c where c.dump_id = f.dump_id and c.class_id = f.missing_id) then 'deleted' else 'missing' end reason, count(*) orphan_references
         from f group by 1, 2, 3""",
    "p2_found": _P2 + "select process_id, dump_id, object_id, change_kind from e where change_kind <> 'unchanged'",
    "p2_entries": _P2
    + """select process_id, dump_id, object_id, cast(coalesce(tag2, tag1) as int) tag, case when no_a or no_b then change_kind else 'common' end entry,
         case when not no_a and not no_b then change_kind = 'changed' end changed, position1, position2 from e""",
    "p2_counts": _P2
    + "select process_id, dump_id, "
    + ", ".join(f"count(*) filter (change_kind = '{k}') {k}" for k in ("added", "removed", "changed", "unchanged"))
    + " from e group by 1, 2",
    "p3_found": _P3 + "select tree, dump_id, node_id, cycle_id from c",
    "p3_nodes": _P3
    + """, h as (select tree, dump_id, node_id, cycle_id, 0 hop from c
           union all
           select x.tree, x.dump_id, x.node_id, h.cycle_id, 1 from h join x on x.tree = h.tree and x.dump_id = h.dump_id and x.parent = h.node_id
            where (x.tree, x.dump_id, x.node_id) not in (select tree, dump_id, node_id from c))
       select tree, dump_id, node_id, root_id, depth, path, null::bigint cycle_id from d
       union all select tree, dump_id, node_id, null, null, null, cycle_id from h""",
    "p3_descendants": _P3
    + """, up as (select l.tree, l.dump_id, l.node_id, l.parent ancestor_id, 1::bigint distance from l join d using (tree, dump_id, node_id) where l.parent is not null
           union all
           select up.tree, up.dump_id, up.node_id, l.parent, up.distance + 1 from up join l on l.tree = up.tree and l.dump_id = up.dump_id and l.node_id = up.ancestor_id
            where l.parent is not null)
       select tree, dump_id, ancestor_id, node_id, distance from up""",
    "p5_found": """select table_name, class_id from (select table_name, class_id, count(*) n, sum(count(*)) over (partition by table_name) total
           from (select 'histogram' table_name, class_id from histogram union all select 'class_diff', class_id from class_diff) group by 1, 2)
         where class_id is not null and n >= 0.05 * total""",
    "p5_objects": "select class_id, count(distinct (dump_id, object_id)) objects from sub_record group by 1",
}

_P5 = """
with h as (select any_value(class_id) class_id, any_value(instance_count) instance_count, any_value(shallow_bytes) shallow_bytes from histogram group by dump_id, batch_no),
     g as (select any_value(class_id) class_id, any_value(count_removed) count_removed, any_value(count_added) count_added,
                  any_value(count_common_unchanged) count_common_unchanged, any_value(count_common_changed) count_common_changed
             from class_diff group by dump_id1, dump_id2, batch_no)
"""
_BOTH = ("instance_count", "shallow_bytes", *_DIFFS)
SQL["p5_join"] = (
    _P5
    + "select class_id, count(distinct h_row) left_rows, count(distinct g_row) right_rows, count(*) pair_count, "
    + ", ".join(f"coalesce(cast(sum({c}) as bigint), 0) {c}" for c in _BOTH)
    + " from (select *, row_number() over () h_row from h) h join (select *, row_number() over () g_row from g) g using (class_id) group by 1"
)
SQL["p5_totals"] = (
    _P5
    + "select class_id, coalesce(left_rows, 0) left_rows, coalesce(right_rows, 0) right_rows, "
    + ", ".join(f"coalesce({c}, 0) {c}" for c in _BOTH)
    + " from (select class_id, count(*) left_rows, cast(sum(instance_count) as bigint) instance_count, cast(sum(shallow_bytes) as bigint) shallow_bytes from h group by 1) full join"
    + " (select class_id, count(*) right_rows, "
    + ", ".join(f"cast(sum({c}) as bigint) {c}" for c in _DIFFS)
    + " from g group by 1) using (class_id) where class_id is not null"
)
