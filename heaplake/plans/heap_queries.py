"""Queries of the heap operators over the relational heap, each with SQL on the tables beneath it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dominators as dom
from ..operators import dumpdiff, graph, resolve, stats, threads
from ..session import forget_at_exit, shared_dir, table
from ..sources.export import export_hprof
from . import relational_heap as R

K = R.K


def _heap(spark: SparkSession, d: str) -> R.Heap:
    return R.shop_heap(spark, d)


# --- histogram, classes, lists -------------------------------------------------------------------------------------


def class_histogram(spark, d):
    h = _heap(spark, d)
    return stats.class_histogram(h.shallow, h.names)


def class_histogram_legacy(spark, d):
    h = _heap(spark, d)
    return stats.legacy_labels(stats.class_histogram(h.shallow, h.names), h.shallow).select("class_id", "legacy_label")


def class_histogram_top(spark, d):
    return stats.top_classes(class_histogram(spark, d), 10)


def histogram_totals(spark, d):
    return stats.totals(class_histogram(spark, d))


def instances_by_name(spark, d):
    h = _heap(spark, d)
    return h["instance"].groupBy("class_id").count().join(h.names, "class_id").groupBy("class_name").agg(F.sum("count").alias("instances"))


def all_classes(spark, d):
    return stats.all_classes(class_histogram(spark, d))


def instances_keys(spark, d):
    return stats.instances_key(_heap(spark, d).names)


def find_class_substring(spark, d):
    return resolve.search_classes(class_histogram(spark, d), "java.lang")


def find_class_exact(spark, d):
    return resolve.search_classes(class_histogram(spark, d), "shop.Order", exact=True)


def class_by_name(spark, d):
    return resolve.find_class(_heap(spark, d).names, "shop/Supplier")


def find_object(spark, d):
    h = _heap(spark, d)
    return stats.find_object(h.shallow, h["gc_root"], 2 * K + 7)


def instances_of_class_page(spark, d):
    h = _heap(spark, d)
    return stats.page(stats.instances_of(h["instance"], h.names, "shop.Customer").select("object_id"), "object_id", offset=200, limit=200)


def instances_of_subclasses(spark, d):
    h = _heap(spark, d)
    return stats.instances_of_subclasses(h["instance"], h.names, h.chain, "shop.Party").select("object_id", "class_id")


def objects_ordered(spark, d):
    """The first page of all objects in unsigned id order."""
    return stats.page(_heap(spark, d).shallow.select("object_id", "tag"), S.unsigned_order(F.col("object_id")), limit=200)


def object_type_name(spark, d):
    return _heap(spark, d).types.select("object_id", "type_name")


def shallow_sizes(spark, d):
    return _heap(spark, d).shallow.select("object_id", F.col("tag").cast("int").alias("tag"), "class_key", "shallow")


def heap_summary(spark, d):
    h, t = _heap(spark, d), R.thread_heap(spark, d)
    records = h.shallow.select("object_id").unionByName(h["gc_root"].select("object_id"))
    return stats.heap_summary(records, h.refs, t["start_thread"], h["gc_root"])


# --- fields and values ---------------------------------------------------------------------------------------------


def class_layout(spark, d):
    return _heap(spark, d).layout.select("class_id", F.col("ord").cast("long").alias("ord"), "name", F.col("type_code").cast("int").alias("type_code"), "offset")


def class_closure(spark, d):
    return _heap(spark, d).chain.select("class_id", F.col("hop").cast("long").alias("hop"), "ancestor_id")


def instance_fields(spark, d):
    rows = _heap(spark, d).fields
    return rows.select("object_id", F.col("ord").cast("long").alias("ord"), "name", F.col("value.ref_id").alias("ref_id"), F.col("value.i").alias("i"), F.col("value.d").alias("d"))


def java_strings(spark, d):
    return _heap(spark, d).strings


def find_strings(spark, d):
    return resolve.find_strings(_heap(spark, d).strings, "r")


def wrapper_values(spark, d):
    rows = _heap(spark, d).values.where("class_name <> 'java.lang.String'")
    return rows.select("object_id", F.col("value.kind").alias("kind"), F.col("value.i").alias("i"), F.col("value.d").alias("d"))


def static_fields(spark, d):
    h = _heap(spark, d)
    rows = resolve.static_fields(h["class_dump"], h["utf8_name"])
    return rows.select("class_id", "name", F.col("value.ref_id").alias("ref_id"), F.col("value.i").alias("i"))


def declared_fields(spark, d):
    h = _heap(spark, d)
    return resolve.declared_fields(h["class_dump"], h["utf8_name"]).groupBy("type_name").agg(F.count("*").alias("fields"))


def resolved_roots(spark, d):
    h = _heap(spark, d)
    return resolve.resolved_roots(h["gc_root"], h.types, h.names).select("root_type", "object_id", "resolved_name")


def resolved_instances(spark, d):
    """The fields of every resolved instance, of whatever class, one row each."""
    h = _heap(spark, d)
    rows = resolve.resolved_instances(h.fields, h.names).select("object_id", "class_name", F.explode("fields").alias("f"))
    return rows.select("object_id", "class_name", F.col("f.ord").cast("long").alias("ord"), F.col("f.name").alias("name"), F.col("f.value.ref_id").alias("ref_id"), F.col("f.value.i").alias("i"), F.col("f.value.d").alias("d"))


def obj_array_elements(spark, d):
    rows = resolve.array_elements(_heap(spark, d)["obj_array"])
    return rows.select("array_id", F.col("pos").cast("long").alias("pos"), "element_id")


def prim_array_decode(spark, d):
    """Every element of every primitive array: bytes and UTF-16 code units in ``i``, floats in ``d``."""
    rows = resolve.prim_elements(_heap(spark, d)["prim_array"])
    return rows.select("array_id", F.col("element_type").cast("int").alias("element_type"), F.col("pos").cast("long").alias("pos"), F.col("value.i").alias("i"), F.col("value.d").alias("d"))


# --- arrays --------------------------------------------------------------------------------------------------------


def array_sizes(spark, d):
    return _heap(spark, d).array_size.select("kind", "object_id", "byte_size")


def largest_arrays(spark, d):
    return stats.arrays_by_size(_heap(spark, d).array_size, "object", limit=50).select("object_id", "byte_size")


def top5_per_kind(spark, d):
    return stats.largest_per_kind(_heap(spark, d).array_size).select("kind", F.col("rank").cast("long").alias("rank"), "object_id", "byte_size")


def obj_arrays_by_length(spark, d):
    rows = _heap(spark, d)["obj_array"].where(F.col("element_class_id") == R.class_id(4))
    return stats.page(rows.select("array_id", "num_elements"), F.desc("num_elements"), "array_id", limit=50)


def array_counts(spark, d):
    return stats.array_counts(_heap(spark, d).array_size).select("kind", "arrays")


# --- roots, references, paths --------------------------------------------------------------------------------------


def root_summary(spark, d):
    return stats.root_counts(_heap(spark, d)["gc_root"]).select("root_type", "label", "roots")


def roots_by_type_page(spark, d):
    rows = stats.roots_listed(_heap(spark, d)["gc_root"])
    return rows.select("root_type", F.col("rank").cast("long").alias("rank"), "object_id", "total")


def is_gc_root(spark, d):
    h = _heap(spark, d)
    return stats.is_root(h.shallow.select("object_id"), "object_id", h["gc_root"])


def root_types_of(spark, d):
    return stats.root_types_of(_heap(spark, d)["gc_root"]).select("object_id", F.array_join("root_types", ",").alias("root_types"))


def references(spark, d):
    return _heap(spark, d).refs


def ref_count_by_kind(spark, d):
    return graph.reference_counts(_heap(spark, d).refs)


def referrers_top50(spark, d):
    h = _heap(spark, d)
    suppliers = table(spark, d, "supplier").select((F.col("s_suppkey") + 7 * K).alias("object_id"))
    return graph.referrers(h.refs, suppliers).select("to_object_id", F.col("rank").cast("long").alias("rank"), "from_object_id")


def path_to_root(spark, d):
    h = _heap(spark, d)
    found = graph.path_to_root(h.refs, h["gc_root"], 4 * K + 7)
    return spark.createDataFrame([(found["status"], i, o) for i, o in enumerate(found["path"])] or [(found["status"], 0, None)], "status string, pos long, object_id long")


def paths_all(spark, d):
    h = _heap(spark, d)
    reached = graph.reachable(h.refs, h["gc_root"], h.shallow.select("object_id"))
    paths = graph.paths_to_roots(reached)
    return paths.select("object_id", (F.size("path") - 1).cast("long").alias("hops"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# --- dominators ----------------------------------------------------------------------------------------------------


def dominators(spark, d):
    return _heap(spark, d).dominator


def dominators_distributed(spark, d):
    """The same graph taken apart, as if it were too large for one task."""
    h = _heap(spark, d)
    return dom.dominators(h.shallow.select("object_id"), h.refs, h["gc_root"], capacity=10_000)


def retained_sizes(spark, d):
    return _heap(spark, d).retained


def retained_topk(spark, d):
    return dom.top_retained(_heap(spark, d).retained)


def dominatees(spark, d):
    h = _heap(spark, d)
    return dom.dominatees(h.dominator, h.retained, 1 * K + 1)


# --- comparison of two dumps ---------------------------------------------------------------------------------------


def _two(spark: SparkSession, d: str) -> tuple[R.Heap, R.Heap]:
    return R.shop_heap(spark, d, until="1997-01-01"), R.shop_heap(spark, d, since="1995-01-01", bumped=True)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """All objects of both dumps."""
    return dumpdiff.compare(*[dumpdiff.comparable(h["instance"], h["obj_array"], h["prim_array"], h["class_dump"]) for h in _two(spark, d)])


def diff_entries(spark, d):
    return _entries(spark, d).select("object_id", "entry", "changed", F.col("tag").cast("int").alias("tag"), "class_key")


def diff_changed(spark, d):
    return dumpdiff.listed(_entries(spark, d), "common", R.class_id(5), changed=True).select("object_id")


def diff_by_class(spark, d):
    names = R.shop_heap(spark, d).names
    return dumpdiff.by_class(_entries(spark, d), names, names)


def diff_top(spark, d):
    return dumpdiff.most_changed(diff_by_class(spark, d), 3).select("class_name", "count_added", "count_removed")


def diff_net_topk(spark, d):
    return dumpdiff.largest_net(diff_by_class(spark, d), 3).select("class_name", "net_change")


def diff_totals(spark, d):
    return dumpdiff.totals(diff_by_class(spark, d))


def address_reuse(spark, d):
    return _entries(spark, d).where("address_reused").select("object_id")


# --- threads -------------------------------------------------------------------------------------------------------


def thread_list(spark, d):
    t = R.thread_heap(spark, d)
    return threads.thread_list(t["start_thread"], t["end_thread"], t["utf8_name"]).select("thread_serial", "thread_name", "thread_group_name", "status")


def frame_resolution(spark, d):
    t = R.thread_heap(spark, d)
    return threads.resolved_frames(t["frame"], t["utf8_name"]).select("frame_id", "method_name", "method_signature", "line_kind", F.col("line").cast("long").alias("line"))


def frame_classes(spark, d):
    t = R.thread_heap(spark, d)
    return threads.with_class_names(t["frame"], t["load_class"], t.names).groupBy("class_name").agg(F.count("*").alias("frames"))


def thread_stacks(spark, d):
    t = R.thread_heap(spark, d)
    rows = threads.thread_stacks(t["gc_root"], t["trace"], threads.resolved_frames(t["frame"], t["utf8_name"]))
    return rows.select("thread_serial", F.col("pos").cast("long").alias("pos"), "frame_id", "method_name")


def thread_names_from_heap(spark, d):
    t = R.thread_heap(spark, d)
    return threads.heap_thread_names(t["gc_root"], t.fields, t.strings)


def size_texts(spark, d):
    sizes = _heap(spark, d).array_size.where("kind = 'object'")
    return sizes.select("object_id", S.hex_id(F.col("object_id")).alias("hex_id"), S.parse_hex_id(S.hex_id(F.col("object_id"))).alias("back"), S.size_text(F.col("byte_size") * 1000 + 1, False).alias("shown"))


# --- the whole way: tables to dump files, dump files through the data source --------------------------------------


def _decoded(spark: SparkSession, d: str) -> R.Heap:
    folder = f"{shared_dir(spark).rstrip('/')}/heaplake-dump-{uuid.uuid4().hex}"
    export_hprof(R.shop_heap(spark, d), folder)
    forget_at_exit(spark, folder)
    return R.Heap.read(spark, folder)


def hprof_class_histogram(spark, d):
    h = _decoded(spark, d)
    return stats.class_histogram(h.shallow, h.names)


def hprof_instance_fields(spark, d):
    rows = _decoded(spark, d).fields
    return rows.select("object_id", F.col("ord").cast("long").alias("ord"), "name", F.col("value.ref_id").alias("ref_id"), F.col("value.i").alias("i"), F.col("value.d").alias("d"))


def hprof_java_strings(spark, d):
    return _decoded(spark, d).strings


def hprof_references(spark, d):
    return _decoded(spark, d).refs


def hprof_resolved_roots(spark, d):
    h = _decoded(spark, d)
    return resolve.resolved_roots(h["gc_root"], h.types, h.names).select("root_type", "object_id", "resolved_name")


_FUNCTIONS = (
    hprof_class_histogram, hprof_instance_fields, hprof_java_strings, hprof_references, hprof_resolved_roots,
    class_histogram, class_histogram_legacy, class_histogram_top, histogram_totals, instances_by_name, all_classes, instances_keys, find_class_substring, find_class_exact, class_by_name, find_object,
    instances_of_class_page, instances_of_subclasses, objects_ordered, object_type_name, shallow_sizes, heap_summary, class_layout, class_closure, instance_fields, resolved_instances, java_strings, find_strings,
    wrapper_values, static_fields, declared_fields, obj_array_elements, prim_array_decode, resolved_roots, array_sizes, largest_arrays, top5_per_kind, obj_arrays_by_length, array_counts,
    root_summary, roots_by_type_page, is_gc_root, root_types_of, references, ref_count_by_kind, referrers_top50, path_to_root, paths_all, dominators, dominators_distributed, retained_sizes, retained_topk,
    dominatees, diff_entries, diff_changed, diff_by_class, diff_top, diff_net_topk, diff_totals, address_reuse, thread_list, frame_resolution, frame_classes, thread_stacks, thread_names_from_heap, size_texts,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# --- the same in SQL -----------------------------------------------------------------------------------------------

_C = R.class_id(0)
_NAMES = ", ".join(f"({_C + o}::bigint, '{name.replace('/', '.')}', {('null' if parent is None else _C + parent)}::bigint)" for o, (name, parent, *_) in R.CLASSES.items())
_LINE = f"select *, {5 * K}::bigint + l_orderkey * 64 + row_number() over (partition by l_orderkey order by {', '.join(R._LINE_ORDER)}) - 1 id from lineitem"
_LONG_TEXT = "2 * (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))"


def _base(where: str = "true", lines: str | None = None) -> str:
    """Common tables of the heap over the orders of a condition."""
    ords = f"(select * from orders where {where})"
    line = lines or f"(select l.* from ({_LINE}) l semi join {ords} o on o.o_orderkey = l.l_orderkey)"
    return f"""
with recursive names(class_id, class_name, super_id) as (values {_NAMES}),
     ords as {ords}, li as {line},
     inst(id, cls, shallow) as (
       select {1 * K}::bigint + r_regionkey, {_C + 1}::bigint, 12 from region union all select {2 * K}::bigint + n_nationkey, {_C + 2}, 12 from nation
       union all select {3 * K}::bigint + c_custkey, {_C + 3}, 24 from customer union all select {4 * K}::bigint + o_orderkey, {_C + 4}, 24 from ords
       union all select id, {_C + 5}, 32 from li union all select {6 * K}::bigint + p_partkey, {_C + 6}, 28 from part
       union all select {7 * K}::bigint + s_suppkey, {_C + 7}, 16 from supplier union all select {8 * K}::bigint + p_partkey, {_C + 8}, 9 from part
       union all select {9 * K}::bigint + p_partkey, {_C + 12}, 4 from part union all select {10 * K}::bigint + s_suppkey, {_C + 13}, 8 from supplier),
     elems(arr, pos, el) as (
       select {16 * K}::bigint + n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1, {2 * K}::bigint + n_nationkey from nation
       union all select {17 * K}::bigint + c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1, {3 * K}::bigint + c_custkey from customer
       union all select {18 * K}::bigint + o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1, {4 * K}::bigint + o_orderkey from ords
       union all select {19 * K}::bigint + l_orderkey, row_number() over (partition by l_orderkey order by id) - 1, id from li),
     arrs(id, cls) as (
       select {16 * K}::bigint + r_regionkey, {_C + 2}::bigint from region union all select {17 * K}::bigint + n_nationkey, {_C + 3} from nation
       union all select {18 * K}::bigint + c_custkey, {_C + 4} from customer union all select {19 * K}::bigint + o_orderkey, {_C + 5} from ords),
     oarr(id, cls, n) as (select a.id, a.cls, coalesce(e.n, 0) from arrs a left join (select arr, count(*) n from elems group by 1) e on e.arr = a.id),
     parr(id, code, bytes) as (
       select {20 * K}::bigint + p_partkey, 8, length(p_name) from part union all select {21 * K}::bigint + vec_id, 6, 4 * len(embedding) from embeddings
       union all select {22 * K}::bigint + doc_id, 5, {_LONG_TEXT} from documents where text is not null),
     obj(id, tag, class_key, shallow) as (
       select id, 33, cls, shallow::bigint from inst union all select id, 34, (-9223372036854775808)::bigint + cls, 8 * n from oarr
       union all select id, 35, (-4611686018427387904)::bigint + code, bytes::bigint from parr union all select class_id, 32, class_id, 0 from names),
     roots(root_type, id) as (
       select 'jni_global', {K}::bigint + r_regionkey from region union all select 'java_frame', {2 * K}::bigint + n_nationkey from nation where n_nationkey % 7 = 0
       union all select 'unknown', {21 * K}::bigint + vec_id from embeddings union all select 'sticky_class', class_id from names),
     refs(to_id, from_id, kind) as (
       select {16 * K}::bigint + r_regionkey, {K}::bigint + r_regionkey, 'field' from region union all select {17 * K}::bigint + n_nationkey, {2 * K}::bigint + n_nationkey, 'field' from nation
       union all select {18 * K}::bigint + c_custkey, {3 * K}::bigint + c_custkey, 'field' from customer union all select {19 * K}::bigint + o_orderkey, {4 * K}::bigint + o_orderkey, 'field' from ords
       union all select {6 * K}::bigint + l_partkey, id, 'field' from li union all select {7 * K}::bigint + l_suppkey, id, 'field' from li
       union all select {8 * K}::bigint + p_partkey, {6 * K}::bigint + p_partkey, 'field' from part union all select {20 * K}::bigint + p_partkey, {8 * K}::bigint + p_partkey, 'field' from part
       union all select {K}::bigint, {_C + 1}::bigint, 'static' union all select el, arr, 'element' from elems),
     prims(code, prim, width) as (values (4, 'boolean', 1), (5, 'char', 2), (6, 'float', 4), (7, 'double', 8), (8, 'byte', 1), (9, 'short', 2), (10, 'int', 4), (11, 'long', 8)),
     hist as (select class_key class_id, count(*) filter (tag <> 32) instance_count, cast(sum(shallow) as bigint) shallow_bytes from obj group by 1),
     named as (select h.class_id, coalesce(n.class_name, m.class_name || '[]', p.prim || '[]') class_name, instance_count, shallow_bytes from hist h
                 left join names n on n.class_id = h.class_id left join names m on (-9223372036854775808)::bigint + m.class_id = h.class_id left join prims p on (-4611686018427387904)::bigint + p.code = h.class_id)
"""


_H = _base()
_KINDS = "(values (0,'boolean'),(1,'char'),(2,'float'),(3,'double'),(4,'byte'),(5,'short'),(6,'int'),(7,'long'),(8,'object')) k(i, kind)"
_SIZES = "select p.prim kind, a.id object_id, a.bytes::bigint byte_size from parr a join prims p using (code) union all select 'object', id, 8 * n from oarr"
_FIELDS = f"""
  select {1 * K}::bigint + r_regionkey object_id, 0::bigint ord, 'nations' "name", {16 * K}::bigint + r_regionkey ref_id, null::bigint i, null::double d from region
  union all select {1 * K}::bigint + r_regionkey, 1, 'regionkey', null, r_regionkey, null from region
  union all select {2 * K}::bigint + n_nationkey, 0, 'customers', {17 * K}::bigint + n_nationkey, null, null from nation union all select {2 * K}::bigint + n_nationkey, 1, 'nationkey', null, n_nationkey, null from nation
  union all select {3 * K}::bigint + c_custkey, 0, 'orders', {18 * K}::bigint + c_custkey, null, null from customer union all select {3 * K}::bigint + c_custkey, 1, 'custkey', null, c_custkey, null from customer
  union all select {3 * K}::bigint + c_custkey, 2, 'acctbal', null, null, c_acctbal from customer
  union all select {4 * K}::bigint + o_orderkey, 0, 'lines', {19 * K}::bigint + o_orderkey, null, null from orders union all select {4 * K}::bigint + o_orderkey, 1, 'orderkey', null, o_orderkey, null from orders
  union all select {4 * K}::bigint + o_orderkey, 2, 'totalprice', null, null, o_totalprice from orders
  union all select id, 0, 'part', {6 * K}::bigint + l_partkey, null, null from li union all select id, 1, 'supplier', {7 * K}::bigint + l_suppkey, null, null from li
  union all select id, 2, 'quantity', null, null, l_quantity from li union all select id, 3, 'extendedprice', null, null, l_extendedprice from li
  union all select {6 * K}::bigint + p_partkey, 0, 'name', {8 * K}::bigint + p_partkey, null, null from part union all select {6 * K}::bigint + p_partkey, 1, 'size', null, p_size, null from part
  union all select {6 * K}::bigint + p_partkey, 2, 'partkey', null, p_partkey, null from part union all select {6 * K}::bigint + p_partkey, 3, 'retailprice', null, null, p_retailprice from part
  union all select {7 * K}::bigint + s_suppkey, 0, 'suppkey', null, s_suppkey, null from supplier union all select {7 * K}::bigint + s_suppkey, 1, 'acctbal', null, null, s_acctbal from supplier
  union all select {8 * K}::bigint + p_partkey, 0, 'value', {20 * K}::bigint + p_partkey, null, null from part union all select {8 * K}::bigint + p_partkey, 1, 'coder', null, 0, null from part
  union all select {9 * K}::bigint + p_partkey, 0, 'value', null, p_size, null from part union all select {10 * K}::bigint + s_suppkey, 0, 'value', null, null, s_acctbal from supplier"""


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::bigint"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


def _chains() -> dict[int, list[int]]:
    out = {}
    for o in R.CLASSES:
        out[o] = [o]
        while (up := R.CLASSES[out[o][-1]][1]) is not None:
            out[o].append(up)
    return out


def _layout_rows() -> list[tuple]:
    rows = []
    for o, chain in _chains().items():
        at, n = 0, 0
        for a in chain:
            for name, code in R.CLASSES[a][2]:
                rows.append((_C + o, n, name, code, at))
                at, n = at + {2: 8, 7: 8, 8: 1, 10: 4, 11: 8}[code], n + 1
    return rows


_IDOM = f""",
     lc as (select li.*, o.o_custkey, c.c_nationkey, n.n_regionkey from li join ords o on o.o_orderkey = li.l_orderkey join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey),
     shared as (select 6 kind, l_partkey key, * from lc union all select 7, l_suppkey, * from lc),
     idom(id, up) as (
       select id, 0::bigint from roots union all select {16 * K}::bigint + r_regionkey, {K}::bigint + r_regionkey from region
       union all select {2 * K}::bigint + n_nationkey, {16 * K}::bigint + n_regionkey from nation where n_nationkey % 7 <> 0
       union all select to_id, from_id from refs where from_id // {K} between 2 and 4
       union all select el, arr from elems where arr // {K} between 17 and 19
       union all select kind * {K}::bigint + key, case when count(distinct id) = 1 then max(id) when count(distinct l_orderkey) = 1 then {19 * K}::bigint + max(l_orderkey)
                   when count(distinct o_custkey) = 1 then {18 * K}::bigint + max(o_custkey) when count(distinct c_nationkey) = 1 then {17 * K}::bigint + max(c_nationkey)
                   when count(distinct case when c_nationkey % 7 = 0 then -1 - c_nationkey else n_regionkey end) = 1 and min(case when c_nationkey % 7 = 0 then 1 else 0 end) = 0 then {16 * K}::bigint + max(n_regionkey)
                   else 0 end from shared group by kind, key
       union all select {8 * K}::bigint + l_partkey, {6 * K}::bigint + l_partkey from lc group by l_partkey union all select {20 * K}::bigint + l_partkey, {8 * K}::bigint + l_partkey from lc group by l_partkey),
     chain(id, above) as (select id, id from idom union all select c.id, i.up from chain c join idom i on i.id = c.above where i.up <> 0),
     ret as (select above object_id, cast(sum(o.shallow) as bigint) retained_bytes from chain c join (select id, min(shallow) shallow from obj group by 1) o using (id) group by 1)
"""

def _side(name: str, orders: str, bumped: bool) -> str:
    """Common tables of all objects of one dump: what the other one is compared with."""
    o, array, prim = f"{name}_o", -(1 << 63), -(1 << 62)
    quantity = "l_quantity + case when l_partkey % 10 = 0 then 1 else 0 end" if bumped else "l_quantity"
    same = [("region", 1, "r_regionkey", 1), ("nation", 2, "n_nationkey", 2), ("customer", 3, "c_custkey", 3), (o, 4, "k", 4), ("part", 6, "p_partkey", 6), ("supplier", 7, "s_suppkey", 7), ("part", 8, "p_partkey", 8), ("part", 9, "p_partkey", 12), ("supplier", 10, "s_suppkey", 13)]
    parts = [f"select {kind * K}::bigint + {key} id, 33 tag, {_C + c}::bigint key, 0::bigint size, '' pay from {t}" for t, kind, key, c in same]
    parts += [f"select id, 33, {_C + 5}::bigint, 0, ({quantity})::varchar from li join {o} on k = l_orderkey"]
    owned = [
        ("region", "r_regionkey", "nation", "n_regionkey", "n_nationkey", 16, 2), ("nation", "n_nationkey", "customer", "c_nationkey", "c_custkey", 17, 3),
        ("customer", "c_custkey", f"(select k, o_custkey from {o} join orders on o_orderkey = k)", "o_custkey", "k", 18, 4), (o, "k", "li", "l_orderkey", "id", 19, 5),
    ]
    for owner, key, members, by, member, kind, c in owned:
        lists = f"(select {by} w, count(*) n, string_agg({member}::varchar, ',' order by {member}) els from {members} group by 1)"
        parts.append(f"select {kind * K}::bigint + {key}, 34, ({array})::bigint + {_C + c}, coalesce(n, 0), coalesce(els, '') from {owner} left join {lists} on w = {key}")
    short = "vec_id % 9 = 0" if bumped else "false"
    parts += [
        f"select {20 * K}::bigint + p_partkey, 35, ({prim})::bigint + 8, 0, '' from part",
        f"select {21 * K}::bigint + vec_id, 35, ({prim})::bigint + 6, case when {short} then 32 else len(embedding) end, case when {short} then 'short' else '' end from embeddings",
        f"select {22 * K}::bigint + doc_id, 35, ({prim})::bigint + 5, 0, '' from documents where text is not null",
        "select class_id, 32, class_id, 0, '' from names",
    ]
    return f"{o} as (select o_orderkey k from orders where {orders}), {name}(id, tag, key, size, pay) as ({' union all '.join(parts)})"


_DIFF = f"""
with names(class_id, class_name, super_id) as (values {_NAMES}), li as ({_LINE}),
     {_side("a", "o_orderdate < timestamp '1997-01-01'", False)},
     {_side("b", "o_orderdate >= timestamp '1995-01-01'", True)},
     e as (select coalesce(a.id, b.id) object_id, case when b.id is null then 'removed' when a.id is null then 'added' else 'common' end entry,
                  case when a.id is not null and b.id is not null then a.pay <> b.pay end changed, coalesce(a.tag, b.tag) tag, coalesce(a.key, b.key) class_key, a.id is not null and b.id is not null and a.size <> b.size reused
             from a full join b on b.id = a.id),
     g as (select class_key class_id, count(*) filter (entry = 'removed') count_removed, count(*) filter (entry = 'added') count_added,
                  count(*) filter (entry = 'common' and not changed) count_common_unchanged, count(*) filter (entry = 'common' and changed) count_common_changed from e group by 1),
     c as (select g.class_id, coalesce(n.class_name, m.class_name || '[]', case g.class_id - ({-(1 << 62)})::bigint when 5 then 'char[]' when 6 then 'float[]' when 8 then 'byte[]' end) class_name,
                  count_removed, count_added, count_common_unchanged, count_common_changed, count_common_unchanged + count_common_changed count_common,
                  count_removed + count_common_unchanged + count_common_changed count_before, count_added + count_common_unchanged + count_common_changed count_after, count_added - count_removed net_change
             from g left join names n on n.class_id = g.class_id left join names m on (-9223372036854775808)::bigint + m.class_id = g.class_id)
"""
_EVENTS = "with e as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events), l as (select * from e where rn <= 5) "

SQL = {
    "class_histogram": _H + "select * from named",
    "class_histogram_legacy": _H
    + """, f as (select class_key, min(id) first from obj where tag = 33 group by 1)
       select n.class_id, case when d.class_id is not null and (f.first is null or n.class_id < f.first) then 'class ' || n.class_name else n.class_name end legacy_label
         from named n left join f on f.class_key = n.class_id left join names d on d.class_id = n.class_id""",
    "class_histogram_top": _H + "select * from named order by instance_count desc, class_name, class_id limit 10",
    "histogram_totals": _H + "select count(*) classes, cast(sum(instance_count) as bigint) instances, cast(sum(shallow_bytes) as bigint) bytes from named",
    "instances_by_name": _H + "select class_name, count(*) instances from inst join names on class_id = cls group by 1",
    "all_classes": _H + "select class_id, class_name, case when class_name = '[B' then (select instance_count from named where class_name = 'byte[]') else instance_count end instance_count, shallow_bytes from named where class_id >= 0",
    "instances_keys": _H + f"select class_id, class_name, case when class_name = '[B' then -4611686018427387904 + 8 when class_name = '[Lshop.Nation;' then (-9223372036854775808)::bigint + {_C + 2} else class_id end instances_key from names",
    "find_class_substring": _H + "select * from named where class_name like '%java.lang%' and class_id >= 0",
    "find_class_exact": _H + "select * from named where class_name = 'shop.Order'",
    "class_by_name": _H + "select class_id, class_name from names where class_name = 'shop.Supplier'",
    "find_object": f"select {2 * K + 7}::bigint object_id, 33 tag",
    "instances_of_class_page": f"select {3 * K}::bigint + c_custkey object_id from customer order by 1 limit 200 offset 200",
    "instances_of_subclasses": f"select {3 * K}::bigint + c_custkey object_id, {_C + 3}::bigint class_id from customer union all select {7 * K}::bigint + s_suppkey, {_C + 7} from supplier",
    "objects_ordered": _H + "select id object_id, tag from obj order by id limit 200",
    "object_type_name": _H
    + """select id object_id, class_name type_name from inst join names on class_id = cls union all select id, class_name || '[]' from oarr join names on class_id = cls
       union all select id, prim || '[]' from parr join prims using (code) union all select class_id, 'Class' from names""",
    "shallow_sizes": _H + "select id object_id, tag, class_key, shallow from obj",
    "heap_summary": _H
    + "select (select count(*) from obj) + (select count(*) from roots) sub_records, (select count(*) from refs) \"references\", (select count(distinct user_id) from events) threads, "
    + ", ".join(f"(select count(*) from roots where root_type = '{r}') {r}" for r in ("unknown", "jni_global", "jni_local", "java_frame", "native_stack", "sticky_class", "thread_block", "monitor_used", "thread_object")),
    "class_layout": _values(_layout_rows(), 'class_id, ord, "name", type_code, "offset"').replace("select *", 'select class_id, ord, "name", type_code::int type_code, "offset"'),
    "class_closure": _values([(_C + o, h, _C + a) for o, chain in _chains().items() for h, a in enumerate(chain)], "class_id, hop, ancestor_id"),
    "instance_fields": f"with li as ({_LINE}) " + _FIELDS,
    "java_strings": f"select {8 * K}::bigint + p_partkey object_id, p_name \"text\" from part",
    "find_strings": f"select {8 * K}::bigint + p_partkey object_id, p_name \"text\" from part where p_name like '%r%'",
    "wrapper_values": f"select {9 * K}::bigint + p_partkey object_id, 'int' kind, p_size::bigint i, null::double d from part union all select {10 * K}::bigint + s_suppkey, 'double', null, s_acctbal from supplier",
    "static_fields": _values([(_C + o, n, v if c == 2 else None, None if c == 2 else v) for o, (_, _, _, statics) in R.CLASSES.items() for n, c, v in statics], 'class_id, "name", ref_id, i'),
    "declared_fields": _values([(t, sum(1 for _, _, f, _ in R.CLASSES.values() for _, c in f if c == k)) for k, t in ((2, "Object"), (7, "double"), (8, "byte"), (10, "int"), (11, "long"))], "type_name, fields"),
    "resolved_roots": _H
    + "select root_type, id object_id, case root_type when 'sticky_class' then (select class_name from names where class_id = id) when 'unknown' then 'float[]' when 'jni_global' then 'shop.Region' else 'shop.Nation' end resolved_name from roots",
    "array_sizes": _H + _SIZES,
    "largest_arrays": _H + "select id object_id, 8 * n byte_size from oarr order by 2 desc, 1 limit 50",
    "top5_per_kind": _H + f"select kind, row_number() over (partition by kind order by byte_size desc, object_id) \"rank\", object_id, byte_size from ({_SIZES}) qualify \"rank\" <= 5",
    "obj_arrays_by_length": _H + f"select id array_id, n num_elements from oarr where cls = {_C + 4} order by n desc, id limit 50",
    "array_counts": _H + f"select kind, count(object_id) arrays from {_KINDS} left join ({_SIZES}) using (kind) group by 1",
    "root_summary": _H
    + "select t.root_type, label, count(id) roots from (values ('unknown','Unknown'),('jni_global','JNI global'),('jni_local','JNI local'),('java_frame','Java frame'),('native_stack','Native stack'),('sticky_class','Sticky class'),"
    + "('thread_block','Thread block'),('monitor_used','Monitor used'),('thread_object','Thread object')) t(root_type, label) left join roots using (root_type) group by 1, 2",
    "roots_by_type_page": _H + 'select root_type, row_number() over (partition by root_type order by id) "rank", id object_id, count(*) over (partition by root_type) total from roots qualify "rank" <= 50',
    "root_types_of": _H + "select id object_id, root_type root_types from roots",
    "references": _H + "select to_id to_object_id, from_id from_object_id, kind from refs",
    "ref_count_by_kind": _H + "select kind, count(*) refs from refs group by 1",
    "referrers_top50": _H + f'select to_id to_object_id, row_number() over (partition by to_id order by from_id) "rank", from_id from_object_id from refs where to_id // {K} = 7 qualify "rank" <= 50',
    "path_to_root": _H
    + f""", o as (select * from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderkey = 7),
       p(step, object_id) as (select 0, {4 * K + 7}::bigint from o union all select 1, {18 * K}::bigint + o_custkey from o union all select 2, {3 * K}::bigint + o_custkey from o
         union all select 3, {17 * K}::bigint + c_nationkey from o union all select 4, {2 * K}::bigint + c_nationkey from o
         union all select 5, {16 * K}::bigint + n_regionkey from o where n_nationkey % 7 <> 0 union all select 6, {K}::bigint + n_regionkey from o where n_nationkey % 7 <> 0)
       select 'Found' status, row_number() over (order by step desc) - 1 pos, object_id from p""",
    "paths_all": _H
    + """, pairs as materialized (select distinct to_id, from_id from refs),
       walk(id, h) as (select id, 0::bigint from roots union select to_id, h + 1 from walk join pairs on from_id = walk.id where h < 14),
       near as materialized (select id, min(h) hops from walk group by 1),
       ends as materialized (select to_id, from_id, hops - 1 before from pairs join near on id = to_id),
       above as materialized (select to_id id, min(from_id) up from ends join near on id = from_id and hops = before group by 1),
       way(id, hops, path) as (select id, hops, id::varchar from near where hops = 0 union all select a.id, w.hops + 1, w.path || '>' || a.id from way w join above a on a.up = w.id)
       select id object_id, hops, path from way""",
    "diff_changed": _DIFF + f"select object_id from e where entry = 'common' and changed and class_key = {_C + 5}",
    "thread_list": _EVENTS + "select user_id thread_serial, 'user-' || user_id thread_name, '' thread_group_name, case when event_type = 'error' then 'ended' else 'running' end status from e where rn = 1",
    "frame_resolution": _EVENTS
    + "select event_id frame_id, event_type method_name, '' method_signature, case event_type when 'view' then 'line' when 'click' then 'none' when 'signup' then 'unknown' when 'purchase' then 'compiled' else 'native' end line_kind, "
    + "case when event_type = 'view' then event_id % 500 + 1 end \"line\" from l",
    "frame_classes": _EVENTS + "select 'shop.Order' class_name, count(*) frames from l",
    "thread_stacks": _EVENTS + "select user_id thread_serial, rn - 1 pos, event_id frame_id, event_type method_name from l",
    "thread_names_from_heap": "select distinct user_id thread_serial, 'user-' || user_id thread_name from events",
    "size_texts": _H
    + """select id object_id, '0x' || lower(to_hex(id)) hex_id, id back, case when 8000 * n + 1 >= 1000000000 then printf('%.1fG', (8000 * n + 1) / 1e9) when 8000 * n + 1 >= 1000000 then printf('%.1fM', (8000 * n + 1) / 1e6)
       when 8000 * n + 1 >= 1000 then printf('%.1fK', (8000 * n + 1) / 1e3) else (8000 * n + 1) || 'B' end shown from oarr""",
}
SQL |= {f"hprof_{n}": SQL[n] for n in ("class_histogram", "instance_fields", "java_strings", "references", "resolved_roots")}
SQL |= {
    "dominators": _H + _IDOM + "select id object_id, up dominator_id from idom",
    "dominators_distributed": _H + _IDOM + "select id object_id, up dominator_id from idom",
    "retained_sizes": _H + _IDOM + "select * from ret",
    "retained_topk": _H + _IDOM + "select * from ret order by retained_bytes desc, object_id limit 50",
    "dominatees": _H + _IDOM + f"select object_id, retained_bytes from ret join idom on id = object_id where up = {K + 1}",
    "diff_entries": _DIFF + "select object_id, entry, changed, tag, class_key from e",
    "diff_by_class": _DIFF + "select * from c",
    "diff_top": _DIFF + "select class_name, count_added, count_removed from c order by count_added + count_removed desc, class_name, class_id limit 3",
    "diff_net_topk": _DIFF + "select class_name, net_change from c order by abs(net_change) desc, class_name, class_id limit 3",
    "diff_totals": _DIFF + "select " + ", ".join(f"cast(sum({x}) as bigint) {x}" for x in ("count_removed", "count_added", "count_common_unchanged", "count_common_changed", "count_common")) + " from c",
    "address_reuse": _DIFF + "select object_id from e where reused",
    "resolved_instances": _H + f", f as ({_FIELDS}) select f.object_id, class_name, f.ord, f.name, f.ref_id, f.i, f.d from f join inst on inst.id = f.object_id join names on class_id = cls",
    "obj_array_elements": _H + "select arr array_id, pos, el element_id from elems",
    "prim_array_decode": f"""with units as (select {22 * K}::bigint + doc_id id, 5 code, flatten([case when unicode(c) < 65536 then [unicode(c)]
         else [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] end for c in regexp_extract_all(text, '(?s).')]) v from documents where text is not null
         union all select {20 * K}::bigint + p_partkey, 8, [unicode(c) for c in regexp_extract_all(p_name, '(?s).')] from part)
       select id array_id, code::int element_type, unnest(generate_series(0, len(v) - 1)) pos, unnest(v)::bigint i, null::double d from units where len(v) > 0
       union all select {21 * K}::bigint + vec_id, 6, unnest(generate_series(0, len(embedding) - 1)), null, unnest(embedding)::double from embeddings""",
    "is_gc_root": _H + "select id object_id, id in (select id from roots) is_root from obj",
}
