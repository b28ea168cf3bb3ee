"""A heap laid over ordinary tables: rows are objects, foreign keys are references.

Object ids are ``kind << 56 | key``. Instances carry real field bytes, so everything from layouts to dominators runs on
them as on a decoded dump.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..model import Heap
from ..session import table
from ..sources.hprof import TABLES

K = 1 << 56
#: ordinal → (name, superclass ordinal, [(field, type code)], [(static, type code, value)])
CLASSES = {
    0: ("java/lang/Object", None, [], []),
    1: ("shop/Region", 0, [("nations", 2), ("regionkey", 10)], [("first", 2, K)]),
    2: ("shop/Nation", 0, [("customers", 2), ("nationkey", 10)], []),
    3: ("shop/Customer", 9, [("orders", 2), ("custkey", 11)], []),
    4: ("shop/Order", 0, [("lines", 2), ("orderkey", 11), ("totalprice", 7)], []),
    5: ("shop/LineItem", 0, [("part", 2), ("supplier", 2), ("quantity", 7), ("extendedprice", 7)], [("LIMIT", 10, 7)]),
    6: ("shop/Part", 0, [("name", 2), ("size", 10), ("partkey", 11), ("retailprice", 7)], []),
    7: ("shop/Supplier", 9, [("suppkey", 11)], []),
    8: ("java/lang/String", 0, [("value", 2), ("coder", 8)], []),
    9: ("shop/Party", 0, [("acctbal", 7)], []),
    10: ("[B", 0, [], []),
    11: ("[Lshop/Nation;", 0, [], []),
    12: ("java/lang/Integer", 0, [("value", 10)], []),
    13: ("java/lang/Double", 0, [("value", 7)], []),
    14: ("java/lang/Thread", 0, [("name", 2)], []),
}
_LINE_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def class_id(ordinal: int) -> int:
    return 31 * K + ordinal


def _packer(layout: str):
    """A function that packs columns into big-endian bytes, a whole batch at once."""
    dtype = np.dtype([(f"f{i}", ">" + {"q": "i8", "i": "i4", "b": "i1", "d": "f8"}[c]) for i, c in enumerate(layout)])

    @F.pandas_udf(T.BinaryType())
    def pack(*columns: pd.Series) -> pd.Series:
        out = np.empty(len(columns[0]), dtype)
        for i, c in enumerate(columns):
            out[f"f{i}"] = c.to_numpy()
        raw, n = out.tobytes(), dtype.itemsize
        return pd.Series([raw[at : at + n] for at in range(0, len(raw), n)], dtype=object)

    return pack


_qi, _qqd, _qqdd, _qiqd, _qd, _qb, _i, _d, _q = map(_packer, ("qi", "qqd", "qqdd", "qiqd", "qd", "qb", "i", "d", "q"))


@F.pandas_udf(T.BinaryType())
def _floats(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, dtype=">f4").tobytes() for v in vectors], dtype=object)


def _id(kind: int, key: Column) -> Column:
    return key.cast("long") + F.lit(kind * K)


def class_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """utf8_name, load_class and class_dump of the fixed classes."""
    words = sorted({w for name, _, fields, statics in CLASSES.values() for w in [name, *[f[0] for f in fields], *[s[0] for s in statics]]})
    number = {w: i + 1 for i, w in enumerate(words)}
    null = {"kind": None, "ref_id": None, "i": None, "d": None, "z": None, "s": None}
    dumps, loads = [], []
    for o, (name, parent, fields, statics) in CLASSES.items():
        values = [{"name_id": number[n], "type_code": c, "value": null | ({"kind": "object", "ref_id": v} if c == 2 else {"kind": dims.TYPES[c][0], "i": v})} for n, c, v in statics]
        size = sum(dims.width(c, 8) for _, c in fields)
        declared = [{"name_id": number[n], "type_code": c} for n, c in fields]
        raw = struct.pack(">qq", o, size) + name.encode()
        dumps.append((class_id(o), 0, 0 if parent is None else class_id(parent), 0, 0, 0, 0, 0, size, [], values, declared, raw, class_id(o)))
        loads.append((class_id(o), number[name], o + 1, 0))
    return {
        "utf8_name": spark.createDataFrame([(i, w) for w, i in number.items()], TABLES["utf8_name"]),
        "load_class": spark.createDataFrame(loads, TABLES["load_class"]),
        "class_dump": spark.createDataFrame(dumps, TABLES["class_dump"]),
    }


def _instances(df: DataFrame, kind: int, key: Column, ordinal: int, data: Column) -> DataFrame:
    at = _id(kind, key)
    return df.select(at.alias("object_id"), F.lit(0).cast("long").alias("stack_trace_serial"), F.lit(class_id(ordinal)).alias("class_id"), data.alias("data"), at.alias("position"))


def _owned(owners: DataFrame, owner: str, members: DataFrame, by: str, kind: int, element: int) -> DataFrame:
    """The arrays of ``members``' ids per owner, empty ones included."""
    lists = members.groupBy(F.col(by).alias("_by")).agg(F.sort_array(F.collect_list("id")).alias("elements"))
    rows = owners.select(F.col(owner).alias("_by")).join(lists, "_by", "left").withColumn("elements", F.coalesce("elements", F.array().cast("array<long>")))
    at = _id(kind, F.col("_by"))
    return rows.select(at.alias("array_id"), F.lit(0).cast("long").alias("stack_trace_serial"), F.size("elements").cast("long").alias("num_elements"), F.lit(class_id(element)).alias("element_class_id"), "elements", at.alias("position"))


def _prims(df: DataFrame, kind: int, key: Column, code: int, data: Column) -> DataFrame:
    at = _id(kind, key)
    rows = df.select(at.alias("array_id"), F.lit(0).cast("long").alias("stack_trace_serial"), F.lit(code).alias("element_type"), data.alias("data"), at.alias("position"))
    return rows.select("array_id", "stack_trace_serial", (F.length("data") / dims.TYPES[code][1]).cast("long").alias("num_elements"), "element_type", "data", "position")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with ``id``: lines of an order are numbered in the order of all their columns."""
    order = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return table(spark, d, "lineitem").withColumn("id", _id(5, F.col("l_orderkey") * 64 + F.row_number().over(order) - 1))


def shop_heap(spark: SparkSession, d: str, since: str | None = None, until: str | None = None, bumped: bool = False) -> Heap:
    """The heap of all tables, or with only the orders from ``since`` on and before ``until``.

    ``bumped``: lines of every tenth part have one more in quantity (the changes between two dumps).
    """
    region, nation, customer = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    supplier, part, orders, line = table(spark, d, "supplier"), table(spark, d, "part"), table(spark, d, "orders"), lines(spark, d)
    if since or until:
        if since:
            orders = orders.where(F.col("o_orderdate") >= since)
        if until:
            orders = orders.where(F.col("o_orderdate") < until)
        line = line.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    if bumped:
        line = line.withColumn("l_quantity", F.when(F.col("l_partkey") % 10 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    c = F.col
    zero = F.lit(0).cast("tinyint")
    instance = [
        _instances(region, 1, c("r_regionkey"), 1, _qi(_id(16, c("r_regionkey")), c("r_regionkey"))),
        _instances(nation, 2, c("n_nationkey"), 2, _qi(_id(17, c("n_nationkey")), c("n_nationkey"))),
        _instances(customer, 3, c("c_custkey"), 3, _qqd(_id(18, c("c_custkey")), c("c_custkey"), c("c_acctbal"))),
        _instances(orders, 4, c("o_orderkey"), 4, _qqd(_id(19, c("o_orderkey")), c("o_orderkey"), c("o_totalprice"))),
        _instances(line, 0, c("id"), 5, _qqdd(_id(6, c("l_partkey")), _id(7, c("l_suppkey")), c("l_quantity"), c("l_extendedprice"))),
        _instances(part, 6, c("p_partkey"), 6, _qiqd(_id(8, c("p_partkey")), c("p_size"), c("p_partkey"), c("p_retailprice"))),
        _instances(supplier, 7, c("s_suppkey"), 7, _qd(c("s_suppkey"), c("s_acctbal"))),
        _instances(part, 8, c("p_partkey"), 8, _qb(_id(20, c("p_partkey")), zero)),
        _instances(part, 9, c("p_partkey"), 12, _i(c("p_size"))),
        _instances(supplier, 10, c("s_suppkey"), 13, _d(c("s_acctbal"))),
    ]
    members = {
        16: (region, "r_regionkey", nation.withColumn("id", _id(2, c("n_nationkey"))), "n_regionkey", 2),
        17: (nation, "n_nationkey", customer.withColumn("id", _id(3, c("c_custkey"))), "c_nationkey", 3),
        18: (customer, "c_custkey", orders.withColumn("id", _id(4, c("o_orderkey"))), "o_custkey", 4),
        19: (orders, "o_orderkey", line, "l_orderkey", 5),
    }
    arrays = [_owned(o, k, m, by, kind, element) for kind, (o, k, m, by, element) in members.items()]
    vectors = table(spark, d, "embeddings")
    if bumped:  # some arrays were replaced by shorter ones at the same address
        vectors = vectors.withColumn("embedding", F.when(c("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(c("embedding")))
    texts = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    prims = [
        _prims(part, 20, c("p_partkey"), 8, F.encode("p_name", "ISO-8859-1")),
        _prims(vectors, 21, c("vec_id"), 6, _floats(c("embedding"))),
        _prims(texts, 22, c("doc_id"), 5, F.encode("text", "UTF-16BE")),
    ]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def roots(df: DataFrame, slug: str, at: Column, serial: Column | None = None) -> DataFrame:
        null = F.lit(None).cast("long")
        return df.select(F.lit(slug).alias("root_type"), at.alias("object_id"), at.alias("position"), null.alias("jni_global_ref_id"), (null if serial is None else serial.cast("long")).alias("thread_serial"), null.alias("frame_number"), null.alias("stack_trace_serial"))

    classes = class_tables(spark)
    gc_root = [
        roots(region, "jni_global", _id(1, c("r_regionkey"))),
        roots(nation.where("n_nationkey % 7 = 0"), "java_frame", _id(2, c("n_nationkey")), c("n_nationkey")),
        roots(vectors, "unknown", _id(21, c("vec_id"))),
        roots(classes["class_dump"], "sticky_class", c("class_id")),
    ]
    return Heap(spark, classes | {"instance": union(instance), "obj_array": union(arrays), "prim_array": union(prims), "gc_root": union(gc_root)})


def thread_heap(spark: SparkSession, d: str) -> Heap:
    """Users as threads: their last five events are the frames of their stack; a thread whose last event is an error has ended."""
    events = table(spark, d, "events")
    c = F.col
    order = Window.partitionBy("user_id").orderBy(c("ts").desc(), c("event_id").desc())
    last = events.withColumn("rn", F.row_number().over(order)).where("rn <= 5")
    users = events.select("user_id").distinct()
    kinds = ["view", "click", "signup", "purchase", "error"]
    number = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i + 1)])[c("event_type")]
    line = F.when(c("event_type") == "view", (c("event_id") % 500 + 1)).when(c("event_type") == "click", 0).when(c("event_type") == "signup", -1).when(c("event_type") == "purchase", -2).otherwise(-3)
    none = F.lit(0).cast("long")
    frame = last.select(c("event_id").alias("frame_id"), (number + 1_000_000_000).cast("long").alias("method_name_id"), none.alias("method_sig_id"), none.alias("source_file_id"), F.lit(5).cast("long").alias("class_serial"), line.cast("int").alias("line_number"))
    stacks = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rn", "event_id"))).alias("f"))
    trace = stacks.select((c("user_id") + 1).alias("trace_serial"), c("user_id").alias("thread_serial"), c("f.event_id").alias("frame_ids"))
    start = users.select(c("user_id").alias("thread_serial"), _id(11, c("user_id")).alias("thread_id"), (c("user_id") + 1).alias("stack_trace_serial"), (c("user_id") + 2_000_000_000).alias("thread_name_id"), none.alias("thread_group_name_id"), none.alias("thread_parent_group_name_id"))
    end = last.where("rn = 1 and event_type = 'error'").select(c("user_id").alias("serial"), c("user_id").alias("position"))
    classes = class_tables(spark)
    methods = spark.createDataFrame([(1_000_000_000 + i + 1, k) for i, k in enumerate(kinds)], "name_id long, name string")
    user_names = users.select((c("user_id") + 2_000_000_000).alias("name_id"), F.concat(F.lit("user-"), c("user_id").cast("string")).alias("name"))
    instance = _instances(users, 11, c("user_id"), 14, _q(_id(12, c("user_id")))).unionByName(_instances(users, 12, c("user_id"), 8, _qb(_id(23, c("user_id")), F.lit(0).cast("tinyint"))))
    prim = _prims(users, 23, c("user_id"), 8, F.encode(F.concat(F.lit("user-"), c("user_id").cast("string")), "ISO-8859-1"))
    at, null = _id(11, c("user_id")), F.lit(None).cast("long")
    gc_root = users.select(F.lit("thread_object").alias("root_type"), at.alias("object_id"), at.alias("position"), null.alias("jni_global_ref_id"), c("user_id").alias("thread_serial"), null.alias("frame_number"), (c("user_id") + 1).alias("stack_trace_serial"))
    empty = spark.createDataFrame([], TABLES["obj_array"])
    names = classes["utf8_name"].unionByName(methods).unionByName(user_names)
    return Heap(spark, classes | {"utf8_name": names, "frame": frame, "trace": trace, "start_thread": start, "end_thread": end, "instance": instance, "prim_array": prim, "obj_array": empty, "gc_root": gc_root})
