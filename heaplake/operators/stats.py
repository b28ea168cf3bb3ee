"""Histograms, counts, lists and pages over the objects of a dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from ..session import broadcast_if_small
from .resolve import SMALL


def shallow_sizes(instance: DataFrame, obj_array: DataFrame, prim_array: DataFrame, class_dump: DataFrame, id_size: int = 8) -> DataFrame:
    """object_id, tag, bucket key and shallow bytes of every object: data bytes only, no headers; class dumps have 0."""
    return (
        instance.select("object_id", F.lit(dims.INSTANCE_DUMP).alias("tag"), S.instance_key(F.col("class_id")).alias("class_key"), F.length("data").cast("long").alias("shallow"))
        .unionByName(obj_array.select(F.col("array_id").alias("object_id"), F.lit(dims.OBJ_ARRAY_DUMP).alias("tag"), S.obj_array_key(F.col("element_class_id")).alias("class_key"), (F.col("num_elements") * id_size).alias("shallow")))
        .unionByName(prim_array.select(F.col("array_id").alias("object_id"), F.lit(dims.PRIM_ARRAY_DUMP).alias("tag"), S.prim_array_key(F.col("element_type")).alias("class_key"), (F.col("num_elements") * S.type_width(F.col("element_type"), id_size)).cast("long").alias("shallow")))
        .unionByName(class_dump.select(F.col("class_id").alias("object_id"), F.lit(dims.CLASS_DUMP).alias("tag"), F.col("class_id").alias("class_key"), F.lit(0).cast("long").alias("shallow")))
    )


def name_buckets(df: DataFrame, names: DataFrame, key: str = "class_key", more: DataFrame | None = None) -> DataFrame:
    """``df`` with ``class_name``: the class's name, ``X[]`` for array buckets, hexadecimal where unknown.

    ``more`` holds names to fall back on (the second dump of a comparison).
    """
    if more is not None:
        names = names.unionByName(more.join(names, "class_id", "left_anti"))
    k = F.col(key)
    prim = (k < 0) & (k.bitwiseAND(F.lit(1 << 62)) != 0)
    arrays = (k < 0) & ~prim
    element = F.when(arrays, k.bitwiseXOR(F.lit(dims.OBJ_ARRAY_BIT))).otherwise(k)
    n = broadcast_if_small(names.select(F.col("class_id").alias("_c"), F.col("class_name").alias("_n")), SMALL)
    joined = df.withColumn("_e", element).join(n, F.col("_e") == F.col("_c"), "left")
    plain = F.coalesce("_n", S.hex_id(F.col("_e")))
    label = F.when(prim, F.concat(S.type_name(k.bitwiseAND(F.lit(0xFF)), "unknown"), F.lit("[]"))).when(arrays, F.concat(plain, F.lit("[]"))).otherwise(plain)
    return joined.withColumn("class_name", label).drop("_e", "_c", "_n")


def class_histogram(shallow: DataFrame, names: DataFrame) -> DataFrame:
    """class_id (bucket), class_name, instance_count and shallow_bytes; classes without instances have 0.

    Rows are aggregated per bucket before names are joined, so the join meets one row a bucket.
    """
    counted = F.when(F.col("tag") != dims.CLASS_DUMP, 1)
    buckets = shallow.groupBy("class_key").agg(F.count(counted).alias("instance_count"), F.sum("shallow").alias("shallow_bytes"))
    named = name_buckets(buckets, names)
    return named.select(F.col("class_key").alias("class_id"), "class_name", "instance_count", "shallow_bytes")


def legacy_labels(histogram: DataFrame, shallow: DataFrame) -> DataFrame:
    """``legacy_label``: the name with ``class `` before it where the class's dump precedes its first instance by id."""
    first = shallow.where(F.col("tag") == dims.INSTANCE_DUMP).groupBy(F.col("class_key").alias("class_id")).agg(F.min(S.unsigned_order(F.col("object_id"))).alias("_first"))
    dumped = shallow.where(F.col("tag") == dims.CLASS_DUMP).select(F.col("class_key").alias("class_id"), F.lit(True).alias("_dumped")).distinct()
    joined = histogram.join(first, "class_id", "left").join(dumped, "class_id", "left")
    before = F.col("_dumped") & (F.col("_first").isNull() | (S.unsigned_order(F.col("class_id")) < F.col("_first")))
    return joined.withColumn("legacy_label", F.when(before, F.concat(F.lit("class "), "class_name")).otherwise(F.col("class_name"))).drop("_first", "_dumped")


def top_classes(histogram: DataFrame, n: int = dims.TOP_N) -> DataFrame:
    return histogram.orderBy(F.desc("instance_count"), "class_name", "class_id").limit(min(n, dims.MAX_TOP_N))


def totals(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.count("*").alias("classes"), F.sum("instance_count").alias("instances"), F.sum("shallow_bytes").alias("bytes"))


def all_classes(histogram: DataFrame) -> DataFrame:
    """Classes (no array buckets); a primitive array class shows the number of its arrays."""
    arrays = histogram.where(S.is_synthetic(F.col("class_id"))).select(F.col("class_id").alias("_k"), F.col("instance_count").alias("_n"))
    code = F.when(F.col("class_name").rlike(r"^\[.$"), S.descriptor_type(F.substring("class_name", 2, 1)))
    classes = histogram.where(~S.is_synthetic(F.col("class_id"))).withColumn("_code", code)
    joined = classes.join(arrays, S.prim_array_key(F.col("_code")) == F.col("_k"), "left")
    shown = F.when(F.col("_code").isNotNull(), F.coalesce("_n", F.lit(0))).otherwise(F.col("instance_count"))
    return joined.select("class_id", "class_name", shown.alias("instance_count"), "shallow_bytes")


def instances_key(names: DataFrame) -> DataFrame:
    """The bucket that holds the objects of each class: array classes map to their array buckets."""
    name = F.col("class_name")
    element = F.when(name.rlike(r"^\[L.*;$"), F.expr("substring(class_name, 3, length(class_name) - 3)"))
    first = names.groupBy(F.col("class_name").alias("_en")).agg(F.min_by("class_id", S.unsigned_order(F.col("class_id"))).alias("_eid"))
    code = F.when(name.rlike(r"^\[.$"), S.descriptor_type(F.substring("class_name", 2, 1)))
    joined = names.withColumn("_el", element).join(first, F.col("_el") == F.col("_en"), "left")
    key = F.coalesce(S.prim_array_key(code), S.obj_array_key(F.col("_eid")), F.col("class_id"))
    return joined.select("class_id", "class_name", key.alias("instances_key"))


def page(df: DataFrame, *order, offset: int = 0, limit: int = dims.PAGE) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def instances_of(instance: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Instances of exactly that class (no subclasses); none for an unknown name."""
    from .resolve import find_class

    return instance.join(broadcast_if_small(find_class(names, name).select("class_id"), 1), "class_id", "left_semi")


def instances_of_subclasses(instance: DataFrame, names: DataFrame, chain: DataFrame, name: str) -> DataFrame:
    """Instances of that class and of all its subclasses (an addition)."""
    from .resolve import find_class

    ids = chain.join(find_class(names, name).select(F.col("class_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("class_id").distinct()
    return instance.join(broadcast_if_small(ids, SMALL), "class_id", "left_semi")


# --- arrays --------------------------------------------------------------------------------------------------------


def array_sizes(obj_array: DataFrame, prim_array: DataFrame, id_size: int = 8) -> DataFrame:
    """kind, object_id, position and byte_size of every array."""
    kind = F.when(F.col("element_type") == 8, "byte")
    kinds = F.create_map(*[F.lit(x) for k, c in dims.ARRAY_KINDS.items() for x in (c, k)])
    prim = prim_array.select(kinds[F.col("element_type").cast("int")].alias("kind"), F.col("array_id").alias("object_id"), "position", (F.col("num_elements") * S.type_width(F.col("element_type"))).cast("long").alias("byte_size"))
    return prim.unionByName(obj_array.select(F.lit("object").alias("kind"), F.col("array_id").alias("object_id"), "position", (F.col("num_elements") * id_size).alias("byte_size")))


def arrays_by_size(sizes: DataFrame, kind: str, offset: int = 0, limit: int = dims.PAGE) -> DataFrame:
    return page(sizes.where(F.col("kind") == kind), F.desc("byte_size"), "object_id", offset=offset, limit=limit)


def largest_per_kind(sizes: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest arrays of each kind; the rank limit is applied before the shuffle as well as after it."""
    order = Window.partitionBy("kind").orderBy(F.desc("byte_size"), "object_id")
    return sizes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def array_counts(sizes: DataFrame) -> DataFrame:
    """Number of arrays of each of the nine kinds, zeros included."""
    found = sizes.groupBy("kind").agg(F.count("*").alias("_n"))
    return dims.array_kinds(sizes.sparkSession).join(found, "kind", "left").select("kind_index", "kind", F.coalesce("_n", F.lit(0)).alias("arrays"))


# --- roots ---------------------------------------------------------------------------------------------------------


def root_counts(gc_root: DataFrame, zeros: bool = True) -> DataFrame:
    found = gc_root.groupBy("root_type").agg(F.count("*").alias("_n"))
    out = dims.root_types(gc_root.sparkSession).join(found, "root_type", "left").select("type_index", "root_type", "label", F.coalesce("_n", F.lit(0)).alias("roots"))
    return out if zeros else out.where("roots > 0")


def root_types_of(gc_root: DataFrame) -> DataFrame:
    """object_id and its distinct root types in canonical order."""
    distinct = gc_root.groupBy("object_id").agg(F.collect_set(F.struct(S.root_index(F.col("root_type")).alias("i"), "root_type")).alias("_t"))  # nine at most
    return distinct.select("object_id", F.transform(F.sort_array("_t"), lambda x: x["root_type"]).alias("root_types"))


def is_root(df: DataFrame, column: str, gc_root: DataFrame) -> DataFrame:
    """``df`` with ``is_root``."""
    roots = gc_root.select(F.col("object_id").alias("_r")).distinct()
    return df.join(roots, F.col(column) == F.col("_r"), "left").withColumn("is_root", F.col("_r").isNotNull()).drop("_r")


def roots_listed(gc_root: DataFrame, root_type: str | None = None) -> DataFrame:
    """The first roots by id: 50 of every type, or 200 of one, each with its type's total."""
    if root_type is not None:
        gc_root, most = gc_root.where(F.col("root_type") == root_type), dims.ROOTS_OF_TYPE
    else:
        most = dims.ROOTS_PER_TYPE
    order = Window.partitionBy("root_type").orderBy(S.unsigned_order(F.col("object_id")), "position")
    counts = gc_root.groupBy("root_type").agg(F.count("*").alias("total"))
    ranked = gc_root.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(counts), "root_type")  # nine rows


def find_object(shallow: DataFrame, gc_root: DataFrame, object_id: int, tag: int | None = None) -> DataFrame:
    """The record of an id (and of that tag, if one is given), at most one row: a dumped object before any root record."""
    dumped = shallow.where(F.col("object_id") == object_id).select("object_id", F.col("tag").cast("int").alias("tag"), F.lit(0).alias("_o"))
    tags = F.create_map(*[F.lit(x) for t, (slug, *_) in dims.ROOTS.items() for x in (slug, t)])
    roots = gc_root.where(F.col("object_id") == object_id).select("object_id", tags[F.col("root_type")].alias("tag"), F.lit(1).alias("_o"))
    found = dumped.unionByName(roots)
    return (found if tag is None else found.where(F.col("tag") == tag)).orderBy("_o", "tag").limit(1).drop("_o")


def at_position(records: DataFrame, position: int) -> DataFrame:
    """The record at a place of the file, at most one row."""
    return records.where(F.col("position") == position).limit(1)


def heap_summary(sub_records: DataFrame, refs: DataFrame, threads: DataFrame, gc_root: DataFrame) -> DataFrame:
    """One row: all sub-records, references, threads, and roots of each type."""
    parts = [d.agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for w, d in (("sub_records", sub_records), ("references", refs), ("threads", threads))]
    roots = gc_root.groupBy("root_type").agg(F.count("*").alias("n")).select("n", F.col("root_type").alias("what"))
    whats = ["sub_records", "references", "threads", *dims.ROOT_ORDER]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(roots).agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in whats])
