"""Names, class layouts, field values and readable objects.

Lookups of the format (name id → text, class → name, class → superclass ...) are equi-joins; the class tables are small
beside the objects, and are broadcast only when counted to be.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..functions import scalars as S
from ..session import broadcast_if_small
from . import hierarchy as trees

#: Class-level tables with up to so many rows are broadcast.
SMALL = 500_000


def value(kind: Column, ref_id: Column | None = None, i: Column | None = None, d: Column | None = None, z: Column | None = None, s: Column | None = None) -> Column:
    """The value struct: ``i`` for integer types and characters, ``d`` for float and double, ``z`` boolean, ``s`` text."""
    null = F.lit(None)
    parts = {"ref_id": (ref_id, "long"), "i": (i, "long"), "d": (d, "double"), "z": (z, "boolean"), "s": (s, "string")}
    return F.struct(kind.alias("kind"), *[(null if c is None else c).cast(t).alias(n) for n, (c, t) in parts.items()])


# --- names ---------------------------------------------------------------------------------------------------------


def lookup_names(df: DataFrame, utf8_name: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the name of ``column``'s name id in ``out``; '' where there is none."""
    names = broadcast_if_small(utf8_name.groupBy(F.col("name_id").alias("_n")).agg(F.min("name").alias("_t")), SMALL)
    return df.join(names, F.col(column) == F.col("_n"), "left").withColumn(out, F.coalesce("_t", F.lit(""))).drop("_n", "_t")


def class_names(load_class: DataFrame, utf8_name: DataFrame) -> DataFrame:
    """class_id and class_name with dots; classes whose name id is unknown are left out."""
    loaded = load_class.select("class_id", F.col("class_name_id").alias("name_id")).distinct()
    return loaded.join(utf8_name.select("name_id", "name"), "name_id").groupBy("class_id").agg(S.dotted(F.min("name")).alias("class_name"))


def find_class(names: DataFrame, name: str) -> DataFrame:
    """The class of that name (either spelling) with the smallest id, as at most one row."""
    return names.where(F.col("class_name") == S.dotted(F.lit(name))).orderBy(S.unsigned_order(F.col("class_id"))).limit(1)


def search_classes(histogram: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """Histogram rows of classes (no array buckets) whose name contains, or is, ``text``."""
    match = F.col("class_name") == text if exact else F.col("class_name").contains(text)
    return histogram.where(match & ~S.is_synthetic(F.col("class_id")))


def object_types(names: DataFrame, instance: DataFrame, obj_array: DataFrame, prim_array: DataFrame, class_dump: DataFrame) -> DataFrame:
    """object_id, tag and type_name of every dumped object; callers default absent objects to Object."""
    n = broadcast_if_small(names, SMALL)
    unnamed = F.coalesce("class_name", F.lit("Object"))
    return (
        instance.select("object_id", "class_id").join(n, "class_id", "left").select("object_id", F.lit(dims.INSTANCE_DUMP).alias("tag"), unnamed.alias("type_name"))
        .unionByName(
            obj_array.select(F.col("array_id").alias("object_id"), F.col("element_class_id").alias("class_id")).join(n, "class_id", "left")
            .select("object_id", F.lit(dims.OBJ_ARRAY_DUMP).alias("tag"), F.concat(unnamed, F.lit("[]")).alias("type_name"))
        )
        .unionByName(prim_array.select(F.col("array_id").alias("object_id"), F.lit(dims.PRIM_ARRAY_DUMP).alias("tag"), F.concat(S.type_name(F.col("element_type")), F.lit("[]")).alias("type_name")))
        .unionByName(class_dump.select(F.col("class_id").alias("object_id"), F.lit(dims.CLASS_DUMP).alias("tag"), F.lit("Class").alias("type_name")))
    )


# --- layouts and fields --------------------------------------------------------------------------------------------


def class_chain(class_dump: DataFrame) -> DataFrame:
    """class_id, hop (0: the class itself) and ancestor_id; a superclass that wasn't dumped ends the chain.

    Classes on or below a circle of superclasses have only themselves in their chain.
    """
    rows = trees.links(class_dump.withColumn("_g", F.lit(0)).withColumn("_d", F.lit(None).cast("timestamp")), "class", "_g", "class_id", "super_class_id", "_d")
    solved = trees.hierarchy(rows, paths=True)
    return solved.select(F.col("node").alias("class_id"), F.posexplode(F.coalesce("path", F.array("node"))).alias("hop", "ancestor_id"))


def class_layout(class_dump: DataFrame, utf8_name: DataFrame, id_size: int = 8, chain: DataFrame | None = None) -> DataFrame:
    """The instance fields of every class with their place in the data: leaf class first, superclasses after it.

    Columns: class_id, ord, declared_by, name, type_code, offset, width. ``chain``: the :func:`class_chain`, where it is known.
    """
    declared = class_dump.select(F.col("class_id").alias("declared_by"), F.posexplode("instance_fields").alias("_o", "_f")).select("declared_by", "_o", "_f.name_id", "_f.type_code")
    declared = lookup_names(declared, utf8_name, "name_id", "name").withColumn("width", S.type_width(F.col("type_code"), id_size).cast("long"))
    chain = (class_chain(class_dump) if chain is None else chain).join(declared, F.col("ancestor_id") == F.col("declared_by"))
    order = Window.partitionBy("class_id").orderBy("hop", "_o")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return chain.select(
        "class_id", (F.row_number().over(order) - 1).alias("ord"), "declared_by", "name", "type_code", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("offset"), "width"
    )


def decode_value(n: Column, code: Column) -> Column:
    """The value struct of a field whose big-endian bytes are the unsigned number ``n``, without leaving the JVM.

    ``n`` should be a column, not an expression: it is used several times.
    """
    name = F.when(code == dims.OBJECT, "object").otherwise(S.type_name(code))
    i = F.when((code == 5) | (code == 11), n).when(code == 8, S.signed(n, 8)).when(code == 9, S.signed(n, 16)).when(code == 10, S.signed(n, 32))
    d = F.when(code == 6, S.float_bits(n)).when(code == 7, S.double_bits(n))
    return value(name, ref_id=F.when(code == dims.OBJECT, n), i=i, d=d, z=F.when(code == 4, n != 0))


def instance_fields(instance: DataFrame, layout: DataFrame, names: list[str] | None = None, codes: list[int] | None = None) -> DataFrame:
    """One row per instance and field: object_id, class_id, ord, name, type_code and value.

    ``names`` and ``codes`` restrict the fields before anything is decoded. Fields beyond the end of the data are absent.
    """
    kept = layout
    if names is not None:
        kept = kept.where(F.col("name").isin(names))
    if codes is not None:
        kept = kept.where(F.col("type_code").isin(codes))
    per_class = kept.groupBy("class_id").agg(F.collect_list(F.struct("ord", "name", "type_code", "offset", "width")).alias("_fields"))  # a class's fields
    rows = instance.select("object_id", "class_id", "data").join(broadcast_if_small(per_class, SMALL), "class_id").withColumn("_f", F.explode("_fields"))
    raw = F.substring(F.col("data"), F.col("_f.offset").cast("int") + 1, F.col("_f.width").cast("int"))
    whole = F.length("data") >= F.col("_f.offset") + F.col("_f.width")
    numbers = rows.where(whole).select("object_id", "class_id", "_f.ord", "_f.name", "_f.type_code", S.unsigned_bytes(raw).alias("_n"))
    return numbers.select("object_id", "class_id", "ord", "name", "type_code", decode_value(F.col("_n"), F.col("type_code")).alias("value"))


def first_field(fields: DataFrame, name: str) -> DataFrame:
    """object_id, type_code and value of each instance's first field of that name (the leaf class comes first)."""
    named = fields.where(F.col("name") == name)
    return named.groupBy("object_id").agg(F.min_by(F.struct("type_code", "value"), "ord").alias("_f")).select("object_id", "_f.type_code", "_f.value")


def resolved_instances(fields: DataFrame, names: DataFrame) -> DataFrame:
    """Instances with all their fields in layout order."""
    packed = fields.groupBy("object_id", "class_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "type_code", "value"))).alias("fields"))
    return packed.join(broadcast_if_small(names, SMALL), "class_id", "left")


# --- strings and values --------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _utf16(raw: pd.Series, little: pd.Series) -> pd.Series:
    """UTF-16 text; an odd last byte is ignored, each lone surrogate becomes a replacement character."""
    return pd.Series([None if r is None else bytes(r[: len(r) & ~1]).decode("utf-16-le" if e else "utf-16-be", "replace") for r, e in zip(raw, little)], dtype=object)


def decode_text(data: Column, element_type: Column, coder: Column, little_endian: bool = False) -> Column:
    """The text of a char array or of a byte array with its coder (0 or none: Latin-1, 1: UTF-16)."""
    wide = (element_type == 5) | ((element_type == 8) & (coder == 1))
    text = _utf16(F.when(wide, data), (element_type == 8) & F.lit(little_endian))
    return F.when(wide, text).when(element_type == 8, S.latin1_text(data)).otherwise(F.lit(""))


def java_strings(instance: DataFrame, layout: DataFrame, names: DataFrame, prim_array: DataFrame, utf16_byte_order: str = "big") -> DataFrame:
    """object_id and text of every java.lang.String; '' where its array is null, missing or of another type."""
    ids = broadcast_if_small(names.where(F.col("class_name") == dims.STRING_CLASS).select("class_id"), SMALL)
    strings = instance.join(ids, "class_id", "left_semi")
    fields = instance_fields(strings, layout, names=["value", "coder"])
    packed = fields.groupBy("object_id").agg(
        F.min_by("value", F.when(F.col("name") == "value", F.col("ord"))).alias("_v"), F.min_by("value", F.when(F.col("name") == "coder", F.col("ord"))).alias("_c")
    )
    parts = strings.select("object_id").join(packed, "object_id", "left").select("object_id", F.col("_v.ref_id").alias("array_id"), F.coalesce("_c.i", F.lit(0)).alias("coder"))
    joined = parts.join(prim_array.select("array_id", "element_type", "data"), "array_id", "left")
    text = decode_text(F.col("data"), F.col("element_type"), F.col("coder"), utf16_byte_order == "little")
    return joined.select("object_id", F.coalesce(text, F.lit("")).alias("text"))


def find_strings(strings: DataFrame, text: str) -> DataFrame:
    return strings.where(F.col("text").contains(text))


def java_values(instance: DataFrame, layout: DataFrame, names: DataFrame, prim_array: DataFrame) -> DataFrame:
    """object_id, class_name and value of Strings and of the eight wrappers; a wrapper without a fitting field stays an object."""
    wrappers = broadcast_if_small(names.where(F.col("class_name").isin(list(dims.WRAPPERS))), SMALL)
    boxed = instance.join(wrappers, "class_id")
    first = first_field(instance_fields(instance.join(wrappers, "class_id", "left_semi"), layout, names=["value"]), "value")
    wanted = F.create_map(*[F.lit(x) for pair in dims.WRAPPERS.items() for x in pair])[F.col("class_name")]
    joined = boxed.select("object_id", "class_name").join(first, "object_id", "left")
    fits = F.col("value.kind") == wanted
    resolved = joined.select("object_id", "class_name", F.when(fits, F.col("value")).otherwise(value(F.lit("object"), ref_id=F.col("object_id"))).alias("value"))
    strings = java_strings(instance, layout, names, prim_array)
    return resolved.unionByName(strings.select("object_id", F.lit(dims.STRING_CLASS).alias("class_name"), value(F.lit("string"), s=F.col("text")).alias("value")))


def resolve(df: DataFrame, ids: str, values: DataFrame) -> DataFrame:
    """``df`` with ``resolved``: null for id 0, the readable value where there is one, else the object's id."""
    v = values.select(F.col("object_id").alias("_id"), F.col("value").alias("_v"))
    joined = df.join(v, F.col(ids) == F.col("_id"), "left")
    plain = F.when(F.col(ids) == 0, value(F.lit("null"))).otherwise(value(F.lit("object"), ref_id=F.col(ids)))
    return joined.withColumn("resolved", F.coalesce("_v", plain)).drop("_id", "_v")


def static_fields(class_dump: DataFrame, utf8_name: DataFrame) -> DataFrame:
    """class_id, ord, name, type_code and value of static fields."""
    rows = class_dump.select("class_id", F.posexplode("static_fields").alias("ord", "_f")).select("class_id", "ord", "_f.name_id", "_f.type_code", "_f.value")
    return lookup_names(rows, utf8_name, "name_id", "name").drop("name_id")


def constant_pool(class_dump: DataFrame) -> DataFrame:
    return class_dump.select("class_id", F.posexplode("const_pool").alias("ord", "_c")).select("class_id", "ord", "_c.cp_index", "_c.value")


def declared_fields(class_dump: DataFrame, utf8_name: DataFrame) -> DataFrame:
    rows = class_dump.select("class_id", F.posexplode("instance_fields").alias("ord", "_f")).select("class_id", "ord", "_f.name_id", "_f.type_code")
    return lookup_names(rows, utf8_name, "name_id", "name").drop("name_id").withColumn("type_name", S.type_name(F.col("type_code"), "Object"))


def array_elements(obj_array: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """array_id, pos, element_id of object arrays, with ``resolved`` if values are given."""
    rows = obj_array.select("array_id", F.posexplode("elements").alias("pos", "element_id"))
    return rows if values is None else resolve(rows, "element_id", values)


def prim_elements(prim_array: DataFrame, most: int | None = None) -> DataFrame:
    """array_id, element_type, pos and value of primitive arrays' elements, all or the first ``most`` of each."""
    w = S.type_width(F.col("element_type"))
    n = F.floor(F.length("data") / w).cast("int")
    n = n if most is None else F.least(n, F.lit(most))
    rows = prim_array.where(n > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))
    raw = F.substring(F.col("data"), F.col("pos") * w + 1, w)
    numbers = rows.select("array_id", "element_type", "pos", S.unsigned_bytes(raw).alias("_n"))
    return numbers.select("array_id", "element_type", "pos", decode_value(F.col("_n"), F.col("element_type")).alias("value"))


def resolved_roots(gc_root: DataFrame, types: DataFrame, names: DataFrame) -> DataFrame:
    """Roots with the type of their object, or for sticky classes the class's name ('' if unknown)."""
    t = types.select("object_id", "type_name")
    joined = gc_root.join(t, "object_id", "left").join(broadcast_if_small(names, SMALL), F.col("object_id") == F.col("class_id"), "left")
    label = F.when(F.col("root_type") == "sticky_class", F.coalesce("class_name", F.lit(""))).otherwise(F.coalesce("type_name", F.lit("Object")))
    return joined.select(*gc_root.columns, label.alias("resolved_name"))
