"""Object-level comparison of two dumps of one process."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from .stats import name_buckets


def comparable(instance: DataFrame, obj_array: DataFrame, prim_array: DataFrame, class_dump: DataFrame) -> DataFrame:
    """Every object as object_id, tag, position, class_key, size and payload: what a change is decided by.

    Payloads are the instance's data, all bytes of a class dump, and the elements of arrays; the class, the trace and the
    element type of objects of one kind are not compared.
    """

    def rows(df: DataFrame, key: str, tag: int, bucket, size: str, payload) -> DataFrame:
        digest = F.concat(F.unhex(F.sha2(payload, 256)))
        return df.select(F.col(key).alias("object_id"), F.lit(tag).alias("tag"), "position", bucket.alias("class_key"), F.col(size).cast("long").alias("size"), F.when(F.length(payload) > 48, digest).otherwise(payload).alias("payload"))

    data = instance.withColumn("_n", F.length("data"))
    packed = obj_array.withColumn("_p", F.array_join(F.transform("elements", lambda e: e.cast("string")), ",").cast("binary"))
    return (
        rows(data, "object_id", dims.INSTANCE_DUMP, F.col("class_id"), "_n", F.col("data"))
        .unionByName(rows(packed, "array_id", dims.OBJ_ARRAY_DUMP, S.obj_array_key(F.col("element_class_id")), "num_elements", F.col("_p")))
        .unionByName(rows(prim_array, "array_id", dims.PRIM_ARRAY_DUMP, S.prim_array_key(F.col("element_type")), "num_elements", F.col("data")))
        .unionByName(rows(class_dump, "class_id", dims.CLASS_DUMP, F.col("class_id"), "instance_size", F.col("raw")))
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per object of either dump: entry (removed, added, common), changed (common ones), tag, positions, class_key.

    Both sides come from :func:`comparable`; of repeated ids the lowest position counts. Objects are joined by id, an
    outer join of two sorted sides. The bucket of a common object is the one it had before.
    """

    def once(df: DataFrame) -> DataFrame:
        return df.groupBy("object_id").agg(F.min(F.struct("position", "tag", "class_key", "size", "payload")).alias("_f"))

    a, b = once(before).withColumnRenamed("_f", "_a"), once(after).withColumnRenamed("_f", "_b")
    joined = a.join(b, "object_id", "full")
    gone, new = F.col("_b").isNull(), F.col("_a").isNull()
    kept = F.when(new, F.col("_b")).otherwise(F.col("_a"))
    changed = (F.col("_a.tag") != F.col("_b.tag")) | ~F.col("_a.payload").eqNullSafe(F.col("_b.payload"))
    return joined.select(
        "object_id", F.when(gone, "removed").when(new, "added").otherwise("common").alias("entry"), F.when(~gone & ~new, changed).alias("changed"),
        kept["tag"].alias("tag"), F.col("_a.position").alias("position1"), F.col("_b.position").alias("position2"), kept["class_key"].alias("class_key"),
        F.when(~gone & ~new, (F.col("_a.tag") != F.col("_b.tag")) | (F.col("_a.size") != F.col("_b.size"))).alias("address_reused"),
    )


_COUNTS = ("count_removed", "count_added", "count_common_unchanged", "count_common_changed")


def by_class(entries: DataFrame, names1: DataFrame, names2: DataFrame) -> DataFrame:
    """Per bucket the four counts, and before, after, common and net change; class dumps count under their own class."""
    tests = (F.col("entry") == "removed", F.col("entry") == "added", (F.col("entry") == "common") & ~F.col("changed"), (F.col("entry") == "common") & F.col("changed"))
    counted = entries.groupBy("class_key").agg(*[F.count(F.when(t, 1)).alias(c) for c, t in zip(_COUNTS, tests)])
    named = name_buckets(counted, names1, more=names2)
    common = F.col("count_common_unchanged") + F.col("count_common_changed")
    return named.select(
        F.col("class_key").alias("class_id"), "class_name", *_COUNTS, common.alias("count_common"), (F.col("count_removed") + common).alias("count_before"),
        (F.col("count_added") + common).alias("count_after"), (F.col("count_added") - F.col("count_removed")).alias("net_change"),
    )


def most_changed(classes: DataFrame, n: int = 50) -> DataFrame:
    return classes.orderBy(F.desc(F.col("count_added") + F.col("count_removed")), "class_name", "class_id").limit(min(n, 1_000))


def largest_net(classes: DataFrame, n: int = 50) -> DataFrame:
    return classes.orderBy(F.desc(F.abs("net_change")), "class_name", "class_id").limit(n)


def totals(classes: DataFrame) -> DataFrame:
    return classes.agg(*[F.sum(c).alias(c) for c in (*_COUNTS, "count_common")])


def listed(entries: DataFrame, entry: str, class_key: int | None = None, changed: bool | None = None) -> DataFrame:
    """Rows of one kind, of one bucket and with one change flag where given."""
    out = entries.where(F.col("entry") == entry)
    if class_key is not None:
        out = out.where(F.col("class_key") == class_key)
    return out if changed is None else out.where(F.col("changed") == changed)
