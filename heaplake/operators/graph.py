"""References between objects and ways to the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from ..session import join_few, materialise
from . import hierarchy as trees
from . import resolve


def references(instance: DataFrame, layout: DataFrame, class_dump: DataFrame, obj_array: DataFrame) -> DataFrame:
    """Every reference as to_object_id, from_object_id and kind (field, static, element).

    A multiset: the same pair may occur again, and targets may be absent. Null references are dropped; superclasses,
    loaders and the constant pool are no references.
    """
    fields = resolve.instance_fields(instance, layout, codes=[dims.OBJECT]).select(F.col("value.ref_id").alias("to_object_id"), F.col("object_id").alias("from_object_id"), F.lit("field").alias("kind"))
    statics = class_dump.select(F.col("class_id").alias("from_object_id"), F.explode("static_fields").alias("_f")).where(F.col("_f.type_code") == dims.OBJECT)
    statics = statics.select(F.col("_f.value.ref_id").alias("to_object_id"), "from_object_id", F.lit("static").alias("kind"))
    elements = obj_array.select(F.explode("elements").alias("to_object_id"), F.col("array_id").alias("from_object_id"), F.lit("element").alias("kind"))
    return fields.unionByName(statics).unionByName(elements).where("to_object_id <> 0")


def referrers(refs: DataFrame, to: int | DataFrame, limit: int = dims.MAX_REFERRERS) -> DataFrame:
    """At most ``limit`` referrers, by id, of one object or of each ``object_id`` of a DataFrame."""
    if isinstance(to, int):
        return refs.where(F.col("to_object_id") == to).orderBy(S.unsigned_order(F.col("from_object_id"))).limit(limit).select("to_object_id", "from_object_id")
    wanted = refs.join(to.select(F.col("object_id").alias("to_object_id")).distinct(), "to_object_id", "left_semi")
    order = Window.partitionBy("to_object_id").orderBy(S.unsigned_order(F.col("from_object_id")))
    return wanted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("to_object_id", "from_object_id", "rank")


def reference_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("kind").agg(F.count("*").alias("refs"))


def path_to_root(refs: DataFrame, gc_root: DataFrame, object_id: int, limit: int = dims.PATH_LIMIT, fan: int = dims.MAX_REFERRERS) -> dict:
    """The shortest way from a root to one object: status Found, NotReachable or LimitReached, and the path root first.

    Breadth-first over at most ``fan`` referrers of each object (by id), giving up at ``limit`` visited objects, so what
    the driver holds is bounded by these. Each level is one query for all objects of the level.
    """
    spark = refs.sparkSession

    def unsigned(n: int) -> int:
        return n & (1 << 64) - 1

    if gc_root.where(F.col("object_id") == object_id).limit(1).count():
        return {"status": "Found", "path": [object_id]}
    refs = materialise(refs.select("to_object_id", "from_object_id"), "edges")  # read once per level
    parent: dict[int, int | None] = {object_id: None}
    level = [object_id]
    while level:
        frontier = spark.createDataFrame([(i,) for i in level], "object_id long")
        rows = referrers(refs, frontier, fan).join(gc_root.select(F.col("object_id").alias("from_object_id"), F.lit(True).alias("root")).distinct(), "from_object_id", "left")
        found: dict[int, list] = {}
        for r in rows.collect():  # at most limit * fan rows
            found.setdefault(r["to_object_id"], []).append((unsigned(r["from_object_id"]), r["rank"], r["from_object_id"], r["root"]))
        following = []
        for current in level:
            for _, _, referrer, root in sorted(found.get(current, [])):
                if referrer in parent:
                    continue
                parent[referrer] = current
                if root:
                    path = [referrer]
                    while parent[path[-1]] is not None:
                        path.append(parent[path[-1]])
                    return {"status": "Found", "path": path}
                if len(parent) >= limit:
                    return {"status": "LimitReached", "path": []}
                following.append(referrer)
        level = following
    return {"status": "NotReachable", "path": []}


def reachable(refs: DataFrame, gc_root: DataFrame, nodes: DataFrame, every: int = 8) -> DataFrame:
    """object_id, parent_id (0 for roots) and hops of everything the roots reach, by breadth-first levels.

    Of several parents on the shortest level the smallest id (unsigned) is kept. ``nodes``: object_id of existing
    objects; references to others lead nowhere. Lineage is cut every level, so losing an executor costs one level.
    """
    edges = materialise(refs.select("to_object_id", "from_object_id"), "edges")
    roots = gc_root.select("object_id").distinct()
    level = materialise(roots.select("object_id", F.lit(0).cast("long").alias("parent_id"), F.lit(0).alias("hops")), "level")
    seen = level
    hops = 0
    while level.limit(1).count():
        hops += 1
        # small levels are sent to the edges where they lie; large ones meet them spread, so that no array of many elements is one task
        step = join_few(edges, level.select(F.col("object_id").alias("from_object_id")), ["from_object_id"], max_rows=1_000_000)
        new = step.groupBy(F.col("to_object_id").alias("object_id")).agg(F.min_by("from_object_id", S.unsigned_order(F.col("from_object_id"))).alias("parent_id"))
        level = materialise(new.join(seen.select("object_id"), "object_id", "left_anti").withColumn("hops", F.lit(hops)), "level")
        seen = seen.unionByName(level)
        if hops % every == 0:
            seen = materialise(seen, "seen")
    # what isn't there refers to nothing, so it needs to be left out only now
    return materialise(seen.join(nodes.select("object_id").distinct(), "object_id", "left_semi"), "reached")


def paths_to_roots(reached: DataFrame) -> DataFrame:
    """object_id and path (root first) of every reached object, from the breadth-first parents."""
    rows = reached.withColumns({"_g": F.lit(0), "_d": F.lit(None).cast("timestamp")})
    solved = trees.hierarchy(trees.links(rows, "paths", "_g", "object_id", "parent_id", "_d"), paths=True)
    return solved.select(F.col("node").alias("object_id"), F.reverse("path").alias("path"))


def path_hops(path: list[int], types: DataFrame, gc_root: DataFrame) -> DataFrame:
    """The objects of one path with their types and root types."""
    from .stats import root_types_of

    spark = types.sparkSession
    rows = spark.createDataFrame(list(enumerate(path)), "pos int, object_id long")
    small = F.broadcast(rows)  # one path, bounded by the search limit
    typed = small.join(types.select("object_id", "type_name"), "object_id", "left")
    return typed.join(root_types_of(gc_root.join(small.select("object_id"), "object_id", "left_semi")), "object_id", "left").select("pos", "object_id", F.coalesce("type_name", F.lit("Object")).alias("type_name"), "root_types")


