"""What dominators and retained sizes share is worked out once."""

from pyspark.sql import functions as F

from heaplake.model import Heap
from heaplake.operators import dominators as dom


def heap(spark):
    empty = spark.createDataFrame([], "object_id long, class_id long, data binary")
    h = Heap(spark, {"instance": empty, "gc_root": spark.createDataFrame([(1,)], "object_id long")})
    h.__dict__["shallow"] = spark.range(1, 6).select(F.col("id").alias("object_id"), F.lit(2).cast("long").alias("shallow"))
    h.tables["refs"] = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)], "to_object_id long, from_object_id long")
    return h


def steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dominators_are_kept_for_retained_sizes_and_dominatees(spark):
    h = heap(spark)
    assert "Join" not in steps(h.dominator) and "FlatMapGroups" not in steps(h.dominator)
    assert h.sized is h.sized and "Range" not in steps(h.sized)
    found = dom.dominatees(h.dominator, h.retained, 1)
    assert [tuple(r) for r in found.collect()] == [(4, 4), (2, 2), (3, 2)]
