"""Mixtures reach their targets for any cap, size and number of sources, and say where they can't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaplake.llm import mixing


def two(spark, cap, **kw):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(300)] + [(1000 + i, "b", 10) for i in range(3000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, cap), ("b", 0.5, cap)], "source string, target_share double, max_repeats int")
    counted, report = mixing.plan_rates(docs, targets, **kw)
    assert counted.where(f"copies > {cap}").count() == 0
    return {r["source"]: r for r in report.collect()}


@pytest.mark.parametrize("cap", [4, 64, 100, 1000])
def test_caps_of_any_size_are_met(spark, cap):
    for r in two(spark, cap).values():
        assert abs(r["mixed_tokens"] - r["wanted_tokens"]) < 0.01 * r["wanted_tokens"], r
        assert abs(r["actual_share"] - 0.5) < 0.005
        assert r["wanted_tokens"] == pytest.approx(0.9 * cap * 3000 / 1.0, rel=0.001)


def test_asked_size_is_met_and_what_is_short_is_reported(spark):
    r = two(spark, 4, total_tokens=60_000)  # a has 12,000 at its cap, wants 30,000; b makes up for it
    assert r["a"]["mixed_tokens"] == 12_000 and r["a"]["short_tokens"] == 18_000
    assert abs(r["b"]["mixed_tokens"] - 48_000) < 500 and r["b"]["short_tokens"] == 0
    assert r["a"]["unused_tokens"] == 0
    r = two(spark, 4, total_tokens=1_000_000)  # more than all caps allow: everything as often as it may be
    assert (r["a"]["mixed_tokens"], r["b"]["mixed_tokens"]) == (12_000, 120_000)
    r = two(spark, 4, total_tokens=2_000)
    assert abs(r["a"]["mixed_tokens"] - 1_000) <= 20 and abs(r["b"]["mixed_tokens"] - 1_000) <= 20 and r["b"]["unused_tokens"] > 25_000


def test_very_many_sources(spark):
    docs = spark.range(60_000).select("id", F.concat(F.lit("s"), (F.col("id") % 12_000).cast("string")).alias("source"), F.lit(7).alias("n_tokens")).withColumnRenamed("id", "doc_id")
    targets = spark.range(12_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(1.0).alias("target_share"), F.lit(2).alias("max_repeats"))
    counted, report = mixing.plan_rates(docs, targets)
    assert counted.count() == 60_000 and report.count() == 12_000
    assert report.agg(F.max(F.abs(F.col("mixed_tokens") - F.col("wanted_tokens")))).first()[0] <= 7


def test_steps_beyond_the_grid_are_no_copies():
    grid = mixing.rate_grid(100)
    steps = mixing.poisson_steps(np.array([0.0, 0.5]), 100, grid)
    assert (steps[0] == len(grid)).all() and (steps[1] < len(grid)).all()
    assert abs(grid[steps[1][-1]] - 99.67) < 0.3  # the rate whose median is 100
