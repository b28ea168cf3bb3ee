"""Percentiles of doubles, and values whose rank is checked against all rows."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaplake.llm import quantiles

FRACTIONS = {"p1": 0.01, "p50": 0.5, "p99": 0.99}


@pytest.mark.parametrize("size", [16, 4096])
def test_doubles_keep_their_fractions(spark, size):
    rng = random.Random(1)
    rows = [("m", rng.choice(["a", "b"]), date(2025, 1, 1), rng.choice([0.5, -0.25, -0.0, 1e300, -1e-300, rng.gauss(0, 1), None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "m string, g string, d date, v double")
    states = quantiles.summarise(df, F.col("m"), F.col("g"), F.col("d"), F.col("v"), size=size)
    for r in quantiles.percentiles(states, FRACTIONS, real=True).collect():
        values = np.sort([v for _, g, _, v in rows if g == r["grp"] and v is not None])
        assert (r["n"], r["min_value"], r["max_value"]) == (len(values), values[0], values[-1])
        for c, q in FRACTIONS.items():
            rank, at = max(1, int(np.ceil(q * len(values)))), r[c]
            assert at in values and np.searchsorted(values, at, "left") + 1 - r["rank_error"] <= rank <= np.searchsorted(values, at, "right") + r["rank_error"]
            assert size < 900 or at == values[rank - 1]


def test_other_types_are_refused(spark):
    df = spark.createDataFrame([("m", "g", date(2025, 1, 1))], "m string, g string, d date").withColumn("v", F.lit("1.5").cast("decimal(10,2)"))
    with pytest.raises(ValueError, match="decimal"):
        quantiles.summarise(df, F.col("m"), F.col("g"), F.col("d"), F.col("v"))


def test_rank_checks_see_a_wrong_value(spark):
    rows = spark.createDataFrame([("m", i) for i in range(100)] + [(None, 5), ("m", None)], "measure string, value long")
    found = spark.createDataFrame([("m", 100, 2, 47), (None, 1, 0, 5)], "measure string, n long, rank_error long, p50 long")
    assert [r["p50"] for r in quantiles.rank_checks(rows, found, ["measure"], {"p50": 0.5}).where("measure is not null").collect()] == [True]
    wrong = found.withColumn("p50", F.lit(46).cast("long"))
    assert {r["measure"]: r["p50"] for r in quantiles.rank_checks(rows, wrong, ["measure"], {"p50": 0.5}).collect()} == {"m": False, None: False}
