"""Mixing sources to target weights by Poisson replication.

Every document has a uniform number made from a seed and its id; its number of copies is the inverse of a Poisson
distribution at that number, cut at the source's cap. The distribution's mean is the source's rate. Copies grow with the
rate while the uniform numbers stay, so the tokens that a source really yields are a step function of its rate; it is
taken from a histogram of the steps (sources x grid rows, whatever the number of documents), and the rate is set where
the yield meets the target. Copies are then exploded and put in a global random order. Nothing per source or document
comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import join_few, materialise

#: The grid on which rates are set: from 1e-7 to 64 mean copies, each place about 0.12 % above the one before; see :func:`rate_grid`.
_RATES = 16_384
_GRID = np.append(0.0, np.geomspace(1e-7, 64.0, _RATES - 1))


def source_name(c: Column) -> Column:
    """A source's name in one spelling: lower case, outer blanks off, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _uniform(seed: int, key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))


def rate_grid(most: int) -> np.ndarray:
    """The grid carried on, with the same ratio, to a rate at which nearly every document has ``most`` copies."""
    top, ratio = most + 10 * math.sqrt(most) + 40, _GRID[-1] / _GRID[-2]
    more = max(0, math.ceil(math.log(top / _GRID[-1]) / math.log(ratio)))
    return np.append(_GRID, _GRID[-1] * ratio ** np.arange(1, more + 1))


def poisson_steps(u: np.ndarray, most: int, grid: np.ndarray = _GRID) -> np.ndarray:
    """For each uniform number the grid places from which on the inverse Poisson distribution is at least 1..``most``.

    The place after the last one stands for rates beyond the grid.
    """
    high = grid > _GRID[-1]  # there exp(-rate) may be too small for a product that begins with it
    logs = np.log(grid[high])
    term = below = np.exp(-grid)
    out = np.empty((len(u), most), dtype="int32")
    for copy in range(1, most + 1):
        # below = P(fewer than copy) falls along the grid; the place is the first with below <= u
        out[:, copy - 1] = len(grid) - np.searchsorted(below[::-1], u, side="right")
        term = term * grid / copy
        term[high] = np.exp(copy * logs - grid[high] - math.lgamma(copy + 1))
        below = below + term
    return out


def _steps(grid: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(u: pd.Series, most: pd.Series) -> pd.Series:
        steps = poisson_steps(u.to_numpy(), max(1, int(most.max())) if len(most) else 1, grid)
        return pd.Series([row[: max(0, m)] for row, m in zip(steps, most.tolist())])

    return run


def _level(limits: DataFrame, total: float) -> float:
    """The level L at which the sum of min(limit, share * L) is ``total``; infinite if all limits together don't reach it.

    Found by narrowing an interval, each time with one aggregation of a row per source.
    """
    bounds = limits.agg(F.sum("most").alias("all"), F.max(F.col("most") / F.col("share")).alias("top")).first()
    if bounds["all"] is None or bounds["all"] <= total:
        return math.inf
    low, high = 0.0, float(bounds["top"])
    for _ in range(6):
        marks = np.linspace(low, high, 34)[1:-1].tolist()
        sums = limits.agg(*[F.sum(F.least("most", F.col("share") * F.lit(x))).alias(f"s{i}") for i, x in enumerate(marks)]).first()
        i = int(np.searchsorted(np.array(sums, dtype="float64"), total))
        low, high = ([low, *marks][i], [*marks, high][i])
    return (low + high) / 2


def plan_rates(docs: DataFrame, targets: DataFrame, *, fill: float = 0.9, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Copies per document and the plan per source.

    ``docs``: doc_id, source, n_tokens (one row per document). ``targets``: source, target_share, max_repeats.
    The first result has doc_id, source, n_tokens, copies (0 or more) of the documents of target sources; the second, one
    row per source of either input, has source, target_share, max_repeats, source_docs, source_tokens, share_of_targets (the target among the sources that
    can be met), wanted_tokens, mixed_tokens, mixed_rows, most_repeats, actual_share, short_tokens (wanted but not there
    within the cap) and unused_tokens (of documents that occur in no copy).

    Without ``total_tokens`` the targets fix the size: the mixture is the largest in which every target share is met while
    the scarcest source uses ``fill`` of what its cap allows. With ``total_tokens`` that size is met as far as all caps
    together allow: a source at its cap gives all that it may, the others make up for it by their targets, and the
    report says what each is short of its share.

    Defined cases: sources without documents or tokens get nothing, and the others share by their targets; documents of
    sources without a target, or with a null source or id, get no copies; a null or non-positive share or cap counts as
    0. Repeated targets of a source are added (the smallest cap holds), repeated documents are one. Sources and targets
    may be any number; a document's steps take as many numbers as its cap.
    """
    nought, none = F.lit(0.0), F.lit(0)
    wanted = materialise(
        targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum(F.greatest(F.coalesce("target_share", nought), nought)).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", none), none)).alias("max_repeats")),
        "targets",
    )
    d = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(source_name(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))).alias("f")).select("doc_id", "f.*")
    most = wanted.where("target_share > 0").agg(F.max("max_repeats")).first()[0]
    grid = rate_grid(max(1, most or 0))
    live = wanted.where("max_repeats > 0 and target_share > 0")
    joined = join_few(d, live.select("source", "max_repeats"), ["source"], "left")
    # once for everything below: the steps, the stock of each source and the copies
    stepped = materialise(joined.withColumn("steps", F.when(F.col("max_repeats").isNotNull(), _steps(grid)(_uniform(seed, "doc_id"), F.coalesce("max_repeats", none)))).drop("max_repeats"), "steps")
    have = materialise(stepped.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("n_tokens").alias("source_tokens")), "stock")

    limits = live.join(have, "source").where("source_tokens > 0")
    shares = limits.agg(F.sum("target_share")).first()[0] or 1.0
    limits = materialise(limits.select("source", (F.col("target_share") / shares).alias("share"), (F.col("max_repeats") * F.col("source_tokens")).cast("double").alias("most")), "limits")
    if total_tokens is None:
        level = size = limits.agg(F.min(F.lit(fill) * F.col("most") / F.col("share"))).first()[0] or 0.0
    else:
        level, size = _level(limits, float(total_tokens)), float(total_tokens)
    aims = limits.select("source", "share", "most", F.least("most", F.col("share") * F.lit(level)).alias("aim"))

    # what each source yields at each place of the grid, and the place where the yield is nearest to its aim
    steps = stepped.select("source", "n_tokens", F.explode("steps").alias("place")).where(F.col("place") < len(grid))
    yields = steps.groupBy("source", "place").agg(F.sum("n_tokens").alias("tokens"))  # a source has at most as many rows as the grid
    reached = F.sum("tokens").over(Window.partitionBy("source").orderBy("place")).cast("double")
    choices = yields.select("source", "place", reached.alias("reached")).unionByName(limits.select("source", F.lit(-1).alias("place"), nought.alias("reached")))
    nearest = choices.join(aims, "source").groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("reached") - F.col("aim")).alias("off"), "place")).alias("best"), F.first("share").alias("share_of_targets")
    )
    chosen = materialise(nearest.select("source", F.col("best.place").alias("place"), "share_of_targets", (F.col("share_of_targets") * size).alias("wanted_tokens")), "places")

    copies = F.coalesce(F.size(F.filter("steps", lambda s: s <= F.col("place"))), none)
    each = join_few(stepped, chosen.select("source", "place"), ["source"], "left").select(
        "doc_id", "source", "n_tokens", F.col("steps").isNotNull().alias("aimed"), F.when(F.col("place").isNull() | F.col("steps").isNull(), 0).otherwise(copies).alias("copies")
    )
    used = each.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").cast("long").alias("mixed_rows"), F.max("copies").alias("most_repeats"),
        F.sum(F.when(F.col("copies") == 0, F.col("n_tokens")).otherwise(0)).alias("unused_tokens"),
    )
    report = have.where("source is not null").join(wanted, "source", "full").join(chosen.drop("place"), "source", "left").join(used, "source", "left")
    report = report.fillna({c: 0 for c in ("source_docs", "source_tokens", "mixed_tokens", "mixed_rows", "most_repeats", "unused_tokens")}).fillna({"target_share": 0.0, "share_of_targets": 0.0, "wanted_tokens": 0.0})
    report = materialise(report.withColumn("short_tokens", F.greatest(F.col("wanted_tokens") - F.col("mixed_tokens"), nought)), "report")
    total = report.agg(F.sum("mixed_tokens")).first()[0] or 0
    return each.where("aimed").drop("aimed"), report.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(total)) if total else nought)


def mixture(docs: DataFrame, counted: DataFrame, *, seed: int = 0) -> DataFrame:
    """Every copy of every document with its text: place (a global random order), doc_id, copy_no, source, n_tokens, text.

    ``docs``: doc_id and text; ``counted`` comes from :func:`plan_rates`. Rows are range-partitioned by place, so written
    files follow each other in the global order.
    """
    taken = counted.where("copies > 0").join(docs.select("doc_id", "text"), "doc_id")
    copies = taken.withColumn("copy_no", F.explode(F.sequence(F.lit(1), "copies")))
    placed = copies.select(F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no").alias("place"), "doc_id", "copy_no", "source", "n_tokens", "text")
    return placed.repartitionByRange("place", "doc_id", "copy_no").sortWithinPartitions("place", "doc_id", "copy_no")


def expected_copies(rate: float, cap: int) -> float:
    """Mean of a Poisson distribution of mean ``rate`` cut at ``cap``."""
    p, mean, rest = math.exp(-rate), 0.0, 1.0
    for k in range(cap):
        mean += k * p
        rest -= p
        p *= rate / (k + 1)
    return mean + cap * rest
