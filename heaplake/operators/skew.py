"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Every input is aggregated by the join key before anything moves, so a key is one row per task however many records it
has. Joins then meet compact states, counts multiply and sums scale by the other side's count, and what is wanted by a
coarser key is rolled up from the states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keys: Sequence[str], delivered: str, *columns: str) -> DataFrame:
    """One row per delivered record: the first delivery (ties by the smallest values) of each ``keys``.

    Null keys form records of their own. Only ``columns`` are kept.
    """
    names = [c for c in columns if c not in keys]
    if not names:
        return df.select(*keys).distinct()
    best = F.min(F.struct(F.coalesce(F.col(delivered), F.lit("0001-01-01").cast("timestamp")).alias("_at"), *names))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in names])


def key_states(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """The compact state per key: ``row_count`` and a sum for each of ``sums`` (output name → column).

    Nulls add nothing to a sum; a key whose values are all null has the sum 0. A null key is a state of its own.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias("row_count"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long")).alias(out) for out, c in sums.items()]
    )


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01, sample_rows: int = 200_000, seed: int = 7) -> DataFrame | None:
    """The keys that seem to hold at least ``share`` of all rows, or None; only a hint for where to pre-aggregate.

    Looks at a sample of about ``sample_rows`` rows; at most ``1 / share`` keys can be returned. Nothing may depend on
    the hint but the work's distribution.
    """
    total = df.count()
    if not total:
        return None
    fraction = min(1.0, sample_rows / total)
    counts = df.sample(fraction, seed).groupBy(*keys).agg(F.count("*").alias("_n"))
    found = counts.where(F.col("_n") >= max(50.0, share * fraction * total)).drop("_n").collect()
    return df.sparkSession.createDataFrame(found, df.select(*keys).schema) if found else None


def heavy_keys(df: DataFrame, scope: str, key: str, least_share: float) -> DataFrame:
    """Keys with at least ``least_share`` of all rows of their ``scope``, every delivered row counted.

    Rows with a null key count in the total but the null key is never reported.
    """
    return heavy_states(key_states(df, [scope, key], {}), scope, key, least_share)


def heavy_states(states: DataFrame, scope: str, key: str, least_share: float) -> DataFrame:
    """:func:`heavy_keys` from states (``scope``, ``key``, row_count): totals per scope are rolled up from the states and
    joined to them, so both sides of the join are already aggregated."""
    totals = roll_up(states, [scope], ["row_count"]).withColumnRenamed("row_count", "total_rows")
    shares = states.where(F.col(key).isNotNull()).join(totals, scope)
    return shares.where(F.col("row_count") >= F.lit(least_share) * F.col("total_rows")).select(
        scope, key, "row_count", "total_rows", (F.col("row_count") / F.col("total_rows")).alias("share")
    )


def eager_join_aggregate(left: DataFrame, right: DataFrame, keys: Sequence[str], left_sums: Mapping[str, str], right_sums: Mapping[str, str], how: str = "inner") -> DataFrame:
    """The aggregate per key of ``left`` joined with ``right``, without forming the joined rows.

    Returns keys, left_rows, right_rows, pair_count (rows of the join) and each requested sum over the rows of the join:
    a left sum counts once for every right row and the other way round. With ``how="full"`` a key of one side only has
    pair_count 0 and its own plain sums (the totals of both tables side by side). Null keys join nothing; with "full"
    they are kept as a row of each side. Products have 38 decimal digits, so two keys of billions of rows don't overflow.
    """
    a = key_states(left, keys, left_sums).withColumnRenamed("row_count", "left_rows")
    b = key_states(right, keys, right_sums).withColumnRenamed("row_count", "right_rows")
    joined = a.join(b, list(keys), how)
    lr, rr = F.coalesce("left_rows", F.lit(0).cast("long")), F.coalesce("right_rows", F.lit(0).cast("long"))

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    scale = (lambda n, other: F.coalesce(F.col(n), F.lit(0).cast("long"))) if how == "full" else (lambda n, other: wide(F.col(n)) * wide(other))
    return joined.select(
        *keys, lr.alias("left_rows"), rr.alias("right_rows"), (wide(lr) * wide(rr)).alias("pair_count"),
        *[scale(n, rr).alias(n) for n in left_sums], *[scale(n, lr).alias(n) for n in right_sums],
    )


def roll_up(states: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Coarser totals from the states of a finer key."""
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
