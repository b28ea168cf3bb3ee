"""What changed between consecutive full snapshots.

Snapshots are kept range-partitioned and sorted: keys are cut into aligned ranges, the ranges of an owner are spread over
the buckets of a table, and a bucket's rows are sorted by (owner, range, key, snapshot). So an owner with a third of all
rows is split, and later snapshots are added to the buckets without moving what is there. Changes are then found without
a shuffle: one pass over each bucket merges all snapshots of an owner at once, where the row before and the row after, in
that order, are the two pointers. A single key with very many rows in a snapshot is reduced to the row that counts before
rows move.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_at_exit, forget_at_exit, join_few, shared_dir

#: Binary and string values up to this length travel as they are, longer ones as length and SHA-256.
_INLINE = 48
#: Integer keys whose upper bits are equal lie in one range of so many bits.
_RANGE_BITS = 12
_BUCKET_ROWS, _MOST_BUCKETS = 500_000, 100_000


def _comparable(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in ("binary", "string"):
        digest = F.when(F.length(c) > _INLINE, F.struct(F.length(c).alias("n"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("v")))
        return digest.when(c.isNotNull(), F.struct(F.lit(-1).alias("n"), c.cast("binary").alias("v")))
    return c


def snapshot_numbers(snapshots: DataFrame) -> DataFrame:
    """Per owner (_o) its snapshots (_s) in order of their earliest time (_t; ties by id), numbered from 0, each with the id of the next one."""
    once = snapshots.groupBy("_o", "_s").agg(F.min("_t").alias("_t"))
    order = Window.partitionBy("_o").orderBy(F.col("_t").asc_nulls_first(), "_s")
    return once.select("_o", "_s", (F.row_number().over(order) - 1).alias("_n"), F.lead("_s").over(order).alias("_next"))


def _range(df: DataFrame, key: str) -> Column:
    whole = dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    return F.shiftright(F.col(key).cast("long"), _RANGE_BITS) if whole else F.pmod(F.xxhash64(key), F.lit(1 << _RANGE_BITS))


class Kept:
    """A kept layout in a folder: ``rows``, a bucketed table, and ``snapshots`` with a row per snapshot delivered."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int):
        self.spark, self.path, self.buckets, self.table = spark, path.rstrip("/"), buckets, f"heaplake_kept_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.table} ({schema}) using parquet clustered by (_o, _r) sorted by (_o, _r, _k, _s) into {buckets} buckets location '{self.path}/rows'")
        drop_at_exit(spark, self.table)

    def add(self, rows: DataFrame, snapshots: DataFrame) -> None:
        placed = rows.repartition(self.buckets, "_o", "_r").sortWithinPartitions("_o", "_r", "_k", "_s")  # as the table is bucketed: a file per bucket
        placed.write.insertInto(self.table)
        snapshots.write.mode("append").parquet(f"{self.path}/snapshots")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def snapshots(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshots")


def keep_snapshots(
    df: DataFrame,
    *,
    owner: str = "process_id",
    snapshot: str = "dump_id",
    taken: str = "dump_ts",
    key: str = "object_id",
    position: str = "position",
    delivered: str = "ingested_at",
    compare: Sequence[str] = ("tag", "payload"),
    carry: str = "tag",
    path: str | None = None,
    to: Kept | None = None,
) -> Kept:
    """The delivered rows in the kept layout: a new one in ``path`` (a temporary one if None), or added to ``to``.

    ``df`` is read twice: its owner, snapshot, time and key columns to number snapshots and to see keys that hold many
    rows, then all columns that count. Rows without owner, snapshot or key are skipped, but a snapshot whose rows all
    lack a key is still a snapshot.
    """
    spark = df.sparkSession
    known = df.where(F.col(owner).isNotNull() & F.col(snapshot).isNotNull())
    # of each snapshot: its time, its rows and the key that may hold most of them, with an error of 0.6 % of its rows
    common = F.expr(f"approx_top_k(`{key}`, 4, 256)")
    seen = known.groupBy(F.col(owner).alias("_o"), F.col(snapshot).alias("_s")).agg(F.min(taken).alias("_t"), F.count("*").alias("_rows"), common.alias("_top"))
    folder = f"{(path or shared_dir(spark)).rstrip('/')}/heaplake-kept-{uuid.uuid4().hex}" if path is None else path
    notes = f"{folder}/seen-{uuid.uuid4().hex}"
    seen.write.parquet(notes)
    seen = spark.read.parquet(notes)
    total = seen.agg(F.sum("_rows")).first()[0] or 0

    rows = known.where(F.col(key).isNotNull()).select(
        F.col(owner).alias("_o"),
        _range(df, key).alias("_r"),
        F.col(key).alias("_k"),
        F.col(snapshot).alias("_s"),
        F.col(position).alias("_pos"),
        F.col(delivered).alias("_d"),
        F.col(carry).alias("_c"),
        F.struct(*[_comparable(df, c).alias(f"v{i}") for i, c in enumerate(compare)]).alias("_v"),
    )
    hot = seen.select("_o", "_s", F.explode("_top").alias("_x")).where(F.col("_x.item").isNotNull() & (F.col("_x.count") >= max(50, total // 100)))
    hot = hot.select("_o", "_s", F.col("_x.item").alias("_k"))  # at most a hundred keys
    if hot.limit(1).count():
        best = F.min(F.struct(F.col("_pos").isNull().alias("no_pos"), "_pos", "_d", "_v", "_c"))
        reduced = rows.join(F.broadcast(hot), ["_o", "_s", "_k"]).groupBy("_o", "_r", "_k", "_s").agg(best.alias("b"))
        rest = rows.join(F.broadcast(hot), ["_o", "_s", "_k"], "left_anti").select(rows.columns)
        rows = rest.unionByName(reduced.select("_o", "_r", "_k", "_s", "b._pos", "b._d", "b._c", "b._v"))
    if to is None:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        buckets = min(_MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total // _BUCKET_ROWS))
        to = Kept(spark, folder, schema, buckets)
        if path is None:
            forget_at_exit(spark, folder)
    to.add(rows, seen.select("_o", "_s", "_t"))
    return to


def kept_changes(kept: Kept, *, carry: str = "tag", unchanged: bool = False, max_snapshots: int = 1_000_000) -> DataFrame:
    """The changes between the consecutive snapshots of a kept layout; see :func:`snapshot_changes`."""
    numbered = join_few(kept.rows, snapshot_numbers(kept.snapshots), ["_o", "_s"], max_rows=max_snapshots)
    once = Window.partitionBy("_o", "_r", "_k", "_n").orderBy(F.col("_pos").asc_nulls_last(), "_d", "_v")
    first = numbered.withColumn("_rank", F.row_number().over(once)).where("_rank = 1").drop("_rank")
    walk = Window.partitionBy("_o", "_r", "_k").orderBy("_n")
    merged = first.select(
        "*",
        *[F.lag(c).over(walk).alias(f"_p{c}") for c in ("_n", "_s", "_pos", "_v")],
        F.lead("_n").over(walk).alias("_fn"),
    )
    adjacent = F.coalesce(F.col("_p_n") == F.col("_n") - 1, F.lit(False))
    kind = F.when(F.col("_n") == 0, None).when(~adjacent, "added").when(~F.col("_v").eqNullSafe(F.col("_p_v")), "changed")
    if unchanged:
        kind = kind.otherwise("unchanged")
    gone = F.col("_next").isNotNull() & ~F.coalesce(F.col("_fn") == F.col("_n") + 1, F.lit(False))
    entry = [
        F.struct(
            kind.alias("change_kind"), F.col("_s").alias("dump_id"),
            F.when(adjacent, F.col("_p_pos")).alias("position1"), F.col("_pos").alias("position2"),
        ),
        F.struct(
            F.when(gone, "removed").alias("change_kind"), F.col("_next").alias("dump_id"),
            F.col("_pos").alias("position1"), F.lit(None).cast(kept.rows.schema["_pos"].dataType).alias("position2"),
        ),
    ]
    out = merged.select("_o", "_k", "_c", F.explode(F.array(*entry)).alias("_e")).where("_e.change_kind is not null")
    return out.select(
        F.col("_o").alias("process_id"), F.col("_e.dump_id").alias("dump_id"), F.col("_k").alias("object_id"),
        F.col("_e.change_kind").alias("change_kind"), F.col("_c").alias(carry), F.col("_e.position1").alias("position1"), F.col("_e.position2").alias("position2"),
    )


def snapshot_changes(df: DataFrame, *, carry: str = "tag", unchanged: bool = False, max_snapshots: int = 1_000_000, **columns) -> DataFrame:
    """Keys added, removed, changed (and, if asked, unchanged) between each snapshot of an owner and the one before it.

    Returns process_id (the owner), dump_id (the later snapshot), object_id, change_kind, ``carry`` of the row that is
    reported (the earlier one for removed keys), position1 and position2. ``columns``: names as in :func:`keep_snapshots`.

    Defined cases: an owner's first snapshot gives no rows. Of several rows of a key in a snapshot the lowest position
    counts (null positions last, then the earliest delivery, then the smallest compared values). Two values are equal if
    both are null or both are the same; an empty value is not null. Rows without owner, snapshot or key are skipped. A
    snapshot's time is the earliest its rows name; equal times are ordered by snapshot id. Other columns are ignored.
    Up to ``max_snapshots`` snapshots are numbered without moving rows; beyond that rows meet their number by a salted join.
    """
    return kept_changes(keep_snapshots(df, carry=carry, **columns), carry=carry, unchanged=unchanged, max_snapshots=max_snapshots)
