"""References to records that do not exist, by bitmaps per key range and delivery period.

Keys of any type are dictionary-encoded as dense integers in key order (:func:`dictionary_encode`); only keys that are
referred to get a code, so whatever else the parent tables hold is dropped by one join. A bitmap is kept as its non-empty
64-bit words, one row per (word, period), where a word is a range of 64 neighbouring codes. Per word, a window ordered by
period ORs the parents delivered before each period, ``reference & ~parent`` leaves the keys without one, and the
dictionary decodes the bits that survive. Periods are a few minutes of delivery time; only keys whose parent arrived
within the period of the reference itself need the exact times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Delivery time of rows that carry none: before everything else.
_UNDATED = -(1 << 62)
_WORD_BITS = 6
#: Keys with at least so many references in a period are spread over several tasks.
_HOT_ROWS = 100_000


def dictionary_encode(df: DataFrame, columns: str | Sequence[str], code: str = "code") -> DataFrame:
    """The rows of ``df``, one per value of ``columns``, with dense integer codes in the order of these columns.

    With one column, repeated and null values are dropped first. Rows are range-partitioned and sorted; each partition
    numbers its own and adds the number of rows in the partitions before it (one count per partition is all that is
    gathered).
    """
    if isinstance(columns, str):
        columns, df = [columns], df.select(columns).where(F.col(columns).isNotNull()).distinct()
    number = F.monotonically_increasing_id()  # the partition, and the place in it
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_id", number)
    placed = materialise(ordered, "dictionary").withColumn("_p", F.shiftright("_id", 33))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    joined = placed.join(F.broadcast(starts), "_p")  # one row a partition
    return joined.select(*df.columns, (F.col("_s") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(code))


def _micros(delivered: Column) -> Column:
    return F.coalesce(F.unix_micros(delivered.cast("timestamp")), F.lit(_UNDATED))


def _words(df: DataFrame, reference: bool) -> DataFrame:
    """code and period as bits of words: ``_rb`` of references or ``_pb`` of parents."""
    bit, none = F.expr(f"shiftleft(1L, cast(code & {(1 << _WORD_BITS) - 1} as int))"), F.lit(None).cast("long")
    return df.select(F.shiftright("code", _WORD_BITS).alias("_w"), "period", (bit if reference else none).alias("_rb"), (none if reference else bit).alias("_pb"))


def _key(df: DataFrame, column: str) -> Column:
    """Text stays text, to be encoded by :func:`orphan_references`; numbers are integers."""
    text = df.select(column).dtypes[0][1]
    return F.col(column) if text == "string" else F.col(column).cast("long")


def references(df: DataFrame, name: str, scope: str, record: str, reference: str, delivered: str, taken: str) -> DataFrame:
    """The references of one table in the common form that :func:`orphan_references` takes."""
    return df.select(
        F.lit(name).alias("ref_table"),
        F.col(scope).cast("long").alias("scope"),
        F.col(record).cast("long").alias("record_id"),
        _key(df, reference).alias("key"),
        F.col(delivered).alias("delivered"),
        F.col(taken).alias("taken"),
    )


def targets(df: DataFrame, scope: str, key: str, delivered: str, valid: Column | None = None) -> DataFrame:
    """The records that references may point to; those that aren't ``valid`` any more are kept as deleted."""
    deleted = F.lit(False) if valid is None else ~F.coalesce(valid, F.lit(False))
    return df.select(F.col(scope).cast("long").alias("scope"), _key(df, key).alias("key"), F.col(delivered).alias("delivered"), deleted.alias("deleted"))


def orphan_references(refs: DataFrame, parents: DataFrame, period_seconds: int = 600, salts: int = 16, hot_rows: int = _HOT_ROWS) -> DataFrame:
    """References whose key has no parent in the same scope, or only one delivered after the referring record.

    ``refs`` comes from :func:`references` (several tables may be united), ``parents`` from :func:`targets`.
    Returns ref_table, scope, record_id, key, taken and ``reason``: ``missing``, ``deleted`` (all records of the key are
    deleted) or ``late``.

    Defined cases: repeated deliveries of a record (same table, scope and record_id) are one record, its first delivery
    decides (of equal times the smallest key). A null or zero key refers to nothing. Rows without scope or record_id are
    no records and are skipped, as are parents without scope or key. A null delivery time counts as before all others.
    Empty inputs give an empty result (all references, when only ``parents`` is empty). Other columns are ignored.
    An integer key on one side only counts as its text; text keys come back as text.

    A key that many records miss is one row and one bit until the end; in the join back to the records, keys with
    ``hot_rows`` references or more in a period are spread over ``salts`` tasks.
    """
    kinds = [df.select("key").dtypes[0][1] for df in (refs, parents)]
    period = period_seconds * 1_000_000
    r = (
        refs.where("scope is not null and record_id is not null")
        .groupBy("ref_table", "scope", "record_id")
        .agg(F.min(F.struct(_micros(F.col("delivered")).alias("at"), F.col("key"))).alias("_f"), F.min("taken").alias("taken"))
        .select("ref_table", "scope", "record_id", "taken", F.col("_f.at").alias("at"), F.col("_f.key").alias("key"))
        .where("key is not null" if kinds[0] == "string" else "key <> 0")
        .withColumn("period", F.expr(f"at div {period}L"))
    )
    if "string" in kinds:
        r, parents = (df.withColumn("key", F.col("key").cast("string")) for df in (r, parents))
    r = materialise(r, "references")  # for the dictionary, and at the end for the records themselves

    # the dictionary: one row per key that is referred to, with the periods in which that happened
    per_period = r.groupBy("scope", "key", "period").agg(F.count("*").alias("n"))
    per_key = per_period.groupBy("scope", "key").agg(F.collect_list(F.struct("period", "n")).alias("periods"))  # as many as there are periods
    keys = dictionary_encode(per_key, ["scope", "key"])
    if "deleted" not in parents.columns:
        parents = parents.withColumn("deleted", F.lit(False))
    there = (
        parents.where("scope is not null and key is not null").groupBy("scope", "key")
        .agg(F.min(F.when(~F.col("deleted"), _micros(F.col("delivered")))).alias("parent_at"), F.lit(True).alias("known"))
        .join(keys.select("scope", "key", "code"), ["scope", "key"]).select("code", "parent_at", "known")
    )
    there = materialise(there, "parents")

    asked = keys.select("code", F.explode("periods").alias("_p")).select("code", "_p.period")
    given = there.where("parent_at is not null").withColumn("period", F.expr(f"parent_at div {period}L"))
    words = _words(asked, True).unionByName(_words(given, False)).groupBy("_w", "period").agg(F.bit_or("_rb").alias("_rb"), F.bit_or("_pb").alias("_pb"))
    before = F.bit_or("_pb").over(Window.partitionBy("_w").orderBy("period").rangeBetween(Window.unboundedPreceding, -1))
    nothing = F.lit(0).cast("long")
    left = words.select("_w", "period", "_rb", F.coalesce(before, nothing).alias("_before")).where("_rb is not null")
    bits = left.withColumn("_orphan", F.expr("_rb & ~_before")).where("_orphan <> 0")
    decoded = bits.withColumn("_i", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(_orphan, i) & 1 = 1)"))).select(
        F.expr(f"shiftleft(_w, {_WORD_BITS}) | _i").alias("code"), "period"
    )
    names = keys.select("code", "scope", "key", F.map_from_entries("periods").alias("_n"))
    found = decoded.join(names, "code").join(there, "code", "left").select("scope", "key", "period", "parent_at", "known", F.col("_n")[F.col("period")].alias("n"))
    found = materialise(found, "orphan-keys")

    # back to the records; only a parent that came in the record's own period needs the exact time of the record
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") >= max(hot_rows, total // 10_000)).select("scope", "key", "period")  # ten thousand at most
    records = r
    if hot.limit(1).count():
        flagged = r.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), ["scope", "key", "period"], "left")
        records = flagged.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash("record_id"), F.lit(salts))).otherwise(0))
        spread = F.when(F.col("n") >= max(hot_rows, total // 10_000), salts - 1).otherwise(0)
        found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), spread)))
    joined = records.join(found, ["scope", "key", "period", *(["_salt"] if "_salt" in found.columns else [])])
    reason = F.when(F.col("parent_at").isNotNull(), "late").when(F.col("known"), "deleted").otherwise("missing")
    return joined.where("parent_at is null or at < parent_at").select("ref_table", "scope", "record_id", "key", "taken", reason.alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references and of distinct missing keys per referring table and calendar month."""
    month = F.date_format("taken", "yyyy-MM")
    per_key = orphans.groupBy("ref_table", month.alias("month"), "scope", "key").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("reason") == "late", 1)).alias("late")
    )
    return per_key.groupBy("ref_table", "month").agg(
        F.sum("n").alias("orphan_references"), F.sum("late").alias("late_references"), F.count("*").alias("missing_keys")
    )


def orphan_reasons(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per referring table, calendar month and reason (missing, deleted or late)."""
    return orphans.groupBy("ref_table", F.date_format("taken", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphan_references"))
