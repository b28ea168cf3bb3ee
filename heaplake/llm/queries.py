"""Queries of the training-data operators: percentiles (p4), token ids (p6), mixing (p7), truncation (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from . import mixing, quantiles, truncation, words

_FRACTIONS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _first(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """The value of each record's first delivery; every measure's rows in one form."""
    best = F.min(F.struct(F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col(group).cast("string").alias("grp"), F.col("dump_ts").alias("ts"), F.col(value).alias("value")))
    return df.groupBy(*keys).agg(best.alias("b")).select("b.grp", "b.ts", "b.value")


def _values(spark: SparkSession, d: str) -> DataFrame:
    """measure, grp, ts and value of every record."""
    sizes = _first(table(spark, d, "array_size"), ["dump_id", "object_id"], "kind", "byte_size")
    retained = _first(table(spark, d, "dominator"), ["dump_id", "object_id"], "dump_id", "retained_bytes")
    shallow = _first(table(spark, d, "histogram"), ["dump_id", "batch_no"], "class_id", "shallow_bytes")
    named = [rows.withColumn("measure", F.lit(m)) for m, rows in (("array_size.byte_size", sizes), ("dominator.retained_bytes", retained), ("histogram.shallow_bytes", shallow))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.summarise(_values(spark, d), F.col("measure"), F.col("grp"), F.to_date("ts"), F.col("value"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("grp", "group_key")


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per measure, group and day."""
    return _shown(quantiles.percentiles(_daily(spark, d), _FRACTIONS))


def p4_union(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per measure and group over all days, from the days' summaries."""
    merged = quantiles.merge_summaries(_daily(spark, d), ["measure", "grp"])
    return _shown(quantiles.percentiles(merged, _FRACTIONS)).drop("day")


def p4_measures(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per measure over all groups and days."""
    merged = quantiles.merge_summaries(_daily(spark, d), ["measure"])
    return _shown(quantiles.percentiles(merged, _FRACTIONS)).drop("day", "group_key")


def _bounds(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    """n of each group and, for each fraction, whether the value found is within rank_error of its rank among all values."""
    rows = materialise(_values(spark, d).withColumn("day", F.to_date("ts")), "values")
    states = quantiles.summarise(rows, F.col("measure"), F.col("grp"), F.col("day"), F.col("value"))
    merged = states if "day" in by else quantiles.merge_summaries(states, by)
    found = materialise(quantiles.percentiles(merged, _FRACTIONS), "found")
    return _shown(quantiles.rank_checks(rows, found, by, _FRACTIONS))


def p4_daily_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d, ["measure", "grp", "day"])


def p4_union_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d, ["measure", "grp"])


def p4_measures_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d, ["measure"])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return words.encode_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids decode to: what was encoded comes back."""
    decoded = words.decode_ids(p6_ids(spark, d), "doc_id", "ids")
    return decoded.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    counts = words.encode_texts(docs, "doc_id", "text", counts_only=True)
    sized = docs.select("doc_id", "source").join(counts, "doc_id")
    return docs, *mixing.plan_rates(sized, table(spark, d, "mix_target"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    docs, counted, _ = _mix(spark, d)
    return mixing.mixture(docs, counted)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "source", "cells")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_documents(spark, d)).where("cut").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.truncated(_documents(spark, d)))


def p8_ways(spark: SparkSession, d: str) -> DataFrame:
    """How many cut texts each way finds: significant lengths with incomplete endings, endings elsewhere, copies."""
    rated = truncation.truncated(_documents(spark, d)).where("cut")
    return rated.groupBy("way").agg(F.count("*").alias("cut_texts"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The significant lengths of each source."""
    return truncation.significant_lengths(truncation.length_tests(truncation.text_lengths(_documents(spark, d))))


QUERIES = {f.__name__: f for f in (p4_daily, p4_union, p4_measures, p4_daily_bounds, p4_union_bounds, p4_measures_bounds, p6_ids, p6_decoded, p7_mixture, p7_shares, p8_found, p8_report, p8_ways, p8_lengths)}

_P4 = """
with v as (select 'array_size.byte_size' measure, any_value(kind) group_key, any_value(dump_ts) ts, any_value(byte_size) x from array_size group by dump_id, object_id
           union all select 'dominator.retained_bytes', cast(dump_id as varchar), any_value(dump_ts), any_value(retained_bytes) from dominator group by dump_id, object_id
           union all select 'histogram.shallow_bytes', cast(any_value(class_id) as varchar), any_value(dump_ts), any_value(shallow_bytes) from histogram group by dump_id, batch_no)
"""
_COLUMNS = "count(x) n, min(x) min_value, max(x) max_value, " + ", ".join(f"quantile_disc(x, {q}) {c}" for c, q in _FRACTIONS.items())
_TRUE = ", ".join(f"true {c}" for c in _FRACTIONS)

SQL = {
    "p4_daily": _P4 + f"select measure, group_key, cast(ts at time zone 'UTC' as date) \"day\", {_COLUMNS}, 0::bigint rank_error from v group by 1, 2, 3",
    # of collapsed groups only the rank is bounded, so these say that every value found is within its bound
    "p4_daily_bounds": _P4 + f"select measure, group_key, cast(ts at time zone 'UTC' as date) \"day\", count(x) n, {_TRUE} from v group by 1, 2, 3 having count(x) > 0",
    "p4_union_bounds": _P4 + f"select measure, group_key, count(x) n, {_TRUE} from v group by 1, 2 having count(x) > 0",
    "p4_measures_bounds": _P4 + f"select measure, count(x) n, {_TRUE} from v group by 1 having count(x) > 0",
    "p6_decoded": "select doc_id, md5(coalesce(text, '')) digest, length(coalesce(text, '')) chars from documents",
}
