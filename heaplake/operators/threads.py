"""Threads, stack traces and frames with their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .resolve import lookup_names


def resolved_frames(frame: DataFrame, utf8_name: DataFrame) -> DataFrame:
    """Frames with names ('' where unknown) and what their line number says."""
    out = frame
    for column, name in (("method_name_id", "method_name"), ("method_sig_id", "method_signature"), ("source_file_id", "source_file")):
        out = lookup_names(out, utf8_name, column, name)
    line = F.col("line_number")
    return out.select("frame_id", "method_name", "method_signature", "source_file", "class_serial", S.line_kind(line).alias("line_kind"), F.when(line > 0, line).alias("line"))


def with_class_names(frames: DataFrame, load_class: DataFrame, names: DataFrame) -> DataFrame:
    """Frames with the name of their class, through the class serial (an addition)."""
    serials = load_class.groupBy("class_serial").agg(F.min("class_id").alias("class_id")).join(names, "class_id")
    return frames.join(serials.select("class_serial", "class_name"), "class_serial", "left")


def trace_frames(trace: DataFrame, frame: DataFrame) -> DataFrame:
    """The frames of every trace in order; frames that aren't there are skipped."""
    rows = trace.select("trace_serial", "thread_serial", F.posexplode("frame_ids").alias("pos", "frame_id"))
    return rows.join(frame, "frame_id")


def ended(df: DataFrame, column: str, end: DataFrame, out: str = "ended") -> DataFrame:
    """``df`` with whether ``column``'s serial has an end (or unload) record."""
    serials = end.select(F.col("serial").alias("_s")).distinct()
    return df.join(serials, F.col(column) == F.col("_s"), "left").withColumn(out, F.col("_s").isNotNull()).drop("_s")


def thread_list(start_thread: DataFrame, end_thread: DataFrame, utf8_name: DataFrame) -> DataFrame:
    out = start_thread
    for column, name in (("thread_name_id", "thread_name"), ("thread_group_name_id", "thread_group_name"), ("thread_parent_group_name_id", "thread_parent_group_name")):
        out = lookup_names(out, utf8_name, column, name)
    out = ended(out, "thread_serial", end_thread)
    return out.select("thread_serial", "thread_id", "stack_trace_serial", "thread_name", "thread_group_name", "thread_parent_group_name", F.when(F.col("ended"), "ended").otherwise("running").alias("status"))


def thread_objects(gc_root: DataFrame) -> DataFrame:
    """The first thread object root (by position) of every thread serial."""
    rows = gc_root.where(F.col("root_type") == "thread_object")
    return rows.groupBy("thread_serial").agg(F.min_by(F.struct("object_id", "stack_trace_serial"), "position").alias("_f")).select("thread_serial", "_f.object_id", "_f.stack_trace_serial")


def heap_thread_names(gc_root: DataFrame, fields: DataFrame, strings: DataFrame) -> DataFrame:
    """thread_serial and name from the thread objects' ``name`` fields; unnamed threads are left out.

    ``fields``: object_id, name, ord, value of instances (of thread classes at least).
    """
    named = fields.where((F.col("name") == "name") & (F.col("value.kind") == "object")).groupBy("object_id").agg(F.min_by("value.ref_id", "ord").alias("_s"))
    joined = thread_objects(gc_root).join(named, "object_id").join(strings.select(F.col("object_id").alias("_s"), "text"), "_s")
    return joined.where("text <> ''").select("thread_serial", F.col("text").alias("thread_name"))


def threads_or_roots(start_thread: DataFrame, end_thread: DataFrame, utf8_name: DataFrame, gc_root: DataFrame, heap_names: DataFrame) -> DataFrame:
    """Threads of the start records or, where a dump has none, of its thread object roots with their names or hex ids."""
    listed = thread_list(start_thread, end_thread, utf8_name).select("thread_serial", "thread_name", "thread_group_name", "status")
    if start_thread.limit(1).count():
        return listed
    roots = thread_objects(gc_root).join(heap_names, "thread_serial", "left")
    return roots.select("thread_serial", F.coalesce("thread_name", S.hex_id(F.col("object_id"))).alias("thread_name"), F.lit(None).cast("string").alias("thread_group_name"), F.lit(None).cast("string").alias("status"))


def thread_stacks(gc_root: DataFrame, trace: DataFrame, frames: DataFrame) -> DataFrame:
    """The stack of every thread when the dump was taken: the trace of its thread object root, frame by frame."""
    roots = thread_objects(gc_root).select("thread_serial", F.col("stack_trace_serial").alias("trace_serial"))
    return trace_frames(trace.drop("thread_serial").withColumn("thread_serial", F.lit(None).cast("long")), frames).drop("thread_serial").join(roots, "trace_serial")
