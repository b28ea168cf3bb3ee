"""Writes a heap's tables as hprof files, one per partition, into a shared folder that the data source reads as one dump."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions import dims
from ..model import Heap
from .codec import Writer

_SEGMENT = 8 << 20


def _value(v: dict) -> object:
    return v["ref_id"] if v["kind"] == "object" else v["z"] if v["kind"] == "boolean" else v["d"] if v["kind"] in ("float", "double") else v["i"]


def _root(w: Writer, r: dict) -> None:
    _, _, _, ids, numbers = next(x for x in dims.ROOTS.values() if x[0] == r["root_type"])
    w.root(r["root_type"], r["object_id"], *([r["jni_global_ref_id"] or 0] if ids else []), *[r[n] or 0 for n in numbers])


def _class(w: Writer, r: dict) -> None:
    statics = [(s["name_id"], s["type_code"], _value(s["value"])) for s in r["static_fields"] or []]
    fields = [(f["name_id"], f["type_code"]) for f in r["instance_fields"] or []]
    codes = {n: c for c, (n, *_) in dims.TYPES.items()}
    pool = [(c["cp_index"], codes[c["value"]["kind"]], _value(c["value"])) for c in r["const_pool"] or []]
    w.class_dump(r["class_id"], r["super_class_id"], r["instance_size"], statics, fields, pool, r["class_loader_id"], r["stack_trace_serial"])


#: table → how a row of it is written
ROWS: dict[str, Callable[[Writer, dict], object]] = {
    "utf8_name": lambda w, r: w.utf8(r["name_id"], r["name"]),
    "load_class": lambda w, r: w.load_class(r["class_serial"], r["class_id"], r["stack_serial"], r["class_name_id"]),
    "unload_class": lambda w, r: w.unload_class(r["serial"]),
    "frame": lambda w, r: w.frame(r["frame_id"], r["method_name_id"], r["method_sig_id"], r["source_file_id"], r["class_serial"], r["line_number"]),
    "trace": lambda w, r: w.trace(r["trace_serial"], r["thread_serial"], r["frame_ids"]),
    "start_thread": lambda w, r: w.start_thread(r["thread_serial"], r["thread_id"], r["stack_trace_serial"], r["thread_name_id"], r["thread_group_name_id"], r["thread_parent_group_name_id"]),
    "end_thread": lambda w, r: w.end_thread(r["serial"]),
    "gc_root": _root,
    "class_dump": _class,
    "instance": lambda w, r: w.instance(r["object_id"], r["class_id"], r["data"], r["stack_trace_serial"]),
    "obj_array": lambda w, r: w.obj_array(r["array_id"], r["element_class_id"], r["elements"], r["stack_trace_serial"]),
    "prim_array": lambda w, r: w.prim_array(r["array_id"], r["element_type"], r["data"], r["stack_trace_serial"]),
}


def _write(table: str, folder: str, id_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rows = Writer(id_size), 0
        for batch in batches:
            for r in batch.to_pylist():
                ROWS[table](w, r)
                rows += 1
                if len(w.heap) > _SEGMENT:
                    w.segment()
        if rows:
            task = TaskContext.get()
            system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            system.create_dir(root, recursive=True)
            name = f"{root}/{table}-{task.partitionId():05d}.hprof"
            with system.open_output_stream(f"{name}.{task.attemptNumber()}.part") as f:
                f.write(w.bytes())
            system.move(f"{name}.{task.attemptNumber()}.part", name)  # a repeated attempt writes the same file again
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    return run


def export_hprof(heap: Heap, folder: str) -> dict[str, int]:
    """Write all tables that hprof has a record for; returns the rows written per table."""
    out = {}
    for table in ROWS:
        if table in heap.tables:
            done = heap[table].mapInArrow(_write(table, folder, heap.id_size), "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()
            out[table] = done[0]
    return out

