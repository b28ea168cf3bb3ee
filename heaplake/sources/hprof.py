"""Spark data source for hprof dump files: ``spark.read.format("hprof").option("table", ...).load(path)``.

The driver steps over record headers (nine bytes each) and hands out ranges of whole records; executors read and decode
their ranges. A heap segment is decoded in order, so segments are the unit of parallelism. Each table is a projection of
its own: what a table doesn't need is stepped over.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dims
from . import codec

_VALUE = "struct<kind: string, ref_id: bigint, i: bigint, d: double, z: boolean, s: string>"
_ROOT_NUMBERS = "jni_global_ref_id long, thread_serial long, frame_number long, stack_trace_serial long"

TABLES = {
    "header": "version string, id_size int, timestamp_ms long, data_offset long",
    "record": "tag int, time_offset_ms long, body_length long, position long",
    "sub_record": "tag int, object_id long, position long, segment_pos long",
    "utf8_name": "name_id long, name string",
    "load_class": "class_id long, class_name_id long, class_serial long, stack_serial long",
    "unload_class": "serial long, position long",
    "class_dump": "class_id long, stack_trace_serial long, super_class_id long, class_loader_id long, signers_id long, domain_id long, reserved1_id long, reserved2_id long, instance_size long, "
    f"const_pool array<struct<cp_index: int, value: {_VALUE}>>, static_fields array<struct<name_id: bigint, type_code: int, value: {_VALUE}>>, "
    "instance_fields array<struct<name_id: bigint, type_code: int>>, raw binary, position long",
    "instance": "object_id long, stack_trace_serial long, class_id long, data binary, position long",
    "obj_array": "array_id long, stack_trace_serial long, num_elements long, element_class_id long, elements array<long>, position long",
    "prim_array": "array_id long, stack_trace_serial long, num_elements long, element_type int, data binary, position long",
    "gc_root": f"root_type string, object_id long, position long, {_ROOT_NUMBERS}",
    "frame": "frame_id long, method_name_id long, method_sig_id long, source_file_id long, class_serial long, line_number int",
    "trace": "trace_serial long, thread_serial long, frame_ids array<long>",
    "start_thread": "thread_serial long, thread_id long, stack_trace_serial long, thread_name_id long, thread_group_name_id long, thread_parent_group_name_id long",
    "end_thread": "serial long, position long",
}
_HEAP_TABLES = ("sub_record", "class_dump", "instance", "obj_array", "prim_array", "gc_root")
_HEAP_TAGS = (0x0C, 0x1C)
_RECORD_OF = {"utf8_name": 0x01, "load_class": 0x02, "unload_class": 0x03, "frame": 0x04, "trace": 0x05, "start_thread": 0x0A, "end_thread": 0x0B}


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _files(path: str) -> list[str]:
    """The dump files of a path: one file, a folder of them or a list separated by commas."""
    from pyarrow import fs

    out = []
    for p in path.split(","):
        remote = "://" in p or p.startswith("file:")
        system, inner = fs.FileSystem.from_uri(p) if remote else (fs.LocalFileSystem(), p)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            out.append(p)
            continue
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".hprof"))
        out += [f"{p.rstrip('/')}/{n}" for n in names]
    return out


class _Buffered:
    """Small reads at rising offsets from blocks of a file."""

    def __init__(self, file, block: int = 1 << 16):
        self.file, self.block, self.start, self.data = file, block, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if not self.start <= at or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, self.block))
        return self.data[at - self.start : at - self.start + n]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, id_size: int):
        super().__init__((path, start, end, id_size))
        self.path, self.start, self.end, self.id_size = path, start, end, id_size


class HprofReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table = schema, options.get("table", "sub_record")
        self.path, self.strict = options["path"], options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.goal, self.rows = int(options.get("rangeBytes", 64 << 20)), int(options.get("batchRows", 8_192))

    def partitions(self) -> list[_Range]:
        out = []
        for path in _files(self.path):
            with _open(path) as f:
                size = f.seek(0, os.SEEK_END)
                read = _Buffered(f)
                head = codec.parse_header(read(0, 128))
                start = at = head["data_offset"]
                id_size = head["id_size"]
                if self.table == "header":
                    out.append(_Range(path, 0, start, id_size))
                    continue
                weight = 0
                try:
                    for tag, _, length, at in codec.scan_records(read, start, size):
                        heavy = (tag in _HEAP_TAGS) == (self.table in _HEAP_TABLES)
                        if heavy and weight and weight + length > self.goal:
                            out.append(_Range(path, start, at, id_size))
                            start, weight = at, 0
                        weight += length + 9 if heavy else 9
                        at += 9 + length
                except codec.HprofError:
                    if self.strict:
                        raise
                if at > start:
                    out.append(_Range(path, start, at, id_size))
        return out

    def _rows(self, part: _Range) -> Iterator[dict]:
        wanted = frozenset([self.table])
        with _open(part.path) as f:
            read = _Buffered(f)
            if self.table == "header":
                yield codec.parse_header(read(0, 128))
                return
            try:
                for tag, time, length, at in codec.scan_records(read, part.start, part.end):
                    if self.table == "record":
                        yield {"tag": tag, "time_offset_ms": time, "body_length": length, "position": at}
                    elif tag in _HEAP_TAGS and self.table in _HEAP_TABLES:
                        f.seek(at + 9)
                        yield from (row for _, row in codec.sub_records(f.read(length), at + 9, part.id_size, wanted))
                    elif tag == _RECORD_OF.get(self.table):
                        yield from (row for _, row in codec.record_rows(tag, read(at + 9, length), at, part.id_size))
            except codec.HprofError:
                if self.strict:
                    raise

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        held: list[dict] = []
        size = 0
        for row in self._rows(part):
            held.append(row)
            size += len(row.get("data") or row.get("elements", ()))
            if len(held) >= self.rows or size > 32 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


class HprofSource(DataSource):
    """Options: ``table`` (see TABLES), ``mode`` FAILFAST or PERMISSIVE (keep what comes before a fault), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "hprof"

    def schema(self) -> str:
        table = self.options.get("table", "sub_record")
        if table not in TABLES:
            raise codec.InvalidTable(f"no table {table}")
        return TABLES[table]

    def reader(self, schema: StructType) -> HprofReader:
        return HprofReader(schema, self.options)


def read_tables(spark: SparkSession, path: str, mode: str = "FAILFAST") -> dict:
    """Every table of a dump as a lazy DataFrame."""
    spark.dataSource.register(HprofSource)
    return {t: spark.read.format("hprof").option("table", t).option("mode", mode).load(path) for t in TABLES}


def tag_name(tag: int) -> str:
    return dims.RECORD_TAGS.get(tag, f"UNKNOWN_{tag:02X}")
