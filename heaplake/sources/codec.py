"""Decoder and encoder of the public hprof binary format.

Integers of the format are big-endian, ids 4 or 8 bytes wide. Ids are kept as the signed long of the same bits.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

from ..functions import dims

_HEAD = struct.Struct(">BII")


class HprofError(Exception):
    """Any fault of a dump file."""


class InvalidHeader(HprofError): ...


class UnexpectedEof(HprofError): ...


class InvalidIdSize(HprofError): ...


class UnknownSubRecordTag(HprofError): ...


class UnknownPrimitiveType(HprofError): ...


class InvalidTable(HprofError): ...


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


# --- header and records --------------------------------------------------------------------------------------------


def parse_header(data: bytes) -> dict[str, Any]:
    """version, id_size, timestamp_ms and data_offset of a file's first bytes."""
    end = data.find(b"\0", 0, 64)
    if end < 0 or not data.startswith(b"JAVA PROFILE"):
        raise InvalidHeader("no version text")
    if len(data) < end + 13:
        raise UnexpectedEof("file header")
    id_size, stamp = struct.unpack_from(">IQ", data, end + 1)
    return {"version": data[:end].decode("ascii", "replace"), "id_size": id_size, "timestamp_ms": signed(stamp), "data_offset": end + 13}


def check_id_size(id_size: int) -> None:
    if id_size not in (4, 8):
        raise InvalidIdSize(f"id size {id_size}")


def scan_records(read: Callable[[int, int], bytes], start: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(tag, time offset, body length, position) of the records from ``start`` on; bodies are skipped.

    ``read(offset, n)`` gives n bytes. Stops with an error at a record that overruns the file.
    """
    at = start
    while at < size:
        head = read(at, 9)
        if len(head) < 9:
            raise UnexpectedEof(f"record header at {at}")
        tag, time, length = _HEAD.unpack(head)
        if at + 9 + length > size:
            raise UnexpectedEof(f"record body at {at}")
        yield tag, time, length, at
        at += 9 + length


# --- heap sub-records ----------------------------------------------------------------------------------------------


class Body:
    """A cursor over one record body; ``base`` is the body's place in the file."""

    def __init__(self, data: bytes, base: int, id_size: int):
        check_id_size(id_size)
        self.data, self.base, self.at, self.id_size = data, base, 0, id_size
        self._id = struct.Struct(">q" if id_size == 8 else ">I")

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise UnexpectedEof(f"{n} bytes at {self.base + self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, layout: str) -> Any:
        return struct.unpack(">" + layout, self.take(struct.calcsize(">" + layout)))

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return self.unpack("H")[0]

    def u4(self) -> int:
        return self.unpack("I")[0]

    def id(self) -> int:
        return self._id.unpack(self.take(self.id_size))[0]

    def value(self, code: int) -> dict[str, Any]:
        if code not in dims.TYPES:
            raise UnknownPrimitiveType(f"type {code} at {self.base + self.at}")
        if code == dims.OBJECT:
            return _value("object", ref_id=self.id())
        name, _, layout, _ = dims.TYPES[code]
        v = self.unpack(layout)[0]
        if code == 4:
            return _value(name, z=v)
        return _value(name, d=float(v)) if code in (6, 7) else _value(name, i=v)


def _value(kind: str, **given: Any) -> dict[str, Any]:
    return {"kind": kind, "ref_id": None, "i": None, "d": None, "z": None, "s": None} | given


def _class_dump(b: Body) -> dict[str, Any]:
    first = b.at - 1
    class_id, trace = b.id(), b.u4()
    ids = [b.id() for _ in range(6)]
    row = dict(zip(("super_class_id", "class_loader_id", "signers_id", "domain_id", "reserved1_id", "reserved2_id"), ids))
    row |= {"class_id": class_id, "stack_trace_serial": trace, "instance_size": b.u4()}
    pool = []
    for _ in range(b.u2()):
        index = b.u2()
        code = b.u1()
        pool.append({"cp_index": index, "value": b.value(code)})
    statics = []
    for _ in range(b.u2()):
        name = b.id()
        code = b.u1()
        statics.append({"name_id": name, "type_code": code, "value": b.value(code)})
    fields = [{"name_id": b.id(), "type_code": b.u1()} for _ in range(b.u2())]
    for f in fields:
        if f["type_code"] not in dims.TYPES:
            raise UnknownPrimitiveType(f"field type {f['type_code']}")
    return row | {"const_pool": pool, "static_fields": statics, "instance_fields": fields, "raw": b.data[first : b.at]}


def sub_records(data: bytes, base: int, id_size: int, wanted: frozenset[str]) -> Iterator[tuple[str, dict[str, Any]]]:
    """The rows of one heap dump segment by table; payloads of unwanted tables are stepped over, not copied."""
    b = Body(data, base, id_size)
    while b.at < len(data):
        place = b.at
        tag = b.u1()
        position = base + place
        if tag in dims.ROOTS:
            slug, _, _, ids, numbers = dims.ROOTS[tag]
            key = b.id()
            more = b.id() if ids else None
            rest = {n: b.u4() for n in numbers}
            if "gc_root" in wanted:
                yield "gc_root", {"root_type": slug, "object_id": key, "position": position, "jni_global_ref_id": more, "thread_serial": None, "frame_number": None, "stack_trace_serial": None} | rest
        elif tag == dims.CLASS_DUMP:
            row = _class_dump(b)
            key = row["class_id"]
            if "class_dump" in wanted:
                yield "class_dump", row | {"position": position}
        elif tag == dims.INSTANCE_DUMP:
            key, trace, class_id, n = b.id(), b.u4(), b.id(), b.u4()
            at = b.at
            b.take(0 if at + n <= len(data) else n)
            b.at += n
            if "instance" in wanted:
                yield "instance", {"object_id": key, "stack_trace_serial": trace, "class_id": class_id, "data": data[at : b.at], "position": position}
        elif tag == dims.OBJ_ARRAY_DUMP:
            key, trace, n, element = b.id(), b.u4(), b.u4(), b.id()
            raw = b.take(n * id_size) if "obj_array" in wanted else b.data[:0] if b.at + n * id_size <= len(data) else b.take(n * id_size)
            if "obj_array" in wanted:
                elements = np.frombuffer(raw, dtype=">i8" if id_size == 8 else ">u4").astype("int64")
                yield "obj_array", {"array_id": key, "stack_trace_serial": trace, "num_elements": n, "element_class_id": element, "elements": elements, "position": position}
            else:
                b.at += n * id_size
        elif tag == dims.PRIM_ARRAY_DUMP:
            key, trace, n, code = b.id(), b.u4(), b.u4(), b.u1()
            if code not in dims.TYPES or code == dims.OBJECT:
                raise UnknownPrimitiveType(f"element type {code} at {position}")
            raw = b.take(n * dims.TYPES[code][1])
            if "prim_array" in wanted:
                yield "prim_array", {"array_id": key, "stack_trace_serial": trace, "num_elements": n, "element_type": code, "data": raw, "position": position}
        else:
            raise UnknownSubRecordTag(f"sub-record tag {tag:#x} at {position}")
        if "sub_record" in wanted:
            yield "sub_record", {"tag": tag, "object_id": key, "position": position, "segment_pos": base - 9}


def record_rows(tag: int, body: bytes, position: int, id_size: int) -> Iterator[tuple[str, dict[str, Any]]]:
    """The row of one top-level record that isn't a heap dump."""
    b = Body(body, position + 9, id_size)
    if tag == 0x01:
        if len(body) >= id_size:  # shorter ones are malformed and skipped
            yield "utf8_name", {"name_id": b.id(), "name": body[id_size:].decode("utf-8", "replace")}
    elif tag == 0x02:
        serial, class_id, stack, name = b.u4(), b.id(), b.u4(), b.id()
        yield "load_class", {"class_id": class_id, "class_name_id": name, "class_serial": serial, "stack_serial": stack}
    elif tag == 0x03:
        yield "unload_class", {"serial": b.u4(), "position": position}
    elif tag == 0x04:
        ids = [b.id() for _ in range(4)]
        serial, line = b.u4(), b.unpack("i")[0]
        yield "frame", dict(zip(("frame_id", "method_name_id", "method_sig_id", "source_file_id"), ids)) | {"class_serial": serial, "line_number": line}
    elif tag == 0x05:
        trace, thread, n = b.u4(), b.u4(), b.u4()
        yield "trace", {"trace_serial": trace, "thread_serial": thread, "frame_ids": [b.id() for _ in range(n)]}
    elif tag == 0x0A:
        serial, thread, trace = b.u4(), b.id(), b.u4()
        names = [b.id() for _ in range(3)]
        yield "start_thread", {"thread_serial": serial, "thread_id": thread, "stack_trace_serial": trace} | dict(zip(("thread_name_id", "thread_group_name_id", "thread_parent_group_name_id"), names))
    elif tag == 0x0B:
        yield "end_thread", {"serial": b.u4(), "position": position}


# --- encoder -------------------------------------------------------------------------------------------------------


class Writer:
    """Builds the bytes of a dump, for fixtures and exports."""

    def __init__(self, id_size: int = 8, version: str = "JAVA PROFILE 1.0.2", timestamp_ms: int = 0):
        self.id_size = id_size
        self.out = bytearray(version.encode() + b"\0" + struct.pack(">IQ", id_size, timestamp_ms))
        self.heap = bytearray()

    def id(self, n: int) -> bytes:
        return struct.pack(">Q", n & (1 << 64) - 1) if self.id_size == 8 else struct.pack(">I", n & 0xFFFFFFFF)

    def record(self, tag: int, body: bytes, time: int = 0) -> Writer:
        self.out += _HEAD.pack(tag, time, len(body)) + body
        return self

    def utf8(self, name_id: int, text: str | bytes) -> Writer:
        return self.record(0x01, self.id(name_id) + (text.encode() if isinstance(text, str) else text))

    def load_class(self, serial: int, class_id: int, stack: int, name_id: int) -> Writer:
        return self.record(0x02, struct.pack(">I", serial) + self.id(class_id) + struct.pack(">I", stack) + self.id(name_id))

    def unload_class(self, serial: int) -> Writer:
        return self.record(0x03, struct.pack(">I", serial))

    def frame(self, frame_id: int, method: int, signature: int, source: int, class_serial: int, line: int) -> Writer:
        return self.record(0x04, b"".join(map(self.id, (frame_id, method, signature, source))) + struct.pack(">Ii", class_serial, line))

    def trace(self, serial: int, thread: int, frames: list[int]) -> Writer:
        return self.record(0x05, struct.pack(">III", serial, thread, len(frames)) + b"".join(map(self.id, frames)))

    def start_thread(self, serial: int, thread_id: int, trace: int, name: int, group: int = 0, parent: int = 0) -> Writer:
        return self.record(0x0A, struct.pack(">I", serial) + self.id(thread_id) + struct.pack(">I", trace) + b"".join(map(self.id, (name, group, parent))))

    def end_thread(self, serial: int) -> Writer:
        return self.record(0x0B, struct.pack(">I", serial))

    def value(self, code: int, v: Any) -> bytes:
        return self.id(v) if code == dims.OBJECT else struct.pack(">" + dims.TYPES[code][2], v)

    def root(self, slug: str, object_id: int, *more: int) -> Writer:
        tag, (_, _, _, ids, _) = next((t, r) for t, r in dims.ROOTS.items() if r[0] == slug)
        self.heap += bytes([tag]) + self.id(object_id) + b"".join(self.id(m) for m in more[:ids]) + b"".join(struct.pack(">I", m) for m in more[ids:])
        return self

    def class_dump(self, class_id: int, super_id: int = 0, size: int = 0, statics: list = (), fields: list = (), pool: list = (), loader: int = 0, trace: int = 0) -> Writer:
        """``statics``: (name id, type, value); ``fields``: (name id, type); ``pool``: (index, type, value)."""
        b = bytes([dims.CLASS_DUMP]) + self.id(class_id) + struct.pack(">I", trace) + self.id(super_id) + self.id(loader) + self.id(0) * 4 + struct.pack(">I", size)
        b += struct.pack(">H", len(pool)) + b"".join(struct.pack(">HB", i, t) + self.value(t, v) for i, t, v in pool)
        b += struct.pack(">H", len(statics)) + b"".join(self.id(n) + bytes([t]) + self.value(t, v) for n, t, v in statics)
        self.heap += b + struct.pack(">H", len(fields)) + b"".join(self.id(n) + bytes([t]) for n, t in fields)
        return self

    def instance(self, object_id: int, class_id: int, data: bytes, trace: int = 0) -> Writer:
        self.heap += bytes([dims.INSTANCE_DUMP]) + self.id(object_id) + struct.pack(">I", trace) + self.id(class_id) + struct.pack(">I", len(data)) + data
        return self

    def obj_array(self, array_id: int, class_id: int, elements: list[int], trace: int = 0) -> Writer:
        self.heap += bytes([dims.OBJ_ARRAY_DUMP]) + self.id(array_id) + struct.pack(">II", trace, len(elements)) + self.id(class_id) + b"".join(map(self.id, elements))
        return self

    def prim_array(self, array_id: int, code: int, data: bytes, trace: int = 0) -> Writer:
        n = len(data) // (dims.TYPES[code][1] if code in dims.TYPES else 1)
        self.heap += bytes([dims.PRIM_ARRAY_DUMP]) + self.id(array_id) + struct.pack(">II", trace, n) + bytes([code]) + data
        return self

    def segment(self, tag: int = 0x1C) -> Writer:
        """Write the heap sub-records so far as one segment."""
        self.record(tag, bytes(self.heap))
        self.heap.clear()
        return self

    def bytes(self) -> bytes:
        if self.heap:
            self.segment()
        return bytes(self.out)
