import struct

import pytest

from heaplake.functions import dims
from heaplake.sources import codec
from heaplake.sources.codec import Writer

from . import fixtures as fx

ALL = frozenset(["sub_record", "class_dump", "instance", "obj_array", "prim_array", "gc_root"])


def scan(data):
    head = codec.parse_header(data)
    return head, list(codec.scan_records(lambda at, n: data[at : at + n], head["data_offset"], len(data)))


def segment_rows(data, wanted=ALL):
    head, records = scan(data)
    return [row for tag, _, n, at in records if tag in (0x0C, 0x1C) for row in codec.sub_records(data[at + 9 : at + 9 + n], at + 9, head["id_size"], wanted)]


def test_header():
    head = codec.parse_header(Writer(4, "JAVA PROFILE 1.0.1", 12345).bytes())
    assert head == {"version": "JAVA PROFILE 1.0.1", "id_size": 4, "timestamp_ms": 12345, "data_offset": 31}
    with pytest.raises(codec.InvalidHeader):
        codec.parse_header(b"NOT A PROFILE\0" + bytes(12))
    with pytest.raises(codec.UnexpectedEof):
        codec.parse_header(b"JAVA PROFILE 1.0.2\0\0\0")


def test_records_and_overrun():
    data = fx.f5()
    _, records = scan(data)
    assert [r[0] for r in records] == [1, 1, 1, 1, 4, 5, 0x0A, 0x0B, 3]
    with pytest.raises(codec.UnexpectedEof):
        scan(data[:-1])


@pytest.mark.parametrize("id_size", [4, 8])
def test_positions(id_size):
    w = Writer(id_size).root("sticky_class", 1).root("sticky_class", 2).segment().record(0x2C, b"")
    rows = [r for t, r in segment_rows(w.bytes()) if t == "sub_record"]
    assert [(r["object_id"], r["position"]) for r in rows] == [(1, 40), (2, 40 + 1 + id_size)]
    assert rows[0]["segment_pos"] == 31


@pytest.mark.parametrize("id_size", [4, 8])
def test_roots_round_trip(id_size):
    w = Writer(id_size)
    for tag, (slug, _, _, ids, numbers) in dims.ROOTS.items():
        w.root(slug, tag + 100, *range(1, ids + len(numbers) + 1))
    rows = [r for t, r in segment_rows(w.bytes()) if t == "gc_root"]
    assert [r["root_type"] for r in rows] == [s for s, *_ in dims.ROOTS.values()]
    by = {r["root_type"]: r for r in rows}
    assert by["jni_global"]["jni_global_ref_id"] == 1
    assert (by["java_frame"]["thread_serial"], by["java_frame"]["frame_number"]) == (1, 2)
    assert by["thread_object"]["stack_trace_serial"] == 2 and by["native_stack"]["thread_serial"] == 1


@pytest.mark.parametrize("id_size", [4, 8])
def test_class_dump_sections(id_size):
    w = Writer(id_size).class_dump(1, 2, 16, statics=[(5, 11, -7), (6, 2, 9), (7, 4, True), (8, 7, 1.5)], fields=[(9, 5)], pool=[(3, 9, -2)], loader=4, trace=6)
    row = dict(segment_rows(w.bytes()))["class_dump"]
    assert (row["super_class_id"], row["class_loader_id"], row["stack_trace_serial"], row["instance_size"]) == (2, 4, 6, 16)
    assert [f["value"]["kind"] for f in row["static_fields"]] == ["long", "object", "boolean", "double"]
    assert [row["static_fields"][i]["value"][k] for i, k in ((0, "i"), (1, "ref_id"), (2, "z"), (3, "d"))] == [-7, 9, True, 1.5]
    assert row["const_pool"][0]["cp_index"] == 3 and row["const_pool"][0]["value"]["i"] == -2
    assert row["instance_fields"] == [{"name_id": 9, "type_code": 5}]
    assert row["raw"] == w.bytes()[-len(row["raw"]) :]


def test_large_ids_keep_their_bits():
    w = Writer().obj_array(0xFFFFFFFFFFFFFFFF, 0x8000000000000000, [0xFFFFFFFF00000000])
    row = dict(segment_rows(w.bytes()))["obj_array"]
    assert (row["array_id"], row["element_class_id"], row["elements"].tolist()) == (-1, -(1 << 63), [-(1 << 32)])


def test_only_wanted_tables():
    rows = segment_rows(fx.f2(), frozenset(["instance"]))
    assert {t for t, _ in rows} == {"instance"} and len(rows) == 3


@pytest.mark.parametrize(
    ("heap", "error"),
    [
        (b"\x99", codec.UnknownSubRecordTag),
        (b"\x05\0\0", codec.UnexpectedEof),
        (bytes([0x23]) + bytes(8) + struct.pack(">II", 0, 1) + b"\x03\0", codec.UnknownPrimitiveType),
        (bytes([0x21]) + bytes(8) + struct.pack(">I", 0) + bytes(8) + struct.pack(">I", 9) + b"123", codec.UnexpectedEof),
        (bytes([0x22]) + bytes(8) + struct.pack(">II", 0, 2) + bytes(8) + bytes(8), codec.UnexpectedEof),
    ],
)
def test_faults(heap, error):
    data = Writer().record(0x1C, heap).bytes()
    for wanted in (ALL, frozenset(["sub_record"])):
        with pytest.raises(error):
            segment_rows(data, wanted)


def test_id_size():
    with pytest.raises(codec.InvalidIdSize):
        codec.Body(b"", 0, 2)


def test_short_utf8_is_skipped():
    assert list(codec.record_rows(1, b"\0\0", 31, 8)) == []
    assert list(codec.record_rows(1, bytes(8) + b"a\xff", 31, 8)) == [("utf8_name", {"name_id": 0, "name": "a�"})]


hypothesis = pytest.importorskip("hypothesis")
st = hypothesis.strategies
ids = st.integers(0, 2**64 - 1)
values = st.one_of(
    st.tuples(st.just(2), ids), st.tuples(st.just(4), st.booleans()), st.tuples(st.just(5), st.integers(0, 65535)), st.tuples(st.just(7), st.floats(allow_nan=False)),
    st.tuples(st.just(8), st.integers(-128, 127)), st.tuples(st.just(9), st.integers(-32768, 32767)), st.tuples(st.just(10), st.integers(-(2**31), 2**31 - 1)), st.tuples(st.just(11), st.integers(-(2**63), 2**63 - 1)),
)


@hypothesis.given(st.lists(st.tuples(ids, values), max_size=6), st.lists(st.tuples(ids, st.sampled_from(sorted(dims.TYPES))), max_size=6), st.lists(ids, max_size=9), st.binary(max_size=40))
@hypothesis.settings(max_examples=60, deadline=None)
def test_any_objects_come_back(statics, fields, elements, data):
    w = Writer().class_dump(1, 2, 3, statics=[(n, *v) for n, v in statics], fields=fields).obj_array(4, 5, elements).instance(6, 1, data).prim_array(7, 8, data)
    rows = dict(segment_rows(w.bytes(), ALL - {"sub_record"}))
    got = rows["class_dump"]["static_fields"]
    assert [(codec.signed(n), c) for n, (c, _) in statics] == [(f["name_id"], f["type_code"]) for f in got]
    for (_, (code, v)), f in zip(statics, got):
        key = {2: "ref_id", 4: "z", 7: "d"}.get(code, "i")
        assert f["value"][key] == (codec.signed(v) if code == 2 else v)
    assert [(f["name_id"], f["type_code"]) for f in rows["class_dump"]["instance_fields"]] == [(codec.signed(n), c) for n, c in fields]
    assert rows["obj_array"]["elements"].tolist() == [codec.signed(e) for e in elements]
    assert rows["instance"]["data"] == data and rows["prim_array"]["data"] == data
