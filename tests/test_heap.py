import struct

import pytest
from pyspark.sql import functions as F

from heaplake.functions import scalars as S
from heaplake.model import Heap, complete
from heaplake.operators import dominators as dom
from heaplake.operators import dumpdiff, graph, resolve, stats, threads
from heaplake.sources import codec
from heaplake.sources.codec import Writer

from . import fixtures as fx


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("id_size", [4, 8])
def test_integer_and_threads(spark, id_size):
    h = Heap.from_bytes(spark, fx.f1(id_size))
    assert h.id_size == id_size
    assert rows(h.names, "class_id") == [(0x200, "java.lang.Integer"), (0x300, "java.lang.Object")]
    assert rows(h.fields.select("object_id", "name", "value.i")) == [(0x100, "value", 42)]
    assert rows(h.values.select("object_id", "value.kind", "value.i")) == [(0x100, "int", 42)]
    assert h["gc_root"].count() == 0
    assert rows(threads.thread_list(h["start_thread"], h["end_thread"], h["utf8_name"]).select("thread_serial", "thread_name", "status")) == [(1, "main", "ended")]
    frames = threads.resolved_frames(h["frame"], h["utf8_name"])
    assert rows(frames.select("frame_id", "method_name", "method_signature", "source_file", "line_kind", "line")) == [(0x10, "main", "()V", "MyClass.java", "line", 7)]
    assert rows(threads.with_class_names(h["frame"], h["load_class"], h.names).select("class_name")) == [("java.lang.Integer",)]


@pytest.mark.parametrize("id_size", [4, 8])
def test_string_and_static(spark, id_size):
    h = Heap.from_bytes(spark, fx.f2(id_size))
    assert rows(h.strings) == [(0x300, "hi")]
    fields = resolve.resolve(h.fields.where("name = 'myField'").select(F.col("value.ref_id").alias("ref")), "ref", h.values)
    assert rows(fields.select("resolved.kind", "resolved.i")) == [("int", 42)]
    assert rows(resolve.static_fields(h["class_dump"], h["utf8_name"]).select("class_id", "name", "value.i")) == [(0x50, "count", 7)]
    assert rows(resolve.declared_fields(h["class_dump"].where("class_id = 80"), h["utf8_name"]).select("name", "type_name")) == [("myField", "Object")]


@pytest.mark.parametrize("id_size", [4, 8])
def test_object_array(spark, id_size):
    h = Heap.from_bytes(spark, fx.f3(id_size))
    got = resolve.array_elements(h["obj_array"], h.values).select("pos", "resolved.kind", "resolved.i")
    assert rows(got, "pos") == [(0, "int", 99), (1, "null", None)]
    assert dict(rows(stats.class_histogram(h.shallow, h.names).select("class_name", "shallow_bytes")))["java.lang.Integer[]"] == 2 * id_size


@pytest.mark.parametrize("id_size", [4, 8])
def test_dominators_and_retained(spark, id_size):
    h = Heap.from_bytes(spark, fx.f4(id_size))
    assert rows(h.dominator, "object_id") == [(0x100, 0), (0x200, 0x100), (0x300, 0), (0x400, 0x200)]
    assert dict(rows(h.retained)) == {0x400: 12, 0x200: 12 + id_size, 0x100: 12 + id_size, 0x300: 0}
    assert rows(dom.dominatees(h.dominator, h.retained, 0x100)) == [(0x200, 12 + id_size)]


def test_segments_and_modes(spark, tmp_path):
    w = Writer().root("sticky_class", 1).segment().root("sticky_class", 2).segment().root("unknown", 3).segment(0x0C)
    path = tmp_path / "a.hprof"
    path.write_bytes(w.bytes())
    reader = spark.read.format("hprof").option("table", "sub_record").option("rangeBytes", 1)
    Heap.read(spark, str(path))
    df = reader.load(str(path))
    assert df.rdd.getNumPartitions() == 3
    assert rows(df.select("object_id"), "object_id") == [(1,), (2,), (3,)]
    path.write_bytes(Writer().root("sticky_class", 1).segment().record(0x1C, b"\x99").bytes())
    with pytest.raises(Exception, match="0x99"):
        reader.load(str(path)).count()
    assert reader.option("mode", "PERMISSIVE").load(str(path)).count() == 1


def test_save_and_load(spark, tmp_path):
    h = Heap.from_bytes(spark, fx.f4())
    assert set(h.save(str(tmp_path)).values()) == {"written"}
    assert set(h.save(str(tmp_path)).values()) == {"kept"}
    (tmp_path / "refs" / "_SUCCESS").unlink()
    assert not complete(spark, str(tmp_path / "refs"))
    assert h.save(str(tmp_path))["refs"] == "written"
    again = Heap.load(spark, str(tmp_path))
    assert again.has_retained and rows(again.retained, "object_id") == rows(h.retained, "object_id")
    again.register("t_")
    assert spark.sql("select count(*) n from t_refs").first()["n"] == 2


def test_dominator_counterexamples(spark):
    def idom(edges, roots, **kw):
        h = Heap.from_bytes(spark, fx.graph(edges, roots))
        nodes = h.shallow.select("object_id").where("object_id <> 16")
        local = dict(rows(dom.dominators(nodes, h.refs, h["gc_root"], **kw)))
        spread = dict(rows(dom.dominators(nodes, h.refs, h["gc_root"], capacity=0)))
        assert local == spread
        return local

    assert idom({1: [2, 3], 2: [3], 3: []}, [1, 2])[3] == 0  # one root reaches another
    assert idom({1: [2], 2: [1, 3], 3: []}, [1, 2]) == {1: 0, 2: 0, 3: 2}  # roots in a circle
    assert idom({1: [999, 2], 2: []}, [1]) == {1: 0, 2: 1}  # dangling reference
    assert idom({1: [2, 3], 2: [4], 3: [4], 4: [5], 5: []}, [1]) == {1: 0, 2: 1, 3: 1, 4: 1, 5: 4}  # diamond
    assert idom({1: [], 5: [6], 6: [5]}, [1]) == {1: 0}  # unreachable island
    assert idom({1: [2], 2: [3, 4], 3: [5], 4: [5], 5: [2]}, [1]) == {1: 0, 2: 1, 3: 2, 4: 2, 5: 2}  # loop


def test_chain_retained(spark):
    w = Writer().utf8(1, "next").utf8(2, "A").load_class(1, 0x10, 0, 2).class_dump(0x10, 0, 8, fields=[(1, 2)]).root("jni_global", 1, 0)
    h = Heap.from_bytes(spark, w.instance(1, 0x10, w.id(2) + b"12").instance(2, 0x10, w.id(3) + bytes(12)).instance(3, 0x10, w.id(0) + bytes(22)).bytes())
    assert dict(rows(h.retained)) == {1: 60, 2: 50, 3: 30}
    assert dict(rows(dom.retained_sizes(h.dominator, h.shallow, capacity=0))) == {1: 60, 2: 50, 3: 30}


def test_paths(spark):
    edges = {1: [2], 2: [3], 3: [], 7: [8], 8: [7]}
    h = Heap.from_bytes(spark, fx.graph(edges, [1]))
    assert graph.path_to_root(h.refs, h["gc_root"], 3) == {"status": "Found", "path": [1, 2, 3]}
    assert graph.path_to_root(h.refs, h["gc_root"], 1) == {"status": "Found", "path": [1]}
    assert graph.path_to_root(h.refs, h["gc_root"], 7)["status"] == "NotReachable"
    assert graph.path_to_root(h.refs, h["gc_root"], 3, limit=2)["status"] == "LimitReached"
    reached = graph.reachable(h.refs, h["gc_root"], h.shallow.select("object_id"))
    assert rows(graph.paths_to_roots(reached), "object_id") == [(1, [1]), (2, [1, 2]), (3, [1, 2, 3])]


def test_referrers_are_capped(spark):
    h = Heap.from_bytes(spark, fx.graph({n: [100] for n in range(200, 260)} | {100: []}, []))
    assert graph.referrers(h.refs, 100).count() == 50
    assert rows(graph.referrers(h.refs, 100, 2).select("from_object_id")) == [(200,), (201,)]


def test_id_with_several_records(spark):
    h = Heap.from_bytes(spark, Writer().root("thread_object", 5, 1, 2).root("jni_local", 5, 1, 1).instance(5, 9, b"").bytes())
    assert rows(stats.find_object(h.shallow, h["gc_root"], 5)) == [(5, 0x21)]
    assert rows(stats.root_types_of(h["gc_root"])) == [(5, ["jni_local", "thread_object"])]
    assert rows(stats.find_object(h.shallow.where("false"), h["gc_root"], 5).select("object_id")) == [(5,)]


def test_texts(spark):
    w = Writer()
    for i, t in enumerate(["java/lang/String", "value", "coder", b"bad\xffname"], 1):
        w.utf8(i, t)
    w.load_class(1, 0x10, 0, 1).load_class(2, 0x11, 0, 4).class_dump(0x10, 0, 9, fields=[(2, 2), (3, 8)])
    cases = {1: (0, "né".encode("latin-1")), 2: (1, "né€".encode("utf-16-be")), 3: (1, b"\0A\xd8\x00\0B"), 4: (1, b"\0A\0"), 5: (0, b"")}
    for i, (coder, data) in cases.items():
        w.prim_array(100 + i, 8, data).instance(i, 0x10, w.id(100 + i) + bytes([coder]))
    w.instance(6, 0x10, w.id(0) + b"\0").instance(7, 0x10, w.id(999) + b"\0")
    w.prim_array(108, 10, bytes(4)).instance(8, 0x10, w.id(108) + b"\0").instance(9, 0x10, b"")
    h = Heap.from_bytes(spark, w.bytes())
    assert dict(rows(h.strings)) == {1: "né", 2: "né€", 3: "A�B", 4: "A", 5: "", 6: "", 7: "", 8: "", 9: ""}
    assert dict(rows(h.names))[0x11] == "bad�name"


def test_layout_of_hierarchies(spark):
    w = Writer()
    for i, t in enumerate(["a", "b", "c", "L", "M", "T"], 1):
        w.utf8(i, t)
    w.class_dump(1, 2, 0, fields=[(1, 8), (2, 7)]).class_dump(2, 3, 0, fields=[(2, 9)]).class_dump(3, 99, 0, fields=[(3, 2), (1, 10)])
    w.class_dump(4, 5).class_dump(5, 4, 0, fields=[(1, 10)])  # superclasses in a circle
    h = Heap.from_bytes(spark, w.instance(50, 1, struct.pack(">bdhqi", -1, 2.5, -3, 77, -9)).instance(51, 1, b"\x05").bytes())
    got = h.layout.where("class_id = 1").select("ord", "name", "type_code", "offset")
    assert rows(got, "ord") == [(0, "a", 8, 0), (1, "b", 7, 1), (2, "b", 9, 9), (3, "c", 2, 11), (4, "a", 10, 19)]
    values = h.fields.where("object_id = 50").select("ord", F.coalesce("value.i", "value.ref_id").alias("i"), "value.d")
    assert rows(values, "ord") == [(0, -1, None), (1, None, 2.5), (2, -3, None), (3, 77, None), (4, -9, None)]
    assert rows(h.fields.where("object_id = 51").select("ord", "value.i")) == [(0, 5)]
    assert rows(resolve.first_field(h.fields, "a").where("object_id = 50").select("value.i")) == [(-1,)]
    assert h.layout.where("class_id = 5").count() == 1


@pytest.mark.parametrize("value", [0.0, -0.0, 1.5, -2.25e-308, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 3.14159])
def test_float_bytes(spark, value):
    import math

    raw = spark.createDataFrame([(bytearray(struct.pack(">d", value)), bytearray(struct.pack(">f", value) if abs(value) < 3e38 or math.isinf(value) else bytes(4)))], "d binary, f binary")
    d, f = raw.select(S.double_bits(S.unsigned_bytes(F.col("d"))), S.float_bits(S.unsigned_bytes(F.col("f")))).first()
    assert d == value and (abs(value) >= 3e38 and not math.isinf(value) or f == struct.unpack(">f", struct.pack(">f", value))[0])
    assert math.isnan(spark.createDataFrame([(bytearray(struct.pack(">d", math.nan)),)], "d binary").select(S.double_bits(S.unsigned_bytes(F.col("d")))).first()[0])


def two_dumps(spark):
    def dump(objects, extra=b""):
        w = Writer().utf8(1, "A").utf8(2, "B").load_class(1, 0x10, 0, 1).load_class(2, 0x20, 0, 2)
        w.class_dump(0x10, 0, 4 + len(extra)).class_dump(0x20)
        for o, c, data in objects:
            w.instance(o, c, data) if c else w.prim_array(o, 8, data)
        return Heap.from_bytes(spark, w.bytes())

    a = dump([(1, 0x10, b"a"), (2, 0x10, b"b"), (3, 0x10, b"c"), (4, 0x10, b"d"), (5, 0x10, b"e")])
    b = dump([(2, 0x10, b"b"), (3, 0x10, b"X"), (4, None, b"dd"), (5, 0x20, b"e"), (6, 0x20, b"n")], b"!")
    return a, b


def test_dump_comparison(spark):
    a, b = two_dumps(spark)
    sides = [dumpdiff.comparable(h["instance"], h["obj_array"], h["prim_array"], h["class_dump"]) for h in (a, b)]
    entries = dumpdiff.compare(*sides)
    got = {r["object_id"]: (r["entry"], r["changed"]) for r in entries.collect()}
    assert got == {1: ("removed", None), 2: ("common", False), 3: ("common", True), 4: ("common", True), 5: ("common", False), 6: ("added", None), 0x10: ("common", True), 0x20: ("common", False)}
    assert rows(entries.where("address_reused").select("object_id"), "object_id") == [(4,), (16,)]
    classes = {r["class_name"]: r for r in dumpdiff.by_class(entries, a.names, b.names).collect()}
    assert [classes["A"][c] for c in ("count_removed", "count_added", "count_common_unchanged", "count_common_changed", "net_change")] == [1, 0, 2, 3, -1]
    assert rows(dumpdiff.listed(entries, "common", 0x10, True).select("object_id"), "object_id") == [(3,), (4,), (16,)]
    assert dumpdiff.totals(dumpdiff.by_class(entries, a.names, b.names)).first()["count_common"] == 6


def test_threads_from_roots_only(spark):
    w = Writer()
    for i, t in enumerate(["java/lang/String", "value", "java/lang/Thread", "name"], 1):
        w.utf8(i, t)
    w.load_class(1, 0x10, 0, 1).load_class(2, 0x11, 0, 3).class_dump(0x10, 0, 8, fields=[(2, 2)]).class_dump(0x11, 0, 8, fields=[(4, 2)])
    w.prim_array(1, 5, "worker".encode("utf-16-be")).instance(2, 0x10, w.id(1)).instance(3, 0x11, w.id(2)).instance(4, 0x11, w.id(0))
    h = Heap.from_bytes(spark, w.root("thread_object", 3, 7, 0).root("thread_object", 4, 8, 0).bytes())
    names = threads.heap_thread_names(h["gc_root"], h.fields, h.strings)
    assert rows(names) == [(7, "worker")]
    listed = threads.threads_or_roots(h["start_thread"], h["end_thread"], h["utf8_name"], h["gc_root"], names)
    assert rows(listed.select("thread_serial", "thread_name"), "thread_serial") == [(7, "worker"), (8, "0x4")]


def test_large_ids_in_order_and_hex(spark):
    h = Heap.from_bytes(spark, Writer().instance(0xF000000000000001, 9, b"").instance(5, 9, b"").bytes())
    assert rows(h["instance"].orderBy(S.unsigned_order(F.col("object_id"))).select(S.hex_id(F.col("object_id")))) == [("0x5",), ("0xf000000000000001",)]
    texts = spark.createDataFrame([("0xff",), ("FF",), ("0xf000000000000001",), ("zz",), ("",)], "s string")
    assert rows(texts.select(S.parse_hex_id(F.col("s")))) == [(255,), (255,), (codec.signed(0xF000000000000001),), (None,), (None,)]


def test_array_kinds(spark):
    w = Writer()
    for i, c in enumerate(range(4, 12)):
        w.prim_array(10 + i, c, bytes(16)).prim_array(30 + i, c, bytes(16))
    h = Heap.from_bytes(spark, w.obj_array(50, 1, [0, 0]).bytes())
    assert {r["arrays"] for r in stats.array_counts(h.array_size).collect()} == {1, 2}
    top = stats.largest_per_kind(h.array_size, 1)
    assert rows(top.where("kind = 'int'").select("object_id", "byte_size")) == [(16, 16)]
    elements = resolve.prim_elements(h["prim_array"], most=1)
    assert elements.count() == 16


def test_line_kinds_and_sizes(spark):
    df = spark.createDataFrame([(5,), (0,), (-1,), (-2,), (-3,), (-9,)], "n int")
    assert [r[0] for r in rows(df.select(S.line_kind(F.col("n"))))] == ["line", "none", "unknown", "compiled", "native", "unknown"]
    sizes = spark.createDataFrame([(999,), (1500,), (2_000_000,), (3_100_000_000,)], "n long")
    assert [r[0] for r in rows(sizes.select(S.size_text(F.col("n"))))] == ["999 B", "1.5 KB", "2.0 MB", "3.1 GB"]
    assert [r[0] for r in rows(sizes.select(S.size_text(F.col("n"), False)))] == ["999B", "1.5K", "2.0M", "3.1G"]


def test_lookups_by_tag_and_position(spark):
    w = Writer().root("unknown", 0x10).root("thread_object", 0x10, 1, 2).class_dump(0x1).instance(0x10, 0x1, b"")
    h = Heap.from_bytes(spark, w.bytes())
    find = lambda *tag: [r["tag"] for r in stats.find_object(h.shallow, h["gc_root"], 0x10, *tag).collect()]
    assert (find(), find(0x08), find(0xFF), find(0x22)) == ([0x21], [0x08], [0xFF], [])
    first = h["sub_record"].orderBy("position").first()
    assert stats.at_position(h["sub_record"], first["position"]).first()["tag"] == 0xFF and not stats.at_position(h["sub_record"], 1).count()


def test_raw_arrays_in_pieces(spark):
    from heaplake.facade import Analysis

    w = Writer()
    for i, (code, data) in enumerate({4: b"\1\0", 5: "aé".encode("utf-16-be"), 6: struct.pack(">2f", 0.5, -1), 7: struct.pack(">d", 0.1), 8: b"\xff\1", 9: b"\xff\xfe", 10: struct.pack(">3i", 1, -2, 3), 11: struct.pack(">q", -(1 << 63))}.items()):
        w.prim_array(0x100 + i, code, data)
    a = Analysis(Heap.from_bytes(spark, w.bytes()))
    got = [a.array_text(0x100 + i) for i in range(8)]
    assert got == ["true, false", "'a', 'é'", "0.5, -1.0", "0.1", "-1, 1", "-2", "1, -2, 3", str(-(1 << 63))]
    assert list(a.array_pieces(0x106, piece=2)) == ["1, -2", ", 3"] and a.array_text(0x106, 2) == "1, -2" and a.array_text(0x999) == ""
