"""Fixed values of the dump format: tags, type codes, array kinds and root types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Top-level record tags.
RECORD_TAGS = {
    0x01: "UTF8", 0x02: "LOAD_CLASS", 0x03: "UNLOAD_CLASS", 0x04: "FRAME", 0x05: "TRACE", 0x06: "ALLOC_SITES", 0x07: "HEAP_SUMMARY",
    0x0A: "START_THREAD", 0x0B: "END_THREAD", 0x0C: "HEAP_DUMP", 0x0D: "CPU_SAMPLES", 0x0E: "CONTROL_SETTINGS", 0x1C: "HEAP_DUMP_SEGMENT", 0x2C: "HEAP_DUMP_END",
}

# Heap sub-record tags.
CLASS_DUMP, INSTANCE_DUMP, OBJ_ARRAY_DUMP, PRIM_ARRAY_DUMP = 0x20, 0x21, 0x22, 0x23
OBJECT_TAGS = (CLASS_DUMP, INSTANCE_DUMP, OBJ_ARRAY_DUMP, PRIM_ARRAY_DUMP)

# Root sub-record tag → (slug, label, record name, number of further ids, names of further u4 fields), in canonical order.
ROOTS = {
    0xFF: ("unknown", "Unknown", "ROOT_UNKNOWN", 0, ()),
    0x01: ("jni_global", "JNI global", "ROOT_JNI_GLOBAL", 1, ()),
    0x02: ("jni_local", "JNI local", "ROOT_JNI_LOCAL", 0, ("thread_serial", "frame_number")),
    0x03: ("java_frame", "Java frame", "ROOT_JAVA_FRAME", 0, ("thread_serial", "frame_number")),
    0x04: ("native_stack", "Native stack", "ROOT_NATIVE_STACK", 0, ("thread_serial",)),
    0x05: ("sticky_class", "Sticky class", "ROOT_STICKY_CLASS", 0, ()),
    0x06: ("thread_block", "Thread block", "ROOT_THREAD_BLOCK", 0, ("thread_serial",)),
    0x07: ("monitor_used", "Monitor used", "ROOT_MONITOR_USED", 0, ()),
    0x08: ("thread_object", "Thread object", "ROOT_THREAD_OBJ", 0, ("thread_serial", "stack_trace_serial")),
}
ROOT_ORDER = {slug: i for i, (slug, *_) in enumerate(ROOTS.values())}

# Type code → (name, width in bytes, struct format, descriptor); the width of an object is the id size.
TYPES = {
    2: ("object", 0, "", "L"), 4: ("boolean", 1, "?", "Z"), 5: ("char", 2, "H", "C"), 6: ("float", 4, "f", "F"), 7: ("double", 8, "d", "D"),
    8: ("byte", 1, "b", "B"), 9: ("short", 2, "h", "S"), 10: ("int", 4, "i", "I"), 11: ("long", 8, "q", "J"),
}
OBJECT = 2

# Array kinds in canonical order, with their element type codes.
ARRAY_KINDS = {"boolean": 4, "char": 5, "float": 6, "double": 7, "byte": 8, "short": 9, "int": 10, "long": 11, "object": 2}

#: Bucket keys of arrays: bit 63 and the element class, or bits 63 and 62 and the element type (as signed longs).
OBJ_ARRAY_BIT = -(1 << 63)
PRIM_ARRAY_BITS = -(1 << 62)

# Wrapper classes whose single field "value" stands for the object.
WRAPPERS = {
    "java.lang.Integer": "int", "java.lang.Long": "long", "java.lang.Double": "double", "java.lang.Float": "float", "java.lang.Short": "short",
    "java.lang.Byte": "byte", "java.lang.Boolean": "boolean", "java.lang.Character": "char",
}
STRING_CLASS = "java.lang.String"

#: Limits with the defaults of the original tools.
MAX_REFERRERS, PATH_LIMIT, PAGE, TOP_N, MAX_TOP_N, ROOTS_PER_TYPE, ROOTS_OF_TYPE = 50, 10_000, 200, 50, 1_000, 50, 200


def width(code: int, id_size: int) -> int:
    return id_size if code == OBJECT else TYPES[code][1]


def root_types(spark: SparkSession) -> DataFrame:
    """The nine root types in canonical order."""
    return spark.createDataFrame([(i, s, label, name) for i, (s, label, name, *_) in enumerate(ROOTS.values())], "type_index int, root_type string, label string, record_name string")


def array_kinds(spark: SparkSession, id_size: int = 8) -> DataFrame:
    """The nine array kinds in canonical order."""
    rows = [(i, k, ("Object" if k == "object" else k) + "[]", c, width(c, id_size)) for i, (k, c) in enumerate(ARRAY_KINDS.items())]
    return spark.createDataFrame(rows, "kind_index int, kind string, display_name string, type_code int, element_size int")
