"""Column functions on ids, names, bytes and sizes; all of them stay in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def _lookup(pairs: dict, code: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])[code]


def type_name(code: Column, unknown: str = "?") -> Column:
    """Java name of a type code; ``object`` is shown as Object."""
    return F.coalesce(_lookup({c: "Object" if c == dims.OBJECT else n for c, (n, *_) in dims.TYPES.items()}, code.cast("int")), F.lit(unknown))


def type_width(code: Column, id_size: int = 8) -> Column:
    return F.coalesce(_lookup({c: dims.width(c, id_size) for c in dims.TYPES}, code.cast("int")), F.lit(0))


def descriptor_type(descriptor: Column) -> Column:
    """Type code of a primitive descriptor letter, null for others."""
    return _lookup({d: c for c, (_, _, _, d) in dims.TYPES.items() if c != dims.OBJECT}, descriptor)


def root_label(slug: Column) -> Column:
    return _lookup({s: label for s, label, *_ in dims.ROOTS.values()}, slug)


def root_index(slug: Column) -> Column:
    return _lookup(dims.ROOT_ORDER, slug)


def unsigned_order(id_: Column) -> Column:
    """A sort key that puts ids in unsigned order: ids from 2**63 on are negative longs."""
    return id_.bitwiseXOR(F.lit(dims.OBJ_ARRAY_BIT))


def hex_id(id_: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(id_)))


def parse_hex_id(text: Column) -> Column:
    """The id of a hexadecimal string with or without 0x; null for anything else or more than 64 bits."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, -10).cast("long"))


def dotted(name: Column) -> Column:
    return F.translate(name, "/", ".")


def slashed(name: Column) -> Column:
    return F.translate(name, ".", "/")


def is_synthetic(key: Column) -> Column:
    """Whether a bucket key stands for arrays and not for a class."""
    return key < 0


def instance_key(class_id: Column) -> Column:
    return class_id


def obj_array_key(element_class_id: Column) -> Column:
    return element_class_id.bitwiseOR(F.lit(dims.OBJ_ARRAY_BIT))


def prim_array_key(element_type: Column) -> Column:
    return element_type.cast("long").bitwiseOR(F.lit(dims.PRIM_ARRAY_BITS))


def line_kind(line: Column) -> Column:
    """What a frame's line number says: line, none, unknown, compiled or native."""
    return F.when(line > 0, "line").when(line == 0, "none").when(line == -2, "compiled").when(line == -3, "native").otherwise("unknown")


def size_text(n: Column, spaced: bool = True) -> Column:
    """A byte count for people, in decimal units with one digit: ``1.5 MB``, or ``1.5M`` unless ``spaced``."""
    gap, b = (" ", "B") if spaced else ("", "")
    out = F.concat(n.cast("string"), F.lit(gap + "B"))
    for limit, unit in ((10**3, "K"), (10**6, "M"), (10**9, "G")):
        out = F.when(n >= limit, F.format_string(f"%.1f{gap}{unit}{b}", n / F.lit(float(limit)))).otherwise(out)
    return out


def unsigned_bytes(raw: Column) -> Column:
    """The big-endian number of up to 8 bytes, 8 bytes as a signed long."""
    return F.conv(F.hex(raw), 16, -10).cast("long")


def signed(n: Column, bits: int) -> Column:
    """The signed value of an unsigned number of ``bits`` bits."""
    return n if bits == 64 else F.when(n >= 1 << (bits - 1), n - (1 << bits)).otherwise(n)


def _float(n: Column, exponent_bits: int, fraction_bits: int) -> Column:
    top = (1 << exponent_bits) - 1
    bias = top >> 1
    e = F.shiftright(n, fraction_bits).bitwiseAND(F.lit(top))
    m = n.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double") / F.lit(float(1 << fraction_bits))
    sign = F.when(F.shiftright(n, exponent_bits + fraction_bits).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = (m + 1.0) * F.pow(F.lit(2.0), (e - bias).cast("double"))
    small = m * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
    special = F.when(m == 0.0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(e == 0, small).when(e == top, special).otherwise(normal)


def double_bits(n: Column) -> Column:
    """The IEEE 754 double of 64 bits, exactly."""
    return _float(n, 11, 52)


def float_bits(n: Column) -> Column:
    return _float(n, 8, 23)


def utf8_text(raw: Column) -> Column:
    """UTF-8 text, invalid bytes replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def latin1_text(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")
