"""Small dumps built with the encoder."""

import struct

from heaplake.sources.codec import Writer


def f1(id_size=8):
    w = Writer(id_size)
    for i, text in enumerate(["value", "java/lang/Integer", "java/lang/Object", "main", "()V", "MyClass.java"], 1):
        w.utf8(i, text)
    w.load_class(1, 0x200, 0, 2).load_class(2, 0x300, 0, 3)
    w.frame(0x10, 4, 5, 6, 1, 7).trace(1, 1, [0x10]).start_thread(1, 0xABC, 1, 4).end_thread(1)
    w.class_dump(0x200, 0x300, 4, fields=[(1, 10)]).class_dump(0x300)
    return w.instance(0x100, 0x200, struct.pack(">i", 42)).bytes()


def f2(id_size=8):
    w = Writer(id_size)
    for i, text in enumerate(["count", "java/lang/Object", "java/lang/Integer", "value", "myField", "java/lang/String", "[C", "java/util/ArrayList"], 1):
        w.utf8(i, text)
    for s, (c, n) in enumerate([(0x10, 3), (0x20, 2), (0x30, 6), (0x40, 7), (0x50, 8)], 1):
        w.load_class(s, c, 0, n)
    w.class_dump(0x20).class_dump(0x10, 0x20, 4, fields=[(4, 10)]).class_dump(0x30, 0x20, id_size, fields=[(4, 2)]).class_dump(0x40, 0x20)
    w.class_dump(0x50, 0x20, id_size, statics=[(1, 10, 7)], fields=[(5, 2)])
    w.instance(0x100, 0x10, struct.pack(">i", 42)).prim_array(0x200, 5, "hi".encode("utf-16-be"))
    return w.instance(0x300, 0x30, w.id(0x200)).instance(0x400, 0x50, w.id(0x100)).bytes()


def f3(id_size=8):
    w = Writer(id_size).utf8(1, "java/lang/Integer").utf8(2, "value").utf8(3, "java/lang/Object").load_class(1, 0x10, 0, 1).load_class(2, 0x20, 0, 3)
    w.class_dump(0x20).class_dump(0x10, 0x20, 4, fields=[(2, 10)])
    return w.instance(0x100, 0x10, struct.pack(">i", 99)).obj_array(0x200, 0x10, [0x100, 0]).bytes()


def f4(id_size=8):
    w = Writer(id_size).utf8(1, "s").utf8(2, "f").utf8(3, "A").utf8(4, "B").load_class(1, 0x100, 0, 3).load_class(2, 0x300, 0, 4)
    w.root("sticky_class", 0x100).root("sticky_class", 0x300).class_dump(0x300)
    w.class_dump(0x100, 0x300, id_size, statics=[(1, 2, 0x200)], fields=[(2, 2)])
    return w.instance(0x200, 0x100, w.id(0x400)).prim_array(0x400, 10, bytes(12)).bytes()


def f5():
    w = Writer().utf8(1, "main").utf8(2, "MyClass").utf8(3, "()V").utf8(4, "MyClass.java")
    return w.frame(0x10, 1, 3, 4, 99, 5).trace(1, 1, [0x10]).start_thread(1, 0xABC, 1, 1, 2).end_thread(1).unload_class(77).bytes()


def f6():
    return Writer().root("sticky_class", 1).root("sticky_class", 2).segment().record(0x2C, b"").bytes()


def graph(edges, roots, sizes=None):
    """A dump whose objects refer to each other as in ``edges``: arrays of one class."""
    w = Writer().utf8(1, "java/lang/Object").load_class(1, 0x10, 0, 1).class_dump(0x10)
    nodes = sorted({*edges, *[t for ts in edges.values() for t in ts if t in edges or t < 900]})
    for n in nodes:
        w.obj_array(n, 0x10, edges.get(n, []))
    for r in roots:
        w.root("jni_global", r, 0)
    return w.bytes()
