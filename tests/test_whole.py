"""Queries over whole tables: nothing is left out, and the rows are those of DuckDB."""

import struct

import pytest

import __spark_entry__ as entry

from .test_queries import DATA, duck, pytestmark, test_query  # noqa: F401

same = test_query
del test_query


@pytest.mark.parametrize("name", ["dominators", "dominators_distributed", "retained_sizes", "retained_topk", "dominatees"])
def test_dominators(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_dominators_have_all_orders_and_lines(spark, duck):  # noqa: F811
    got = entry.queries()["dominators"](spark, DATA)
    for kind, table in ((4, "orders"), (5, "lineitem")):
        assert got.where(f"shiftright(object_id, 56) = {kind}").count() == duck.sql(f"select count(*) from {table}").fetchall()[0][0]


@pytest.mark.parametrize("name", ["diff_entries", "diff_by_class", "diff_top", "diff_net_topk", "diff_totals", "address_reuse"])
def test_diff(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_diff_has_changed_order_arrays(spark):
    rows = {r["class_name"]: r for r in entry.queries()["diff_by_class"](spark, DATA).collect()}
    assert rows["shop.Order[]"]["count_common_changed"] > 0
    assert {"char[]", "byte[]", "shop.Customer[]", "shop.Supplier", "java.lang.String"} <= set(rows)


@pytest.mark.parametrize("name", ["resolved_instances", "obj_array_elements", "is_gc_root", "prim_array_decode"])
def test_all_kinds(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_all_primitive_arrays_are_decoded(spark, duck):  # noqa: F811
    got = {}
    for r in entry.queries()["prim_array_decode"](spark, DATA).collect():
        got.setdefault((r["array_id"] >> 56, r["array_id"] & ((1 << 56) - 1)), {})[r["pos"]] = (r["i"], r["d"])
    want = {}
    for key, name in duck.sql("select p_partkey, p_name from part").fetchall():
        want[20, key] = {i: (b, None) for i, b in enumerate(name.encode("latin-1"))}
    for key, vector in duck.sql("select vec_id, embedding from embeddings").fetchall():
        want[21, key] = {i: (None, x) for i, x in enumerate(vector)}
    for key, text in duck.sql("select doc_id, text from documents where text is not null and text <> ''").fetchall():
        raw = text.encode("utf-16-be")
        want[22, key] = {i: (u, None) for i, (u,) in enumerate(struct.iter_unpack(">H", raw))}
    assert set(got) == set(want)
    assert all(got[k] == elements for k, elements in want.items())
