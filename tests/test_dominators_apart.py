"""A graph that is taken apart: its result reads what was solved."""

from heaplake.operators import dominators as dom

from .test_dominators_kept import heap, steps


def test_the_trees_of_a_graph_taken_apart_are_followed_once(spark):
    h = heap(spark)
    got = dom.dominators(h.sized.select("object_id"), h.refs, h["gc_root"], capacity=2)
    assert {r["object_id"]: r["dominator_id"] for r in got.collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 4}
    assert "FlatMapGroups" not in steps(got)  # nothing is solved again by whoever reads the result
