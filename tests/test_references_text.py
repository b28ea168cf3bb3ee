"""Text keys are encoded by the operator itself."""

import random

import pytest

from heaplake.operators import references as refs

from .test_records import T0, brute_orphans, minutes


@pytest.mark.parametrize("parent_type", ["string", "long"])
def test_text_keys_against_brute_force(spark, parent_type):
    rng = random.Random(5)
    ids = ["00f", "a", "b", "", "z" * 300, "12x"] if parent_type == "string" else ["7", "8", "-3", "90071992547409931", "x"]
    numbers = [k for k in ids if k != "x"]
    records = [(rng.choice([1, 2]), rng.randrange(60), rng.choice([*ids, None]), rng.choice([*range(40), None])) for _ in range(300)]
    parents = [(rng.choice([1, 2]), rng.choice([*numbers, None]), rng.choice([*range(40), None])) for _ in range(8)]
    r = spark.createDataFrame([(*x[:3], minutes(x[3]), T0) for x in records], "dump_id long, record_id long, key string, ingested_at timestamp, dump_ts timestamp")
    kept = [(d, k if k is None or parent_type == "string" else int(k), minutes(t)) for d, k, t in parents]
    p = spark.createDataFrame(kept, f"dump_id long, id {parent_type}, ingested_at timestamp")
    got = refs.orphan_references(refs.references(r, "t", "dump_id", "record_id", "key", "ingested_at", "dump_ts"), refs.targets(p, "dump_id", "id", "ingested_at"), salts=3)
    order = {k: i + 1 for i, k in enumerate(sorted(ids))}  # numbers in value order stand for the texts
    name = {i: k for k, i in order.items()}
    want = brute_orphans([(d, i, order.get(k), t) for d, i, k, t in records], [(d, order.get(k), t) for d, k, t in parents])
    assert {(x["scope"], x["record_id"], x["key"]) for x in got.collect()} == {(d, i, name[k]) for d, i, k in want}
    assert want
