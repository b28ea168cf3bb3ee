"""Training-data operators against brute force, round trips and held-out cases."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaplake.llm import mixing, quantiles, truncation, words

# --- percentiles ---------------------------------------------------------------------------------------------------


def daily(spark, rows, **kw):
    df = spark.createDataFrame(rows, "m string, g string, d date, v long").withColumn("level", F.lit("x"))
    return quantiles.summarise(df, F.col("m"), F.col("g"), F.col("d"), F.col("v"), **kw)


FRACTIONS = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def exact(values, q):
    s = sorted(values)
    return s[max(1, len(s) - int(np.floor(len(s) - q * len(s)))) - 1]


def test_small_groups_are_exact(spark):
    rng = random.Random(1)
    rows = [("m", rng.choice(["a", "b", None]), date(2025, 1, rng.choice([1, 2])), rng.choice([0, 5, 5, 2**62, -7, None])) for _ in range(300)]
    rows += [("m", "nulls", date(2025, 1, 1), None)] * 3
    got = {(r["grp"], r["day"]): r for r in quantiles.percentiles(daily(spark, rows), FRACTIONS).collect()}
    for key in {(g, d) for _, g, d, _ in rows}:
        values = [v for _, g, d, v in rows if (g, d) == key and v is not None]
        r = got[key]
        assert (r["n"], r["rank_error"]) == (len(values), 0)
        assert [r[c] for c in FRACTIONS] == ([exact(values, q) for q in FRACTIONS.values()] if values else [None] * 4)


@pytest.mark.parametrize("size", [16, 64])
def test_rank_error_bound_holds_for_any_union(spark, size):
    rng = random.Random(2)
    rows = [("m", "g", date(2025, 1, 1 + i % 3), int(rng.paretovariate(0.3)) % 2**61 if i % 4 else 17) for i in range(9000)]
    states = daily(spark, rows, size=size)
    for by, pick in ((["measure", "grp", "day"], lambda r, x: x[2] == r["day"]), (["measure", "grp"], lambda r, x: True)):
        merged = quantiles.merge_summaries(states, by, size=size, salts=3) if "day" not in by else states
        assert merged.agg(F.max(F.size("vals"))).first()[0] <= size
        for r in quantiles.percentiles(merged, FRACTIONS).collect():
            values = np.sort([x[3] for x in rows if pick(r, x)])
            n = len(values)
            assert (r["n"], r["min_value"], r["max_value"]) == (n, values[0], values[-1])
            assert 0 < r["rank_error"] <= n * np.log2(2 * n / size) / size
            for c, q in FRACTIONS.items():
                rank = max(1, int(np.ceil(q * n)))
                low, high = np.searchsorted(values, r[c], "left") + 1, np.searchsorted(values, r[c], "right")
                assert low - r["rank_error"] <= rank <= high + r["rank_error"]


def test_no_rows(spark):
    assert quantiles.percentiles(daily(spark, []), FRACTIONS).count() == 0


# --- token ids -----------------------------------------------------------------------------------------------------

TEXTS = [
    "Hello world, it's  a\ttest\n\n  x", "", None, "   ", "\r\n\r\n  　 a", "naïve 東京 123٣ 👩‍🔬 \x1b[0;31mErr\x1b[0m", "<|endoftext|> is text", "a" * 5000 + " " * 3000 + "� b",
    "don't we'll I'D 're", "x" + "\n" * 50 + "y", "Hello world, it's  a\ttest\n\n  x",
]


def reference_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{words.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(words, "_BLOCK_WORDS", 5)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, block long")
    ids = words.encode_texts(df, "doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert [got[i] for i in range(len(TEXTS))] == reference_ids(TEXTS)
    back = {r["doc_id"]: r["text"] for r in words.decode_ids(ids, "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    counts = {r["doc_id"]: r["n_tokens"] for r in words.encode_texts(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_repeated_and_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(((r["doc_id"], len(r["ids"])) for r in words.encode_texts(df, "doc_id", "text").collect()), key=str) == [(1, 1), (1, 2), (None, 1)]
    assert words.encode_texts(df.where("false"), "doc_id", "text").count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def test_steps_invert_the_poisson_distribution():
    u = np.random.default_rng(3).random(2000)
    steps = mixing.poisson_steps(u, 6)
    assert (np.diff(steps, axis=1) >= 0).all()
    for rate in (0.1, 1.0, 3.5):
        place = int(np.searchsorted(mixing._GRID, rate))
        counts = (steps <= place).sum(axis=1)
        term, below, want = np.exp(-mixing._GRID[place]), 0.0, np.zeros(len(u), int)
        for k in range(1, 7):
            below += term
            want += u >= below
            term *= mixing._GRID[place] / k
        assert (counts == want).all()
        assert abs(counts.mean() - mixing.expected_copies(rate, 6)) < 0.1


def mix(spark, n=3000, **kw):
    rng = random.Random(4)
    docs = [(i, rng.choices(["big", " BIG", "mid-size", "small", "other", None], [60, 5, 20, 4, 10, 1])[0], rng.choice([0, 10, 40, 200])) for i in range(n)]
    targets = [("big", 0.5, 1), ("mid_size", 0.3, 2), ("small", 0.15, 5), ("absent", 0.05, 3), ("zero", 0.0, 3), (None, 0.3, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("copies", F.lit("x")).withColumn("target_share", F.lit(1))
    return mixing.plan_rates(d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **kw)


def test_shares_and_caps(spark):
    counted, report = mix(spark)
    r = {x["source"]: x for x in report.collect()}
    for s, share in (("big", 0.5), ("mid_size", 0.3), ("small", 0.15)):
        assert abs(r[s]["actual_share"] - share / 0.95) < 0.01, s
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    assert (r["absent"]["mixed_tokens"], r["zero"]["mixed_rows"], r["other"]["mixed_tokens"]) == (0, 0, 0)
    caps = {"big": 1, "mid_size": 2, "small": 5}
    assert all(x["copies"] <= caps[x["source"]] for x in counted.collect())
    again, _ = mix(spark)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, again.collect()))
    half = {x["source"]: x for x in mix(spark, total_tokens=5000)[1].collect()}
    assert abs(sum(x["mixed_tokens"] for x in half.values()) - 5000) < 1000


def test_mixture_rows(spark):
    counted, _ = mix(spark, 400)
    docs = spark.createDataFrame([(i, f"t{i}", 9) for i in range(400)], "doc_id long, text string, place long")
    rows = mixing.mixture(docs, counted).collect()
    want = {(x["doc_id"], k + 1) for x in counted.collect() for k in range(x["copies"])}
    assert {(x["doc_id"], x["copy_no"]) for x in rows} == want and len(rows) == len(want)
    assert all(x["text"] == f"t{x['doc_id']}" for x in rows)
    assert [x["place"] for x in rows] == sorted(x["place"] for x in rows)


def test_nothing_to_mix(spark):
    counted, report = mix(spark, 0)
    assert counted.count() == 0 and {r["actual_share"] for r in report.collect()} == {0.0}


# --- truncation ----------------------------------------------------------------------------------------------------


def test_significant_lengths(spark):
    rng = random.Random(6)
    lengths = [("a", "chars", min(500, int(rng.gauss(450, 80)))) for _ in range(3000)] + [("b", "chars", int(rng.gauss(450, 80))) for _ in range(3000)]
    tests = truncation.length_tests(spark.createDataFrame(lengths, "source string, unit string, length int"))
    found = truncation.significant_lengths(tests).collect()
    assert [(r["source"], r["length"]) for r in found] == [("a", 500)] and found[0]["log_odds"] > 2
    assert truncation.significant_lengths(tests.where("false")).count() == 0


def notebooks(n, seed):
    """Whole notebooks of sentences and code with their cells, and some cut at 700 characters or at any place."""
    rng = random.Random(seed)
    nouns, verbs = ["ledger", "harbour", "meadow", "window", "signal"], ["measure", "compare", "encode", "plot"]
    rows = []
    for i in range(n):
        parts, cells, at = [], [], 0
        for j in range(rng.randrange(4, 16)):
            if rng.random() < 0.5:
                body, kind = " ".join(f"We {rng.choice(verbs)} the {rng.choice(nouns)} before the {rng.choice(nouns)}{rng.choice(['.', '.', '.', ' again.'])}" for _ in range(rng.randrange(1, 4))), "text"
            else:
                body, kind = "\n".join(f"{rng.choice(nouns)} = {rng.choice(verbs)}({rng.choice(nouns)}, rate={rng.randrange(99)})" for _ in range(rng.randrange(1, 4))), "code"
            head = f"# %% [{j}]\n"
            parts.append(head + body + "\n\n")
            cells.append({"cell_no": j, "kind": kind, "execution_count": j, "char_start": at + len(head), "cell_chars": len(body)})
            at += len(parts[-1])
        text, source = "".join(parts).rstrip() if rng.random() < 0.5 else "".join(parts), rng.choice(["limited", "Limited ", "free", None])
        cut = 0
        if source and source.lower().startswith("limited") and len(text) > 700:
            cut = 700
        elif source == "free" and rng.random() < 0.06:
            cut = rng.randrange(60, len(text) - 20)
        if cut:
            text = text[:cut]
            cells = [c | {"cell_chars": min(c["cell_chars"], cut - c["char_start"])} for c in cells if c["char_start"] < cut]
        inside = bool(cut) and not any(len(text.rstrip()) == c["char_start"] + c["cell_chars"] and c["char_start"] + c["cell_chars"] < cut for c in cells)
        rows.append((i, text, source, cells if rng.random() < 0.95 else None, bool(cut), inside))
    return rows


def test_held_out_truncation(spark):
    rows = notebooks(1500, 8)
    extra = [(9001, None, "free", None, False, False), (9002, "", "free", None, False, False), (9003, " \t\n ", "limited", None, False, False), (9004, "Z" * 300_000, "free", None, False, False)]
    schema = "doc_id long, text string, source string, cells array<struct<cell_no int, kind string, execution_count int, char_start int, cell_chars int>>, row int, same string"
    df = spark.createDataFrame([(*r[:4], 1, "x") for r in rows + extra], schema)
    got = {r["doc_id"]: r for r in truncation.truncated(df).collect()}
    assert 9001 not in got and 9002 not in got and 9003 not in got and 9004 in got
    flagged = {i for i, r in got.items() if r["cut"]} - {9004}
    cut, inside = {r[0] for r in rows if r[4]}, {r[0] for r in rows if r[5]}
    assert len(flagged - cut) <= 0.03 * len(flagged)
    assert len(flagged & inside) >= 0.9 * len(inside)
    assert any(r["limit_unit"] == "chars" and r["limit_length"] == 700 for r in got.values())
    report = {r["source"]: r for r in truncation.truncation_report(truncation.truncated(df)).collect()}
    assert set(report) == {"limited", "free", ""} and report["limited"]["cut_at_limits"] > 50


def test_truncation_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None, None), (2, "a b", "s", None)], "doc_id long, text string, source string, cells array<struct<cell_no int, kind string, execution_count int, char_start int, cell_chars int>>")
    assert {r["cut"] for r in truncation.truncated(df).collect()} == {False}
    assert truncation.truncated(df.where("false")).count() == 0


def test_endings():
    assert truncation.ending("abc\n\n") == ("abc", 2, False)
    assert truncation.ending("x = 1\n```\n") == ("x = 1", 1, True)
