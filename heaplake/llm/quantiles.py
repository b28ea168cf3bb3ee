"""Percentiles with a bounded rank error by deterministic buffer collapsing.

A summary is a few sorted buffers of ``size`` values, each standing for ``2 ** level`` values a piece, and one unfilled
buffer of single values. Two buffers of a level collapse into one of the next by taking every other value of their merged
order; the offset alternates. A collapse at a level moves any rank by at most that level's weight, and every buffer
carries the sum of these weights: the sum over a summary's buffers is a proven bound of its rank error. After n values
that is at most ``n * levels / (2 * size)``. Summaries merge by pooling their buffers, so days, partitions and tables can
be combined in any order; the merges run as a tree (partition, then salted group, then group).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 4096


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Turns the bits of doubles, as longs, into longs of the same order, and such longs back into bits."""
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


_FLUSH = 1_000_000
_STATE = "measure string, grp string, day date, level int, n long, err long, lo long, hi long, vals array<long>"
_KEYS = ["measure", "grp", "day"]


class Summary:
    """The buffers of one group while it is being built."""

    __slots__ = ("size", "loose", "count", "levels", "turn")

    def __init__(self, size: int):
        self.size, self.loose, self.count = size, [], 0
        self.levels: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.turn: dict[int, int] = {}

    def add(self, level: int, values: np.ndarray, err: int) -> None:
        if level == 0 and len(values) != self.size:
            if len(values):
                self.loose.append(values)
                self.count += len(values)
                if self.count >= self.size:
                    self._fill()
        else:
            self._push(level, values, err)

    def _fill(self) -> None:
        pool = np.sort(np.concatenate(self.loose))
        cut = len(pool) // self.size * self.size
        # neighbouring buffers take turns through the order, so that each covers the whole range
        step = cut // self.size
        for i in range(step):
            self._push(0, pool[i:cut:step], 0)
        self.loose = [pool[cut:]] if cut < len(pool) else []
        self.count = len(pool) - cut

    def _push(self, level: int, values: np.ndarray, err: int) -> None:
        held = self.levels.setdefault(level, [])
        held.append((values, err))
        if len(held) == 2:
            (a, ea), (b, eb) = held
            held.clear()
            offset = self.turn[level] = 1 - self.turn.get(level, 1)
            merged = np.sort(np.concatenate([a, b]), kind="mergesort")[offset::2]
            self._push(level + 1, merged, ea + eb + (1 << level))

    def buffers(self) -> Iterator[tuple[int, np.ndarray, int]]:
        if self.loose or not any(self.levels.values()):
            yield 0, np.sort(np.concatenate(self.loose)) if self.loose else np.empty(0, "int64"), 0
        for level, held in self.levels.items():
            for values, err in held:
                yield level, values, err


def _frame(rows: list[tuple], lists: list[np.ndarray], keys: tuple[list, list, list]) -> pa.RecordBatch:
    level, n, err, lo, hi = zip(*rows) if rows else ((), (), (), (), ())
    offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype("int32")
    values = np.concatenate(lists) if lists else np.empty(0, "int64")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.date32()), pa.array(level, pa.int32()),
            pa.array(n, pa.int64()), pa.array(err, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())),
        ],
        names=["measure", "grp", "day", "level", "n", "err", "lo", "hi", "vals"],
    )


def _leaves(size: int):
    """Summaries of the groups of one partition; values are held for ``_FLUSH`` rows at most."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        part = [t.column(i).combine_chunks().dictionary_encode(null_encoding="encode") for i in range(3)]
        code = np.zeros(t.num_rows, "int64")
        for p in part:
            code = code * max(1, len(p.dictionary)) + p.indices.to_numpy(zero_copy_only=False)
        column = t.column(3).combine_chunks()
        given = column.is_valid().to_numpy(zero_copy_only=False)
        value = column.fill_null(0).to_numpy(zero_copy_only=False)
        if value.dtype == np.float64:
            value = np.where(np.isnan(value), np.nan, value + 0.0)  # one NaN, above everything, and one zero
            value = _ordered(value.view("int64"))
        order = np.lexsort((value, ~given, code))
        code, value, given = code[order], value[order], given[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, "int64")
        many = np.add.reduceat(given.astype("int64"), start) if len(start) else start
        rows, lists, where = [], [], []
        for s, m in zip(start.tolist(), many.tolist()):
            values = value[s : s + m]
            lo, hi = (int(values[0]), int(values[-1])) if m else (None, None)
            if m < size:
                rows.append((0, m, 0, lo, hi))
                lists.append(values)
                where.append(order[s])
                continue
            summary = Summary(size)
            summary.add(0, values, 0) if m == size else (summary.loose.append(values), setattr(summary, "count", m), summary._fill())
            for level, kept, err in summary.buffers():
                rows.append((level, len(kept) << level, err, lo, hi))
                lists.append(kept)
                where.append(order[s])
        at = pa.array(np.array(where, dtype="int64"))
        return _frame(rows, lists, tuple(t.column(i).take(at).combine_chunks() for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _FLUSH:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge(size: int):
    """Merge the buffers of each group; rows come sorted by group, one group's summary is held at a time."""

    def close(key: tuple, s: Summary, lo, hi, rows: list, lists: list, keys: tuple) -> None:
        for level, values, err in s.buffers():
            rows.append((level, len(values) << level, err, lo, hi))
            lists.append(values)
            for to, k in zip(keys, key):
                to.append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, summary, lo, hi = None, None, None, None
        for batch in batches:
            rows, lists, keys = [], [], ([], [], [])
            columns = [batch.column(i).to_pylist() for i in range(3)]
            levels, errs = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            los, his = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            offsets, values = batch.column(8).offsets.to_numpy(), batch.column(8).values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(zip(*columns)):
                if key != current:
                    if summary is not None:
                        close(current, summary, lo, hi, rows, lists, keys)
                    current, summary, lo, hi = key, Summary(size), None, None
                summary.add(levels[i], values[offsets[i] : offsets[i + 1]], errs[i])
                if los[i] is not None:
                    lo, hi = (los[i], his[i]) if lo is None else (min(lo, los[i]), max(hi, his[i]))
            yield _frame(rows, lists, keys)
        if summary is not None:
            rows, lists, keys = [], [], ([], [], [])
            close(current, summary, lo, hi, rows, lists, keys)
            yield _frame(rows, lists, keys)

    return run


def summarise(df: DataFrame, measure: Column, group: Column, day: Column, value: Column, size: int = SIZE) -> DataFrame:
    """The summary of ``value`` per measure, group and day, as buffer rows.

    Null values count nowhere; a group of nulls only has a summary of no values. Null groups and days are groups of their
    own. Ties keep their multiplicity. Integers are kept as 64-bit integers; floats and doubles as the integers of the same
    order (pass ``real`` to :func:`percentiles` to get them back; NaN comes after all numbers, -0.0 is 0.0). Other types
    are a ValueError: nothing is rounded silently.
    """
    kind = df.select(value.alias("v")).dtypes[0][1]
    if kind in ("float", "double"):
        value = value.cast("double")
    elif kind in ("bigint", "int", "smallint", "tinyint"):
        value = value.cast("long")
    else:
        raise ValueError(f"percentiles of {kind}: cast to a 64-bit integer or a double first")
    rows = df.select(measure.cast("string").alias("measure"), group.cast("string").alias("grp"), day.cast("date").alias("day"), value.alias("value"))
    return merge_summaries(rows.mapInArrow(_leaves(size), _STATE), _KEYS, size)


def merge_summaries(states: DataFrame, by: Sequence[str], size: int = SIZE, salts: int = 32) -> DataFrame:
    """One summary per ``by`` (some of measure, grp and day) from any summaries: the union of days, for example.

    A first round merges within salted groups, so that a group with very many summaries isn't one task's work.
    """
    rows = states.select(*[F.col(c) if c in by else F.lit(None).cast(t).alias(c) for c, t in zip(_KEYS, ("string", "string", "date"))], "level", "n", "err", "lo", "hi", "vals")
    order = [*by, "level", "lo", "hi", "n"]  # a fixed order makes results repeatable
    salt = F.pmod(F.xxhash64("lo", "hi", "n", "level"), F.lit(salts))
    many = F.size("vals") * 4 >= size  # only large buffers need the first round
    first = rows.where(many).withColumn("_salt", salt).repartition(*by, "_salt").sortWithinPartitions(*by, "_salt", "level", "lo", "hi", "n").drop("_salt")
    pooled = first.mapInArrow(_merge(size), _STATE).unionByName(rows.where(~many | F.col("vals").isNull()))
    return pooled.repartition(*by).sortWithinPartitions(*order).mapInArrow(_merge(size), _STATE)


def _evaluate(fractions: Sequence[float]):
    """The fractions' values of each summary; rows come sorted by group."""

    def finish(key: tuple, held: list, lo, hi) -> tuple:
        weights = np.concatenate([np.full(len(v), 1 << level, "int64") for level, v, _ in held])
        values = np.concatenate([v for _, v, _ in held])
        n = int(weights.sum())
        if not n:
            return (*key, 0, None, None, 0, [None] * len(fractions))
        if len(held) > 1:
            order = np.argsort(values, kind="stable")
            values, weights = values[order], weights[order]
        cum = np.cumsum(weights)
        ranks = [max(1, n - int(np.floor(n - q * n))) for q in fractions]
        found = [int(values[min(len(values) - 1, int(np.searchsorted(cum, r)))]) for r in ranks]
        return (*key, n, lo, hi, sum(e for _, _, e in held), found)

    def show(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.date32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_KEYS, "n", "min_value", "max_value", "rank_error", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, lo, hi = None, [], None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7)]
            offsets, values = batch.column(8).offsets.to_numpy(), batch.column(8).values.to_numpy(zero_copy_only=False)
            for i, (m, g, d, level, err, a, b) in enumerate(zip(*columns)):
                key = (m, g, d)
                if key != current:
                    if held:
                        out.append(finish(current, held, lo, hi))
                    current, held, lo, hi = key, [], None, None
                held.append((level, values[offsets[i] : offsets[i + 1]], err))
                if a is not None:
                    lo, hi = (a, b) if lo is None else (min(lo, a), max(hi, b))
            yield show(out)
        if held:
            yield show([finish(current, held, lo, hi)])

    return run


def percentiles(states: DataFrame, fractions: dict[str, float], *, real: bool = False) -> DataFrame:
    """measure, grp, day, n, min_value, max_value, rank_error and one column per fraction.

    The value of a fraction q is the smallest one whose rank is at least ``ceil(q * n)``, off by at most ``rank_error``
    ranks; with rank_error 0 it is exact, as are min_value and max_value always. A summary of no values gives nulls.
    ``real``: the summaries are of doubles.

    A summary that is one sorted buffer of single values, as most are, is read off in the JVM; only summaries of several
    buffers go to Python.
    """
    w = Window.partitionBy(*_KEYS)
    counted = states.withColumn("_rows", F.count("*").over(w))
    alone = (F.col("_rows") == 1) & (F.col("level") == 0)
    n = F.size("vals")

    def at(q: float) -> Column:
        rank = F.greatest(F.lit(1), n - F.floor(n - F.lit(float(q)) * n)).cast("int")
        return F.when(n > 0, F.element_at("vals", F.least(rank, F.greatest(n, F.lit(1)))))

    direct = counted.where(alone).select(*_KEYS, n.cast("long").alias("n"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"), "err", F.array(*[at(q) for q in fractions.values()]).alias("found"))
    direct = direct.withColumnRenamed("err", "rank_error")
    several = counted.where(~alone).drop("_rows").sortWithinPartitions(*_KEYS, "level")
    rows = direct.unionByName(several.mapInArrow(_evaluate(list(fractions.values())), "measure string, grp string, day date, n long, min_value long, max_value long, rank_error long, found array<long>"))
    shown = rows.select(*_KEYS, "n", "min_value", "max_value", "rank_error", *[F.col("found")[i].alias(c) for i, c in enumerate(fractions)])
    return shown.withColumns({c: _double(F.col(c)) for c in ("min_value", "max_value", *fractions)}) if real else shown


@F.arrow_udf(T.DoubleType())
def _double(ordered: pa.Array) -> pa.Array:
    bits = _ordered(ordered.fill_null(0).to_numpy(zero_copy_only=False).astype("int64"))
    return pa.array(bits.view("float64"), mask=ordered.is_null().to_numpy(zero_copy_only=False))


def rank_checks(rows: DataFrame, found: DataFrame, keys: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """For each group and fraction whether the value found lies within ``rank_error`` of its rank among all ``rows``.

    ``rows``: keys and value; ``found``: keys, n, rank_error and a column per fraction. Ranks are counted over the values as
    they are, so this is an exact check of :func:`percentiles`. Groups are aggregated where their rows lie.
    """
    few = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "rank_error", *fractions)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = rows.where("value is not null").join(few, same)
    below = both.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("rank_error").alias("err"),
        *[F.count(F.when(F.col("value") < F.col(c), 1)).alias(f"_lt_{c}") for c in fractions], *[F.count(F.when(F.col("value") <= F.col(c), 1)).alias(f"_le_{c}") for c in fractions],
    )

    def within(c: str, q: float) -> Column:
        rank = F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.lit(float(q)) * F.col("n")))
        return (F.col(f"_lt_{c}") + 1 - F.col("err") <= rank) & (rank <= F.col(f"_le_{c}") + F.col("err"))

    return below.select(*keys, "n", *[within(c, q).alias(c) for c, q in fractions.items()])
