"""Texts cut off by field limits and broken transfers.

Per source, the lengths of its texts (in characters, in bytes, and in bytes modulo a transfer block) form discrete
hazards: of the texts that reach a length, the share that ends there. Window functions set each hazard against those of
the neighbouring lengths; lengths with too many ends for chance are kept under false-discovery control. A text at such a
length has the odds of that excess for being cut, any other text the small odds of its source, and the ending decides.

How complete an ending looks is learned from the corpus itself: cells inside parsed notebooks end where their authors
ended them, and any other place is where a cut could fall. A logistic model of the characters, words and line shape
before the end is fitted to both on a bounded sample, and gives the log likelihood ratio of "cut" against "own end".
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import join_few, materialise
from .mixing import source_name

#: Transfer blocks: ends at equal places of blocks this large are counted together.
BLOCK_BYTES = 4096
#: At most so many notebooks (chosen by hash) teach the model of endings.
SAMPLE_DOCS = 8_000
#: At a limit at least this share is taken to end there of its own accord: authors fit texts to the limits they know.
OWN_SHARE = 0.02
#: The share of a source's texts that are cut at no particular length stays this far from 0 and 1: only so that its odds are finite.
_LEAST_SHARE = 1e-4
_PLACES = 24
_CONTEXT = 240
_BITS = 18
# --- lengths -------------------------------------------------------------------------------------------------------


def _log_tail(seen: Column, expected: Column) -> Column:
    """Log of an upper bound of the Poisson chance of at least ``seen`` where ``expected`` are expected."""
    z = seen + 1.0
    factorial = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)  # Stirling; off by less than 0.001
    bound = -expected + seen * F.log(expected) - factorial - F.log1p(-expected / z)
    return F.when(seen <= expected, 0.0).otherwise(F.least(F.lit(0.0), bound))


def length_tests(lengths: DataFrame, near: int = 40) -> DataFrame:
    """Each (source, unit, length) with docs, at_risk, expected and log_p.

    ``lengths``: source, unit, length, a row per text. The hazard expected at a length is that of the lengths up to
    ``near`` away on both sides, itself left out; half an end is added so that an empty neighbourhood isn't a zero.
    """
    ends = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("docs"))
    own = Window.partitionBy("source", "unit").orderBy("length")
    before = F.coalesce(F.sum("docs").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = F.sum("docs").over(Window.partitionBy("source", "unit")) - before  # a frame that ends at the end would be summed anew for each row
    around = own.rangeBetween(-near, near)
    risk = ends.withColumn("at_risk", reach)
    places = F.least(F.col("length"), F.lit(near)) + near
    tested = risk.select(
        "*",
        (F.sum("docs").over(around) - F.col("docs")).alias("near_docs"),
        F.avg("at_risk").over(around).alias("near_risk"),
    ).withColumn("expected", F.col("at_risk") * (F.col("near_docs") + 0.5) / (F.greatest(places, F.lit(1)) * F.col("near_risk")))
    return tested.select("source", "unit", "length", "docs", "at_risk", "expected", _log_tail(F.col("docs"), F.col("expected")).alias("log_p"))


def significant_lengths(tests: DataFrame, rate: float = 0.001) -> DataFrame:
    """The tests that hold at a false-discovery rate (Benjamini-Hochberg), with log_odds: excess against expectation.

    The number k of tests that hold is the largest with k tests at or below ``rate * k / total``. It is found from above
    by counting alone, so the tests stay where they are: each count gives the next, lower limit until it stays the same.
    """
    total = tests.count()
    bound, k = math.log(rate), -1
    while k != (k := tests.where(F.col("log_p") <= bound).count()):
        bound = math.log(rate * max(k, 1) / max(1, total)) if k else -math.inf
    kept = tests.where(F.col("log_p") <= (bound if k else -1e300))
    own = F.greatest(F.col("expected"), OWN_SHARE * F.col("docs"))
    odds = F.log((F.col("docs") - own) / own)
    return kept.select("source", "unit", "length", "docs", "expected", "log_p", odds.alias("log_odds"))


# --- endings -------------------------------------------------------------------------------------------------------


def ending(text: str) -> tuple[str, int, bool]:
    """The content before trailing line ends and a closing fence; the number of line ends (2 at most); was there a fence."""
    body = text.rstrip("\r\n")
    breaks = min(2, text.count("\n", len(body)))
    fence = body.endswith("\n```")
    return (body[:-4].rstrip("\r\n") if fence else body), breaks, fence


def _count(text: str, of: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(of), F.lit("")))


@contextmanager
def _small_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that run within compile many expressions as several methods: the JVM only interprets methods beyond 8,000 bytes."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def marked(df: DataFrame) -> DataFrame:
    """``df`` (with context, kind, fence, open_fence) with ``marks``: the hashed features of the end of each context.

    They are the last characters and words, the shape of the last line (letters, digits and blanks as runs), brackets and
    quotes left open on it, how its columns compare with the line before, and pairs of these with the kind of cell.
    """
    c = F.col
    d = df.withColumn("_two", F.substring_index("context", "\n", -2)).withColumn("_plain", F.substring_index("_two", "\n", -1)).withColumn("_line", F.regexp_replace("_plain", "[1-9]", "0"))
    d = d.withColumns({"_above": F.left("_two", F.greatest(F.length("_two") - F.length("_plain") - 1, F.lit(0))), "_s": F.regexp_replace(F.right("context", F.lit(17)), "[1-9]", "0")})
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace("_line", r"\p{L}+", "a"), "00+", "0"), r"(\s)\s+", "$1")
    opened = F.greatest(F.lit(-2), F.least(F.lit(3), F.regexp_count("_line", F.lit(r"[(\[{<]")) - F.regexp_count("_line", F.lit(r"[)\]}>]"))))
    quotes = [(_count("_line", q) % 2).cast("string") for q in ("'", '"', "`", "*")]
    d = d.withColumns({
        "_shape": runs, "_open": opened.cast("string"), "_quotes": F.concat(*quotes), "_word": F.substring_index("_line", " ", -1),
        "_fields": F.regexp_count("_line", F.lit(r"\S+")), "_fields_above": F.regexp_count("_above", F.lit(r"\S+")),
    })
    signs = [F.signum(a - b).cast("int").cast("string") for a, b in ((c("_fields"), c("_fields_above")), (F.length("_line"), F.length("_above")))]
    d = d.withColumn("_columns", F.concat(*signs, (c("_fields_above") > 2).cast("string")))

    def last(column: str, n: int) -> Column:
        return F.right(c(column), F.lit(n))

    def first(column: str, n: int) -> Column:
        return F.left(c(column), F.lit(n))

    plain = [(f"{n}:", last("_s", n)) for n in (1, 2, 3, 4, 5, 6, 8, 10, 13, 17)]
    plain += [("w", c("_word")), ("v", F.substring_index("_line", " ", -2)), ("u", F.substring_index("_line", " ", -3)), ("s", last("_shape", 40)), ("t", last("_shape", 12)), ("r", last("_shape", 6)), ("q", first("_shape", 8))]
    tied = [
        ("b", c("_open"), c("_quotes")), ("f", c("_columns")), ("m", c("fence").cast("string"), c("open_fence").cast("string")), ("1", last("_s", 1)), ("2", last("_s", 3)), ("x", c("_word")),
        ("y", last("_shape", 8)), ("h", first("_shape", 3), c("_open"), first("_quotes", 1)), ("e", first("_shape", 1), last("_s", 1)), ("g", c("_columns"), c("_open")),
        ("n", F.least(c("_fields"), F.lit(9)).cast("string"), F.least(c("_fields_above"), F.lit(9)).cast("string")),
    ]
    names = [F.concat(F.lit(tag), *parts) for tag, *parts in [*plain, *tied]] + [F.concat("kind", F.lit(f"|{tag}"), *parts) for tag, *parts in tied]
    marks = F.array(*[F.crc32(n).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int") for n in names])
    return d.withColumn("marks", marks).drop(*[x for x in d.columns if x.startswith("_") and x not in df.columns])


_LESSON = "doc_id long, place int, label tinyint, breaks int, context string, kind string, fence boolean, open_fence boolean"


def _lessons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Own ends (label 0) and other places (label 1) of parsed notebooks, and their last line ends (label 2)."""
    for frame in frames:
        for at in range(0, len(frame), 100):  # small parts keep the memory of a task small
            part = frame.iloc[at : at + 100]
            taught = [(doc, i, *x) for doc, text, cells in zip(part["doc_id"], part["text"], part["cells"]) for i, x in enumerate(_lesson(int(doc), text, cells))]
            if taught:
                yield pd.DataFrame(taught, columns=[c.split()[0] for c in _LESSON.split(", ")])


def _lesson(doc: int, text: str, cells) -> Iterator[tuple[int, int, str, str, bool, bool]]:
    known = [(c["kind"] or "none", c["char_start"], c["char_start"] + c["cell_chars"]) for c in cells if c is not None and c["char_start"] is not None and c["cell_chars"] is not None]
    if len(text) < 2 or not known:
        return
    rng = np.random.default_rng(doc & 0x7FFFFFFF)
    blind = rng.random(len(known) + _PLACES) < 0.15  # the kind isn't always known

    def open_fence(upto: int) -> bool:
        return bool(text.count("```", 0, upto) & 1)

    ends = {len(text[:end].rstrip("\r\n")) for _, _, end in known}
    for i, (kind, _, end) in enumerate(known[:-1]):
        if end > len(text):
            continue
        stop = end + 4 if text[end : end + 4] == "\n```" else end
        body, _, fence = ending(text[max(0, stop - _CONTEXT) : stop])
        yield 0, 0, body, "none" if blind[i] else kind, fence, open_fence(stop)
    starts = np.array([c[1] for c in known])
    for j, at in enumerate(rng.integers(1, len(text), _PLACES).tolist()):
        body, breaks, fence = ending(text[max(0, at - _CONTEXT) : at])
        before = len(text[:at].rstrip("\r\n"))
        if before in ends or not body or (fence and before - 4 in ends):
            continue
        i = int(np.searchsorted(starts, at)) - 1
        yield 1, breaks, body, "none" if i < 0 or blind[len(known) + j] else known[i][0], fence, open_fence(at)
    yield 2, ending(text[-_CONTEXT:])[1], "", "none", False, False


def sampled(docs: DataFrame, most: int, there: int | None = None) -> DataFrame:
    """About ``most`` parsed notebooks, chosen by a 53-bit number made from their id, so at any size of the corpus.

    ``there``: the number of parsed notebooks, counted without reading texts where it isn't given.
    """
    parsed = docs.where("doc_id is not null and cells is not null and size(cells) > 1")
    share = min(1.0, most / max(1, parsed.count() if there is None else there))
    number = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("endings")), 11) / F.lit(float(1 << 53))
    return parsed.where(number < share).where("text is not null")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of the ending model and the log ratios for 0, 1 and 2 trailing line ends, from all lessons."""
    parts: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        parts[0].append(batch.column(0).to_numpy(zero_copy_only=False).astype("int8"))
        parts[1].append(batch.column(1).to_numpy(zero_copy_only=False).astype("int8"))
        parts[2].append(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("int32"))
    label, breaks, marks = (np.concatenate(p or [np.empty(0, d)]) for p, d in zip(parts, ("int8", "int8", "int32")))
    for p in parts:
        p.clear()
    marks = marks.reshape(len(label), -1 if len(label) else 0)
    width = marks.shape[1]
    weights, ratio = np.zeros((1 << _BITS) + 1, dtype="float32"), np.zeros(3)
    counts = np.bincount(label, minlength=3)
    if counts[0] and counts[1]:
        taught = np.flatnonzero(label < 2)
        rng, square = np.random.default_rng(1), np.full(len(weights), 1e-2, dtype="float32")
        for _ in range(5):
            order = rng.permutation(taught)
            for at in range(0, len(order), 512):
                rows = order[at : at + 512]
                idx = marks[rows]
                p = 1 / (1 + np.exp(-(weights[idx].sum(axis=1) + weights[-1])))
                g = (p - label[rows]) / 20
                flat, step = idx.ravel(), np.repeat(g, width)
                np.add.at(square, flat, step * step)
                np.add.at(weights, flat, -0.06 * step / np.sqrt(square[flat]))
                weights[-1] -= 0.05 * g.mean()
        weights[-1] -= math.log(counts[1] / counts[0])
        cut = np.bincount(breaks[label == 1], minlength=3) + 1.0
        own = np.bincount(breaks[label == 2], minlength=3) + 1.0
        ratio = np.log((cut / cut.sum()) / (own / own.sum()))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([ratio.tolist()], pa.list_(pa.float64()))], names=["weights", "breaks"])


def fit_endings(docs: DataFrame, most: int = SAMPLE_DOCS) -> tuple[np.ndarray, list[float]]:
    """The ending model, fitted in one task on the lessons of about ``most`` notebooks; only its weights come to the driver."""
    sample = sampled(docs.select("doc_id", "text", "cells"), most)
    # few files hold the sample, so its texts are spread; lessons are ordered so that the fit is the same each time
    spread = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    lessons = marked(spread.mapInPandas(_lessons, _LESSON)).select("doc_id", "place", "label", "breaks", "marks")
    ordered = lessons.repartition(1).sortWithinPartitions("doc_id", "place", "label", "breaks", "marks").select("label", "breaks", "marks")
    with _small_methods(docs.sparkSession):
        model = ordered.mapInArrow(_fit, "weights binary, breaks array<double>").first()
    if model is None:  # no notebook to learn from
        return np.zeros((1 << _BITS) + 1, dtype="float32"), [0.0, 0.0, 0.0]
    return np.frombuffer(model["weights"], dtype="float32"), model["breaks"]


def _weighed(weights: np.ndarray):
    """The sum of the weights of a row's marks, a batch at once."""

    @F.arrow_udf("double")
    def run(marks: pa.Array) -> pa.Array:
        at = marks.flatten().to_numpy(zero_copy_only=False)
        return pa.array(weights[at].reshape(len(marks), -1 if len(marks) else 0).sum(axis=1, dtype="float64") + float(weights[-1]))

    return run


def scored(df: DataFrame, model: tuple[np.ndarray, list[float]], tail: str = "tail", out: str = "score") -> DataFrame:
    """``df`` with the log likelihood ratio of ``tail``'s ending. ``df`` has also kind and open_fence.

    Features are made in the JVM; Python only adds up weights (a table of fixed size, 1 MB) of whole batches.
    """
    weights, breaks = model
    whole = F.rtrim(F.col(tail), F.lit("\ufffd"))
    d = df.withColumn("_text", whole).withColumn("_body", F.rtrim(F.col("_text"), F.lit("\r\n")))
    d = d.withColumn("_rest", F.substring(F.col("_text"), F.length("_body") + 1, F.length("_text"))).withColumn("fence", F.endswith("_body", F.lit("\n```")))
    body = F.when(F.col("fence"), F.rtrim(F.left("_body", F.greatest(F.length("_body") - 4, F.lit(0))), F.lit("\r\n"))).otherwise(F.col("_body"))
    d = d.withColumn("context", F.right(body, F.lit(_CONTEXT))).withColumn("_n", F.least(F.lit(2), _count("_rest", "\n")))
    ended = F.when(F.col("fence"), 0.0).when(F.col("_n") == 0, breaks[0]).when(F.col("_n") == 1, breaks[1]).otherwise(breaks[2])
    lost = F.when(F.length(tail) > F.length("_text"), 6.0).otherwise(0.0)
    return marked(d).withColumn(out, _weighed(weights)("marks") + ended + lost).drop("_text", "_body", "_rest", "_n", "fence", "context", "marks")


# --- both ----------------------------------------------------------------------------------------------------------


def _prior(bins: pd.DataFrame) -> pd.DataFrame:
    """The log odds of a source's texts to be cut at no particular length, from the histogram of their scores."""
    share, ratio, n = 0.01, np.exp(bins["score"].to_numpy()), bins["n"].to_numpy()
    for _ in range(30):
        share = min(1 - _LEAST_SHARE, max(_LEAST_SHARE, float((n * share * ratio / (share * ratio + 1 - share)).sum() / n.sum())))
    return pd.DataFrame({"source": bins["source"].iloc[:1], "prior": [math.log(share / (1 - share))]})


def _each_length(df: DataFrame) -> DataFrame:
    return df.select("source", F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
        F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")),
        F.struct(F.lit("block").alias("unit"), F.pmod("bytes", F.lit(BLOCK_BYTES)).alias("length")),
    )).alias("x")).select("source", "x.unit", "x.length")


def text_lengths(docs: DataFrame) -> DataFrame:
    """source, unit, length of every text that isn't blank, for :func:`length_tests`."""
    named = source_name(F.coalesce("source", F.lit(""))).alias("source")
    return _each_length(docs.where("text rlike '(?U)\\\\S'").select(named, F.length("text").alias("chars"), F.octet_length("text").alias("bytes")))


def truncated(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, rate: float = 0.001, near: int = 40) -> DataFrame:
    """Every text that isn't blank with source, limit_unit and limit_length (if it ends at a significant length),
    log_odds (prior and ending together), ``cut`` and ``way``: what a cut text was found by.

    ``way`` is ``limit`` for texts at a significant length, ``ending`` for others, whose source's share of such cuts stands
    in for the hazard, ``copy`` for texts that only an equal text decides, and null for texts that aren't cut.

    ``docs``: doc_id, text, source and cells (array of structs with kind, char_start, cell_chars; null where unknown).
    Texts are read once for their lengths, digests and ends, and once more for the bounded sample that teaches endings.
    Defined cases: null, empty and blank texts give no row. A null source is a source of its own (''); spellings of one
    name are one source. Texts equal to a text that is cut are cut. Repeated rows give a row each. Without parsed
    notebooks nothing can be learned: endings then tell nothing, and texts at significant lengths count as cut. A
    character cut in two at a byte limit may leave up to three bytes less, or a replacement character.
    """
    last = F.element_at("cells", -1) if "cells" in docs.columns else None
    fences = F.length("text") - F.length(F.replace("text", F.lit("```"), F.lit("")))
    base = docs.where("text rlike '(?U)\\\\S'").select(
        "doc_id", source_name(F.coalesce("source", F.lit(""))).alias("source"), F.md5(F.col("text").cast("binary")).alias("same"),
        F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.right("text", F.lit(_CONTEXT + 8)).alias("tail"),
        F.coalesce(F.when(F.col("cells").isNotNull() & (F.size("cells") > 0), last["kind"]), F.lit("none")).alias("kind"), (F.pmod(F.floor(fences / 3), F.lit(2)) == 1).alias("open_fence"),
    )
    lost, ends = F.length("tail") - F.length(F.rtrim(F.col("tail"), F.lit("\ufffd"))), F.right("tail", F.lit(24))
    base = materialise(base.withColumns({"lost": lost, "row": F.monotonically_increasing_id(), "wide": F.octet_length(ends) > F.length(ends)}), "ends")

    # hazards first: which lengths have more ends than their neighbours
    tests = materialise(length_tests(_each_length(base), near), "tests")
    limits = materialise(significant_lengths(tests, rate), "limits")

    # the lengths in bytes that a text may have been cut at: its own, or up to three more if a character was cut in two
    whole = F.col("bytes") - 3 * F.col("lost")
    byte_lengths = F.when(F.col("lost") > 0, F.sequence(whole, whole + 3)).when(F.col("wide"), F.sequence(F.col("bytes"), F.col("bytes") + 3)).otherwise(F.array("bytes"))
    pairs = F.concat(
        F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length"))),
        F.transform(byte_lengths, lambda b: F.struct(F.lit("bytes").alias("unit"), b.cast("int").alias("length"))),
        F.transform(byte_lengths, lambda b: F.struct(F.lit("block").alias("unit"), F.pmod(b, F.lit(BLOCK_BYTES)).cast("int").alias("length"))),
    )
    places = base.select("row", "source", F.explode(pairs).alias("x")).select("row", "source", "x.unit", "x.length")
    at_limit = join_few(places, limits.select("source", "unit", "length", "log_odds"), ["source", "unit", "length"]).groupBy("row").agg(F.max(F.struct("log_odds", "unit", "length")).alias("limit"))

    # then endings: of every text as it stands, and at limits without a mark that was set in place of the rest
    model = fit_endings(docs, sample_docs)
    ends = base.join(at_limit, "row", "left")
    with _small_methods(docs.sparkSession):
        rated = materialise(scored(ends, model).select("row", "doc_id", "source", "same", "limit", "score", "tail", "kind", "open_fence"), "scores")
    short = F.rtrim(F.col("tail"), F.lit(" \t\r\n"))
    mark = F.when(F.endswith(short, F.lit("...")), 3).when(F.endswith(short, F.lit("\u2026")), 1).otherwise(0)
    bare = rated.where("limit is not null").withColumn("_short", short).withColumn("_mark", mark).where("_mark > 0 and length(_short) > _mark")
    bare = scored(bare.select("row", "kind", "open_fence", F.left("_short", F.length("_short") - F.col("_mark")).alias("tail")), model, out="bare").select("row", "bare")

    # the share of texts cut at no particular length, per source: a few rounds of expectation on a histogram of scores
    bins = rated.where("limit is null").groupBy("source", F.round(F.greatest(F.least("score", F.lit(30.0)), F.lit(-30.0)), 1).alias("score")).agg(F.count("*").alias("n"))
    priors = materialise(bins.groupBy("source").applyInPandas(_prior, "source string, prior double"), "priors")  # 600 rows a source at most
    odds = F.when(F.col("limit").isNotNull(), F.col("limit.log_odds") + F.greatest("score", F.coalesce("bare", "score"))).otherwise(F.coalesce("prior", F.lit(-4.6)) + F.col("score"))
    own = join_few(rated.join(bare, "row", "left"), priors, ["source"], "left").select("doc_id", "source", "same", "limit", odds.alias("own_odds"))
    own = materialise(own, "odds")
    copies = own.groupBy("same").agg(F.count("*").alias("n"), F.max("own_odds").alias("best"), F.min("own_odds").alias("least")).where("n > 1 and best > least")
    out = join_few(own, materialise(copies.select("same", "best"), "copies"), ["same"], "left").withColumn("log_odds", F.coalesce("best", "own_odds"))
    cut = F.col("log_odds") > 0
    way = F.when(~cut, None).when(F.col("own_odds") <= 0, "copy").when(F.col("limit").isNotNull(), "limit").otherwise("ending")
    return out.select("doc_id", "source", F.col("limit.unit").alias("limit_unit"), F.col("limit.length").alias("limit_length"), "log_odds", cut.alias("cut"), way.alias("way"))


def truncation_report(rated: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many were found at significant lengths, by endings alone and as copies."""
    return rated.groupBy("source").agg(
        F.count("*").alias("texts"), F.count(F.when(F.col("cut"), 1)).alias("cut_texts"),
        *[F.count(F.when(F.col("way") == w, 1)).alias(n) for w, n in (("limit", "cut_at_limits"), ("ending", "cut_elsewhere"), ("copy", "cut_as_copies"))],
        F.avg(F.col("cut").cast("double")).alias("cut_share"),
    )
