"""Token ids of a whole corpus through a distinct-word table.

Texts are split into words by the tokenizer's own pattern in the JVM. Consecutive documents form blocks of bounded size;
a block keeps its distinct words once and its documents as codes into them. The blocks' words meet by a shuffle on the
word, where each distinct word of the corpus is encoded exactly once, and the ids go back to the blocks, where codes are
replaced by ids position by position. What is shuffled is one row per block and distinct word, not one per occurrence,
so a word that makes up a third of all text is one row a block.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Where the public vocabulary files are looked for unless a caller names another place.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before the merges of byte_bpe_50k. The flag makes \s Unicode-wide.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK_WORDS = 1_000_000
_BLOCK = "block long, keys array<long>, counts array<int>, codes binary, width int, words array<string>"

_encoders: dict[int, object] = {}


def read_ranks(directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    """The rank file of a byte-level tokenizer: a fixed vocabulary of under 1 MB, read on the driver and sent with tasks."""
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tokenizer of a rank file, built once per Python worker."""
    known = hash(ranks)
    if known not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[known] = tiktoken.Encoding("public", pat_str=WORD_PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[known]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``_BLOCK_WORDS`` words, or one document."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype("int64")
        at = 0
        while at < len(lengths):
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(lengths[at:]), _BLOCK_WORDS, side="right")))
            coded = lists.slice(at, upto - at).flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            width = 2 if len(coded.dictionary) <= 0xFFFF else 4
            packed = pa.compress(codes.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) | number], pa.int64()), pa.array([keys.slice(at, upto - at).to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths[at:upto]], pa.list_(pa.int32())), pa.array([packed], pa.binary()), pa.array([width], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
                ],
                names=["block", "keys", "counts", "codes", "width", "words"],
            )
            number += 1
            at = upto


def _encode(ranks: bytes, counts_only: bool):
    """Ids (or their number) of each word. All rows of a word come one after the other, so it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, its_ids = encoder(ranks).encode_ordinary, None, None
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            pieces = [its_ids if word == last else np.array(encode(word), dtype="int32") for word in words]
            if words:
                last, its_ids = words[-1], pieces[-1]
            at = coded.indices.to_numpy(zero_copy_only=False)
            length = np.array([len(p) for p in pieces], dtype="int64")
            if counts_only:
                out = pa.array(length[at] if len(at) else [], pa.int32())
            else:
                out = _gather(pieces, length, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["block", "code", "ids"])

    return run


def _gather(pieces: list, length: np.ndarray, at: np.ndarray) -> pa.ListArray:
    flat = np.concatenate(pieces) if pieces else np.empty(0, "int32")
    start = np.append(0, np.cumsum(length))[:-1]
    n = length[at]
    offsets = np.append(0, np.cumsum(n))
    values = flat[np.repeat(start[at] - offsets[:-1], n) + np.arange(offsets[-1])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _assemble(counts_only: bool):
    """Replace a block's codes by the ids of its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids = [], []
        order = np.argsort(right.column("code").to_numpy())
        found = right.column("ids").combine_chunks()
        if counts_only:
            length = found.to_numpy(zero_copy_only=False)[order]
        else:
            where = found.offsets.to_numpy()[:-1][order]
            length = np.diff(found.offsets.to_numpy())[order]
            flat = found.values.to_numpy()
        for row in range(left.num_rows):
            raw = left.column("codes")[row].as_py()
            width, docs = left.column("width")[row].as_py(), left.column("counts")[row].values.to_numpy().astype("int64")
            codes = np.frombuffer(pa.decompress(raw, decompressed_size=int(docs.sum()) * width, codec="zstd", asbytes=True), dtype=f"<u{width}").astype("int64")
            n = length[codes].astype("int64") if len(codes) else np.empty(0, "int64")
            ends = np.append(0, np.cumsum(n))
            bounds = ends[np.append(0, np.cumsum(docs))]
            keys.append(left.column("keys")[row].values)
            if counts_only:
                ids.append(pa.array(np.diff(bounds), pa.int64()))
            else:
                values = flat[np.repeat(where[codes] - ends[:-1], n) + np.arange(ends[-1])] if len(codes) else np.empty(0, "int32")
                ids.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32())))
        return pa.table({"key": pa.chunked_array(keys, pa.int64()), "ids": pa.chunked_array(ids)})

    return run


def encode_texts(df: DataFrame, key: str, text: str, *, ranks: bytes | None = None, counts_only: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>), or ``n_tokens``, of every row's text by a public byte-level tokenizer.

    Defined cases: null and empty texts give the empty list (0 tokens); strings of special tokens are ordinary text. Rows
    are kept as they are: repeated or null keys give a row each. Blanks and unusual characters are kept, so the ids decode
    to exactly the text. Other columns are ignored; an empty table gives an empty result.
    """
    ranks = read_ranks() if ranks is None else ranks
    words = F.regexp_extract_all(F.col(text), F.lit(f"(?U){WORD_PATTERN}"), F.lit(0))
    split = df.select(F.col(key).cast("long").alias("_key"), words.alias("_words"))
    blocks = materialise(split.mapInArrow(_blocks, _BLOCK), "blocks")
    vocabulary = blocks.select("block", F.posexplode("words").alias("code", "word")).repartition("word").sortWithinPartitions("word")
    kind = "int" if counts_only else "array<int>"
    encoded = vocabulary.mapInArrow(_encode(ranks, counts_only), f"block long, code int, ids {kind}")
    out = "long" if counts_only else "array<int>"
    joined = blocks.drop("words").groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(counts_only), f"key long, ids {out}")
    return joined.select(F.col("key").alias(key), F.col("ids").alias("n_tokens" if counts_only else "ids"))


def vocabulary_pieces(df: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """The tokenizer's vocabulary as rows: id and the piece's bytes in hexadecimal (at most some 50,000 rows)."""
    ranks = read_ranks() if ranks is None else ranks
    rows = [(int(b), base64.b64decode(a).hex()) for a, b in map(bytes.split, ranks.splitlines())]
    return df.sparkSession.createDataFrame(rows, "id int, piece string")


def decode_ids(df: DataFrame, key: str, ids: str, *, ranks: bytes | None = None) -> DataFrame:
    """``key`` and ``text`` of each row's token ids, through a join of the ids with the vocabulary.

    Rows are kept as they are: repeated or null keys give a row each. The empty (or null) list gives the empty text.
    """
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    parts = rows.select("_row", "_key", F.posexplode_outer("_ids").alias("at", "id"))
    pieces = parts.join(F.broadcast(vocabulary_pieces(df, ranks)), "id", "left")  # a fixed vocabulary
    ordered = pieces.groupBy("_row", "_key").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "piece")))).alias("p"))
    return ordered.select(F.col("_key").alias(key), F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8").alias("text"))
