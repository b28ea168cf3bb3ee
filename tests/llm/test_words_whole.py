"""Decoding keeps rows apart."""

from heaplake.llm import words


def test_repeated_and_null_keys_are_decoded_one_by_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, ""), (None, "c"), (None, None)], "doc_id long, text string")
    back = words.decode_ids(words.encode_texts(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(["(1, 'a b')", "(1, 'a b')", "(1, '')", "(None, 'c')", "(None, '')"])
