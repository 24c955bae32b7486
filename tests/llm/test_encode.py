import os
import random

import pytest

from corpusmill.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.RANKS), reason="no rank file")


@pytest.fixture(scope="module")
def c():
    return encode.codec()


def test_merge_is_the_library_s(c):
    rnd = random.Random(1)
    for alphabet in ("a", "ab", "abcé中", "01", "etaoin"):
        for n in (1, 2, 3, 50, 700):
            w = "".join(rnd.choice(alphabet) for _ in range(n))
            assert c.decode_bytes(c.merge(w.encode())) == w.encode()
            if w.isalpha():
                assert c.merge(w.encode()) == c.lib.encode_ordinary(w)


def test_long_texts_are_cut_safely(c):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["word", " ", "  ", "\n", "\r\n", "don't", " 12", "é", "中文", "...", "\t", "<|endoftext|>"]) for _ in range(40_000))
    assert len(text) > 3 * encode.CHUNK_CHARS
    assert c.encode(text) == c.lib.encode_ordinary(text)
    assert c.decode_bytes(c.encode(text)).decode() == text


def test_a_run_without_a_boundary(c):
    text = "x" * 100_000 + "!"
    got = c.encode(text)
    assert c.decode_bytes(got).decode() == text and got[-1] == c.lib.encode_ordinary("!")[0]
    assert c.encode("y" * 40_000) == c.lib.encode_ordinary("y" * 40_000)


def test_column(spark):
    d = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "<|endoftext|>"), (4, "<|endoftext|>")], "doc_id long, text string")
    got = [(r.doc_id, r.ids) for r in encode.encode_column(d, ["doc_id"]).collect()]
    c = encode.codec()
    assert got[1:3] == [(2, []), (3, [])] and got[3] == got[4] and encode.END_ID not in got[3][1]
    assert got[0] == (1, c.lib.encode_ordinary("a b"))
    assert encode.encode_column(d.limit(0), ["doc_id"]).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert [r.n_tokens for r in encode.count_tokens(d, ["doc_id"]).collect()] == [len(i) for _, i in got]


def test_clashing_columns_and_decoding(spark):
    d = spark.createDataFrame([(1, "héllo", [1]), (2, None, None)], "doc_id long, text string, ids array<int>")
    e = encode.encode_column(d, ["doc_id"])
    assert e.columns == ["doc_id", "ids"]
    back = encode.decode_column(e, ["doc_id"]).collect()
    assert [(bytes(r.raw).decode(), r.valid) for r in back] == [("héllo", True), ("", True)]
    cutoff = spark.createDataFrame([(encode.codec().encode("é")[:1] if len(encode.codec().encode("é")) > 1 else [127],), (None,), ([None, 70000],)], "ids array<int>").selectExpr("1 doc_id", "ids")
    assert [r.valid for r in encode.decode_column(cutoff, ["doc_id"]).collect()][1:] == [None, True]


def test_source_names(spark):
    d = spark.createDataFrame([(" A ",), ("",), (None,), ("\t",), ("a",)], "s string")
    from pyspark.sql import functions as F

    assert [r[0] for r in d.select(encode.source_name(F.col("s"))).collect()] == ["a", None, None, None, "a"]
