import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from siftline.llm.pieces import Pieces, decode, encode, packed, pieces, suffix_array, words_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(11)
    parts = ["the ", "tion", "er", "ing", " ", "  ", "    ", "\n", "\t", "é", "É", "ß", "😀", "中文", "▁", "\x00", "\x01", "́", "1", "2024", "<s>", "</s>", "<0x41>", "aaaa", "ab", "ion", "th", "e", "...", "!!", "==", "--", "zzz", "qu", "Ein", "heit", "lich", "ción"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(1500)]
    letters = "abcdefghijklmnopqrstuvwxyzéñü"
    out += ["".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(3000)]
    return out + ["a" * n for n in range(1, 40)] + [" " * n for n in range(1, 40)] + ["=" * n + " " for n in range(1, 70)]


def test_words_match_the_library(model):
    own, all_texts = pieces(PATH), texts()
    ids = own.encode_words([w for t in all_texts for w in words_of(t)])
    at = 0
    for t in all_texts:
        n = len(words_of(t))
        assert np.frombuffer(b"".join(ids[at : at + n]), "<u4").tolist() == model.encode(t, num_threads=1), repr(t)
        at += n


def test_suffix_array():
    codes = np.array([3, 1, 3, 1, 2, 0, 3], "i4")
    key, _, _, width = packed(codes, 2)
    assert width == 2 and suffix_array(key, width, 8).tolist() == sorted(range(7), key=lambda i: codes[i:].tolist())


def test_tables(spark, model):
    rows = [(i, t, "x") for i, t in enumerate([None, "", *texts()[:300], "word " * 40_000, "x" * 30_000])] + [(3, "again", "x"), (3, "again", "x"), (None, "k", "x")]
    coded = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH)
    assert coded.columns == ["doc_id", "text", "ids"]
    both = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, back="back")
    assert both.columns == ["doc_id", "text", "ids", "back"]
    got = decode(coded, PATH, name="back").collect()
    assert sorted(map(str, got)) == sorted(map(str, both.collect()))
    assert len(got) == len(rows)
    for r in got:
        want = model.encode(r.text or "", num_threads=1)
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.back == (r.text or "").replace("▁", " ")


def test_bytes_that_are_no_text(spark):
    own = Pieces(PATH)
    row = np.array([own.bytes[0xFF], own.bytes[0xC3], own.bytes[0xA9]], "<u4").tobytes()
    got = decode(spark.createDataFrame([(bytearray(row),), (None,)], "ids binary"), PATH).collect()
    assert [r.text for r in got] == ["�é", ""]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(empty, PATH), PATH).count() == 0
