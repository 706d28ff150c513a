import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomweb.llm import bpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


CASES = ["", " ", "  ", "a", "don't 'tis it's'll 'x 're're'r 've'v'll'l'l", "a  b\n\n c \t", "' 's '\n's", "x''s '''re", "1 22 ٣ ½ a1b2", "  　x  ", "'S 'T", "é́ñ 漢字 🙂🙂 ‍", "a\x1cb\x85c", "<|endoftext|>", "'rst 'lls 'vex"]


def test_cases_as_the_library(library):
    enc = bpe.encoder()
    for text, (packed, starts) in zip(CASES, enc.encode(CASES)):
        assert ids(packed) == library.encode_ordinary(text), text
        assert enc.decode(packed) == text.encode()
        assert list(starts[:1]) == ([0] if text else [])


def test_every_code_point(library):
    every = "".join(f"{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or c > 0x10FFF0))
    step = 300_000
    texts = [every[i : i + step] for i in range(0, len(every), step)]
    for text, (packed, _) in zip(texts, bpe.encoder().encode(texts)):
        assert ids(packed) == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("'strevmld a1.\n\t éZ漢"), max_size=60), max_size=6))
def test_random_texts(texts):
    enc = bpe.encoder()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    for text, (packed, _) in zip(texts, enc.encode(texts)):
        assert ids(packed) == own.encode_ordinary(text)


def test_long_slices(library):
    for text in ("ab" * 20_000, "the" * 5_000 + "é" * 3_000, " " * 30_000):
        assert ids(bpe.encoder().encode([text])[0][0]) == library.encode_ordinary(text)


def test_query_on_odd_rows(spark, tmp_path, library):
    long = "some words, and 12 numbers\n" * 20_000
    rows = [(1, "it's", "x"), (2, None, "x"), (3, "", None), (4, long, "y"), (1, "it's", "x"), (None, "null id", "z")]
    spark.createDataFrame(rows, "doc_id bigint, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in bpe.op8_byte_bpe(spark, str(tmp_path)).na.fill(-1, ["doc_id"]).collect())
    want = []
    for doc_id, text, _ in rows:
        x = library.encode_ordinary(text or "")
        want.append((-1 if doc_id is None else doc_id, len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_general_operators(spark):
    docs = spark.createDataFrame([(1, "it's so"), (2, None)], "doc_id bigint, text string")
    encoded = bpe.encode_documents(docs)
    assert [r.slice_starts for r in encoded.orderBy("doc_id").collect()] == [[0, 2, 4], []]
    assert [bytes(r.decoded) for r in bpe.decode_documents(encoded).orderBy("doc_id").collect()] == [b"it's so", b""]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op8_byte_bpe(spark, str(tmp_path)).count() == 0
