import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fathomweb.llm import packing


def slow_pack(lengths, capacity):
    """The rule, literally: try every open bin, take the least sum of squares."""
    bins = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, best = lengths[item], None
        gaps = [capacity - sum(lengths[i] for i in b) for b in bins]
        for k, g in enumerate(gaps):
            if g >= size:
                after = gaps[:k] + [g - size] + gaps[k + 1 :]
                squares = sum(after.count(x) ** 2 for x in set(after) - {0})
                if best is None or (squares, g) < best[:2]:
                    best = (squares, g, k)
        if best is None:
            bins.append([item])
        else:
            bins[best[2]].append(item)
    return sorted(sum(lengths[i] for i in b) for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_pack_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 31, 40)
    where, offset = packing.pack(lengths, 30)
    found = defaultdict(list)
    for n, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        found[b].append((o, n))
    for items in found.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 30
    assert sorted(sum(n for _, n in x) for x in found.values()) == slow_pack(lengths.tolist(), 30)


def test_few_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 5000).astype(int) + 1)
    where, _ = packing.pack(lengths, 4096)
    assert len(set(where.tolist())) <= 1.002 * lengths.sum() / 4096 + 1


def test_words_give_the_texts_ids():
    library = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["", "It's  A\ttest, don't!\n\nÉcole ESCUELA 123", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0w   q", "é e ́ ﬁ ŉ İ Σ ΑΣ", "  lead 漢字 🙂", "''s 's ' s"]
    for text, got in zip(texts, packing.WordIds(packing.TOKENIZER).ids(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_query_on_odd_rows(spark, tmp_path):
    library = Tokenizer.from_file(packing.TOKENIZER)
    rows = [(1, "short text", 0), (2, None, 0), (3, "", 0), (4, "many words here " * 4000, 0), (1, "short text", 1), (None, "no id", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op5_best_fit_packing(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(doc_id or 0, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)


def test_many_groups_and_empty_table(spark, tmp_path):
    rows = [(i, "w " * (i % 700)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack_documents(docs, group=100).collect()
    assert len(got) == 300 and len({(r.sequence_id, r.offset) for r in got}) == 300
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op5_best_fit_packing(spark, str(tmp_path)).count() == 0
