import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fathomweb.llm import common, packing  # noqa: E402

from . import test_neardup, test_secrets, test_substrings  # noqa: E402


def test_each_stage_as_brute_force(spark, tmp_path):
    where = "/root/testdata/sf0.001"
    docs = common.table(spark, where, "documents")
    names, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in out.collect()} if name != "packing" else out.collect()
        if name != "packing":
            assert out.columns == names and len(after) == out.count()
        if name == "quality":
            labels = {r.doc_id: r.quality for r in common.table(spark, where, "labels").collect()}
            assert all(after[d] == rows[d] for d in after)
            assert np.mean([(d in after) == (q == 1) for d, q in labels.items() if d in rows]) > 0.95
        elif name == "near_dedup":
            want = {d for d, _, _, kept in test_neardup.brute_force([(d, r.text) for d, r in rows.items()], 5) if kept}
            assert set(after) == want and all(after[d] == rows[d] for d in after)
        elif name == "substring_dedup":
            for d, _, removed, digest in test_substrings.brute_force([(d, r.text) for d, r in rows.items()]):
                text = after[d].text
                assert hashlib.sha256(text.encode()).hexdigest() == digest and after[d].n_chars == len(text) if removed else after[d] == rows[d]
        elif name == "secrets":
            for d, r in after.items():
                assert not test_secrets.base_of(r.text)
                assert bool(test_secrets.base_of(rows[d].text)) <= (r.text != rows[d].text)
        else:
            library = Tokenizer.from_file(packing.TOKENIZER)
            want = []
            for d, r in rows.items():
                ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
                want += [(d, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
            assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == sorted(want)
        docs, before = out, after
    whole = corpus_pipeline.run(spark, where)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, before))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_through_all_stages(spark, tmp_path, empty):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, and columns whose names the operators use themselves."""
    where = "/root/testdata/sf0.001"
    good = common.table(spark, where, "documents").join(common.table(spark, where, "labels").where("quality = 1"), "doc_id").limit(3).collect()
    names = ["a", "b", "ranges", "spans", "row_hash", "own", "kept", "component_id", "a.b"]
    texts = [r.text for r in good] + [good[0].text, None, "", " \n", " ".join(f"w{i}" for i in range(60_000)), "token = abcdefgh12345678 " + good[1].text]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", len(t) if t else None, *([f"{i}"] * len(names))) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, *rows[1][1:]), (None, None, None, None, None, *([None] * len(names)))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([] if empty else rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        n = docs.count()
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert [f[:2] for f in out.dtypes] == [f[:2] for f in docs.dtypes]
            assert all(len(set(r[5:])) == 1 for r in out.collect())
            if name in ("substring_dedup", "secrets"):
                assert out.count() == n
        else:
            assert (out.count() == 0) == empty
        docs = out
