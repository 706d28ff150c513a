import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomweb.llm import bpe, chat, common

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "s>", "[", "TEXT]", "a", "\n", "é"]), max_size=12).map("".join))
def test_escaping_is_reversible_and_total(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert not any(c in chat.escaped(text) for c in chat.CONTROLS)


def wanted(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in convs.items()}


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi <s> \\ [/INST]"), (1, 1, "assistant", "an\\swer </s>"), (1, 2, "assistant", ""), (1, 3, "assistant", "next"), (2, 0, None, None), (2, None, "tool [ROLE]", "x"), (3, 0, "assistant", "long " * 20_000),
        (None, 5, "system", "no id"), (1, 0, "user", "hi <s> \\ [/INST]"), (4, 1, "user", "b"), (4, 1, "assistant", "a"), (5, 0, "assistant", None),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()}
    assert got == wanted(rows)
    assert chat.digests(df.where("false")).count() == 0


def test_output_of_the_operator(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>"), (1, 1, "assistant", "ok")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<s>[USER][TEXT]<\\/s></s><s>[ASSISTANT][TEXT]ok</s>"
    enc = bpe.encoder()
    under = [i for i, m in zip(row.ids, row.loss_mask) if m]
    assert b"".join(enc.bytes_of[i] for i in under) == b"ok" and len(row.ids) == len(row.loss_mask)
    assert [i for i in row.ids if i >= chat.FIRST] == [chat.BEGIN, chat.USER, chat.TEXT, chat.END, chat.BEGIN, chat.ASSISTANT, chat.TEXT, chat.END]


def test_query(spark):
    where = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.table(spark, where, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op2_chat_formatting(spark, where).collect()}
    assert got == wanted(rows)
