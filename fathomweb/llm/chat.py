"""Chat formatting at the level of tokens.

A conversation's turns become one sequence of ids. Every segment of text is encoded by itself, by
the byte-level BPE of ``bpe``; the marks between segments are reserved ids above its vocabulary, so
no text can produce one. Control strings that occur in a text are escaped as well, reversibly, so
that the formatted text is unambiguous too. The loss mask is 1 on assistant texts: +1 where one
begins and -1 where it ends, added up.

    <s> [ROLE] user [TEXT] ... </s>            by ids: BEGIN, role, TEXT, text..., END for each turn
    [SYS], [USER], [ASSISTANT]                 marks for the usual roles; any other role is spelled out behind [ROLE]

Defined results: turns stand in the order of (turn, role, text), null turns first; null roles and
texts are empty; equal rows are turns of their own; rows whose conv_id is null form one
conversation; an empty table gives none; other columns are ignored. A conversation is one row of
the result, so it must fit a task; conversations are dealt by id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

#: The control strings, and the ids reserved for them behind the vocabulary's 50,256.
MARKS = ("<s>", "</s>", "[ROLE]", "[TEXT]", "[SYS]", "[USER]", "[ASSISTANT]")
FIRST = 50_256
BEGIN, END, ROLE, TEXT, SYS, USER, ASSISTANT = range(FIRST, FIRST + len(MARKS))
ROLES = {"system": SYS, "user": USER, "assistant": ASSISTANT}
#: Control strings of this template and of others in use, none of which may stand in a formatted text's content.
CONTROLS = (*MARKS, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    """Backslashes are doubled, and one is put behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(turns: list[tuple[str, str]], encoded: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a conversation; ``encoded`` has the packed ids of each escaped segment."""
    parts, steps, at = [], [], 0
    for role, text in turns:
        own = encoded[escaped(text)]
        head = [BEGIN, ROLES[role], TEXT] if role in ROLES else [BEGIN, ROLE, *np.frombuffer(encoded[escaped(role)], dtype="<u4").tolist(), TEXT]
        parts += [np.array(head, dtype="<u4").tobytes(), own, np.array([END], dtype="<u4").tobytes()]
        at += len(head)
        size = len(own) // 4
        if role == "assistant":
            steps.append((at, at + size))
        at += size + 1
    change = np.zeros(at + 1, dtype=np.int64)
    for a, b in steps:
        change[a] += 1
        change[b] -= 1
    return np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(change[:-1]).astype(np.int8)


def read_back(ids: np.ndarray, mask: np.ndarray, enc: bpe.Encoder) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns and the texts under the mask, from ids and mask alone."""
    names = {v: k for k, v in ROLES.items()}
    turns, masked, role, at = [], [], "", 0
    special = np.flatnonzero(ids >= FIRST).tolist()
    text_of = lambda a, b: unescaped(enc.decode(ids[a:b].astype("<u4").tobytes()).decode())
    for here, there in zip(special, [*special[1:], len(ids)]):
        mark = int(ids[here])
        if mark in names:
            role = names[mark]
        elif mark == ROLE:
            role = text_of(here + 1, there)
        elif mark == TEXT:
            turns.append((role, text_of(here + 1, there)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    for at, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        masked.append(text_of(at, end))
    return turns, masked


def formatted_text(ids: np.ndarray, enc: bpe.Encoder) -> str:
    """The sequence as text, marks spelled out."""
    special = np.flatnonzero(ids >= FIRST).tolist()
    out, at = [], 0
    for here in [*special, len(ids)]:
        out.append(enc.decode(ids[at:here].astype("<u4").tobytes()).decode())
        if here < len(ids):
            out.append(MARKS[int(ids[here]) - FIRST])
        at = here + 1
    return "".join(out)


def _conversations(rows: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _each(rows: DataFrame, schema: str, names: list[str], work) -> DataFrame:
    """Formats every conversation and hands (turns, ids, mask, encoder) to ``work``."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                turns_of = [[(t["role"], t["text"]) for t in turns] for turns in part.column(1).to_pylist()]
                segments = sorted({escaped(x) for turns in turns_of for role, text in turns for x in ((text,) if role in ROLES else (role, text))})
                encoded = dict(zip(segments, (packed for packed, _ in enc.encode(segments))))
                done = [work(*assemble(turns, encoded), enc) for turns in turns_of]
                if done:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in zip(*done))], names=["conv_id", *names])

    return _conversations(rows).mapInArrow(run, f"conv_id {kind}, {schema}")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, ids array<bigint>, loss_mask array<int>, formatted string) of each conversation of (conv_id, turn, role, text)."""

    def work(ids: np.ndarray, mask: np.ndarray, enc: bpe.Encoder) -> tuple:
        return ids.astype(np.int64), mask.astype(np.int32), formatted_text(ids, enc)

    return _each(rows, "ids array<bigint>, loss_mask array<int>, formatted string", ["ids", "loss_mask", "formatted"], work)


def digests(rows: DataFrame) -> DataFrame:
    """Formats each conversation and digests what is read back from its ids and mask."""

    def work(ids: np.ndarray, mask: np.ndarray, enc: bpe.Encoder) -> tuple:
        turns, masked = read_back(ids, mask, enc)
        whole, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(masked)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(turns), sha(whole), len(loss), sha(loss), len(formatted_text(ids, enc)), len(ids)

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"]
    return _each(rows, "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_ids bigint", names, work)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, and one whose texts are control strings."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return digests(rows.union(more.select(*(F.col(n).cast(t) for n, t in rows.dtypes))))


QUERIES = {"op2_chat_formatting": op2_chat_formatting}
ORACLE_SQL: dict[str, str] = {}
