"""Chat formatting by token-level assembly.

Every turn's role and content are encoded separately, so no token can span a border, and reserved ids
are spliced in between: BEGIN, then for each turn START role HEADER content END. The loss mask comes
from a prefix sum over +1 / -1 marks at the borders of what the assistant says, its END included.
Reserved ids lie outside the vocabulary, so no content can produce them; strings in content that look
like control strings (``<|``) are escaped with a backslash as well, for consumers that turn tokens
back to text; ``unescape`` restores them exactly.

Results: one row for each conversation: ``conv_id, n_turns, tokens, loss_mask``. Turns are ordered by
turn, then role and text; rows that repeat exactly count once; a null turn goes first, a null role is
'user', a null text is empty. Rows without conv_id are left out. An empty table gives an empty result;
further columns are ignored. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import kernel as k
from oriel.llm.tokens import VOCABULARY, encode, share
from oriel.ship import map_arrow

BEGIN, START, HEADER, END = 50256, 50257, 50258, 50259
ASSISTANT = "assistant"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def assemble(turns: list[tuple[str, list[int]]], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and loss mask of one conversation of (role, content tokens)."""
    parts: list[list[int]] = [[BEGIN]]
    place, marks = 1, []
    for role, content in turns:
        head = [START, *encode(role, path), HEADER]
        parts += [head, content, [END]]
        if role == ASSISTANT:
            marks.append((place + len(head), place + len(head) + len(content) + 1))
        place += len(head) + len(content) + 1
    step = np.zeros(place + 1, np.int32)
    for a, b in marks:
        step[a] += 1
        step[b] -= 1
    return np.fromiter((t for p in parts for t in p), np.int32, place), np.cumsum(step)[:-1].astype(np.int32)


def format_chats(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Token ids and loss masks of all conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens, masks, counts = [], [], []
                for turns in part.column(1).to_pylist():
                    own = [((t["role"] if t["role"] is not None else "user"), encode(escape(t["text"] or ""), path)) for t in turns]
                    ids, mask = assemble(own, path)
                    tokens.append(ids)
                    masks.append(mask)
                    counts.append(len(own))
                bound = np.cumsum([0, *map(len, tokens)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), k.lists(np.concatenate(tokens), bound, pa.int32()), k.lists(np.concatenate(masks), bound, pa.int32())], ["conv_id", "n_turns", "tokens", "loss_mask"])

    share(conversations.sparkSession, path)
    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t")).where("conv_id is not null")
    whole = slim.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    return map_arrow(whole, run, "conv_id long, n_turns long, tokens array<int>, loss_mask array<int>")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
