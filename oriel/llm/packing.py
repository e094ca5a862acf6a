"""Mixture-controlled packing: deficit round-robin over source queues.

Each source's documents stand in a queue, shuffled by a hash of their doc_id. Each round gives
``capacity`` tokens of credit to the queues that are not empty, in proportion to their weights; what an
emptying queue cannot use goes to the others in that round. A queue is served whole tokens, and the
fraction that is left of its credit, its deficit, is carried to the next round. The rounds' tokens, in
the order of the sources' names, are one stream, which is cut into windows of ``capacity`` tokens; so
every window but the last is full, and off the target proportions by the deficits alone (under one token
for each source before it in the round).

Nothing of that is done in sequence: a queue's credit after any round follows from the virtual time of
that round (``prefix.Shares``), so each document finds by itself the rounds that its tokens are in, from
its place in its queue, and places in the stream are running totals. Deficits carry across windows and
partitions by construction. Any number of sources will do; one whose share is under a token a window
is served a token every so many rounds. The shares (24 bytes for each distinct ratio of total and weight)
go to all tasks.

Results: one row for each piece: ``window, position`` (in the window), ``source, doc_id, doc_start``
(token of the document) and ``n_tokens``. Documents are cut at borders of rounds and windows; no token is
dropped. Tokens are those of a public vocabulary. See ``prefix.queue`` for nulls and rows that repeat (the
tokens of rows that share a doc_id count as one document's, in no defined order of the rows); documents
without tokens have no piece. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import prefix
from oriel.llm.mixing import SEED
from oriel.llm.prefix import DEFAULT_WEIGHT, WEIGHTS
from oriel.llm.tokens import VOCABULARY
from oriel.ship import map_arrow

CAPACITY = 2048
ROUNDS_PER_BUCKET = 8
ROWS_AT_ONCE = 20_000
#: Virtual times are in double precision: what is this close below a whole token counts as whole.
CLOSE = 1e-6


def _repeat(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, each repeated ``n`` times, and the number of the repeat."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def rounds(begin: np.ndarray, end: np.ndarray, weight: np.ndarray, shares: prefix.Shares, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (row, round, from, to) of the stretches [begin, end) of queues."""
    last = int(np.ceil(shares.total / capacity)) - 1
    first = np.clip(np.floor(shares.served_at(begin / weight) / capacity) - 1, 0, last).astype(np.int64)
    until = np.clip(np.ceil(shares.served_at(end / weight) / capacity) + 1, 0, last).astype(np.int64)
    wide = until - first + 1 <= end - begin  # else fewer tokens than rounds
    row, i = _repeat(np.where(wide, until - first + 1, 0))
    at = first[row] + i
    low = np.where(at > 0, np.floor(weight[row] * shares.time_at(at * float(capacity)) + CLOSE), 0)
    high = np.floor(weight[row] * shares.time_at((at + 1) * float(capacity)) + CLOSE)
    a, b = np.maximum(low, begin[row]).astype(np.int64), np.where(at == last, end[row], np.minimum(high, end[row])).astype(np.int64)
    own, i = _repeat(np.where(wide, 0, end - begin))
    t = begin[own] + i
    one = np.clip(np.ceil((shares.served_at((t + 1) / weight[own]) - CLOSE) / capacity) - 1, 0, last).astype(np.int64)
    keep = b > a
    return np.concatenate([row[keep], own]), np.concatenate([at[keep], one]), np.concatenate([a[keep], t]), np.concatenate([b[keep], t + 1])


def _pieces(shares: prefix.Shares, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                n, until, weight = (part.column(i).to_numpy() for i in (2, 3, 4))
                row, turn, a, b = rounds(until - n, until, weight.astype(np.float64), shares, capacity)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(turn), pa.array(a - (until - n)[row]), pa.array(b - a)], ["doc_id", "source", "round", "doc_start", "n"])

    return run


def pack(docs: DataFrame, weights: dict[str, int] | None = None, default: int = DEFAULT_WEIGHT, capacity: int = CAPACITY, seed: int = SEED, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Pieces of documents in windows of the target proportions."""
    weight = prefix.weight_of(WEIGHTS if weights is None else weights, default)
    if capacity < 1:
        raise ValueError("capacity must be 1 at least")
    items, rows = prefix.queue(docs, seed, vocabulary)
    shares = prefix.shares(items, weight)
    queues = prefix.running_total(items, ["source"], prefix.place_buckets(rows), ["place", "doc_id"], "tokens", "until").where("tokens > 0")
    pieces = map_arrow(queues.select("doc_id", "source", "tokens", "until", weight.alias("weight")), _pieces(shares, capacity), "doc_id long, source string, round long, doc_start long, n long")
    # a round has as many pieces as tokens at most
    buckets = [F.floor(F.col("round") / (ROUNDS_PER_BUCKET * 4096**i)).cast("long") for i in (1, 0)]
    # a document's tokens of a round stand together, documents in the order of their queue
    order = ["round", "source", "place", "doc_id", "doc_start"]
    placed = prefix.running_total(pieces.withColumn("place", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))), [], buckets, order, "n", "until")
    cut = placed.withColumn("begin", F.col("until") - F.col("n")).withColumn("window", F.explode(F.expr(f"sequence(begin div {capacity}, (until - 1) div {capacity})")))
    cut = cut.withColumns({"a": F.greatest(F.col("begin"), F.col("window") * capacity), "b": F.least(F.col("until"), (F.col("window") + 1) * capacity)})
    return cut.select("window", (F.col("a") - F.col("window") * capacity).alias("position"), "source", "doc_id", (F.col("doc_start") + F.col("a") - F.col("begin")).alias("doc_start"), (F.col("b") - F.col("a")).alias("n_tokens"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
