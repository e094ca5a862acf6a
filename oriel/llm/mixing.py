"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their doc_id. Each has a virtual finish time: the tokens of its
source up to and including it, divided by the source's target weight. The documents are then sorted by
that time across all sources and cut off at the total budget, so at any cut the sources' tokens stand
in the proportions of their weights for as long as they last. Tokens are those of a public vocabulary.

Ranges of virtual time are chosen by the tokens that the queues have served by then (``prefix.Shares``),
so they hold about as many tokens each, whatever the weights and totals of the sources.

Results: ``doc_id, source, tokens, virtual_finish, running_tokens`` in the order of the mix; the last
row's running total is at most the budget. See ``prefix.queue`` for nulls and rows that repeat; rows
without doc_id are in no mix. Ties in time go by hash, then doc_id; a document without tokens has the time
of the one before it. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import prefix
from oriel.llm.prefix import DEFAULT_WEIGHT, WEIGHTS
from oriel.llm.tokens import VOCABULARY
from oriel.ship import map_arrow

FRACTION = 0.5
SEED = 7


def _ranges(shares: prefix.Shares, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shares.served_at(batch.column(4).to_numpy()) / max(1.0, shares.total) * ranges
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype("int64"))], [*batch.schema.names, "range"])

    return run


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default: int = DEFAULT_WEIGHT, budget: int | None = None, fraction: float = FRACTION, seed: int = SEED, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """The documents of the mix in order; ``budget`` in tokens, or ``fraction`` of all tokens."""
    weight = prefix.weight_of(WEIGHTS if weights is None else weights, default)
    items, rows = prefix.queue(docs, seed, vocabulary)
    timed = prefix.running_total(items, ["source"], prefix.place_buckets(rows), ["place", "doc_id"], "tokens", "own_tokens")
    timed = timed.select("doc_id", "source", "tokens", "place", (F.col("own_tokens").cast("double") / weight.cast("double")).alias("virtual_finish"))
    shares = prefix.shares(items, weight)
    if budget is None:
        budget = int(int(shares.total) * fraction)
    ranged = map_arrow(timed, _ranges(shares, max(1, rows // prefix.ROWS_PER_BUCKET)), "doc_id long, source string, tokens long, place string, virtual_finish double, range long")
    buckets = [F.floor(F.col("range") / prefix.ROWS_PER_BUCKET).cast("long"), F.col("range")]
    mixed = prefix.running_total(ranged, [], buckets, ["virtual_finish", "place", "doc_id"], "tokens", "running_tokens")
    kept = mixed.where(F.col("running_tokens") <= budget)
    return kept.orderBy("virtual_finish", "place", "doc_id").select("doc_id", "source", "tokens", "virtual_finish", "running_tokens")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The mix with words as tokens: SQL has no tokenizer. Tests hold ``mix`` with ``vocabulary=None`` against it.
WORDS_SQL = rf"""
WITH d AS (
  SELECT doc_id, min(coalesce(source, '')) AS source, CAST(sum(coalesce(len(regexp_extract_all(text, '{prefix.WORD}')), 0)) AS BIGINT) AS tokens
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
q AS (SELECT *, md5(CAST(doc_id AS VARCHAR) || ':{SEED}') AS place FROM d),
t AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
      / CASE source {' '.join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT} END AS virtual_finish FROM q),
r AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY virtual_finish, place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM t)
SELECT doc_id, source, tokens, virtual_finish, running_tokens FROM r WHERE running_tokens <= (SELECT floor(sum(tokens) * {FRACTION}) FROM q)
"""
