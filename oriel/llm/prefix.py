"""Shuffled queues, running totals over them and shares between them, without any sequential pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm import kernel as k
from oriel.llm import tokens
from oriel.ship import map_arrow
from oriel.storage import materialise

ROWS_PER_BUCKET = 4096
#: Where no vocabulary is given a token is a word: a run of characters other than these spaces.
WORD = r"[^ \t\n\f\r]+"
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}
DEFAULT_WEIGHT = 1


def weight_of(weights: dict[str, int], default: int) -> Column:
    if default <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    out = F.lit(default)
    for source, weight in sorted(weights.items()):
        out = F.when(F.col("source") == source, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch, size=k.CHUNK_BYTES // 2):
                n = [len(tokens.encode(t, path)) if t else 0 for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def queue(docs: DataFrame, seed: int, vocabulary: str | None) -> tuple[DataFrame, int]:
    """One slim row for each doc_id, and their number: ``doc_id, source, tokens, place``.

    Tokens are those of the vocabulary, or words without one. ``place`` is a hash that shuffles the
    documents. Rows that share a doc_id are one item with the sum of their tokens and the least source; a
    null source is the source '', a null text has no tokens; rows without doc_id are left out.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if vocabulary is None:
        counted = slim.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    else:
        tokens.share(docs.sparkSession, vocabulary)
        counted = map_arrow(slim, _count(vocabulary), "doc_id long, source string, tokens long")
    own = counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))
    kept = materialise(own.withColumn("place", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))), "queue")
    return kept, kept.count()


def place_buckets(rows: int) -> list[Column]:
    """Prefixes of ``place``, coarse to fine, with about ROWS_PER_BUCKET rows to each of the last; they grow with the table."""
    digits = max(0, math.ceil(math.log(max(rows / ROWS_PER_BUCKET, 1), 16)))
    return [F.substring("place", 1, n) for n in (*range(3, digits, 3), digits) if n] or [F.lit("")]


def running_total(df: DataFrame, keys: list[str], buckets: list[Column], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the running total of ``value`` over ``order`` within ``keys``.

    ``buckets`` are monotone in ``order``, each of them constant within those after it. Totals of buckets
    are added up level by level first, so that no window is over more rows than one bucket has, however
    large one key is.
    """
    marks = [f"_bucket{i}" for i in range(len(buckets))]
    df = df.withColumns(dict(zip(marks, buckets, strict=True)))
    offsets, outer = None, keys
    for i, mark in enumerate(marks):
        totals = df.groupBy(*keys, *marks[: i + 1]).agg(F.sum(value).alias("_sum"))
        earlier = Window.partitionBy(*outer).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("_own", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        if offsets is not None:
            totals = totals.join(offsets, outer).withColumn("_own", F.col("_own") + F.col("_before")).drop("_before")
        outer = [*keys, *marks[: i + 1]]
        offsets = totals.select(*outer, F.col("_own").alias("_before"))
    within = Window.partitionBy(*outer).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, outer).withColumn(name, F.col("_before") + F.sum(value).over(within)).drop(*marks, "_before")


@dataclass
class Shares:
    """How queues of given totals empty when each is served in proportion to its weight.

    From virtual time ``time[p]`` on, when ``served[p]`` tokens are out, the queues still filled weigh
    ``weight[p]`` together: a virtual time serves each of them its weight in tokens.
    """

    time: np.ndarray
    served: np.ndarray
    weight: np.ndarray

    @property
    def total(self) -> float:
        return float(self.served[-1])

    def served_at(self, time: np.ndarray) -> np.ndarray:
        """Tokens out at a virtual time; monotone."""
        p = np.clip(np.searchsorted(self.time, time, "right") - 1, 0, len(self.time) - 1)
        after = np.append(self.served, self.served[-1])[p + 1]
        return np.minimum(self.served[p] + self.weight[p] * (time - self.time[p]), after)

    def time_at(self, served: np.ndarray) -> np.ndarray:
        """The virtual time at which so many tokens are out; infinite for all of them."""
        p = np.clip(np.searchsorted(self.served, served, "right") - 1, 0, len(self.time) - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = self.time[p] + (served - self.served[p]) / self.weight[p]
        return np.where(served >= self.served[-1], np.inf, at)


def shares(items: DataFrame, weight: Column) -> Shares:
    """The shares of the sources of ``items``; what comes to the driver is a row for each distinct total and weight."""
    totals = items.groupBy("source").agg(F.sum("tokens").alias("n")).where("n > 0").select("n", weight.alias("w")).groupBy("n", "w").agg(F.count("*").alias("c")).collect()
    ends = sorted((r.n / r.w, r.n * r.c, r.w * r.c) for r in totals)
    time, left = [0.0], [float(sum(w for _, _, w in ends))]
    for end, _, w in ends:
        if end > time[-1]:
            time.append(end)
            left.append(left[-1])
        left[-1] -= w
    served = np.concatenate([[0.0], np.cumsum(np.array(left[:-1]) * np.diff(time))])
    served[-1] = sum(n for _, n, _ in ends)
    return Shares(np.array(time), served, np.array(left))
