"""Document fingerprints: a threshold-scaled sketch of the word shingles of each document.

Every distinct shingle hash below a fixed fraction of the hash range, one in ``SCALE``, is retained, so
the sketch of a union is the union of the sketches, and the share of a small document's hashes found in
a large one estimates containment however unequal the two are. With 20 shingles (24 words) a sketch is
empty in 0.3 % of cases (0.75 ** 20): that is the shortest text that estimates are meant for. Shorter
texts often have an empty sketch (a single shingle in 75 %) and then no estimate.

Results: one row for each row with a doc_id: ``doc_id``, ``n_shingles`` (distinct), ``n_kept`` and
``sketch`` (ascending signed 64-bit hashes). Null, empty and blank texts have an empty sketch; a text
of under ``n`` words has one shingle of all its words; rows that repeat are sketched again; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import kernel as k
from oriel.ship import map_arrow

SHINGLE = 5
SCALE = 4
LEAST = 0.5


def limit(scale: int) -> np.uint64:
    """Hashes below it are kept."""
    return k.U((1 << 64) // scale) if scale > 1 else k.U((1 << 64) - 1)


def fingerprints(docs: DataFrame, n: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """The sketch of each document at one in ``scale``."""
    if n < 1 or scale < 1:
        raise ValueError("n and scale must be 1 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                words = k.Words(part.column(1))
                doc, value, bound = k.distinct_shingles(words, n)
                low = value < limit(scale)
                kept = value[low].view(np.int64)
                doc = doc[low]
                kept = kept[np.lexsort((kept, doc))]
                cut = np.searchsorted(doc, np.arange(words.n_docs + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bound), pa.int64()), pa.array(np.diff(cut), pa.int64()), k.lists(kept, cut, pa.int64())], ["doc_id", "n_shingles", "n_kept", "sketch"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return map_arrow(slim, run, "doc_id long, n_shingles long, n_kept long, sketch array<long>")


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of each group's union."""
    return sketches.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("sketch"))


def containment(small: Column, large: Column) -> Column:
    """Estimated share of the shingles of ``small`` that ``large`` has; null for an empty sketch."""
    return F.when(F.size(small) > 0, F.size(F.array_intersect(small, large)) / F.size(small))


def contained_in(items: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimated containment of the item in the document reaches ``least`` (above 0).

    An equi-join on single hashes; both inputs are sketch tables of the same n and scale.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    a = items.select(F.col("doc_id").alias("item_id"), "n_kept", F.explode("sketch").alias("h"))
    b = docs.select("doc_id", F.explode("sketch").alias("h"))
    return a.join(b, "h").groupBy("item_id", "doc_id").agg((F.countDistinct("h") / F.first("n_kept")).alias("containment")).where(F.col("containment") >= least)


def containments(items: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """``item_id, n_kept, doc_id, containment``: for each item the documents that hold its share ``least``.

    No item is lost: one without such a document has a row with null ``doc_id``, and the ``n_kept`` of 0
    tells that its text is too short for an estimate. Items and documents whose ids repeat count once, by
    the union of their sketches.
    """
    a = merge(fingerprints(items), ["doc_id"]).withColumn("n_kept", F.size("sketch"))
    return a.select(F.col("doc_id").alias("item_id"), "n_kept").join(contained_in(a, fingerprints(docs), least), "item_id", "left")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold at least half of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return containments(items, spark.read.parquet(f"{sf_dir}/documents.parquet"), LEAST)
