"""Substring deduplication: every run of ``width`` words that occurs more than once in the corpus.

Count-min prefilter, then exact grouping:

1. Each window of ``width`` words is represented by its anchor, the sub-window of half its width with
   the least hash. Equal windows have equal anchors at equal offsets, so the number of places of an
   anchor is at least the number of places of every window it stands for: it is an estimate of their
   counts that is never too low. There are about 4 / width anchors to a word.
2. Every input partition counts its anchors in a count-min sketch. The sketch is cut in blocks by
   anchor hash, its size follows the number of anchors, and the partitions' blocks are added up where
   the anchors of that block are looked up: nothing is broadcast or sent to the driver. An estimate is
   never below the true count, so no repeated window is lost.
3. For the anchors estimated to repeat, the windows they stand for are grouped exactly, by anchor and
   window hash (128 bits together). Hot anchors, told by a sample, are counted by aggregation instead, and
   blocks with many places are looked up in several tasks.

Results: one row for each maximal stretch of words that repeated windows cover: ``doc_id``,
``start_word``, ``end_word`` (exclusive) and ``copies``, the most places that one of its windows has.
Repeats inside one document count. Rows without doc_id or text and texts of under ``width`` words give
nothing; rows that repeat a doc_id are places of their own, reported under that doc_id; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm import kernel as k
from oriel.ship import map_arrow
from oriel.storage import materialise

WIDTH = 50
DEPTH = 3
ROW_CELLS = 1 << 14
ANCHORS_PER_BLOCK = 8192
#: Anchors with about this many places are counted by aggregation, not in one place; one place in SAMPLE tells them.
HOT = 1 << 16
SAMPLE = 64
_ROW_SALT = np.arange(1, DEPTH + 1, dtype=np.uint64) * k.K2


def anchor_of_windows(words: k.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, and that of its anchor; and the hash of each sub-window."""
    half = width // 2
    sub = k.rolling(words.hash, half)
    span = width - half + 1
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sub
    low, place, size = sub, np.arange(len(sub), dtype=np.int64), 1
    while size < span:  # the first of the least, by whole hashes
        step = min(size, span - size)
        later = low[step:] < low[:-step]
        low, place, size = np.where(later, low[step:], low[:-step]), np.where(later, place[step:], place[:-step]), size + step
    place = place[:n]
    own = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    return own, place[own], sub


def cells(h: np.ndarray) -> np.ndarray:
    """The cell of each hash in each row of a block, as row * ROW_CELLS + cell; shape (DEPTH, n)."""
    return np.stack([(k.mix(h + _ROW_SALT[row]) % k.U(ROW_CELLS)).astype(np.int64) + row * ROW_CELLS for row in range(DEPTH)])


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> k.U(20)) % k.U(blocks)).astype(np.int32)


def partition_sketch(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The count-min sketch of one partition, without its zeros: block, cell and count (saturated)."""
    at = (block_of(hashes, blocks).astype(np.int64)[None, :] * (DEPTH * ROW_CELLS) + cells(hashes)).ravel()
    at, count = np.unique(at, return_counts=True)
    return at // (DEPTH * ROW_CELLS), (at % (DEPTH * ROW_CELLS)).astype(np.uint16), np.minimum(count, 255).astype(np.uint8)


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                words = k.Words(part.column(1))
                _, place, sub = anchor_of_windows(words, width)
                place = np.unique(place) if len(place) and (np.diff(place) < 0).any() else place[np.concatenate([[True], np.diff(place) > 0])] if len(place) else place
                doc = words.doc[place]
                ids = part.column(0).to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(k.signed(sub[place])), pa.array(ids, pa.int64()), pa.array((place - words.bound[doc]).astype(np.int32))], ["anchor", "doc_id", "pos"])

    return run


def _sketches(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merged(batches, 1_000_000):
            block, cell, count = partition_sketch(batch.column("anchor").to_numpy().view(np.uint64), blocks)
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cut[1:], len(block))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[cut].astype(np.int32)),
                    pa.array([cell[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                ],
                ["block", "cells", "counts"],
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def estimates(hashes: np.ndarray, sketches: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Estimated counts of hashes of one block from the sketches of all partitions; never too low."""
    total = np.zeros(DEPTH * ROW_CELLS, np.int64)
    for cell, count in sketches:
        total[cell] += count
    return total[cells(hashes)].min(axis=0)


def _suspects(left: pa.Table, right: pa.Table) -> pa.Table:
    hashes = left.column("anchor").to_numpy().view(np.uint64)
    parts = [(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint8)) for a, b in zip(right.column("cells").to_pylist(), right.column("counts").to_pylist(), strict=True)]
    return left.select(["doc_id", "pos"]).filter(pa.array(estimates(hashes, parts) >= 2))


def _windows(width: int):
    """For each suspect anchor of a document: the hashes of the windows it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                words = k.Words(part.column(1))
                own, place, sub = anchor_of_windows(words, width)
                wanted = np.zeros(len(words) + 1, bool)
                marks = part.column(2)
                at = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
                fit = at < words.count[row]
                wanted[(words.bound[row] + at)[fit]] = True
                keep = wanted[place]
                own, place = own[keep], place[keep]
                if not len(own):
                    continue
                window = k.rolling(words.hash, width, k.K1)[own]
                cut = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(own, prepend=-2) != 1))
                doc = words.doc[place[cut]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k.signed(sub[place[cut]])),
                        pa.array(part.column(0).to_numpy(zero_copy_only=False)[doc], pa.int64()),
                        pa.array((own[cut] - words.bound[doc]).astype(np.int32)),
                        pa.LargeListArray.from_arrays(np.append(cut, len(own)), pa.array(k.signed(window))).cast(pa.list_(pa.int64())),
                    ],
                    ["anchor", "doc_id", "first", "windows"],
                )

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the windows of each anchor; stretches of windows that have two places or more."""
    for table in k.grouped(batches, "anchor", 50_000):
        table = table.combine_chunks()
        column = table.column("windows").combine_chunks()
        length = column.value_lengths().to_numpy(zero_copy_only=False)
        window = column.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(table.num_rows), length)
        anchor = table.column("anchor").to_numpy()[row]
        order = np.lexsort((window, anchor))
        a, w = anchor[order], window[order]
        new = np.ones(len(w), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(new) - 1
        copies = np.empty(len(w), np.int64)
        copies[order] = np.bincount(group)[group]
        place = table.column("first").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        keep = np.flatnonzero(copies > 1)
        if not len(keep):
            continue
        row, place, copies = row[keep], place[keep], copies[keep]
        cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1))
        last = np.append(cut[1:], len(row)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(table.column("doc_id").to_numpy()[row[cut]]), pa.array(place[cut].astype(np.int64)), pa.array(place[last].astype(np.int64)), pa.array(np.maximum.reduceat(copies, cut))],
            ["doc_id", "low", "high", "copies"],
        )


def _hot_repeats(windows: DataFrame, width: int) -> DataFrame:
    """As ``_repeats``, for anchors of any number of places: counts are combined before they are shuffled."""
    each = windows.select("anchor", "doc_id", "first", F.posexplode("windows").alias("i", "window")).select("anchor", "window", "doc_id", (F.col("first") + F.col("i")).cast("long").alias("low"))
    several = each.groupBy("anchor", "window").agg(F.count("*").alias("copies")).where("copies > 1")
    return each.join(several, ["anchor", "window"]).select("doc_id", "low", F.col("low").alias("high"), "copies")


def repeated_passages(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Stretches of words covered by windows of ``width`` words that occur more than once."""
    if width < 2:
        raise ValueError("width must be 2 at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    anchors = materialise(map_arrow(docs, _anchors(width), "anchor long, doc_id long, pos int"), "anchors")
    blocks = anchors.count() // ANCHORS_PER_BLOCK + 1
    sketches = map_arrow(anchors.select("anchor"), _sketches(blocks), "block int, cells binary, counts binary")
    block = F.pmod(F.shiftrightunsigned("anchor", 20), F.lit(blocks)).cast("int")
    placed = anchors.withColumn("block", block)
    # a block that a hot anchor is in is looked up in several places, each with a copy of its sketch
    salts = materialise(placed.groupBy("block").agg(F.ceil(F.count("*") / (4 * ANCHORS_PER_BLOCK)).cast("int").alias("salts")).where("salts > 1"), "salts")
    if salts.isEmpty():
        placed, sketches = placed.withColumn("salt", F.lit(0)), sketches.withColumn("salt", F.lit(0))
    else:
        placed = placed.join(salts, "block", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        sketches = sketches.join(salts, "block", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    found = placed.groupBy("block", "salt").cogroup(sketches.groupBy("block", "salt")).applyInArrow(_suspects, "doc_id long, pos int")
    suspects = found.groupBy("doc_id").agg(F.collect_set("pos").alias("marks"))
    some = anchors.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SAMPLE)) == 0).groupBy("anchor").count()
    many = materialise(some.where(F.col("count") >= max(1, hot // SAMPLE)).select("anchor"), "hot")
    windows = map_arrow(docs.join(suspects, "doc_id").select("doc_id", "text", "marks"), _windows(width), "anchor long, doc_id long, first int, windows array<long>")
    cold, apart = windows, []
    if not many.isEmpty():
        windows = materialise(windows, "windows")
        cold, apart = windows.join(many, "anchor", "left_anti"), [_hot_repeats(windows.join(many, "anchor"), width)]
    shuffled = cold.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    runs = reduce(DataFrame.unionByName, [map_arrow(shuffled, _repeats, "doc_id long, low long, high long, copies long"), *apart])
    by = Window.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max(F.col("high") + width).over(by.rowsBetween(Window.unboundedPreceding, -1))
    stretches = runs.withColumn("opens", F.when(F.col("low") <= reach, 0).otherwise(1)).withColumn("stretch", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return stretches.groupBy("doc_id", "stretch").agg(F.min("low").alias("start_word"), (F.max("high") + width).alias("end_word"), F.max("copies").alias("copies")).drop("stretch")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{k.SQL_SPACE}'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {WIDTH - 1})) AS pos FROM d WHERE len(w) >= {WIDTH}),
g AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + {WIDTH}], ' ')) AS h FROM p),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS copies FROM g),
k AS (SELECT doc_id, pos, copies, CASE WHEN pos <= max(pos + {WIDTH}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM r WHERE copies > 1),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stretch FROM k)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + {WIDTH} AS BIGINT) AS end_word, CAST(max(copies) AS BIGINT) AS copies FROM s GROUP BY doc_id, stretch
"""
