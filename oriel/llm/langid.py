"""Language identification by prediction by partial matching.

Every language has a variable-order byte context tree (orders 0 to ``ORDER``) with method-C escapes:
in a context with total T and d distinct symbols, a symbol of count c has probability c / (T + d) and
an escape d / (T + d), after which the next shorter context decides; below order 0 each of the 256
bytes has probability 1/256. The statistics are frozen after training, so the code length of a text
is a sum over its bytes and is exact. The trees of all languages are laid out as one automaton over
the union of their contexts: a byte costs a few table look-ups, in vectorised form, whatever the
number of languages.

Training uses a bounded sample: the ``per_language`` labelled documents with the least hashes of their
doc_id in each language, whole texts; another ``held_out`` documents set the threshold. A text is
rejected if it is null, empty or without letters, or if the best language needs more than
``SLACK`` times the bits per byte that the worst percent of held-out documents needs, after
``GRACE`` bits that let short texts pass.

Results: ``doc_id``, ``language`` (null if rejected as empty), ``bits_per_byte`` of the best and
``margin`` to the second best language, ``keep``. One row for each input row; rows that repeat are
scored again and a null doc_id is kept as null. Ties go to the language first in alphabetical order.
Without any labelled document every document is kept with a null language. Further columns are
ignored, and kept as they are by the pipeline stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm import kernel as k
from oriel.ship import map_arrow

ORDER = 4
PER_LANGUAGE = 300
HELD_OUT = 100
LEAST_COUNT = 24
SLACK = 1.5
GRACE = 64.0
PAD = 0
#: Bytes scored at a time: the costs take 4 bytes for each of them and each language.
AT_ONCE = 1 << 18


@dataclass
class Model:
    """Frozen trees: ``child[state, symbol]`` is the next state; states past ``nodes`` are final."""

    languages: list[str]
    symbol: np.ndarray
    nodes: int
    child: np.ndarray
    cost: np.ndarray
    limit: float = float("inf")


def padded(column: pa.Array, symbol: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with ``order`` pads before each text; the places of real symbols; offsets of texts in those."""
    data, offsets = k.text_bytes(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n * order, PAD, np.uint8)
    at = np.arange(len(data)) + np.repeat((np.arange(n) + 1) * order, np.diff(offsets))
    out[at] = symbol[data]
    return out, at, offsets


def train(texts: dict[str, list[str]], order: int = ORDER, least: int = LEAST_COUNT) -> Model:
    """Trees of the given texts by language. Contexts longer than 1 need ``least`` uses in a language."""
    languages = sorted(texts)
    seen = np.zeros(256, bool)
    for own in texts.values():
        seen[np.unique(k.text_bytes(pa.array(own, pa.string()))[0])] = True
    symbol = np.zeros(256, np.uint8)
    used = np.flatnonzero(seen)
    symbol[used] = np.arange(len(used)) + 1
    # symbol 0 is the pad as context and any byte that training lacks as the coded symbol; the latter's
    # cost is that of one byte below order 0.
    rare = len(used) + 1
    symbol[~seen] = rare
    size = rare + 1
    streams = {lang: padded(pa.array(texts[lang], pa.string()), symbol, order)[:2] for lang in languages}
    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    for depth in range(order + 1):
        frequent = []
        for lang in languages:
            s, at = streams[lang]
            code = s[at].astype(np.int64)
            context = np.zeros(len(at), np.int64)
            for j in range(1, depth + 1):
                context = context * size + s[at - j]
            keys, count = np.unique(context * size + code, return_counts=True)
            grams[lang, depth] = (keys, count)
            if depth:
                own, where = np.unique(keys // size, return_inverse=True)
                frequent.append(own[np.bincount(where, count) >= (least if depth > 1 else 1)])
        if depth:
            found = np.unique(np.concatenate(frequent)) if frequent else np.zeros(0, np.int64)
            contexts.append(found[np.isin(found // size, contexts[-1])])  # the newest symbol stands first
    first = np.cumsum([0, *map(len, contexts)])
    nodes = int(first[-1])
    child = np.tile(np.arange(2 * nodes, dtype=np.int32)[:, None], (1, size))
    child[:nodes] += nodes
    for depth in range(1, order + 1):
        parent = np.searchsorted(contexts[depth - 1], contexts[depth] // size) + first[depth - 1]
        child[parent, contexts[depth] % size] = np.arange(len(contexts[depth])) + first[depth]
    cost = np.full((len(languages), nodes + 1, size), 8.0)
    for i, lang in enumerate(languages):
        for depth in range(order + 1):
            rows = slice(first[depth], first[depth + 1])
            base = cost[i, nodes][None, :] if depth == 0 else cost[i, np.searchsorted(contexts[depth - 1], contexts[depth] // size) + first[depth - 1]]
            keys, count = grams[lang, depth]
            node = np.searchsorted(contexts[depth], keys // size)
            known = (node < len(contexts[depth])) & (contexts[depth][np.minimum(node, len(contexts[depth]) - 1)] == keys // size) if len(contexts[depth]) else np.zeros(len(keys), bool)
            counts = np.zeros((len(contexts[depth]), size))
            counts[node[known], keys[known] % size] = count[known]
            total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(counts > 0, np.log2((total + distinct) / counts), np.log2((total + distinct) / np.maximum(distinct, 1)) + base)
            cost[i, rows] = np.where(total > 0, own, base)
    return Model(languages, symbol, nodes, child, np.ascontiguousarray(np.moveaxis(cost[:, :nodes], 0, 2), np.float32))


def code_lengths(column: pa.Array, model: Model, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and its bytes."""
    s, at, offsets = padded(column, model.symbol, order)
    size = model.child.shape[1]
    flat = model.child.ravel()
    state = np.zeros(len(at), np.int32)
    for j in range(1, order + 1):
        state = flat[state * np.int32(size) + s[at - j]]
    state[state >= model.nodes] -= model.nodes
    cost = model.cost.reshape(-1, len(model.languages))[state * np.int32(size) + s[at]]
    bits = np.zeros((len(offsets) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        bits[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
    return bits, np.diff(offsets)


def sample(docs: DataFrame, per_language: int, held_out: int) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Whole texts of the bounded sample by language: for training and for the threshold."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null").distinct()
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = slim.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_language + held_out).collect()
    rank = {(r.doc_id, r.lang): r["rank"] for r in picked}
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    rows = docs.where(F.col("doc_id").isin(sorted({i for i, _ in rank})) & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").collect() if rank else []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        place = rank.get((r.doc_id, r.lang))
        if place and r.text.strip():
            (held if place > per_language else fit).setdefault(r.lang, []).append(r.text)
    return fit, held


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, held_out: int = HELD_OUT) -> Model | None:
    """A model with its threshold, or None where no document is labelled."""
    texts, held = sample(docs, per_language, held_out)
    if not texts:
        return None
    model = train(texts)
    check = [t for own in (held or texts).values() for t in own]
    bits, n = code_lengths(pa.array(check, pa.string()), model)
    model.limit = SLACK * float(np.quantile(np.maximum(bits.min(1) - GRACE, 0) / np.maximum(n, 1), 0.99)) + 0.5
    return model


def judge(column: pa.Array, model: Model | None) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Language, bits per byte, margin and whether it is kept, for each text."""
    count = len(column)
    letters = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None:
        empty = pa.nulls(count)
        return empty.cast(pa.string()), empty.cast(pa.float64()), empty.cast(pa.float64()), letters
    bits, n = code_lengths(column, model)
    order = np.argsort(bits, axis=1, kind="stable")
    best = bits[np.arange(count), order[:, 0]]
    second = bits[np.arange(count), order[:, min(1, order.shape[1] - 1)]]
    keep = letters & (np.maximum(best - GRACE, 0) <= model.limit * n)
    none = n == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        rate, margin = best / n, (second - best) / n
    names = pa.array(model.languages, pa.string()).take(pa.array(order[:, 0], mask=none))
    return names, pa.array(rate, mask=none), pa.array(margin, mask=none), keep


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of each document and whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch, size=AT_ONCE):
                language, rate, margin, keep = judge(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), language, rate, margin, pa.array(keep)], ["doc_id", "language", "bits_per_byte", "margin", "keep"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, run, "doc_id long, language string, bits_per_byte double, margin double, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch, "text", AT_ONCE):
                yield part.filter(pa.array(judge(part.column(place), shared.value)[3]))

    return map_arrow(docs, run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
