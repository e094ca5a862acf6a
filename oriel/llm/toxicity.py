"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the mean of hashed rows: one for the word and one for each of its 4-byte
pieces. Filters of several widths slide over the words, each is max-pooled over the whole document,
and a logistic layer reads the pooled values. It is trained in numpy with Adam on a bounded sample:
the ``per_class`` labelled documents of each class with the least hashes of their doc_id, of which one
in four is held out. Thresholds are calibrated by language on all labelled documents that were not
trained on, each class weighted to its share among all labelled ones: the one with the best F1, the
middle of the gap it falls in; a language with under ``LEAST_HELD`` such documents of a class uses the
threshold of all.

Scoring never multiplies matrices per position: a filter's response is a sum of projections that are
computed once for each distinct word.

Results: ``doc_id``, ``lang``, ``score`` (0 to 1) and ``toxic``, for each row with a doc_id. A null,
empty or blank text scores 0 and is not toxic; rows that repeat are scored again; if a doc_id has
several labels the greatest counts; without labels of both classes every score is 0. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm import kernel as k
from oriel.ship import map_arrow
from oriel.storage import materialise

PER_CLASS = 1200
BUCKETS = 1 << 17
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PIECE = 4
EPOCHS = 3
BATCH = 32
RATE = 0.01
LEAST_HELD = 8


@dataclass
class Model:
    table: np.ndarray
    filters: np.ndarray  # SIZE x (sum of widths * FILTERS): all projections side by side
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    limits: dict[str | None, float] = field(default_factory=dict)


def features(words: k.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: index of each word's type, and the types' hashed rows with their bounds."""
    _, first, kind = np.unique(words.hash, return_index=True, return_inverse=True)
    begin, length = words.first[first], words.length[first]
    pieces = np.maximum(length - PIECE + 1, 0)
    total = np.cumsum(pieces + 1) - (pieces + 1)
    rows = np.empty(int((pieces + 1).sum()), np.int64)
    rows[total] = (words.hash[first] % k.U(BUCKETS)).astype(np.int64)
    inner = np.ones(len(rows), bool)
    inner[total] = False
    at = np.repeat(begin, pieces) + np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    h = np.zeros(len(at), np.uint64)
    for j in range(PIECE):
        h = h * k.K2 + k.BYTE[words.wide[at + j]]
    rows[inner] = (k.mix(h) % k.U(BUCKETS)).astype(np.int64)
    return kind.reshape(-1), rows, np.append(total, len(rows))


def embed(model: Model, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    return np.add.reduceat(model.table[rows], bound[:-1], axis=0) / np.sqrt(np.diff(bound))[:, None].astype(np.float32)


def _columns(width: int, j: int) -> slice:
    before = sum(w for w in WIDTHS if w < width) * FILTERS
    return slice(before + j * FILTERS, before + (j + 1) * FILTERS)


def pooled(model: Model, projected: np.ndarray, kind: np.ndarray, bound: np.ndarray, places: bool = False):
    """Max-pooled responses of each document and, if asked for, the places they come from.

    A document shorter than a filter has its missing words as zeros.
    """
    n = len(bound) - 1
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    where = np.full((n, len(WIDTHS) * FILTERS), -1, np.int64)
    full = np.flatnonzero(np.diff(bound))
    if not len(full):
        return (out, where) if places else out
    by_filter = np.zeros((projected.shape[1], projected.shape[0] + 1), np.float32)
    by_filter[:, :-1] = projected.T
    ends = np.repeat(bound[1:], np.diff(bound))
    shifted = [kind]
    for j in range(1, max(WIDTHS)):
        beyond = np.arange(len(kind)) + j >= ends
        shifted.append(np.where(beyond, projected.shape[0], np.append(kind[j:], np.zeros(j, kind.dtype))))
    for i, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            value = by_filter[_columns(width, 0).start + f][kind]
            for j in range(1, width):
                value += by_filter[_columns(width, j).start + f][shifted[j]]
            top = np.maximum.reduceat(value, bound[full])
            out[full, i * FILTERS + f] = np.maximum(top + model.bias[i * FILTERS + f], 0)
            if places:
                hit = np.flatnonzero(value == np.repeat(top, np.diff(bound)[full]))
                where[full, i * FILTERS + f] = hit[np.searchsorted(hit, bound[full])]
    return (out, where) if places else out


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(column: pa.Array, model: Model | None) -> np.ndarray:
    words = k.Words(column)
    if model is None or not len(words):
        return np.zeros(words.n_docs)
    kind, rows, bound = features(words)
    value = _probability(pooled(model, embed(model, rows, bound) @ model.filters, kind, words.bound) @ model.out + model.out_bias).astype(np.float64)
    return np.where(words.count > 0, value, 0.0)


def start(ready: list, rng: np.random.Generator) -> Model:
    """Weights to begin with: small noise, but for the first dimension of the embeddings, which has the
    shrunken log-odds of each hashed row's presence in toxic documents, and the filters that read it."""
    with_row = np.zeros((2, BUCKETS))
    total = np.zeros(2)
    for doc, docs_bound, kind, rows, bound, y in ready:
        total += [len(y) - y.sum(), y.sum()]
        pairs = np.unique(doc * len(bound) + kind)
        owner, own = pairs // len(bound), pairs % len(bound)
        length = np.diff(bound)[own]
        at = np.repeat(bound[own], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        present = np.unique(np.repeat(owner, length) * BUCKETS + rows[at])
        for c in (0, 1):
            with_row[c] += np.bincount(present[y[present // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
    odds = np.log((with_row[1] + 2) / (total[1] + 4)) - np.log((with_row[0] + 2) / (total[0] + 4))
    odds[with_row.sum(0) == 0] = 0
    table = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    table[:, 0] = odds
    filters = rng.normal(0, 0.1, (SIZE, sum(WIDTHS) * FILTERS)).astype(np.float32)
    for width in WIDTHS:
        for j in range(width):
            filters[0, _columns(width, j)] = np.abs(rng.normal(0.5, 0.2, FILTERS)) / width
    n = len(WIDTHS) * FILTERS
    return Model(table, filters, np.full(n, -0.5, np.float32), np.abs(rng.normal(0, 0.1, n)).astype(np.float32), -1.0)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    ready = []
    for part in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
        words = k.Words(pa.array([texts[i] for i in part], pa.string()))
        ready.append((words.doc, words.bound, *features(words), labels[part].astype(np.float32)))
    model = start(ready, rng)
    moments = {name: [np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))] for name in ("table", "filters", "bias", "out")}
    bias_moment = [0.0, 0.0]
    step = 0
    def adam(name, grad, rows=None):
        value, (m, v) = getattr(model, name), moments[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            doc, docs_bound, kind, rows, bound, y = ready[i]
            if not len(doc):
                continue
            step += 1
            x = embed(model, rows, bound)
            hidden, where = pooled(model, x @ model.filters, kind, docs_bound, places=True)
            error = (_probability(hidden @ model.out + model.out_bias) - y) / len(y)
            back = error[:, None] * model.out[None, :] * (hidden > 0)
            grad_filters = np.zeros_like(model.filters)
            grad_x = np.zeros_like(x)
            for f, width in enumerate(WIDTHS):
                own = slice(f * FILTERS, (f + 1) * FILTERS)
                place, value = where[:, own], back[:, own]
                d, column = np.nonzero((place >= 0) & (value != 0))
                if not len(d):
                    continue
                for j in range(width):
                    at = place[d, column] + j
                    fit = (at < len(doc)) & (doc[np.minimum(at, len(doc) - 1)] == d)
                    token, c, g = kind[at[fit]], column[fit], value[d, column][fit]
                    block = model.filters[:, _columns(width, j)]
                    np.add.at(grad_x, token, g[:, None] * block[:, c].T)
                    np.add.at(grad_filters[:, _columns(width, j)].T, c, g[:, None] * x[token])
            grad_out, grad_bias, grad_out_bias = hidden.T @ error, back.sum(0), float(error.sum())
            used = np.flatnonzero(np.any(grad_x != 0, axis=1))
            lengths = np.diff(bound)[used]
            at = np.repeat(bound[used], lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            touched, where_row = np.unique(rows[at], return_inverse=True)
            grad_table = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(grad_table, where_row.reshape(-1), np.repeat(grad_x[used] / np.sqrt(lengths)[:, None], lengths, axis=0))
            adam("out", grad_out)
            adam("bias", grad_bias)
            adam("filters", grad_filters)
            if len(touched):
                adam("table", grad_table, touched)
            bias_moment = [0.9 * bias_moment[0] + 0.1 * grad_out_bias, 0.99 * bias_moment[1] + 0.01 * grad_out_bias**2]
            model.out_bias -= RATE * (bias_moment[0] / (1 - 0.9**step)) / ((bias_moment[1] / (1 - 0.99**step)) ** 0.5 + 1e-6)
    return model


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic``: the greatest label of each document."""
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, known: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> tuple[Model | None, list[int]]:
    """A model without thresholds and the documents it was trained on, or None without labels of both classes."""
    by = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = {r.doc_id: r.toxic for r in known.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_class).collect()}
    rows = docs.where(F.col("doc_id").isin(sorted(picked))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).collect() if picked else []
    # of several texts of one doc_id the greatest, in whatever order they come
    rows = list({r.doc_id: r for r in sorted((r for r in rows if r.text and r.text.strip()), key=lambda r: (r.doc_id, r.text))}.values())
    label = np.array([int(picked[r.doc_id] > 0) for r in rows])
    if not len(rows) or label.min() == label.max():
        return None, []
    held = np.zeros(len(rows), bool)
    held[np.random.default_rng(11).permutation(len(rows))[: len(rows) // 4]] = True
    model = train([r.text for r, h in zip(rows, held, strict=True) if not h], label[~held], epochs)
    return model, [r.doc_id for r, h in zip(rows, held, strict=True) if not h]


def calibrate(scored: DataFrame, known: DataFrame, trained: list[int]) -> dict[str | None, float]:
    """Thresholds by language, and at None that of all, from every labelled document that was not trained on.

    The threshold is the one with the best F1, in the middle of the gap between neighbouring scores. Each
    class counts with its share among all labelled documents, however few of it training left over.
    Running counts are two-level: within steps of the log-odds, and over the steps.
    """
    keys = ["whole", "lang", "step"]
    odds = F.log(F.greatest("score", F.lit(1e-12))) - F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))
    held = ~F.col("doc_id").isin(trained) if trained else F.lit(True)
    each = scored.where("score > 0").join(known.select("doc_id", (F.col("toxic") > 0).cast("long").alias("y")), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("lang", "score")).alias("m")).select("y", held.cast("long").alias("held"), "m.lang", "m.score")
    each = each.withColumn("whole", F.explode(F.array(F.lit(True), F.lit(False)))).where("whole or lang is not null").withColumn("lang", F.expr("if(whole, '', lang)"))
    points = materialise(each.groupBy("whole", "lang", F.floor(odds * 32).alias("step"), "score").agg(F.sum(F.expr("held * y")).alias("hit"), F.sum(F.expr("held * (1 - y)")).alias("miss"), F.sum("y").alias("toxic"), F.sum(F.expr("1 - y")).alias("clean")), "toxicity")
    of, down = Window.partitionBy("whole", "lang"), Window.partitionBy("whole", "lang").orderBy(F.desc("step"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    steps = points.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("hit", "miss", "toxic", "clean")], F.max(F.expr("if(hit + miss > 0, score, null)")).alias("top"))
    steps = steps.withColumns({f"all_{c}": F.sum(c).over(of) for c in ("hit", "miss", "toxic", "clean")}).where("top is not null")
    steps = steps.withColumns({"hits": F.coalesce(F.sum("hit").over(above), F.lit(0)), "misses": F.coalesce(F.sum("miss").over(above), F.lit(0)), "below": F.lead("top").over(down)}).drop("hit", "miss", "toxic", "clean")
    steps = steps.where(f"least(all_hit, all_miss) >= if(whole, 1, {LEAST_HELD})")
    inner = Window.partitionBy(*keys).orderBy(F.desc("score"))
    runs = points.where("hit + miss > 0").join(steps, keys).withColumns({"hits": F.col("hits") + F.sum("hit").over(inner), "misses": F.col("misses") + F.sum("miss").over(inner), "below": F.coalesce(F.lead("score").over(inner), "below", F.lit(0.0))})
    runs = runs.withColumn("caught", F.expr("cast(hits as double) * all_toxic / all_hit"))
    f1 = F.expr("2 * caught / (caught + cast(misses as double) * all_clean / all_miss + all_toxic)")
    best = runs.groupBy("whole", "lang").agg(F.max(F.struct(f1.alias("f1"), "score", "below")).alias("m")).collect()
    limits = {None if r.whole else r.lang: (r.m.score + r.m.below) / 2 for r in best}
    return limits if None in limits or not trained else calibrate(scored, known, [])


def fit_and_score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> tuple[Model | None, DataFrame]:
    """A model with thresholds by language, or None without labels of both classes; the scores of ``docs``."""
    known = known_labels(labels)
    model, trained = learn(docs, known, per_class, epochs)
    scored = score(docs, model)
    if model is not None:
        scored = materialise(scored, "toxicity")
        model.limits = calibrate(scored, known, trained)
    return model, scored


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> Model | None:
    """A model with thresholds by language, or None without labels of both classes."""
    return fit_and_score(docs, labels, per_class, epochs)[0]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang, score`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in k.chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores(part.column(2), model))], ["doc_id", "lang", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return map_arrow(slim, run, "doc_id long, lang string, score double")


def judge(scored: DataFrame, model: Model | None) -> DataFrame:
    """The verdict by each score."""
    own = {x: v for x, v in (model.limits if model else {}).items() if x is not None}
    limit = F.lit(model.limits[None] if model else 2.0)
    if own:
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.col("lang")), limit)
    return scored.withColumn("toxic", (F.col("score") > limit) & (F.col("score") > 0))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Score and verdict of each document."""
    return judge(score(docs, model), model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scored = fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(scored, model)
