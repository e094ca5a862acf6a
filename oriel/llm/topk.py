"""Exact top-k search by no-random-access aggregation.

Every row of ``items`` is a query: its distinct words. A document's score is the sum, over the words it
shares with the query, of integer impacts: rarity times saturated frequency, less for long documents.
The postings of a few thousand documents at a time are laid out as one list for each word, sorted by
impact. The lists of a query are read in step from their tops. A document's lower bound is what it has
shown so far, its upper bound adds the last impact read of every list that has not shown it. Reading
stops when no document outside the best k can reach the k-th lower bound; the rest of the lists is
then read for those k alone, which makes their scores final. The best k of all parts are merged.

Word counts and lengths are taken over all documents. Integers throughout make ties exact: they go to
the lower doc_id.

Results: ``item_id, rank, doc_id, score`` with at most k rows for each item, fewer where fewer
documents share a word with it. Items and documents without id or words give nothing; rows that repeat
an id are entries of their own; an empty table on either side gives an empty result; further columns
are ignored. Items are searched for in groups of ``ITEMS_AT_ONCE``.
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

K = 10
ITEMS_AT_ONCE = 2000
DOCS_AT_ONCE = 8000


def impact(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: int) -> np.ndarray:
    """``mean`` is the mean length in thousandths. Every product is under 2**63 for texts of up to 10**11 words."""
    return weight * tf * 2200 // (tf * 1000 + 300 + 900_000 * length // mean)


def mean_length(n: int, total: int) -> int:
    return max(1, 1000 * total // max(1, n))


def search_lists(docs: np.ndarray, impacts: np.ndarray, begin: np.ndarray, end: np.ndarray, n_docs: int, best: int, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``best`` documents with the greatest sums over the lists [begin, end), sorted by impact."""
    begin, end = begin[end > begin], end[end > begin]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = end - begin
    depth = 16
    while True:
        read = np.minimum(length, depth)
        total = int(read.sum())
        at = np.repeat(begin, read) + np.arange(total) - np.repeat(np.cumsum(read) - read, read)
        frontier = np.where(read < length, impacts[begin + read - 1], 0)
        lower = np.bincount(docs[at], impacts[at], minlength=n_docs)
        if not frontier.any():
            break
        open_sum = int(frontier.sum())
        upper = lower + open_sum - np.bincount(docs[at], np.repeat(frontier, read), minlength=n_docs)
        if n_docs > best:
            top = np.argpartition(-lower, best - 1)[:best]
            worst = lower[top].min()
            outside = upper.copy()
            outside[top] = -1
            if worst > 0 and outside.max() < worst:
                inside = np.zeros(n_docs, bool)
                inside[top] = True
                later = length - read
                rest = np.repeat(begin + read, later) + np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)
                rest = rest[inside[docs[rest]]]
                lower = np.where(inside, lower + np.bincount(docs[rest], impacts[rest], minlength=n_docs), 0)
                break
        depth *= 2
    if stats is not None:
        stats["read"] = stats.get("read", 0) + total
        stats["all"] = stats.get("all", 0) + int(length.sum())
    found = np.flatnonzero(lower > 0)
    order = found[np.lexsort((found, -lower[found]))][:best]
    return order, lower[order].astype(np.int64)


def _postings(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                words = k.Words(part.column(1))
                place = np.searchsorted(terms, words.hash)
                known = terms[np.minimum(place, len(terms) - 1)] == words.hash
                pair, tf = np.unique(words.doc[known] * len(terms) + place[known], return_counts=True)
                bound = np.searchsorted(pair, np.arange(words.n_docs + 1) * len(terms))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.count, pa.int64()), k.lists((pair % len(terms)).astype(np.int32), bound, pa.int32()), k.lists(tf.astype(np.int32), bound, pa.int32())], ["doc_id", "length", "terms", "tf"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used])], ["term", "df"])

    return run


def _search(shared, best: int):
    def part_of(table: pa.Table) -> pa.RecordBatch:
        weight, queries, mean = shared.value
        table = table.sort_by("doc_id").combine_chunks()
        ids = table.column("doc_id").to_numpy()
        lists = table.column("terms").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        term = lists.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), size)
        worth = impact(weight[term], table.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64), table.column("length").to_numpy()[doc], mean)
        keep = worth > 0
        term, doc, worth = term[keep], doc[keep], worth[keep]
        order = np.lexsort((-worth, term))
        term, doc, worth = term[order], doc[order], worth[order]
        bound = np.searchsorted(term, np.arange(len(weight) + 1))
        items, found, score = [], [], []
        for item, own in queries:
            hit, value = search_lists(doc, worth, bound[own], bound[own + 1], len(ids), best)
            items.append(np.full(len(hit), item, np.int64))
            found.append(ids[hit])
            score.append(value)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([join(items), join(found), join(score)], ["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                piece = batch.slice(at, DOCS_AT_ONCE)
                if rows + piece.num_rows > DOCS_AT_ONCE and held:
                    yield part_of(pa.Table.from_batches(held))
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if held:
            yield part_of(pa.Table.from_batches(held))

    return run


RESULT = "item_id long, rank long, doc_id long, score long"


def _of_group(docs: DataFrame, group: list[tuple[int, str]], best: int) -> DataFrame:
    spark = docs.sparkSession
    words = k.Words(pa.array([t for _, t in group], pa.string()))
    terms = np.unique(words.hash)
    postings = materialise(map_arrow(docs, _postings(terms), "doc_id long, length long, terms array<int>, tf array<int>"), "postings")
    sums = postings.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    weight = np.zeros(len(terms), np.int64)
    # as many rows as the items have distinct words
    for r in map_arrow(postings.select("terms"), _frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weight[r.term] = int(np.floor(1000 * np.log(1 + sums["n"] / r.df)))
    queries = [(i, np.unique(np.searchsorted(terms, words.hash[a:b]))) for (i, _), a, b in zip(group, words.bound[:-1], words.bound[1:], strict=True) if b > a]
    shared = spark.sparkContext.broadcast((weight, queries, mean_length(int(sums["n"]), int(sums["total"] or 0))))
    return map_arrow(postings, _search(shared, best), "item_id long, doc_id long, score long")


def top_documents(items: DataFrame, docs: DataFrame, best: int = K) -> DataFrame:
    """The ``best`` documents of each item."""
    if best < 1:
        raise ValueError("best must be 1 at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator()
    parts: list[DataFrame] = []
    group: list[tuple[int, str]] = []
    for r in rows:
        if r.text.strip(" \t\n\f\r"):
            group.append((r.item_id, r.text))
        if len(group) == ITEMS_AT_ONCE:
            parts.append(_of_group(docs, group, best))
            group = []
    if group:
        parts.append(_of_group(docs, group, best))
    if not parts:
        return docs.sparkSession.createDataFrame([], RESULT)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = reduce(DataFrame.unionAll, parts)
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{k.SQL_SPACE}'), lambda x: x <> '') AS w FROM {table} WHERE {key} IS NOT NULL"


ORACLE = rf"""
WITH d AS ({_words_sql('documents', 'doc_id')}), i AS ({_words_sql('benchmark', 'item_id')} AND text IS NOT NULL),
n AS (SELECT count(*)::BIGINT AS n, sum(coalesce(len(w), 0))::BIGINT AS total FROM d),
t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d),
f AS (SELECT doc_id, length, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM i),
x AS (SELECT term, count(*) AS df FROM f GROUP BY term),
p AS (SELECT item_id, doc_id, (CAST(floor(1000 * ln(1 + n.n::DOUBLE / df)) AS BIGINT) * tf * 2200) // (tf * 1000 + 300 + (900000 * length) // greatest(1, (1000 * n.total) // n.n)) AS impact
      FROM q JOIN f USING (term) JOIN x USING (term), n),
s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM p GROUP BY item_id, doc_id HAVING sum(impact) > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT item_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
