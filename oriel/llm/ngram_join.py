"""N-gram Jaccard join by chosen paths.

Each document is the set of its distinct runs of ``n`` words. Documents with equal sets are first
taken together: their least doc_id, ``rid``, stands for them. A set is embedded as ``COORDINATES``
min-hash values. In each of several independent runs the sets are split recursively: a node of the tree
draws two coordinates by hashing its path, and a set goes to the child of its value in each. Nodes that
fit in memory are split further, and finally compared by brute force, in one place: when they are small,
when ``DEPTH`` levels are reached, or when their members are alike so that splitting would not pay.
Larger nodes send their children to the next round of the whole cluster; nodes that a sample shows to be
hot are never gathered at all. The number of runs follows from all of the levels that there can be, so a
pair at the threshold is found with probability ``recall``.

Members of a node that are alike and more than ``GROUP`` are not written as pairs. Overlapping groups of
that kind are taken together, cut in blocks, and each pair of blocks is compared exactly by products of
the matrices of sets and runs: what is passed on is a row for each member and block, never a row for each
pair. A leaf over ``LOCAL`` whose members are not alike is compared in pairs of blocks of signatures.
Candidates are then compared exactly on their whole texts.

``classes``: one row for each doc_id: ``doc_id``, ``class_id`` (the least doc_id that a chain of links
leads to, its own if none does) and ``n_links``, the number of other documents whose similarity reaches
the threshold, documents with an equal set included; every link between different sets is counted, with
no cap on partners. ``jaccard_pairs``: ``doc_a < doc_b`` and ``jaccard`` (of the whole sets, exact).
A text of under ``n`` words with any is the set of its one run; null, empty and blank texts have no link;
rows without doc_id are left out. Rows that share a doc_id are one document, with one of their texts
(the one with the least hash); a document is not paired with itself. An empty table gives an empty
result; further columns are ignored, and kept as they are by the pipeline stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.fixpoint import connected_components
from oriel.llm import kernel as k
from oriel.ship import map_arrow, ship
from oriel.storage import materialise

N = 3
THRESHOLD = 0.5
RECALL = 0.99
COORDINATES = 32
DRAWS = 2
BRUTE = 48
LOCAL = 4096
DEPTH = 4
#: Alike members of a node beyond this many are handed on as one group instead of as pairs.
GROUP = 512
#: A block of a group: at most so many sets, and about so many runs of words in all.
BLOCK = 2048
BLOCK_RUNS = 1 << 20
#: Nodes of about this many rows are not gathered; one row in SAMPLE tells them.
HOT = 1 << 16
SAMPLE = 64
DOCS_PER_TASK = 1500
PAIRS_AT_ONCE = 50_000
COLUMNS_AT_ONCE = 2048
_SALT = np.random.default_rng(5).integers(1, 2**63, COORDINATES, dtype=np.uint64) * k.U(2) + k.U(1)


def least_agreement(threshold: float, loss: float) -> tuple[int, float]:
    """Coordinates in which candidates must agree, and the share of pairs at the threshold that this loses: ``loss`` at most."""
    chance = [math.comb(COORDINATES, i) * threshold**i * (1 - threshold) ** (COORDINATES - i) for i in range(COORDINATES + 1)]
    least = next(i for i in range(COORDINATES + 1) if sum(chance[: i + 1]) > loss)
    return max(1, least), sum(chance[: max(1, least)])


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is a candidate with probability ``recall``.

    In one run a pair of similarity s survives a level with 1 - (1 - s q)**DRAWS, q being the chance
    below it; ``depth`` levels are the most that there are. What ``least_agreement`` loses is added.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) ** DRAWS
    short = 1 - recall / (1 - least_agreement(threshold, (1 - recall) / 4)[1])
    return max(1, math.ceil(math.log(short) / math.log(1 - q))) if q < 1 else 1


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                _, value, bound = k.distinct_shingles(k.Words(part.column(1)), n)
                full = np.flatnonzero(np.diff(bound))
                at = bound[full]
                sign = np.zeros((len(full), COORDINATES), np.uint16)
                one = two = np.zeros(0, np.uint64)
                if len(full):
                    for c in range(COORDINATES):
                        low = np.minimum.reduceat((value ^ (_SALT[c] >> k.U(7))) * _SALT[c], at)
                        sign[:, c] = (k.mix(low) >> k.U(48)).astype(np.uint16)
                    one, two = np.add.reduceat(k.mix(value), at), np.add.reduceat(k.mix(value * k.K2), at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(full)), pa.array(k.signed(one)), pa.array(k.signed(two)), pa.array(np.diff(bound)[full], pa.int64()), pa.array([s.tobytes() for s in sign], pa.binary())], ["doc_id", "h1", "h2", "size", "sign"]
                )

    return run


def _unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, COORDINATES)


def _pack(sign: np.ndarray) -> pa.Array:
    sign = np.ascontiguousarray(sign)
    offsets = np.arange(len(sign) + 1, dtype=np.int32) * (2 * COORDINATES)
    return pa.Array.from_buffers(pa.binary(), len(sign), [None, pa.py_buffer(offsets), pa.py_buffer(sign)])


def draws(node: np.ndarray) -> np.ndarray:
    """The DRAWS distinct coordinates of each node."""
    h = k.mix(node + k.K1)
    first = h % k.U(COORDINATES)
    step = (h >> k.U(32)) % k.U(COORDINATES - 1) + k.U(1)
    return np.stack([first, (first + step) % k.U(COORDINATES)]).astype(np.int64)


def children(node: np.ndarray, sign: np.ndarray) -> list[np.ndarray]:
    """The child of each member in each of its node's draws."""
    return [k.mix(node * k.K2 + (c.astype(np.uint64) << k.U(16)) + sign[np.arange(len(node)), c].astype(np.uint64) + k.U(1)) for c in draws(node)]


def brute(sign: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that agree in ``least`` coordinates or more, some at a time."""
    if len(sign) <= BRUTE:
        agree = (sign[:, None, :] == sign[None, :, :]).sum(2) >= least
        yield np.nonzero(np.triu(agree, 1))
        return
    a, b, held = [], [], 0
    for i in range(len(sign) - 1):
        hit = np.flatnonzero((sign[i + 1 :] == sign[i]).sum(1) >= least) + i + 1
        a.append(np.full(len(hit), i))
        b.append(hit)
        held += len(hit)
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if a:
        yield np.concatenate(a), np.concatenate(b)


def alike(sign: np.ndarray, threshold: float) -> bool:
    """Whether the mean agreement of members, over a fixed set of shifts, reaches the threshold."""
    m = len(sign)
    return np.mean([(sign == np.roll(sign, s, axis=0)).mean() for s in {1, m // 3 + 1, m // 2}]) >= threshold


def split(node: int, member: np.ndarray, sign: np.ndarray, depth: int, threshold: float, least: int, group: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Leaves below a node: (leaf, members a, members b) of candidate pairs, or (leaf, members, None) of a group."""
    stack = [(node, np.arange(len(member)), depth)]
    while stack:
        node, own, depth = stack.pop()
        if len(own) < 2:
            continue
        dense = len(own) > BRUTE and alike(sign[own], threshold)
        if dense and len(own) > group:
            yield node, member[own], None
            continue
        if len(own) <= BRUTE or depth >= DEPTH or dense:
            for a, b in brute(sign[own], least):
                if len(a):
                    yield node, member[own[a]], member[own[b]]
            continue
        for child in children(np.full(len(own), node, np.uint64), sign[own]):
            order = np.argsort(child, kind="stable")
            cut = np.flatnonzero(np.diff(child[order])) + 1
            for part in np.split(order, cut):
                if len(part) > 1:
                    stack.append((child[part[0]], own[part], depth + 1))


def _roots(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = _unpack(batch.column(1))
            for r in range(runs):
                for child in children(np.full(len(sign), r, np.uint64), sign):
                    yield pa.RecordBatch.from_arrays([pa.array(k.signed(child)), batch.column(0), batch.column(1)], ["node", "rid", "sign"])

    return run


#: A pair has ``other``; a member of a group has neither ``other`` nor ``sign``; the rest goes on to the next level.
PATHS = "node long, rid long, other long, sign binary"
_PATHS = ["node", "rid", "other", "sign"]


def _members(node: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k.signed(node)), pa.array(rid), pa.nulls(len(rid), pa.int64()), pa.nulls(len(rid), pa.binary())], _PATHS)


def _onwards(node: np.ndarray, rid: np.ndarray, sign: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """The children of a node's members; at the last level the members themselves, for comparison in blocks."""
    for child in children(node, sign) if depth < DEPTH else [node]:
        yield pa.RecordBatch.from_arrays([pa.array(k.signed(child)), pa.array(rid), pa.nulls(len(rid), pa.int64()), _pack(sign)], _PATHS)


class _Pairs:
    """Candidate pairs, handed on some at a time."""

    def __init__(self):
        self.leaf, self.a, self.b, self.held = [], [], [], 0

    def add(self, leaf: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.leaf.append(np.full(len(a), leaf, np.uint64))
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held >= PAIRS_AT_ONCE:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            yield pa.RecordBatch.from_arrays([pa.array(k.signed(np.concatenate(self.leaf))), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.binary())], _PATHS)
        self.leaf, self.a, self.b, self.held = [], [], [], 0


def _level(depth: int, threshold: float, least: int, local: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, large, dense = _Pairs(), None, False
        for table, whole in k.pieces(batches, "node", 40_000):
            node = table.column("node").to_numpy().view(np.uint64)
            rid = table.column("rid").to_numpy()
            sign = _unpack(table.column("sign"))
            if not whole:
                if node[0] != large:
                    large, dense = node[0], alike(sign, threshold)
                yield from [_members(node, rid)] if dense else _onwards(node, rid, sign, depth)
                continue
            cut = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
            size = np.diff(cut)
            for g in np.flatnonzero(size > 1):
                own = slice(cut[g], cut[g + 1])
                if size[g] > local and alike(sign[own], threshold):
                    yield _members(node[own], rid[own])
                elif size[g] > local:
                    yield from _onwards(node[own], rid[own], sign[own], depth)
                else:
                    for at, x, y in split(node[cut[g]], rid[own], sign[own], depth, threshold, least, group):
                        yield from [_members(np.full(len(x), at, np.uint64), x)] if y is None else found.add(at, x, y)
        yield from found.rest()

    return run


def _hot(depth: int):
    """Rows of hot nodes, of which it is known whether they are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, rid, dense = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            if dense.any():
                yield _members(node[dense], rid[dense])
            if not dense.all():
                yield from _onwards(node[~dense], rid[~dense], _unpack(batch.column(2))[~dense], depth)

    return run


def _alike_nodes(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"node": table.column("node").slice(0, 1), "dense": pa.array([alike(_unpack(table.column("sign")), threshold)])})

    return run


def _leaves(least: int):
    """Candidate pairs of each pair of blocks of a leaf."""

    def run(table: pa.Table) -> pa.Table:
        rid, node, found = table.column("rid").to_numpy(), table.column("node").to_numpy().view(np.uint64)[0], _Pairs()
        out = [x for a, b in brute(_unpack(table.column("sign")), least) for x in found.add(node, rid[a], rid[b])]
        out += found.rest()
        return pa.Table.from_batches(out, None if out else pa.schema([("node", pa.int64()), ("rid", pa.int64()), ("other", pa.int64()), ("sign", pa.binary())]))

    return run


def _in_blocks(df: DataFrame, blocks) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: ``i <= j``, only ``0, 0`` where there is one block."""
    df = df.withColumn("own", F.pmod(F.xxhash64(F.col("rid"), F.lit(3)), blocks).cast("int"))
    df = df.withColumn("with", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return df.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with")


def candidates(sets: DataFrame, threshold: float, recall: float, local: int = LOCAL, group: int = GROUP, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``leaf, a, b`` of ``sets`` (rid, sign), repeats included; and members of groups, ``node, rid``."""
    least, _ = least_agreement(threshold, (1 - recall) / 4)
    sampled = F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0
    level, some = (map_arrow(x, _roots(runs_for(threshold, recall)), "node long, rid long, sign binary") for x in (sets, sets.where(sampled)))
    outs = []
    for depth in range(1, DEPTH + 1):
        nodes = materialise(some.groupBy("node").count().where(F.col("count") >= max(1, hot // SAMPLE)).select("node"), "hot")
        cold, here = level, []
        if not nodes.isEmpty():
            # each hot node has HOT rows at least, so there are few of them; the planner sees their size
            by = Window.partitionBy("node").orderBy(F.xxhash64("rid", F.lit(1)), "rid")
            picked = some.join(nodes, "node").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 512)
            judged = materialise(picked.select("node", "sign").groupBy("node").applyInArrow(_alike_nodes(threshold), "node long, dense boolean"), "hot")
            here.append(materialise(map_arrow(level.join(judged, "node").select("node", "rid", "sign", "dense"), _hot(depth), PATHS), "paths"))
            cold = level.join(nodes, "node", "left_anti")
        placed = cold.repartition(F.col("node")).sortWithinPartitions("node", F.xxhash64("rid"), "rid")
        here.append(materialise(map_arrow(placed, _level(depth, threshold, least, local, group), PATHS), "paths"))
        outs += here
        onwards = [x.where("other is null and sign is not null").select("node", "rid", "sign") for x in here]
        level = reduce(DataFrame.unionAll, onwards)
        some = level.where(sampled)
        if level.isEmpty():
            break
    else:
        blocks = level.groupBy("node").agg(F.ceil(F.count("*") / local).alias("n"))
        apart = _in_blocks(level.join(blocks, "node"), F.col("n")).where("i < j or n = 1")
        outs.append(materialise(apart.select("node", "i", "j", "rid", "sign").groupBy("node", "i", "j").applyInArrow(_leaves(least), PATHS), "paths"))
    every = reduce(DataFrame.unionAll, outs)
    pairs = every.where("other is not null").select(F.col("node").alias("leaf"), F.col("rid").alias("a"), F.col("other").alias("b"))
    return pairs, every.where("other is null and sign is null").select("node", "rid")


def _sets_of(n: int, names: list[str]):
    """The distinct hashed runs of each text, before the columns after it; a text that does not have the hash ``h1`` is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.chunks(batch):
                _, value, bound = k.distinct_shingles(k.Words(part.column(1)), n)
                full = np.flatnonzero(np.diff(bound))
                own = np.zeros(part.num_rows, np.int64)
                if len(full):
                    own[full] = np.add.reduceat(k.mix(value), bound[full]).view(np.int64)
                fit = np.zeros(part.num_rows, bool)
                fit[full] = own[full] == part.column(0).to_numpy()[full]
                yield pa.RecordBatch.from_arrays([k.lists(k.signed(value), bound, pa.int64()), *part.columns[2:]], ["runs", *names]).filter(pa.array(fit))

    return run


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and runs with their bounds, of a table of sets; repeats of an id are left out."""
    rid, first = np.unique(table.column("rid").to_numpy(), return_index=True)
    runs = table.column("runs").take(pa.array(first)).combine_chunks()
    runs = pa.concat_arrays(runs.chunks) if isinstance(runs, pa.ChunkedArray) else runs
    return rid, runs.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False)))


def overlaps(flat: np.ndarray, bound: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``rows`` with sets ``columns``, exact: matrix products, some runs at a time."""
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    size = int(shared[-1]) + 1 if len(shared) else 0
    owner = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    keep = count[code] > 1
    code, owner = shared[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    place = [np.full(len(bound) - 1, -1), np.full(len(bound) - 1, -1)]
    place[0][rows], place[1][columns] = np.arange(len(rows)), np.arange(len(columns))
    for begin in range(0, size, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(code, [begin, begin + COLUMNS_AT_ONCE])
        sides = []
        for at, n in zip(place, (len(rows), len(columns)), strict=True):
            mine = at[owner[a:b]] >= 0
            dense = np.zeros((n, min(COLUMNS_AT_ONCE, size - begin)), np.float32)
            dense[at[owner[a:b][mine]], code[a:b][mine] - begin] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T  # counts under 2**24 are exact in single precision
    return out


def _compare_blocks(threshold: float):
    """Pairs at the threshold between two blocks of a group, or within one; sets of 2**24 runs or more do not occur in memory."""

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rid, flat, bound = _columns(table)
        own = dict(zip(table.column("rid").to_pylist(), table.column("own").to_pylist(), strict=True))
        block = np.array([own[x] for x in rid.tolist()])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(rows) or not len(columns):
            return rid, *(np.zeros(0, np.int64),) * 2, np.zeros(0)
        both = overlaps(flat, bound, rows, columns).astype(np.float64)
        size = np.diff(bound)
        both /= size[rows][:, None] + size[columns][None, :] - both
        a, b = np.nonzero(np.triu(both >= threshold, 1) if i == j else both >= threshold)
        return rid, rows[a], columns[b], both[a, b]

    return run


def _tally(rid: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """``rid, n, low``: for each set with a pair, the documents it is linked to, and the least set of its class here."""
    n = np.bincount(a, weight[b], len(rid)).astype(np.int64) + np.bincount(b, weight[a], len(rid)).astype(np.int64)
    low = np.arange(len(rid))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    hit = np.flatnonzero(n)
    return pa.table({"rid": pa.array(rid[hit], pa.int64()), "n": pa.array(n[hit], pa.int64()), "low": pa.array(rid[low[hit]], pa.int64())})


PAIRS, LINKS = "a long, b long, jaccard double", "rid long, n long, low long"


def _result(rid: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, jaccard: np.ndarray, as_pairs: bool) -> pa.Table:
    if not as_pairs:
        return _tally(rid, weight, a, b)
    x, y = rid[a], rid[b]
    return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64()), "jaccard": pa.array(jaccard, pa.float64())})


def _weights(table: pa.Table, rid: np.ndarray) -> np.ndarray:
    ids, first = np.unique(table.column("rid").to_numpy(), return_index=True)
    return table.column("weight").to_numpy()[first][np.searchsorted(ids, rid)]


def _compare_groups(threshold: float, as_pairs: bool):
    compare = _compare_blocks(threshold)

    def run(table: pa.Table) -> pa.Table:
        rid, a, b, jaccard = compare(table)
        return _result(rid, _weights(table, rid), a, b, jaccard, as_pairs)

    return run


def _verify(threshold: float, as_pairs: bool):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        if not sets.num_rows or not pairs.num_rows:
            return _result(*(np.zeros(0, np.int64),) * 4, np.zeros(0), as_pairs)
        rid, flat, bound = _columns(sets)
        _, first = np.unique(sets.column("rid").to_numpy(), return_index=True)
        group = sets.column("part").to_numpy()[first]
        a, b = np.searchsorted(rid, pairs.column("a").to_numpy()), np.searchsorted(rid, pairs.column("b").to_numpy())
        known = (a < len(rid)) & (b < len(rid))
        known[known] = (rid[a[known]] == pairs.column("a").to_numpy()[known]) & (rid[b[known]] == pairs.column("b").to_numpy()[known])
        known[known] = (group[a[known]] < 0) | (group[a[known]] != group[b[known]])  # the others are compared as groups
        a, b = a[known], b[known]
        _, flat = np.unique(flat, return_inverse=True)
        order = np.argsort(a, kind="stable")
        cut = np.append(np.flatnonzero(np.append(True, np.diff(a[order]) != 0)), len(order)) if len(a) else np.zeros(1, np.int64)
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        jaccard = np.zeros(len(a))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            mine = flat[bound[a[order[lo]]] : bound[a[order[lo]] + 1]]
            mark[mine] = 1
            for i in order[lo:hi]:
                both = int(mark[flat[bound[b[i]] : bound[b[i] + 1]]].sum())
                jaccard[i] = both / (len(mine) + int(bound[b[i] + 1] - bound[b[i]]) - both)
            mark[mine] = 0
        keep = jaccard >= threshold
        return _result(rid, _weights(sets, rid), a[keep], b[keep], jaccard[keep], as_pairs)

    return run


def _linked(docs: DataFrame, n: int, threshold: float, recall: float, local: int, group: int, hot: int, as_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs or links of unequal sets, by their ``rid``; the sets, ``h1, h2, size, rid, weight``; and ``doc_id, h1, h2, size``."""
    if not 0 < threshold <= 1 or not 0 < recall < 1 or n < 1:
        raise ValueError("threshold, recall or n is out of range")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    signed = map_arrow(docs, _signatures(n), "doc_id long, h1 long, h2 long, size long, sign binary")
    # the hashes of equal sets are equal, and so are their signatures
    one = materialise(signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "size", "sign")).alias("s")).select("doc_id", "s.*"), "documents")
    sets = materialise(one.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("rid"), F.count("*").alias("weight"), F.min("sign").alias("sign")), "sets")
    pairs, members = candidates(sets.select("rid", "sign"), threshold, recall, local, group, hot)
    tasks = max(1, sets.count() // DOCS_PER_TASK)
    pairs = materialise(pairs.groupBy("a", "b").agg(F.min("leaf").alias("leaf")).select(F.pmod("leaf", F.lit(tasks)).cast("int").alias("task"), "a", "b"), "candidates")
    ends = pairs.select("task", F.col("a").alias("rid")).union(pairs.select("task", F.col("b").alias("rid"))).groupBy("rid").agg(F.collect_set("task").alias("tasks"))
    schema = PAIRS if as_pairs else LINKS
    wanted = sets.select("rid", "h1", "size", "weight").join(ends, "rid", "left")
    grouped = not members.isEmpty()
    if grouped:
        low = members.groupBy("node").agg(F.min("rid").alias("low"))
        parts = materialise(connected_components(members.join(low, "node").select("rid", "low").distinct(), "rid", "low").select(F.col("node").alias("rid"), F.col("component").alias("part")), "groups")
        wanted = wanted.join(parts, "rid", "left").withColumn("part", F.coalesce("part", F.lit(-1).cast("long")))
    else:
        wanted = wanted.withColumn("part", F.lit(-1).cast("long"))
    wanted = materialise(wanted.where("tasks is not null or part >= 0"), "wanted")
    # one way of joining at every size: what is wanted grows with the corpus
    own = ["rid", "weight", "part", "tasks"]
    texts = docs.join(wanted.hint("merge"), docs.doc_id == wanted.rid).select("h1", "text", *own)
    each = map_arrow(texts, _sets_of(n, own), "runs array<long>, rid long, weight long, part long, tasks array<int>")
    if not grouped:
        in_tasks = each.select(F.explode("tasks").alias("task"), "rid", "weight", "part", "runs")
        return in_tasks.groupBy("task").cogroup(pairs.groupBy("task")).applyInArrow(_verify(threshold, as_pairs), schema), sets, one
    each = materialise(each, "runs")
    in_tasks = each.where("tasks is not null").select(F.explode("tasks").alias("task"), "rid", "weight", "part", "runs")
    exact = in_tasks.groupBy("task").cogroup(pairs.groupBy("task")).applyInArrow(_verify(threshold, as_pairs), schema)
    blocks = wanted.where("part >= 0").groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_RUNS)).cast("int").alias("blocks"))
    apart = _in_blocks(each.where("part >= 0").join(blocks, "part"), F.col("blocks")).select("part", "own", "i", "j", "rid", "weight", "runs")
    return exact.unionAll(apart.groupBy("part", "i", "j").applyInArrow(_compare_groups(threshold, as_pairs), schema)), sets, one


_SET = ["h1", "h2", "size"]


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, local: int = LOCAL, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """All pairs of documents at or above the threshold, with the recall asked for; as many rows as there are pairs."""
    exact, sets, one = _linked(docs, n, threshold, recall, local, group, hot, True)
    members = one.select("doc_id", *_SET).join(sets.select(*_SET, "rid"), _SET).select("rid", "doc_id")
    left, right = members.select(F.col("rid").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("rid").alias("b"), F.col("doc_id").alias("y"))
    across = exact.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    same = left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return across.unionAll(same)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, local: int = LOCAL, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """``doc_id, class_id, n_links`` of every document."""
    exact, sets, one = _linked(docs, n, threshold, recall, local, group, hot, False)
    links = materialise(exact, "links")
    count = links.groupBy("rid").agg(F.sum("n").alias("n"))
    component = connected_components(links.where("rid <> low").select("rid", "low"), "rid", "low").withColumnRenamed("node", "rid")
    of_set = sets.select(*_SET, "rid", "weight").join(count, "rid", "left").join(component, "rid", "left")
    of_set = of_set.select(*_SET, F.coalesce("component", "rid").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = one.select("doc_id", *_SET).join(of_set, _SET).select("doc_id", "class_id", "n_links")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, local: int = LOCAL, group: int = GROUP) -> DataFrame:
    """``docs`` without the documents that a chain of pairs links to one of a lower doc_id; rows without doc_id stay."""
    losers = materialise(classes(docs, n, threshold, recall, local, group).where("doc_id <> class_id").select(F.col("doc_id").alias("_loser")), "losers")
    return docs.join(losers, docs["doc_id"].cast("long") == losers["_loser"], "left_anti")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{k.SQL_SPACE}'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {N - 1}, 1))) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos + 1 : pos + {N}], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT doc_a, doc_b FROM j JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE shared::DOUBLE / (x.size + y.size - shared) >= {THRESHOLD}),
b AS (SELECT doc_a AS a, doc_b AS b FROM e UNION ALL SELECT doc_b, doc_a FROM e),
r AS (SELECT DISTINCT a, a AS c FROM b UNION SELECT b.b, r.c FROM r JOIN b ON r.a = b.a WHERE r.c < b.b),
c AS (SELECT a, min(c) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM b GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN c ON c.a = doc_id LEFT JOIN l ON l.a = doc_id
"""
