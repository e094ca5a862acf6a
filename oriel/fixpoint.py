"""Fixpoint operators over edge tables.

Two forms compute the same: below ``ONE_TASK`` edges (checked by counting) one task walks the edges in
memory, above it a loop of joins runs on the cluster, with its lineage cut each round. The loops double
path lengths, so their rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.ship import ship
from oriel.storage import materialise, release

ONE_TASK = 200_000
#: Rounds of the depth that go level by level.
LEVELS = 64


def _small(edges: DataFrame, limit: int) -> bool:
    return edges.limit(limit + 1).count() <= limit


def _in_one_task(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, schema)


def _reach(start: str, nexts: dict[str, list[str]]) -> set[str]:
    seen: set[str] = set()
    stack = list(nexts.get(start, ()))
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            stack.extend(nexts.get(node, ()))
    return seen


def closure_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    nexts = defaultdict(list)
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        nexts[a].append(b)
    rows = [(a, b) for a in list(nexts) for b in _reach(a, nexts)]
    return pd.DataFrame(rows, columns=["a", "b"])


def transitive_closure(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``a, b``: every node and what it reaches over one edge or more. Cycles reach themselves."""
    edges = edges.select("a", "b").where("a is not null and b is not null").distinct()
    if _small(edges, one_task):
        return _in_one_task(edges, closure_pairs, "a string, b string")
    # ``known`` has all paths up to a length, ``power`` those of that length alone: a pair with one path is made once
    known = power = materialise(edges, "closure")
    count = known.count()
    while True:
        then = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        more = materialise(known.union(then(power, known)).distinct(), "closure")
        grown = more.count()
        spent = [known] if power is known else [known, power]
        if grown == count:
            release(*spent)
            return more
        twice = materialise(then(power, power).distinct(), "closure")
        release(*spent)
        known, power, count = more, twice, grown


def cyclic(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``a, b``: pairs of nodes of one cycle, each with itself as well.

    Edges that nothing leads to, or that lead to nothing, are on no cycle: they are taken off while that takes off a
    tenth at least, and only what is left is closed.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null").distinct()
    if not _small(edges, one_task):
        edges = materialise(edges, "cyclic")
        count = edges.count()
        while True:
            inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
            inner = materialise(inner.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "cyclic")
            release(edges)
            before, count, edges = count, inner.count(), inner
            if count > 0.9 * before or not count:
                break
    pairs = transitive_closure(edges, one_task)
    return pairs.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


def descendants(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``a, b``: every node and all that is below it, itself included."""
    pairs = transitive_closure(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), one_task)
    nodes = edges.select("a").union(edges.select("b")).distinct()
    return pairs.union(nodes.select("a", F.col("a").alias("b"))).distinct()


def depths(pdf: pd.DataFrame) -> pd.DataFrame:
    """Longest path to a root; an edge within a cycle counts nothing."""
    nexts = defaultdict(list)
    nodes = dict.fromkeys([*pdf["a"], *pdf["b"]])
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        nexts[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    group: dict[str, int] = {}
    path: list[str] = []
    depth: dict[int, int] = {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(nexts.get(root, ())))]
        index[root] = low[root] = len(index)
        path.append(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    path.append(other)
                    work.append((other, iter(nexts.get(other, ()))))
                    break
                if other not in group:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = len(depth)
                    members = []
                    while True:
                        member = path.pop()
                        group[member] = own
                        members.append(member)
                        if member == node:
                            break
                    depth[own] = max((depth[group[n]] + 1 for m in members for n in nexts.get(m, ()) if group[n] != own), default=0)
    return pd.DataFrame([(n, depth[group[n]]) for n in nodes], columns=["node", "depth"])


def depth(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, depth``: the longest way up, over the condensation of cycles.

    The distributed form takes off the edges to roots, level by level. What is deeper than ``LEVELS`` is done by
    doubling longest paths between pairs.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null").distinct()
    if _small(edges, one_task):
        return _in_one_task(edges, depths, "node string, depth long")
    edges = materialise(edges, "depth")
    mutual = materialise(cyclic(edges, one_task).groupBy("a").agg(F.min("b").alias("g")).select(F.col("a").alias("n"), "g"), "depth")
    name = lambda df, c: df.join(mutual.withColumnRenamed("n", c), c, "left").withColumn(c, F.coalesce("g", c)).drop("g")
    left = materialise(name(name(edges, "a"), "b").where("a <> b").select("a", "b").distinct(), "depth")
    # a node is as deep as there are rounds in which it leads anywhere
    levels = []
    while len(levels) < LEVELS and not left.isEmpty():
        levels.append(materialise(left.select("a").distinct(), "depth"))
        former, left = left, materialise(left.join(levels[-1].withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "depth")
        release(former)
    one = F.lit(1).cast("long").alias("d")
    best = reduce(DataFrame.union, [x.select("a", one) for x in levels], left.select("a", one).limit(0))
    if not left.isEmpty():
        best = best.union(_longest(left))
    best = best.groupBy("a").agg(F.sum("d").alias("d"))
    nodes = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node").join(mutual, F.col("node") == F.col("n"), "left").withColumn("r", F.coalesce("g", "node"))
    return nodes.join(best, F.col("r") == F.col("a"), "left").select("node", F.coalesce("d", F.lit(0)).cast("long").alias("depth"))


def _longest(edges: DataFrame) -> DataFrame:
    """``a, d``: the longest way up from each node of an acyclic graph, by doubling."""
    longest = materialise(edges.select("a", "b", F.lit(1).cast("long").alias("d")), "depth")
    total = None
    while True:
        more = longest.alias("x").join(longest.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.d") + F.col("y.d")).alias("d"))
        former, longest = longest, materialise(longest.union(more).groupBy("a", "b").agg(F.max("d").alias("d")), "depth")
        release(former)
        state = longest.agg(F.count("*"), F.sum("d")).first()
        if tuple(state) == total:
            break
        total = tuple(state)
    return longest.groupBy("a").agg(F.max("d").alias("d"))


def component_ids(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """``id, root``, one row for each node of an edge, and ``node, id``.

    Nodes are numbered by a hash; if two have the same, another seed is taken. In each round a node goes to the least
    number among itself and its neighbours, and edges go with their ends: this shrinks stars to one node in two rounds.
    Null ends and loops are ignored; nodes without edges don't occur.
    """
    stated = edges.select(F.col(a).alias("u"), F.col(b).cast(edges.schema[a].dataType).alias("v")).where("u is not null and v is not null and u <> v")
    seed = 0
    while True:
        number = lambda c: F.xxhash64(c, F.lit(seed))  # noqa: B023, E731
        nodes = materialise(stated.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("id", number("node")), "components")
        if nodes.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
        release(nodes)
        seed += 1
    pairs, steps, former = stated.select(number("u").alias("u"), number("v").alias("v")), [], None
    while True:
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        steps.append(materialise(both.groupBy("e.u").agg(F.min("e.v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("root")), "components"))
        to = lambda c: steps[-1].select(F.col("id").alias(c), F.col("root").alias("to"))
        moved = pairs.join(to("u"), "u").select(F.col("to").alias("u"), "v").join(to("v"), "v").select("u", F.col("to").alias("v")).where("u <> v")
        pairs = materialise(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components")
        if former is not None:
            release(former)
        former = pairs
        if pairs.isEmpty():
            break
    found = steps.pop()
    while steps:
        last = steps.pop()
        small = found.count() <= ONE_TASK  # many nodes may have the same root
        onward = found.select(F.col("id").alias("root"), F.col("root").alias("to"))
        found = materialise(last.join(F.broadcast(onward) if small else onward, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "components")
    return found, nodes


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node that each node of an edge is connected to."""
    found, nodes = component_ids(edges, a, b)
    named = materialise(nodes.join(found, "id").select("node", "root"), "components")
    least = materialise(named.groupBy("root").agg(F.min("node").alias("component")), "components")
    return named.join(F.broadcast(least) if least.count() <= ONE_TASK else least, "root").select("node", "component")


def frontier(roots: DataFrame | None, triples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Concise bounded descriptions: ``root`` and the triples of each root, through blank objects.

    Without ``roots`` every IRI that is a subject is one. Only pairs of roots and blank nodes take part in the rounds.
    """
    columns = columns or triples.columns
    if roots is None:
        own, first = triples.where("s_kind = 0").withColumn("root", F.col("s")), lambda inner: inner.where("s_kind = 0").withColumn("root", F.col("s"))
    else:
        names = roots.select("s").distinct()
        own, first = triples.join(names, "s", "left_semi").withColumn("root", F.col("s")), lambda inner: inner.join(names, "s", "left_semi").withColumn("root", F.col("s"))
    inner = materialise(triples.where("o_kind = 1").select("s", "s_kind", "o").distinct(), "description")
    found = materialise(first(inner).select("root", F.col("o").alias("s")).where("root <> s").distinct(), "description")
    parts = [found]
    while not found.isEmpty():
        seen = reduce(DataFrame.unionByName, parts)
        if len(parts) > 16:
            seen, old = materialise(seen, "description"), parts
            parts = [seen]
            release(*old)
            found = None
        step = (parts[0] if found is None else found).join(inner, "s").select("root", F.col("o").alias("s")).where("root <> s").distinct()
        found = materialise(step.join(seen, ["root", "s"], "left_anti"), "description")
        parts.append(found)
    below = triples.where("s_kind = 1").join(reduce(DataFrame.unionByName, parts), "s")
    return own.select("root", *columns).unionByName(below.select("root", *columns)).distinct()


def list_members(first: DataFrame, rest: DataFrame, nil: str) -> DataFrame:
    """``head, position, member`` of RDF collections; ``first`` and ``rest`` have ``a, b``. Cycles end there.

    Pointer doubling: each round doubles how far every cell sees ahead.
    """
    ahead = materialise(rest.where(F.col("b") != nil).select("a", "b", F.lit(1).cast("long").alias("d")).distinct(), "list")
    heads = first.select("a").distinct().join(rest.select(F.col("b").alias("a")), "a", "left_anti")
    reach = materialise(heads.select(F.col("a").alias("head"), F.col("a").alias("cell"), F.lit(0).cast("long").alias("position")), "list")
    jump = ahead
    while not jump.isEmpty():
        further = reach.join(jump, F.col("cell") == F.col("a")).select("head", F.col("b").alias("cell"), (F.col("position") + F.col("d")).alias("position"))
        grown = materialise(reach.unionByName(further).groupBy("head", "cell").agg(F.min("position").alias("position")), "list")
        if grown.count() == reach.count():
            break
        reach = grown
        jump = materialise(jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.d") + F.col("y.d")).alias("d")).where("a <> b"), "list")
    return reach.join(first.select(F.col("a").alias("cell"), F.col("b").alias("member")), "cell").select("head", "position", "member")


def nearest_named(triples: DataFrame, hops: int = 4) -> DataFrame:
    """``node, owner``: for blank nodes, the least IRI among the nearest that lead to them in ``hops`` steps."""
    incoming = triples.where("o_kind = 1").select(F.col("o").alias("node"), F.col("s").alias("up"), F.col("s_kind").alias("k")).distinct()
    state = incoming
    found = state.where("k = 0").select("node", F.col("up").alias("owner"), F.lit(1).alias("d"))
    for i in range(2, hops + 1):
        state = state.where("k = 1").alias("x").join(incoming.alias("y"), F.col("x.up") == F.col("y.node")).select(F.col("x.node"), F.col("y.up"), F.col("y.k")).distinct()
        found = found.unionByName(state.where("k = 0").select("node", F.col("up").alias("owner"), F.lit(i).alias("d")))
    return found.groupBy("node").agg(F.min(F.struct("d", "owner")).alias("m")).select("node", "m.owner")
