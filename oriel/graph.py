"""A graph: quads with set semantics, and the views that checks share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel import terms as t
from oriel.storage import materialise


class Graph:
    """Triples of one graph or of a merge of several.

    A view with a constant predicate filters before duplicates are removed, so the filter reaches the
    scan, and branches of a mapping that cannot produce the predicate are pruned.
    """

    def __init__(self, quads: DataFrame, distinct: bool = False):
        self.quads = quads
        self._all = quads.select(*t.TRIPLE)
        self._distinct = distinct

    @cached_property
    def triples(self) -> DataFrame:
        return self._all if self._distinct else self._all.distinct()

    def loose(self) -> "Graph":
        """The same graph for rules that ignore how often a triple is stated: none is removed, so nothing is shuffled."""
        return Graph(self.quads, distinct=True)

    def where(self, condition) -> DataFrame:
        return self.triples.where(condition)

    def of(self, *predicates: str) -> DataFrame:
        return self.where(F.col("p").isin(list(predicates)) if len(predicates) > 1 else F.col("p") == predicates[0])

    @cached_property
    def types(self) -> DataFrame:
        """``s, s_kind, c, c_kind``: resources and their types."""
        return self.of(t.TYPE).where("o_kind < 2").select("s", "s_kind", F.col("o").alias("c"), F.col("o_kind").alias("c_kind"))

    def typed(self, *classes: str) -> DataFrame:
        """``s, s_kind`` of the resources with one of the types."""
        return self.of(t.TYPE).where(F.col("o").isin(list(classes)) & (F.col("o_kind") == 0)).select("s", "s_kind").distinct()

    def edges(self, *predicates: str) -> DataFrame:
        """``a, b``: subjects and non-literal objects of the predicates."""
        return self.of(*predicates).where("o_kind < 2").select(F.col("s").alias("a"), F.col("o").alias("b"))

    def union(self, *others: "Graph") -> "Graph":
        """The merge of graphs; identical triples are one."""
        quads = self.quads
        for other in others:
            quads = quads.unionByName(other.quads, allowMissingColumns=True)
        return Graph(quads)

    def named(self, *graphs: str) -> "Graph":
        """The merge of some named graphs."""
        return Graph(self.quads.where(F.col("g").isin(list(graphs))))

    def stored(self) -> "Graph":
        """Written once, clustered by predicate, so that later scans for one prune row groups."""
        return Graph(materialise(self.triples.repartitionByRange(F.col("p"), F.col("s")).sortWithinPartitions("p", "s"), "graph"), distinct=True)
