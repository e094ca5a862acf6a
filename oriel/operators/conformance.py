"""Conformance of a data graph to a separately supplied ontology.

Several domains or ranges of a property are alternatives, and a subclass of one satisfies it. What has
no type at all cannot be judged: it is counted, not reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel import findings
from oriel import terms as t
from oriel.fixpoint import transitive_closure
from oriel.graph import Graph
from oriel.registry import CHECKS


@dataclass
class Declarations:
    """What an ontology states explicitly, nothing induced. Columns: ``c``; ``p``; ``p, c``; ``p, c``; ``a, b``; ``s``."""

    classes: DataFrame
    properties: DataFrame
    domain: DataFrame
    range: DataFrame
    parents: DataFrame
    annotated: DataFrame


def declarations(ontology: Graph) -> Declarations:
    pair = lambda p: ontology.of(p).where("o_kind < 2").select(F.col("s").alias("p"), F.col("o").alias("c"))
    domain, ranges, parents = pair(t.DOMAIN), pair(t.RANGE), ontology.edges(t.SUBCLASS)
    classes = ontology.typed(*t.CLASS_KINDS).select(F.col("s").alias("c")).union(parents.select("a")).union(parents.select("b")).distinct()
    properties = ontology.typed(*t.PROPERTY_KINDS).select(F.col("s").alias("p")).union(domain.select("p")).union(ranges.select("p")).distinct()
    return Declarations(classes, properties, domain, ranges, parents, ontology.of(t.LABEL, t.COMMENT).select("s").distinct())


def _used(data: Graph) -> DataFrame:
    return data.where(~F.col("p").isin(t.TYPE, *t.ANNOTATIONS, t.SUBCLASS, t.DOMAIN, t.RANGE))


def _judged(uses: DataFrame, node: str, allowed: DataFrame, types: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``p, node, verdict`` of each use of a constrained property: true, false, or null for an untyped node.

    ``uses`` has ``p`` and ``node``. The alternatives of each property are expanded by the classes below
    them, so one equi-join on property and type decides, whatever the depth of the hierarchy.
    """
    universal = allowed.where(F.col("c").isin(t.UNIVERSAL)).select("p").distinct()
    constrained = allowed.select("p").distinct().join(universal, "p", "left_anti")
    below = allowed.join(ancestors, F.col("c") == F.col("b")).select("p", F.col("a").alias("c")).union(allowed.select("p", "c")).distinct().withColumn("fits", F.lit(True))
    pairs = uses.select("p", F.col(node).alias("node")).join(constrained, "p").groupBy("p", "node").agg(F.count("*").alias("n"))
    typed = pairs.join(types.select(F.col("s").alias("node"), "c"), "node", "left").join(below, ["p", "c"], "left")
    return typed.groupBy("p", "node").agg(F.first("n").alias("n"), F.when(F.max(F.col("c").isNotNull()), F.coalesce(F.max("fits"), F.lit(False))).alias("verdict"))


@dataclass
class Conformance:
    """Rows of ``focus, path, value, message`` by check, and counts of what could not be judged."""

    rows: dict[str, DataFrame]
    unverifiable_domain: DataFrame
    unverifiable_range: DataFrame

    def findings(self, source: str = "data") -> DataFrame:
        spark = self.unverifiable_domain.sparkSession
        return findings.merge(findings.union([findings.make(df, CHECKS[i], source) for i, df in self.rows.items()], spark))


def conformance(known: Declarations, data: Graph) -> Conformance:
    ancestors = transitive_closure(known.parents)
    uses = _used(data)
    declared = uses.join(known.properties, "p", "left_semi")
    classes = data.types.where(~F.col("c").isin(t.META_TYPES)).select("c").distinct().join(known.classes, "c", "left_anti")
    predicates = uses.select("p").distinct().join(known.properties, "p", "left_anti")
    types = data.types.select("s", "c").distinct()
    domain = _judged(declared, "s", known.domain, types, ancestors)
    resources = _judged(declared.where("o_kind < 2"), "o", known.range, types, ancestors)
    datatypes = known.range.where(F.col("c").startswith(t.XSD))
    open_to_all = known.range.where(F.col("c") == t.RDFS + "Literal").select("p").distinct()
    literals = declared.where("o_kind = 2").join(datatypes.select("p").distinct().join(open_to_all, "p", "left_anti"), "p").select("p", "o", F.coalesce("o_dt", F.lit(t.XSD + "string")).alias("c")).distinct()
    ill = literals.join(datatypes, ["p", "c"], "left_anti").select("p", F.col("o").alias("node"))
    unpopulated = known.classes.join(types.select("c").distinct(), "c", "left_anti")
    row = lambda df, focus, path, value, *say: df.select(F.col(focus).alias("focus"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), (F.col(value) if value else F.lit(None)).cast("string").alias("value"), F.concat(*[F.col(x[1:]) if x.startswith("$") else F.lit(x) for x in say]).alias("message"))
    return Conformance(
        {
            "CNF-001": row(classes, "c", None, None, "$c", " is used as a type but not declared"),
            "CNF-002": row(predicates, "p", None, None, "$p", " is used but not declared"),
            "CNF-003": row(domain.where("verdict = false"), "p", None, "node", "$node", " uses ", "$p", " but is outside its domain"),
            "CNF-004": row(resources.where("verdict = false").select("p", "node").union(ill), "p", None, "node", "$node", " is outside the range of ", "$p"),
            "CNF-005": row(unpopulated, "c", None, None, "$c", " has no members"),
        },
        domain.where("verdict is null").groupBy("p").agg(F.sum("n").alias("n")),
        resources.where("verdict is null").groupBy("p").agg(F.sum("n").alias("n")),
    )
