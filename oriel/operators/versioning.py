"""Differences of two ontology versions, the version step they call for, and renamed terms."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel import terms as t
from oriel.fixpoint import descendants
from oriel.functions import iri
from oriel.graph import Graph
from oriel.ship import ship
from oriel.storage import materialise

RESTRICTING = [t.OWL + x + "Property" for x in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")]
FACTS = "fact string, k1 string, k2 string"


def snapshot(g: Graph) -> DataFrame:
    """``fact, k1, k2``: the comparable facts about named terms, written once. Pairs are unordered."""
    named = g.where("s_kind = 0")
    edges = lambda p: named.where((F.col("p") == p) & (F.col("o_kind") == 0)).select("s", "o")
    fact = lambda name, df, a="s", b="o": df.select(F.lit(name).alias("fact"), F.col(a).alias("k1"), (F.col(b) if b else F.lit("")).alias("k2"))
    pair = lambda name, p: edges(p).where("s <> o").select(F.lit(name).alias("fact"), F.least("s", "o").alias("k1"), F.greatest("s", "o").alias("k2"))
    typed = lambda kinds: named.where((F.col("p") == t.TYPE) & F.col("o").isin(kinds)).select("s", "o")
    sub, domain, ranges, traits = edges(t.SUBCLASS), edges(t.DOMAIN), edges(t.RANGE), typed(t.CHARACTERISTICS)
    classes = typed(t.CLASS_KINDS).select("s").union(sub.select("s")).union(sub.select("o"))
    properties = typed(t.PROPERTY_KINDS).select("s").union(domain.select("s")).union(ranges.select("s")).union(traits.select("s"))
    notes = named.where(F.col("p").isin(t.LABEL, t.COMMENT, t.PREF_LABEL)).select("s", F.concat_ws(" ", "p", "o").alias("o"))
    notes = notes.join(classes.union(properties).distinct(), "s", "left_semi")
    parts = [
        fact("class", classes, b=None), fact("property", properties, b=None), fact("subclass", sub), pair("disjoint", t.OWL + "disjointWith"), pair("equivalent_class", t.OWL + "equivalentClass"),
        pair("equivalent_property", t.OWL + "equivalentProperty"), fact("domain", domain), fact("range", ranges), fact("characteristic", traits), fact("annotation", notes),
    ]
    return materialise(reduce(DataFrame.unionByName, parts).distinct(), "snapshot")


def _ends(old: DataFrame, new: DataFrame, which: str, common: DataFrame) -> DataFrame:
    """``change, fact, k1, k2`` for domains or ranges: widened or narrowed, by sets expanded with subclasses."""

    def sets(facts: DataFrame, name: str) -> DataFrame:
        own = facts.where(F.col("fact") == which).select(F.col("k1").alias("p"), F.col("k2").alias("c"))
        below = descendants(facts.where("fact = 'subclass'").select(F.col("k1").alias("a"), F.col("k2").alias("b")))
        full = own.join(below, F.col("c") == F.col("a"), "left").select("p", "c", F.coalesce("b", "c").alias("x"))
        return full.groupBy("p").agg(F.array_sort(F.collect_set("c")).alias(name), F.collect_set("x").alias(name + "_all"))

    both = common.join(sets(old, "o"), "p", "left").join(sets(new, "n"), "p", "left")
    for c in ("o", "o_all", "n", "n_all"):
        both = both.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    change = (
        F.when(F.col("o") == F.col("n"), None).when(F.size("o") == 0, "narrowed").when(F.size("n") == 0, "widened").when(F.size(F.array_except("o_all", "n_all")) == 0, "widened").otherwise("narrowed")
    )
    return both.select(change.alias("change"), F.lit(which).alias("fact"), F.col("p").alias("k1"), F.concat(F.array_join("o", ", "), F.lit(" -> "), F.array_join("n", ", ")).alias("k2")).where("change is not null")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, fact, k1, k2``: added, removed, widened, narrowed and changed facts of two snapshots."""
    plain = ["class", "property", "subclass", "disjoint", "equivalent_class", "equivalent_property"]
    key = ["fact", "k1", "k2"]
    whole = lambda x, y, change: x.where(F.col("fact").isin(plain)).join(y, key, "left_anti").select(F.lit(change).alias("change"), *key)
    shared = lambda kinds: old.where(F.col("fact").isin(kinds)).select(F.col("k1").alias("p")).intersect(new.where(F.col("fact").isin(kinds)).select(F.col("k1").alias("p")))
    common = shared(["property"])
    traits = lambda x, y, change: x.where("fact = 'characteristic'").join(y, key, "left_anti").join(common, F.col("k1") == F.col("p"), "left_semi").select(F.lit(change).alias("change"), *key)
    terms = old.where("fact in ('class', 'property')").select(F.col("k1").alias("p")).distinct().intersect(new.where("fact in ('class', 'property')").select(F.col("k1").alias("p")).distinct())
    notes = lambda x, y: x.where("fact = 'annotation'").join(y, key, "left_anti").select("k1")
    changed = notes(old, new).union(notes(new, old)).distinct().join(terms, F.col("k1") == F.col("p"), "left_semi").select(F.lit("changed").alias("change"), F.lit("annotation").alias("fact"), "k1", F.lit("").alias("k2"))
    parts = [whole(new, old, "added"), whole(old, new, "removed"), _ends(old, new, "domain", common), _ends(old, new, "range", common), traits(new, old, "added"), traits(old, new, "removed"), changed]
    return reduce(DataFrame.unionByName, parts)


def bump(changes: DataFrame) -> DataFrame:
    """One row, ``bump``: MAJOR, MINOR, PATCH or NONE."""
    c, f = F.col("change"), F.col("fact")
    major = ((c == "removed") & f.isin("class", "property", "subclass", "equivalent_class", "equivalent_property")) | ((c == "added") & (f == "disjoint")) | (c == "narrowed") | ((c == "added") & (f == "characteristic") & F.col("k2").isin(RESTRICTING))
    level = F.when(major, 3).when(c == "changed", 1).otherwise(2)
    top = changes.agg(F.coalesce(F.max(level), F.lit(0)).alias("n"))
    return top.select(F.element_at(F.array(*[F.lit(x) for x in ("NONE", "PATCH", "MINOR", "MAJOR")]), F.col("n") + 1).alias("bump"))


LEAST_RATIO, SCALE = 0.6, 0.85


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@dataclass(frozen=True)
class Rename:
    kind: str
    old: str
    new: str
    confidence: float
    reason: str


def rename_candidates(old: DataFrame, new: DataFrame, new_graph: Graph) -> DataFrame:
    """``kind, old, new, confidence, reason`` of removed and added terms that may be one another.

    Similar names are only compared where their lengths allow the least ratio at all: a ratio of r needs
    the shorter to have r / (2 - r) of the longer's length.
    """
    ship(old.sparkSession)
    gone = old.where("fact in ('class', 'property')").join(new, ["fact", "k1", "k2"], "left_anti").select(F.col("fact").alias("kind"), F.col("k1").alias("old"))
    come = new.where("fact in ('class', 'property')").join(old, ["fact", "k1", "k2"], "left_anti").select(F.col("fact").alias("kind"), F.col("k1").alias("new"))
    same = new_graph.edges(t.OWL + "equivalentClass", t.OWL + "equivalentProperty")
    moved = new_graph.where(F.col("p").endswith("isReplacedBy") & (F.col("o_kind") == 0)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    told = same.union(same.select("b", "a")).union(moved).toDF("old", "new").distinct()
    explicit = gone.join(told, "old").join(come, ["kind", "new"]).select("kind", "old", "new", F.lit(1.0).alias("confidence"), F.lit("annotation").alias("reason"))
    a, b = gone.withColumn("x", iri.local_name(F.col("old"))), come.withColumn("y", iri.local_name(F.col("new")))
    equal = a.join(b, (a.kind == b.kind) & (F.col("x") == F.col("y"))).select(a.kind, "old", "new", F.lit(1.0).alias("confidence"), F.lit("same name").alias("reason"))
    least = LEAST_RATIO / (2 - LEAST_RATIO)
    fits = (a.kind == b.kind) & (F.col("x") != F.col("y")) & (F.least(F.length("x"), F.length("y")) >= least * F.greatest(F.length("x"), F.length("y")))
    similar = F.pandas_udf(_similarity, "double")
    close = a.join(b, fits).withColumn("ratio", similar("x", "y")).where(F.col("ratio") >= LEAST_RATIO).select(a.kind, "old", "new", (F.col("ratio") * SCALE).alias("confidence"), F.lit("similar name").alias("reason"))
    return explicit.unionByName(equal).unionByName(close)


def match(candidates: DataFrame) -> list[Rename]:
    """One-to-one, greedily: annotations first, then equal names, then the most similar."""
    order = {"annotation": 0, "same name": 1, "similar name": 2}
    rows = sorted(candidates.collect(), key=lambda r: (order[r.reason], -r.confidence, r.old, r.new))
    used_old, used_new, out = set(), set(), []
    for r in rows:
        if r.old not in used_old and r.new not in used_new:
            used_old.add(r.old)
            used_new.add(r.new)
            out.append(Rename(r.kind, r.old, r.new, round(r.confidence, 4), r.reason))
    return out
