"""The registry's checks as joins, anti-joins and aggregations over triples."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel import findings
from oriel import terms as t
from oriel.fixpoint import transitive_closure
from oriel.functions import iri
from oriel.graph import Graph
from oriel.plans import sparql
from oriel.registry import CHECKS, RULES, Check, rule
from oriel.storage import materialise

DEEP_HOPS = 6
BLANK_SHARE = 0.2
FAN_OUT = 50
SIDE_BY_SIDE = 8


def _rows(df: DataFrame, focus, path=None, value=None, message: Column | None = None) -> DataFrame:
    column = lambda x: F.lit(x).cast("string") if x is None else F.col(x) if isinstance(x, str) else x
    return df.select(column(focus).alias("focus"), column(path).alias("path"), column(value).alias("value"), column(message).alias("message"))


def _say(*parts) -> Column:
    return F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])


def _without(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    # an outer join: the planner would copy an anti-join into each branch of the mapping's union
    return df.join(other.select(F.col(right).alias("_key")).distinct(), F.col(left) == F.col("_key"), "left").where("_key is null").drop("_key")


def _with(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other.select(F.col(right).alias("_key")).distinct(), F.col(left) == F.col("_key")).drop("_key")


def _with_predicates(df: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows with one of the predicates. Predicates are few and each has a large part of the rows, so these are not moved."""
    return df.join(F.broadcast(terms.select(F.col("s").alias("_key")).distinct()), F.col("p") == F.col("_key")).drop("_key")


def _without_predicates(df: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows whose predicate is none of the resources, of which there may be many."""
    other = _without(df.select("p").distinct(), terms, "p", "s").select(F.col("p").alias("s"))
    return _with_predicates(df, other)


@rule("STR-001")
def undeclared_class(g: Graph) -> DataFrame:
    used = g.types.where((F.col("c_kind") == t.IRI) & ~F.col("c").isin(t.META_TYPES))
    return _rows(_without(used, g.typed(*t.CLASS_KINDS, t.OWL + "Restriction"), "c", "s"), "s", None, "c", _say("$s", " has the type ", "$c", ", which is not declared"))


@rule("STR-002")
def undeclared_property(g: Graph) -> DataFrame:
    used = g.where((F.col("p") != t.TYPE) & ~iri.is_w3c(F.col("p"))).select("s", "p")
    return _rows(_without_predicates(used, g.typed(*t.PROPERTY_KINDS)).distinct(), "s", "p", None, _say("$p", " is used on ", "$s", " but not declared"))


@rule("STR-003")
def no_domain_or_range(g: Graph) -> DataFrame:
    stated = g.where(F.col("p").isin(t.DOMAIN, t.RANGE) | F.col("p").endswith("domainIncludes") | F.col("p").endswith("rangeIncludes"))
    return _rows(_without(g.typed(t.OBJECT_PROPERTY, t.DATATYPE_PROPERTY), stated, "s", "s"), "s", None, None, _say("$s", " states neither a domain nor a range"))


@rule("STR-004")
def undefined_class(g: Graph) -> DataFrame:
    defining = g.of(*(t.OWL + x for x in ("equivalentClass", "intersectionOf", "unionOf", "oneOf", "disjointWith")), t.SUBCLASS)
    known = defining.select("s").union(g.of(t.OWL + "disjointWith").where("o_kind < 2").select("o"))
    named = g.typed(t.CLASS).where((F.col("s_kind") != t.BLANK) & ~iri.is_w3c(F.col("s")))
    return _rows(_without(named, known, "s", "s"), "s", None, None, _say("No axiom defines ", "$s"))


@rule("STR-005")
def untyped_domain(g: Graph) -> DataFrame:
    return _rows(_without(g.of(t.DOMAIN), g.types, "o", "s"), "s", F.lit(t.DOMAIN), "o", _say("The domain ", "$o", " of ", "$s", " has no type"))


@rule("STR-006")
def untyped_object(g: Graph) -> DataFrame:
    used = g.where((F.col("o_kind") == t.IRI) & ~F.col("p").isin(t.TYPE, t.OWL + "imports", t.OWL + "versionIRI") & ~iri.is_w3c(F.col("p")) & ~iri.is_w3c(F.col("o")))
    return _rows(_without(used, g.types, "o", "s"), "s", "p", "o", _say("$o", " is an object of ", "$s", " but has no type"))


@rule("STR-007")
def untyped_predicate(g: Graph) -> DataFrame:
    used = _without_predicates(g.where(~iri.is_w3c(F.col("p"))), g.types)
    return _rows(used, "p", None, findings.joined(F.array("s", "o")), _say("$p", " is used on ", "$s", " but has no type"))


@rule("STR-008")
def untyped_range(g: Graph) -> DataFrame:
    ranges = _with(g.of(t.RANGE), g.typed(t.OBJECT_PROPERTY), "s", "s")
    return _rows(_without(ranges, g.types, "o", "s"), "s", F.lit(t.RANGE), "o", _say("The range ", "$o", " of ", "$s", " has no type"))


@rule("STR-009")
def untyped_subject(g: Graph) -> DataFrame:
    used = g.where((F.col("p") != t.TYPE) & (F.col("s_kind") != t.BLANK) & ~iri.is_w3c(F.col("s")))
    return _rows(_without(used, g.types, "s", "s"), "s", "p", "o", _say("$s", " uses ", "$p", " but has no type"))


@rule("LOG-001")
def disjoint_ancestor(g: Graph) -> DataFrame:
    both = transitive_closure(g.edges(t.SUBCLASS)).join(g.edges(t.OWL + "disjointWith"), ["a", "b"])
    return _rows(both, "a", F.lit(f"({t.SUBCLASS})+"), "b", _say("$a", " is below ", "$b", " and disjoint with it"))


@rule("LOG-002")
def functional_violation(g: Graph) -> DataFrame:
    # least and greatest text are found by sorting: once, after the rows have moved
    several = _with_predicates(g.triples.select("s", "p", "o"), g.typed(t.OWL + "FunctionalProperty")).repartition("s", "p").groupBy("s", "p").agg(F.min("o").alias("low"), F.max("o").alias("high")).where("low <> high")
    return _rows(several, "s", "p", None, _say("$p", " of ", "$s", " has the values ", "$low", " and ", "$high"))


@rule("LOG-003")
def redundant_equivalence(g: Graph) -> DataFrame:
    both = g.edges(t.OWL + "equivalentClass").join(g.edges(t.SUBCLASS), ["a", "b"]).where("a <> b")
    return _rows(both, "a", F.lit(t.OWL + "equivalentClass"), "b", _say("$a", " is both a subclass and an equivalent of ", "$b"))


@rule("LOG-004")
def several_inverses(g: Graph) -> DataFrame:
    stated = g.edges(t.OWL + "inverseOf")
    each = stated.union(stated.select("b", "a")).toDF("p", "q").where(F.col("q").contains(":")).groupBy("p").agg(F.array_sort(F.collect_set("q")).alias("qs")).where("size(qs) > 1")
    pair = each.select("p", F.explode(F.expr("flatten(transform(qs, (x, i) -> transform(slice(qs, i + 2, size(qs)), y -> struct(x as x, y as y))))")).alias("e"))
    return _rows(pair, "p", F.lit(t.OWL + "inverseOf"), F.concat_ws(", ", "e.x", "e.y"), F.concat("p", F.lit(" has the inverses "), "e.x", F.lit(" and "), "e.y"))


@rule("LOG-005")
def own_inverse(g: Graph) -> DataFrame:
    return _rows(g.edges(t.OWL + "inverseOf").where("a = b"), "a", F.lit(t.OWL + "inverseOf"), "b", _say("$a", " is declared its own inverse"))


def _ends_differ(g: Graph, kind: str) -> DataFrame:
    domains, ranges = g.of(t.DOMAIN).select("s", F.col("o").alias("d")), g.of(t.RANGE).select("s", F.col("o").alias("r"))
    pairs = g.typed(t.OWL + kind).join(domains, "s").join(ranges, "s").where("d <> r")
    return _rows(pairs, "s", F.lit(f"{t.DOMAIN}, {t.RANGE}"), findings.joined(F.array("d", "r")), _say("$s", " has the domain ", "$d", " but the range ", "$r"))


@rule("LOG-006")
def symmetric_ends(g: Graph) -> DataFrame:
    return _ends_differ(g, "SymmetricProperty")


@rule("LOG-007")
def transitive_ends(g: Graph) -> DataFrame:
    return _ends_differ(g, "TransitiveProperty")


@rule("QUA-001")
def term_without_label(g: Graph) -> DataFrame:
    terms = g.typed(t.CLASS, t.OBJECT_PROPERTY, t.DATATYPE_PROPERTY).where(F.col("s_kind") == t.IRI)
    return _rows(_without(terms, g.of(t.LABEL, t.PREF_LABEL), "s", "s"), "s", F.lit(t.LABEL), None, _say("$s", " has no label"))


@rule("QUA-002")
def bare_ontology(g: Graph) -> DataFrame:
    described = g.of(t.OWL + "versionInfo", t.DCTERMS + "title", t.LABEL, t.PREF_LABEL)
    return _rows(_without(g.typed(t.ONTOLOGY), described, "s", "s"), "s", None, None, _say("$s", " has no title, version or label"))


@rule("QUA-003")
def deprecated_in_use(g: Graph) -> DataFrame:
    old = g.of(t.OWL + "deprecated").where("o_kind = 2 and o in ('true', '1')").select(F.col("s").alias("term")).distinct()
    # types are terms as well: few, and each in many rows
    used = g.triples.select("s", F.col("p").alias("term")).union(g.types.select("s", "c")).join(F.broadcast(old), "term").distinct()
    return _rows(used, "s", "term", None, _say("$s", " uses ", "$term", ", which is deprecated"))


@rule("QUA-004")
def resource_without_label(g: Graph) -> DataFrame:
    places = F.array(F.struct(F.col("s").alias("n"), F.col("s_kind").alias("k")), F.struct(F.col("p").alias("n"), F.lit(t.IRI).alias("k")), F.struct(F.col("o").alias("n"), F.col("o_kind").alias("k")))
    nodes = g.triples.select(F.explode(places).alias("x")).where((F.col("x.k") == t.IRI) & ~iri.is_w3c(F.col("x.n"))).select(F.col("x.n").alias("n")).distinct()
    exempt = g.of(t.LABEL, t.PREF_LABEL).select("s").union(g.of(t.OWL + "versionIRI", t.SEE_ALSO).where("o_kind = 0").select("o"))
    return _rows(_without(nodes, exempt, "n", "s"), "n", F.lit(t.PREF_LABEL), None, _say("$n", " has no label"))


@rule("QUA-005")
def no_header(g: Graph) -> DataFrame:
    counted = g.typed(t.ONTOLOGY).agg(F.count("*").alias("n")).where("n = 0")
    return _rows(counted, F.lit(t.WHOLE_GRAPH), None, None, F.lit("The graph declares no ontology"))


@rule("QUA-006")
def iri_as_namespace(g: Graph) -> DataFrame:
    terms = g.typed(t.CLASS, *t.PROPERTY_KINDS).where(F.col("s_kind") == t.IRI).select(F.col("s").alias("term"), iri.namespace(F.col("s")).alias("ns"))
    return _rows(terms.join(g.typed(t.ONTOLOGY), F.col("ns") == F.col("s")), "s", None, "term", _say("$s", " is also the namespace of ", "$term"))


@rule("QUA-007")
def no_version_iri(g: Graph) -> DataFrame:
    return _rows(_without(g.typed(t.ONTOLOGY), g.of(t.OWL + "versionIRI"), "s", "s"), "s", None, None, _say("$s", " has no version IRI"))


@rule("QUA-008")
def plain_http(g: Graph) -> DataFrame:
    headers = g.typed(t.ONTOLOGY)
    versions = _with(g.of(t.OWL + "versionIRI"), headers, "s", "s").select("s", F.col("o").alias("id"))
    return _rows(headers.select("s", F.col("s").alias("id")).union(versions).where(~F.col("id").startswith("https://")).distinct(), "s", None, "id", _say("$id", " of ", "$s", " does not start with https"))


@rule("EFF-001")
def deep_chain(g: Graph, hops: int = DEEP_HOPS) -> DataFrame:
    edge = g.edges(t.SUBCLASS).where("a <> b")
    path = edge.select(F.col("a").alias("c0"), F.col("b").alias("c1"))
    for i in range(1, hops):
        path = path.join(edge, F.col(f"c{i}") == F.col("a")).where(F.col("b") != F.col("c0")).select("c0", F.col("b").alias(f"c{i + 1}")).distinct()
    return _rows(path, "c0", None, f"c{hops}", _say("$c0", f" is {hops} steps below ", f"$c{hops}"))


@rule("EFF-002")
def many_blanks(g: Graph, share: float = BLANK_SHARE) -> DataFrame:
    ends = F.array(F.struct(F.col("s").alias("n"), F.col("s_kind").alias("k")), F.struct(F.col("o").alias("n"), F.col("o_kind").alias("k")))
    nodes = g.triples.select(F.explode(ends).alias("x")).where("x.k < 2").select("x.n", "x.k").distinct()
    total = nodes.agg(F.count("*").alias("total"), F.sum((F.col("k") == t.BLANK).cast("long")).alias("blank")).where(F.col("blank") / F.col("total") > share)
    return _rows(total, F.lit(t.WHOLE_GRAPH), None, None, F.concat(F.round(F.col("blank") * 100.0 / F.col("total"), 1).cast("string"), F.lit(" percent of the nodes are blank")))


@rule("EFF-003")
def fan_out(g: Graph, most: int = FAN_OUT) -> DataFrame:
    counted = g.where(F.col("p") != t.TYPE).groupBy("s", "p").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return _rows(counted, "s", "p", None, F.concat("s", F.lit(" has "), F.col("n").cast("string"), F.lit(" values of "), "p"))


@rule("STY-001")
def class_name(g: Graph) -> DataFrame:
    named = g.typed(t.CLASS).where((F.col("s_kind") == t.IRI) & ~iri.local_name(F.col("s")).rlike("^[A-Z][0-9A-Za-z]*$"))
    return _rows(named, "s", None, None, _say("The class name of ", "$s", " is not in upper camel case"))


@rule("STY-002")
def property_name(g: Graph) -> DataFrame:
    named = g.typed(t.OBJECT_PROPERTY, t.DATATYPE_PROPERTY).where((F.col("s_kind") == t.IRI) & ~iri.local_name(F.col("s")).rlike("^[a-z][0-9A-Za-z]*$"))
    return _rows(named, "s", None, None, _say("The property name of ", "$s", " is not in lower camel case"))


@rule("STY-003")
def untagged_label(g: Graph) -> DataFrame:
    return _rows(g.of(t.LABEL).where("o_kind = 2 and coalesce(o_lang, '') = ''"), "s", F.lit(None).cast("string"), "o", _say("The label of ", "$s", " has no language"))


@rule("STY-004")
def drifted_label(g: Graph) -> DataFrame:
    terms = g.typed(t.CLASS, t.DATATYPE_PROPERTY, t.OBJECT_PROPERTY, t.ANNOTATION_PROPERTY).where(~iri.is_w3c(F.col("s"))).select("s")
    labels = g.of(t.PREF_LABEL).select("s", "o").distinct().join(terms, "s").where(iri.flat(iri.local_name(F.col("s"))) != iri.flat(F.col("o")))
    return _rows(labels, "s", F.lit(t.PREF_LABEL), "o", _say("The label ", "$o", " does not fit the name of ", "$s"))


@rule("STY-005")
def mixed_separators(g: Graph) -> DataFrame:
    local = iri.local_name(F.col("s"))
    found = g.typed(t.CLASS, t.DATATYPE_PROPERTY, t.OBJECT_PROPERTY).select(F.regexp_replace(local, r"[0-9A-Za-z]+([^0-9A-Za-z:/# ])[0-9A-Za-z]+.*", "$1").alias("x")).where(F.col("x").rlike("[^0-9A-Za-z:/# ]"))
    many = found.agg(F.array_sort(F.collect_set("x")).alias("xs")).where("size(xs) > 1")
    return _rows(many, F.lit(t.WHOLE_GRAPH), None, F.array_join("xs", "|"), F.concat(F.lit("Names use several separators: "), F.array_join("xs", " ")))


_PORTABLE = [("date", r"^-?\d{4}-\d\d-\d\d(?:Z|[-+]\d\d:\d\d)?$"), ("integer", r"^[-+]?\d+$"), ("boolean", r"^(0|1|false|true)$")]


@rule("DAT-001")
def bad_literal(g: Graph) -> DataFrame:
    bad = reduce(lambda x, y: x | y, [(F.col("o_dt") == t.XSD + name) & ~F.col("o").rlike(pattern) for name, pattern in _PORTABLE])
    return _rows(g.where((F.col("o_kind") == t.LITERAL) & bad), "s", "p", "o", _say("$o", " is not a valid ", "$o_dt"))


def ill_typed_literals(g: Graph) -> DataFrame:
    """The supplement of DAT-001: literals outside the value space of any known XSD type."""
    bad = g.where((F.col("o_kind") == t.LITERAL) & F.col("o_dt").startswith(t.XSD) & iri.ill_typed(F.col("o"), F.col("o_dt")))
    return _rows(bad, "s", "p", "o", _say("$o", " is not in the value space of ", "$o_dt"))


@rule("DAT-002")
def dangling_reference(g: Graph) -> DataFrame:
    used = g.where((F.col("o_kind") == t.IRI) & ~F.col("p").isin(t.TYPE, t.SEE_ALSO) & ~iri.is_w3c(F.col("o")))
    known = g.triples.select("s").union(g.types.select("c")).union(g.of(t.OWL + "versionIRI").where("o_kind = 0").select("o"))
    return _rows(_without(used, known, "o", "s"), "s", "p", "o", _say("$o", " is referred to by ", "$s", " but never described"))


@rule("DAT-003")
def repeated_literal(g: Graph) -> DataFrame:
    # more than one triple is more than one kind, datatype or language: least and greatest of them differ, however often each is stated
    rest = F.struct("s_kind", "o_dt", "o_lang")
    counted = g.where(F.col("o_kind") == t.LITERAL).repartition("s", "p", "o").groupBy("s", "p", "o").agg(F.min(rest).alias("low"), F.max(rest).alias("high")).where("not (low <=> high)")
    return _rows(counted, "s", "p", None, _say("$o", " is stated more than once for ", "$p", " of ", "$s"))


@rule("REA-001")
def disjoint_membership(g: Graph) -> DataFrame:
    stated = g.edges(t.OWL + "disjointWith").where("a <> b")
    pairs = stated.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first, second = g.types.select("s", F.col("c").alias("a")), g.types.select("s", F.col("c").alias("b"))
    both = first.join(pairs, "a").join(second, ["s", "b"])
    return _rows(both, "s", None, F.concat_ws(", ", "a", "b"), _say("$s", " is a member of ", "$a", " and ", "$b", ", which are disjoint"))


@rule("REA-002")
def asymmetric_both_ways(g: Graph) -> DataFrame:
    there = _with_predicates(g.where("o_kind < 2 and s <> o"), g.typed(t.OWL + "AsymmetricProperty")).select("s", "p", "o").distinct()
    back = there.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return _rows(there.join(back, ["s", "p", "o"]), "s", "p", "o", _say("$p", " holds both ways between ", "$s", " and ", "$o"))


@rule("REA-003")
def irreflexive_loop(g: Graph) -> DataFrame:
    return _rows(_with_predicates(g.where("o_kind < 2 and s = o"), g.typed(t.OWL + "IrreflexiveProperty")), "s", "p", None, _say("$p", " relates ", "$s", " to itself"))


@rule("REA-004")
def empty_class_member(g: Graph) -> DataFrame:
    return _rows(g.types.where(F.col("c") == t.OWL + "Nothing"), "s", None, None, _say("$s", " is a member of the empty class"))


#: What stays meaningful on a deductive closure.
CLOSURE_SAFE = ["LOG-001", "LOG-002", "LOG-004", "LOG-005", "REA-001", "REA-002", "REA-003", "REA-004"]


#: Rules whose findings, merged, do not depend on how often a triple is stated.
SET_INSENSITIVE = {f"STR-{i:03}" for i in range(1, 10)} | {f"QUA-{i:03}" for i in range(1, 9)} | {f"STY-{i:03}" for i in range(1, 6)} | {"LOG-002", "LOG-003", "LOG-004", "LOG-005", "EFF-002", "DAT-001", "DAT-002", "DAT-003", "REA-001", "REA-002", "REA-003", "REA-004"}


def apply_rule(g: Graph, check_id: str) -> DataFrame:
    """The rows of a rule; only rules that count triples need them to be distinct."""
    return RULES[check_id](g.loose() if check_id in SET_INSENSITIVE else g)


def run_check(g: Graph, check_id: str, source: str = "spark") -> DataFrame:
    """Merged findings of one check."""
    return findings.merge(findings.make(apply_rule(g, check_id), CHECKS[check_id], source))


@dataclass
class Outcome:
    """What became of one check."""

    check_id: str
    source: str
    findings: int = 0
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Own:
    """A check of a project: a query that selects ?focus and, if need be, ?path, ?value and ?message."""

    check: Check
    query: str


def own_checks(registry: str | Path, folder: str | Path | None = None) -> list[Own]:
    """Checks of a JSON list of ``id, category, severity, title, remediation`` and ``query``, the name of a file in
    ``folder`` (by default that of the registry) or the text itself. Ids must be new and unique."""
    base, own, seen = Path(folder or Path(registry).parent), [], set(CHECKS)
    for x in json.loads(Path(registry).read_text()):
        if missing := [k for k in ("id", "severity", "title", "query") if not x.get(k)]:
            raise ValueError(f"{registry}: a check lacks {', '.join(missing)}")
        if x["id"] in seen:
            raise ValueError(f"{registry}: {x['id']} is there already")
        if x["severity"] not in findings.RANK:
            raise ValueError(f"{registry}: {x['id']} has the severity {x['severity']}")
        seen.add(x["id"])
        path = base / x["query"]
        text = x["query"] if "{" in x["query"] else path.read_text()
        own.append(Own(Check(x["id"], x.get("category", "custom"), x["severity"], x["title"], x.get("remediation", "")), text))
    return own


def outcome_log(outcomes: list[Outcome]) -> str:
    """A line for each check, those that failed last."""
    lines = [f"{o.check_id}\t{o.source}\t" + (f"failed: {o.error}" if o.error else f"{o.findings} findings\t{o.seconds:.1f} s") for o in sorted(outcomes, key=lambda o: (bool(o.error), o.check_id))]
    return "\n".join(lines) + "\n"


def run_all(g: Graph, ids: list[str] | None = None, source: str = "spark", literals: bool = True, own: list[Own] = (), outcomes: list[Outcome] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Merged findings of the given checks, of all by default, and of a project's own. A graph out of files should be stored first.

    The key of a finding has its check's id, so each check is merged by itself. They are planned and run
    side by side, and written to the shared folder: the whole is a union of small tables, not one plan
    of some forty joins. Where ``outcomes`` is given, it gets what became of each check, and one that fails
    does not stop the others; without it the first failure is raised. Where ``columns`` are given, of the key and
    of what is the same for all of a check, only these are written, and messages and sources are never made.
    """

    def rows_of(check_id: str) -> DataFrame:
        rows = findings.make(apply_rule(g, check_id), CHECKS[check_id], source)
        if check_id == "DAT-001" and literals and ids is None:
            rows = rows.unionByName(findings.make(ill_typed_literals(g), CHECKS["DAT-001"], "literal-typing"))
        return rows

    def one(job: tuple[Check, str, Callable[[], DataFrame]]) -> tuple[Outcome, DataFrame | None]:
        check, by, rows = job
        began, outcome = time.time(), Outcome(check.id, by)
        try:
            found = materialise(findings.keys_of(rows(), check).select(*columns) if columns else findings.merge(rows()), "findings")
            if outcomes is not None:
                outcome.findings = found.count()
        except Exception as e:
            if outcomes is None:
                raise
            outcome.error, found = " ".join(str(e).split())[:500] or type(e).__name__, None
        outcome.seconds = time.time() - began
        return outcome, found

    jobs = [(CHECKS[i], source, partial(rows_of, i)) for i in ids or sorted(RULES)]
    jobs += [(x.check, "sparql", lambda x=x: findings.make(sparql.check_rows(g, x.query), x.check, "sparql")) for x in own]
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        done = list(pool.map(one, jobs))
    if outcomes is not None:
        outcomes.extend(o for o, _ in done)
    found = findings.union([x for _, x in done if x is not None], g.quads.sparkSession)
    return found.select(*columns) if columns else found
