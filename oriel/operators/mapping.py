"""Mapping queries: tables to triples, template sketches, and alignment with an ontology and taxonomies."""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel import terms as t
from oriel.fixpoint import transitive_closure
from oriel.graph import Graph
from oriel.operators.conformance import Conformance, Declarations, conformance, declarations
from oriel.plans.sparql import TERM, Compiler, Parser
from oriel.sources.reader import query_prefixes

SCRATCH = "urn:oriel:row:"
IGNORED_PREFIXES = ("rdf", "rdfs", "owl", "xsd", "skos")


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, normalise: bool = False) -> DataFrame:
    """A delimited file with all columns as text; tabs for .tsv. Normalised headers are trimmed, lower case, with underscores."""
    df = spark.read.csv(path, header=header, sep=delimiter or ("\t" if path.endswith((".tsv", ".tsv.gz")) else ","))
    names = [c if header else chr(97 + i) for i, c in enumerate(df.columns)]
    if normalise:
        names = [n.strip().lower().replace(" ", "_") for n in names]
    return df.toDF(*names)


def triplify(rows: DataFrame, query: str, prefixes: dict[str, str] | None = None, graph: str = "urn:g/mapped", limit: int | None = None) -> DataFrame:
    """Quads of a CONSTRUCT query over the rows of a table: each column is a variable, an empty cell is unbound.

    One projection: the rows are never joined or shuffled before the final removal of duplicates.
    """
    q = Parser(query, prefixes).query()
    rows = rows.limit(limit) if limit is not None else rows
    cell = lambda c: F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != ""), F.struct(F.col(f"`{c}`").cast("string").alias("value"), F.lit(t.LITERAL).alias("kind"), F.lit(t.XSD + "string").alias("dt"), F.lit(None).cast("string").alias("lang"))).otherwise(F.lit(None).cast(TERM))
    df, names = rows.select(*[cell(c).alias(f"v_{c}") for c in rows.columns]), set(rows.columns)
    c = Compiler(Graph(rows.sparkSession.createDataFrame([], t.QUAD)))
    for item in q.where:
        if item[0] == "bind":
            df, names = df.withColumn(f"v_{item[1]}", c.term(item[2], names)), names | {item[1]}
        elif item[0] == "filter":
            df = df.where(c.test(item[1], names))
        else:
            raise ValueError("a mapping query has BIND and FILTER only")
    out = c.construct(q, q.template, (df, names, names))
    return out.select(F.lit(graph).alias("g"), *t.TRIPLE, F.lit("mapped").alias("src"))


@dataclass(frozen=True)
class Job:
    table: str
    query: str


def discover(tables: list[str], queries: list[str]) -> tuple[list[Job], list[str]]:
    """Tables with the query of the same stem, else with the only query there is; the rest are warned about."""
    find = lambda sources, patterns: sorted({f for s in sources for f in ([s] if not os.path.isdir(s) else [f for p in patterns for f in glob.glob(os.path.join(s, p))])})
    files, texts = find(tables, ("*.csv", "*.tsv", "*.csv.gz", "*.tsv.gz")), find(queries, ("*.rq", "*.sparql", "*.tarql"))
    stem = lambda f: os.path.basename(f).split(".")[0]
    by = {stem(q): q for q in texts}
    jobs, warnings = [], []
    for f in files:
        q = by.get(stem(f)) or (texts[0] if len(texts) == 1 else None)
        if q:
            jobs.append(Job(f, q))
        else:
            warnings.append(f"no query for {f}")
    return jobs, warnings


def sketch_triples(query: str) -> list[tuple]:
    """The triples of a query's template; variables and new nodes become scratch entities."""
    out = []
    for s, p, o in Parser(query).query().template:
        show = lambda x: (x[1] + (None,) * (4 - len(x[1]))) if x[0] == "term" else (x[1], t.IRI, None, None) if x[0] == "iri" else (SCRATCH + x[1], t.IRI, None, None)
        a, b, c = show(s), show(p), show(o)
        out.append((a[0], a[1], b[0], *c))
    return out


def sketch(spark: SparkSession, queries: dict[str, str]) -> Graph:
    return Graph(spark.createDataFrame([("urn:g/sketch", *x, name) for name, text in sorted(queries.items()) for x in sketch_triples(text)], t.QUAD))


def prefix_conflicts(queries: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Merged prefixes of some queries, the first of each name winning, and warnings about the others."""
    out: dict[str, str] = {}
    warnings = []
    for name, text in sorted(queries.items()):
        for p, space in query_prefixes(text).items():
            if out.setdefault(p, space) != space:
                warnings.append(f"{name} binds {p}: to <{space}>, not <{out[p]}>")
    return out, warnings


def prefix_alignment(used: DataFrame, known: DataFrame, ignored: tuple[str, ...] = IGNORED_PREFIXES) -> DataFrame:
    """``file, prefix, namespace, kind``: how prefixes of queries drift from those of an ontology set.

    Both tables have ``file, prefix, namespace``. The empty prefix of the ontologies counts for nothing.
    """
    known = known.where("prefix <> ''")
    names = known.groupBy("prefix").agg(F.collect_set("namespace").alias("spaces"))
    spaces = known.select("namespace").distinct().withColumn("owned", F.lit(True))
    both = used.where(~F.col("prefix").isin(list(ignored))).join(names, "prefix", "left").join(spaces, "namespace", "left")
    kind = F.when(F.col("spaces").isNotNull(), F.when(~F.array_contains("spaces", F.col("namespace")), "namespace_mismatch")).when(F.col("owned"), "prefix_name_mismatch").otherwise("undeclared_namespace")
    return both.select("file", "prefix", "namespace", kind.alias("kind")).where("kind is not null")


def undeclared_terms(known: Declarations, g: Graph) -> Conformance:
    """Classes and properties of a sketch that the ontology lacks."""
    result = conformance(known, g)
    result.rows = {i: result.rows[i] for i in ("CNF-001", "CNF-002")}
    return result


def taxonomy_references(template: Graph, known: Declarations, taxonomy: Graph) -> DataFrame:
    """``property, term``: values written into templates that no taxonomy describes."""
    used = template.where((F.col("p") != t.TYPE) & (F.col("o_kind") == t.IRI) & ~F.col("o").startswith(SCRATCH)).select(F.col("p").alias("property"), F.col("o").alias("term")).distinct()
    described = known.classes.union(known.properties).union(taxonomy.triples.select("s")).toDF("term").distinct()
    return used.join(described, "term", "left_anti").select("property", "term")


def taxonomy_properties(known: Declarations, taxonomy: Graph) -> DataFrame:
    """``p``: properties whose range, or a class below it, has members in the taxonomy."""
    members = taxonomy.types.select("c").distinct()
    below = transitive_closure(known.parents).select(F.col("b").alias("c"), "a")
    held = known.range.join(members, "c", "left_semi").select("p").union(known.range.join(below, "c").join(members.withColumnRenamed("c", "a"), "a", "left_semi").select("p"))
    return held.distinct()


def taxonomy_membership(data: Graph, properties: DataFrame, taxonomy: Graph) -> DataFrame:
    """``subject, property, term``: values of taxonomy properties in data that no taxonomy describes."""
    used = data.where("o_kind = 0").join(properties.withColumnRenamed("p", "_p"), F.col("p") == F.col("_p"), "left_semi")
    return used.join(taxonomy.triples.select(F.col("s").alias("o")).distinct(), "o", "left_anti").select(F.col("s").alias("subject"), F.col("p").alias("property"), F.col("o").alias("term"))


@dataclass
class Layers:
    """The four layers' gaps: template terms, template values, data values, data conformance."""

    terms: DataFrame
    references: DataFrame
    membership: DataFrame
    conformance: DataFrame

    def clean(self) -> bool:
        return all(df.isEmpty() for df in (self.terms, self.references, self.membership, self.conformance))


def four_layers(template: Graph, ontology: Graph, taxonomy: Graph, data: Graph) -> Layers:
    known = declarations(ontology)
    checked = conformance(known, data.union(taxonomy))
    checked.rows.pop("CNF-005")
    return Layers(undeclared_terms(known, template).findings("sketch"), taxonomy_references(template, known, taxonomy), taxonomy_membership(data, taxonomy_properties(known, taxonomy), taxonomy), checked.findings("output-data"))


def recent_repeats(df: DataFrame, order: str, window: int) -> DataFrame:
    """Triples without those that the ``window`` rows before them, in ``order``, already state."""
    by = Window.partitionBy(*t.TRIPLE).orderBy(order)
    before = F.lag(order).over(by)
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(order) - F.col("_before") > window)).drop("_before")


def named_graph_check(template: Graph, live: DataFrame, known: Declarations) -> DataFrame:
    """``kind, term, gap``: template against ontology, live graph against ontology, template against live."""
    use = lambda g: g.types.where(~F.col("c").isin(t.META_TYPES)).select(F.lit("class").alias("kind"), F.col("c").alias("term")).union(g.where((F.col("p") != t.TYPE) & ~F.col("p").isin(t.ANNOTATIONS)).select(F.lit("property").alias("kind"), F.col("p").alias("term"))).distinct()
    a, b = use(template), use(Graph(live))
    c = known.classes.select(F.lit("class").alias("kind"), F.col("c").alias("term")).union(known.properties.select(F.lit("property").alias("kind"), F.col("p").alias("term")))
    gap = lambda x, y, name: x.join(y, ["kind", "term"], "left_anti").withColumn("gap", F.lit(name))
    return gap(a, c, "template lacks ontology term").union(gap(b, c, "live lacks ontology term")).union(gap(a, b, "template term not live")).union(gap(b, a, "live term not in template"))
