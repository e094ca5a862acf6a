"""Metrics of graphs, of schemas induced from use, and of ontologies as authored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel import terms as t
from oriel.fixpoint import component_ids, cyclic, depth, transitive_closure
from oriel.functions import iri
from oriel.graph import Graph
from oriel.operators.conformance import Declarations
from oriel.storage import materialise

UNTYPED = "(untyped)"


def ratio(a: Column, b: Column, digits: int = 3) -> Column:
    return F.when(b > 0, F.round(a.cast("double") / b, digits)).otherwise(F.lit(0.0))


def _entities(g: Graph) -> DataFrame:
    """``n`` and ``degree``: subjects, and non-literal objects other than types.

    Repeats are removed where the triples of a subject meet, so that a subject's degree leaves there as one row.
    Types have no part in degrees: they only name subjects, however often they are stated.
    """
    stated = g.loose()
    one = F.lit(1).cast("long").alias("d")
    ends = F.array(F.struct(F.col("s").alias("n"), one), F.when(F.col("o_kind") < 2, F.struct(F.col("o").alias("n"), one)))
    facts = stated.where(F.col("p") != t.TYPE).repartition("s").distinct().select(F.explode(ends).alias("x")).where("x is not null").select("x.n", "x.d")
    typed = stated.of(t.TYPE).select(F.col("s").alias("n"), F.lit(0).cast("long").alias("d"))
    return facts.unionByName(typed).groupBy("n").agg(F.sum("d").alias("degree"))


def _entity_count(g: Graph) -> DataFrame:
    """The number of entities: found without removing repeated triples first."""
    o = F.when((F.col("p") != t.TYPE) & (F.col("o_kind") < 2), F.col("o"))
    return g.loose().triples.select(F.explode(F.array("s", o)).alias("n")).where("n is not null").distinct().agg(F.count("*").alias("entity_count"))


def _type_counts(g: Graph) -> DataFrame:
    """The numbers of subjects with a type, and with several; every one of them is an entity."""
    kinds = g.loose().of(t.TYPE).select("s", "o").distinct().groupBy("s").agg(F.count("*").alias("k"))
    return kinds.agg(F.count("*").alias("typed"), F.count(F.when(F.col("k") > 1, 1)).alias("multi_typed_entity_count"))


def graph_sizes(g: Graph) -> DataFrame:
    """One row: counts of triples by kind, entities, classes and properties."""
    is_type, literal = F.col("p") == t.TYPE, F.col("o_kind") == 2
    # classes and predicates are few: counted first by each of them, then once more
    each = g.triples.groupBy("p", F.when(is_type, F.col("o")).alias("c"), literal.alias("literal")).agg(F.count("*").alias("k"))
    total = lambda x, name: F.coalesce(F.sum(F.when(x, F.col("k"))), F.lit(0)).alias(name)
    main = each.agg(
        total(F.lit(True), "triple_count"),
        F.countDistinct(F.when(is_type, F.col("c"))).alias("class_count"),
        F.countDistinct(F.when(~is_type, F.col("p"))).alias("property_count"),
        total(is_type, "type_triple_count"),
        total(~is_type & F.col("literal"), "literal_triple_count"),
        total(~is_type & ~F.col("literal"), "object_triple_count"),
    )
    return main.crossJoin(_entity_count(g))


def graph_typing(g: Graph) -> DataFrame:
    """One row: typed, untyped and multiply typed entities."""
    counts = _type_counts(g).crossJoin(_entity_count(g)).withColumnRenamed("entity_count", "entities")
    return counts.select("typed", (F.col("entities") - F.col("typed")).alias("untyped_entity_count"), ratio(F.col("entities") - F.col("typed"), F.col("entities")).alias("untyped_entity_ratio"), "multi_typed_entity_count")


def graph_richness(g: Graph) -> DataFrame:
    """One row: attribute, relationship and class richness, and average population."""
    x = graph_sizes(g).crossJoin(_type_counts(g))
    return x.select(
        ratio(F.col("literal_triple_count"), F.col("entity_count")).alias("attribute_richness"),
        ratio(F.col("object_triple_count"), F.col("object_triple_count") + F.col("type_triple_count")).alias("relationship_richness"),
        ratio(F.col("class_count"), F.col("class_count")).alias("class_richness"),
        ratio(F.col("typed"), F.col("class_count")).alias("average_population"),
    )


def graph_degrees(g: Graph) -> DataFrame:
    return _entities(g).agg(ratio(F.sum("degree"), F.count("*")).alias("average_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def graph_components(g: Graph) -> DataFrame:
    """One row: connected components over object triples, isolated entities included."""
    edges = g.loose().where((F.col("p") != t.TYPE) & (F.col("o_kind") < 2)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    found, _ = component_ids(edges)
    sizes = found.groupBy("root").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    alone = F.col("entity_count") - F.col("nodes")
    return sizes.crossJoin(_entity_count(g)).select((F.col("components") + alone).alias("connected_component_count"), F.greatest("largest", F.least("entity_count", F.lit(1))).alias("largest_component_size"), alone.alias("isolated_entity_count"))


def predicate_table(g: Graph, top: int | None = None) -> DataFrame:
    """Uses, distinct subjects and objects, and kind of range of each predicate but rdf:type."""
    value = F.struct("o", "o_kind", "o_dt", "o_lang")
    literal, resource = F.max(F.col("o_kind") == 2), F.max(F.col("o_kind") < 2)
    out = g.where(F.col("p") != t.TYPE).groupBy(F.col("p").alias("predicate")).agg(
        F.count("*").alias("uses"), F.countDistinct("s").alias("subjects"), F.countDistinct(value).alias("objects"), F.when(literal & resource, "mixed").when(literal, "literal").otherwise("resource").alias("range_kind")
    )
    out = out.orderBy(F.desc("uses"), "predicate")
    return out.limit(top) if top else out


def cross_namespace(iris: DataFrame, column: str) -> DataFrame:
    """Local names that several of the IRIs share."""
    return iris.select(F.col(column).alias("iri")).distinct().groupBy(iri.last_segment(F.col("iri")).alias("local_name")).agg(F.array_sort(F.collect_set("iri")).alias("iris")).where("size(iris) > 1")


def file_table(quads: DataFrame) -> DataFrame:
    """Triples, entities, classes, properties and untyped share of each source file."""
    q = quads.select("src", *t.TRIPLE).distinct()
    is_type = F.col("p") == t.TYPE
    counts = q.groupBy("src").agg(F.count("*").alias("triples"), F.countDistinct(F.when(is_type, F.col("o"))).alias("classes"), F.countDistinct(F.when(~is_type, F.col("p"))).alias("properties"))
    ends = F.array(F.struct(F.col("s").alias("n"), is_type.alias("typed")), F.when(~is_type & (F.col("o_kind") < 2), F.struct(F.col("o").alias("n"), F.lit(False).alias("typed"))))
    nodes = q.select("src", F.explode(ends).alias("x")).where("x is not null").groupBy("src", "x.n").agg(F.max("x.typed").alias("typed"))
    own = nodes.groupBy("src").agg(F.count("*").alias("entities"), F.count(F.when(~F.col("typed"), 1)).alias("untyped"))
    return counts.join(own, "src").withColumn("untyped_ratio", ratio(F.col("untyped"), F.col("entities")))


class Schema:
    """A schema induced from how a graph uses classes and properties; explicit axioms take precedence."""

    def __init__(self, g: Graph):
        # all below is about sets, so repeated triples do no harm and need not be removed first
        self.g = g = g.loose()
        self.types = g.of(t.TYPE).where(~F.col("o").isin(t.CLASS_KINDS)).select("s", F.col("o").alias("c")).distinct()
        self.parents = g.edges(t.SUBCLASS).distinct()
        self.explicit_classes = g.typed(*t.CLASS_KINDS).select(F.col("s").alias("c")).distinct()
        self.classes = self.explicit_classes.union(self.types.select("c")).union(self.parents.select("a")).union(self.parents.select("b")).distinct()
        uses = g.where(~F.col("p").isin(t.TYPE, *t.ANNOTATIONS))
        self.properties = uses.groupBy("p").agg(F.max(F.col("o_kind") == 2).alias("literal"), F.max(F.col("o_kind") < 2).alias("resource"))
        stated = lambda p: g.of(p).select(F.col("s").alias("p"), F.col("o").alias("c")).distinct()
        self.explicit_domain, self.explicit_range = stated(t.DOMAIN), stated(t.RANGE)

        def ends(stated: DataFrame, used: DataFrame) -> DataFrame:
            """``p, c``: as stated, else the types of what the predicate is used with. Predicates are few."""
            used = used.join(F.broadcast(stated.select("p").distinct()), "p", "left_anti")
            found = used.join(self.types, "s", "left").select("p", F.coalesce("c", F.lit(UNTYPED)).alias("c")).distinct()
            return materialise(stated.join(self.properties.select("p"), "p", "left_semi").union(found), "schema")

        # an object can be that of most triples, a subject is not
        self.domain, self.range = ends(self.explicit_domain, uses.select("p", "s")), ends(self.explicit_range, uses.where("o_kind < 2").select("p", F.col("o").alias("s")).distinct())
        self.annotated = g.of(t.LABEL, t.COMMENT).select(F.col("s").alias("c")).distinct()


def class_metrics(schema: Schema) -> DataFrame:
    """Per class: instances, depth, children, ancestors, coupling, own and all properties, tangled, annotated."""
    up = transitive_closure(schema.parents)
    count = lambda df, key, what, name: df.groupBy(F.col(key).alias("c")).agg(F.countDistinct(what).alias(name))
    own = schema.domain.select("c", "p").distinct()
    inherited = up.join(schema.domain.select("p", F.col("c").alias("b")), "b").select(F.col("a").alias("c"), "p")
    d, r = schema.domain.where(F.col("c") != UNTYPED), schema.range.where(F.col("c") != UNTYPED)
    ends = d.select("p", F.col("c").alias("x")).join(r.select("p", F.col("c").alias("y")), "p").where("x <> y")
    coupled = ends.select(F.col("x").alias("c"), F.col("y").alias("z")).union(ends.select("y", "x")).distinct()
    parts = [
        count(schema.types, "c", "s", "instances"), depth(schema.parents).select(F.col("node").alias("c"), F.col("depth").alias("dit")), count(schema.parents, "b", "a", "noc"), count(up, "a", "b", "nac"),
        count(coupled, "c", "z", "cbo"), count(own, "c", "p", "wmc"), count(own.union(inherited), "c", "p", "rfc"), count(schema.parents, "a", "b", "n_parents"), schema.annotated.withColumn("annotated", F.lit(True)),
    ]
    out = reduce(lambda x, y: x.join(y, "c", "left"), parts, schema.classes).na.fill(0)
    return out.select(F.col("c").alias("class"), "instances", "dit", "noc", "nac", "cbo", "wmc", "rfc", (F.col("n_parents") > 1).alias("tangled"), F.coalesce("annotated", F.lit(False)).alias("annotated"))


def schema_richness(schema: Schema) -> DataFrame:
    """One row of richness measures of an induced schema."""
    p = schema.properties.select("p", (F.col("literal") & ~F.col("resource")).alias("datatype"), (~F.col("literal") & F.col("resource")).alias("object"))
    slots = schema.domain.where(F.col("c") != UNTYPED).groupBy("p").agg(F.countDistinct("c").alias("k"))
    props = p.join(slots, "p", "left").agg(F.coalesce(F.sum(F.when(F.col("datatype"), F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)))), F.lit(0)).alias("slots"), F.count(F.when(F.col("object"), 1)).alias("objects"))
    counts = schema.classes.agg(F.count("*").alias("classes")).crossJoin(schema.parents.distinct().agg(F.count("*").alias("edges"))).crossJoin(schema.types.agg(F.countDistinct("c").alias("populated"), F.countDistinct("s").alias("typed"))).crossJoin(props)
    c = F.col
    return counts.select(
        ratio(c("slots"), c("classes")).alias("attribute_richness"), ratio(c("objects"), c("objects") + c("edges")).alias("relationship_richness"), ratio(c("edges"), c("classes")).alias("inheritance_richness"),
        ratio(c("populated"), c("classes")).alias("class_richness"), ratio(c("typed"), c("classes")).alias("average_population"),
    )


def schema_completeness(schema: Schema) -> DataFrame:
    """One row: explicit against induced classes, domains and ranges; annotated terms."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    props = schema.properties.select("p")
    parts = [
        one(schema.classes, "class_count"), one(schema.explicit_classes, "explicit_class_count"), one(props, "property_count"), one(props.join(schema.explicit_domain, "p", "left_semi"), "explicit_domain_count"),
        one(props.join(schema.explicit_range, "p", "left_semi"), "explicit_range_count"), one(schema.classes.join(schema.annotated, "c", "left_semi"), "annotated_class_count"), one(props.join(schema.annotated, F.col("p") == F.col("c"), "left_semi"), "annotated_property_count"),
    ]
    return reduce(DataFrame.crossJoin, parts).withColumn("induced_class_count", F.col("class_count") - F.col("explicit_class_count"))


def declared_richness(known: Declarations, data: Graph) -> DataFrame:
    """One row: richness of the declared schema, populations taken from the data."""
    kinds = known.range.join(known.classes.withColumn("own", F.lit(True)), "c", "left").groupBy("p").agg(F.max(F.col("c").startswith(t.XSD) | (F.col("c") == t.RDFS + "Literal")).alias("datatype"), F.max(F.coalesce("own", F.lit(False))).alias("object"))
    slots = known.domain.join(known.classes, "c", "left_semi").groupBy("p").agg(F.countDistinct("c").alias("k"))
    props = known.properties.join(kinds, "p", "left").join(slots, "p", "left").withColumn("object", F.coalesce("object", F.lit(True))).withColumn("datatype", F.coalesce("datatype", F.lit(False)) & ~F.col("object"))
    sums = props.agg(F.coalesce(F.sum(F.when(F.col("datatype"), F.coalesce("k", F.lit(1)))), F.lit(0)).alias("slots"), F.count(F.when(F.col("object"), 1)).alias("objects"), F.count("*").alias("properties"))
    types = data.of(t.TYPE).select("s", F.col("o").alias("c"))
    counts = known.classes.agg(F.count("*").alias("classes")).crossJoin(known.parents.agg(F.count("*").alias("edges"))).crossJoin(sums).crossJoin(types.agg(F.countDistinct("s").alias("typed"))).crossJoin(known.classes.join(types, "c", "left_semi").agg(F.count("*").alias("populated")))
    c = F.col
    return counts.select(
        ratio(c("slots"), c("classes")).alias("attribute_richness"), ratio(c("objects"), c("objects") + c("edges")).alias("relationship_richness"), ratio(c("edges"), c("classes")).alias("inheritance_richness"),
        ratio(c("populated"), c("classes")).alias("class_richness"), ratio(c("typed"), c("classes")).alias("average_population"), c("classes").alias("class_count"), c("properties").alias("property_count"),
    )


FACETS = ("someValuesFrom", "allValuesFrom", "hasValue", "hasSelf", "cardinality", "minCardinality", "maxCardinality", "qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "onProperty")
EXPRESSIONS = ("unionOf", "intersectionOf", "oneOf", "complementOf")


def property_kinds(ontology: Graph) -> DataFrame:
    """``p, kind``: as declared, else by ranges: datatype where all are datatypes, object where there is any, else unknown."""
    declared = ontology.of(t.TYPE).where(F.col("o").isin(t.PROPERTY_KINDS)).groupBy(F.col("s").alias("p")).agg(F.max(F.col("o") == t.OBJECT_PROPERTY).alias("obj"), F.max(F.col("o") == t.DATATYPE_PROPERTY).alias("dat"), F.max(F.col("o") == t.ANNOTATION_PROPERTY).alias("ann"))
    stated = ontology.where((F.col("p") == t.RANGE) | (iri.last_segment(F.col("p")) == "rangeIncludes")).groupBy(F.col("s").alias("p")).agg(F.min(F.col("o").startswith(t.XSD) | (F.col("o") == t.RDFS + "Literal")).alias("data"))
    both = declared.join(stated, "p", "full")
    return both.select("p", F.when(F.col("obj"), "object").when(F.col("dat"), "datatype").when(F.col("ann"), "annotation").when(F.col("data"), "datatype").when(~F.col("data"), "object").otherwise("unknown").alias("kind"))


def expressivity(ontology: Graph) -> DataFrame:
    """``feature, uses``: axioms, restriction facets, characteristics and anonymous class kinds of an authored ontology."""
    axioms = ["subClassOf", "subPropertyOf", "domain", "range"]
    owl = ["equivalentClass", "disjointWith", "inverseOf", "equivalentProperty", "sameAs", "differentFrom", "propertyChainAxiom", "hasKey", *FACETS, *EXPRESSIONS]
    by_p = ontology.where(F.col("p").isin([t.RDFS + a for a in axioms] + [t.OWL + a for a in owl])).groupBy(iri.last_segment(F.col("p")).alias("feature")).agg(F.count("*").alias("uses"))
    by_type = ontology.of(t.TYPE).where(F.col("o").isin([*t.CHARACTERISTICS, t.OWL + "Restriction", t.OWL + "NamedIndividual"])).groupBy(iri.last_segment(F.col("o")).alias("feature")).agg(F.count("*").alias("uses"))
    old = ontology.of(t.OWL + "deprecated").where("o in ('true', '1')").agg(F.count("*").alias("uses")).select(F.lit("deprecated").alias("feature"), "uses")
    return by_p.union(by_type).union(old.where("uses > 0"))


def anonymous_classes(ontology: Graph) -> DataFrame:
    """``node, kind``: blank class expressions by kind."""
    by_p = ontology.where("s_kind = 1").where(F.col("p").isin([t.OWL + e for e in EXPRESSIONS])).select(F.col("s").alias("node"), iri.last_segment(F.col("p")).alias("kind"))
    restrictions = ontology.of(t.TYPE).where((F.col("s_kind") == 1) & (F.col("o") == t.OWL + "Restriction")).select(F.col("s").alias("node"), F.lit("restriction").alias("kind"))
    return restrictions.union(by_p).groupBy("node").agg(F.max(F.when(F.col("kind") == "restriction", "~restriction").otherwise(F.col("kind"))).alias("kind")).select("node", F.regexp_replace("kind", "~", "").alias("kind"))


def cyclic_classes(ontology: Graph) -> DataFrame:
    return cyclic(ontology.edges(t.SUBCLASS)).where("a = b").select(F.col("a").alias("class"))
