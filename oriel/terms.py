"""RDF vocabulary and the quad schema."""

from __future__ import annotations

from pyspark.sql import types as T

IRI, BLANK, LITERAL = 0, 1, 2
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCTERMS = "http://purl.org/dc/terms/"
W3C = "http://www.w3.org/"
TYPE = RDF + "type"
LABEL, COMMENT, SUBCLASS, DOMAIN, RANGE, SEE_ALSO = (RDFS + x for x in ("label", "comment", "subClassOf", "domain", "range", "seeAlso"))
PREF_LABEL = SKOS + "prefLabel"
OBJECT_PROPERTY, DATATYPE_PROPERTY, ANNOTATION_PROPERTY, CLASS, ONTOLOGY = (OWL + x for x in ("ObjectProperty", "DatatypeProperty", "AnnotationProperty", "Class", "Ontology"))
PROPERTY = RDF + "Property"
PROPERTY_KINDS = [OBJECT_PROPERTY, DATATYPE_PROPERTY, ANNOTATION_PROPERTY, PROPERTY]
CLASS_KINDS = [CLASS, RDFS + "Class"]
CHARACTERISTICS = [OWL + x + "Property" for x in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")]
#: What an rdf:type may point to without being declared.
META_TYPES = [
    *(OWL + x for x in ("Thing", "Nothing", "Restriction", "NamedIndividual", "AllDisjointClasses", "AllDisjointProperties", "AllDifferent", "NegativePropertyAssertion", "Axiom")),
    *CLASS_KINDS, ONTOLOGY, *PROPERTY_KINDS, *CHARACTERISTICS, RDFS + "Resource", RDFS + "Datatype",
]
ANNOTATIONS = [LABEL, COMMENT, *(SKOS + x for x in ("prefLabel", "altLabel", "hiddenLabel", "definition", "note", "scopeNote", "example", "historyNote", "editorialNote", "changeNote"))]
UNIVERSAL = [OWL + "Thing", RDFS + "Resource"]
#: Focus of findings about a graph as a whole.
WHOLE_GRAPH = "urn:oriel:graph"

QUAD = T.StructType(
    [
        T.StructField("g", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("s_kind", T.IntegerType()),
        T.StructField("p", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("o_kind", T.IntegerType()),
        T.StructField("o_dt", T.StringType()),
        T.StructField("o_lang", T.StringType()),
        T.StructField("src", T.StringType()),
    ]
)
TRIPLE = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
