"""An RDF view of the test tables, with an ontology that is flawed on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oriel import terms as t
from oriel.graph import Graph
from oriel.relational import Column, quads

K, C, R = "urn:k/", "urn:c/", "urn:t/"
IRI, B, L = t.IRI, t.BLANK, t.LITERAL
_key = lambda kind, column: f"concat('{R}{kind}/', cast({column} AS string))"
_day = "cast(cast(o_orderdate AS date) AS string)"

COLUMNS = [
    Column("region", _key("region", "r_regionkey"), t.TYPE, f"'{K}Region'", IRI),
    Column("region", _key("region", "r_regionkey"), t.LABEL, "r_name", L, language="en"),
    Column("nation", _key("nation", "n_nationkey"), t.TYPE, f"'{K}Nation'", IRI),
    Column("nation", _key("nation", "n_nationkey"), C + "region", _key("region", "n_regionkey"), IRI),
    Column("nation", _key("nation", "n_nationkey"), t.LABEL, "n_name", L, where="n_nationkey % 2 = 0"),
    Column("nation", _key("nation", "n_nationkey"), t.LABEL, "n_name", L, language="en", where="n_nationkey % 2 = 1"),
    Column("customer", _key("customer", "c_custkey"), t.TYPE, f"'{K}Customer'", IRI, where="c_mktsegment = 'BUILDING'"),
    Column("customer", _key("customer", "c_custkey"), C + "nation", _key("nation", "c_nationkey"), IRI),
    Column("customer", _key("customer", "c_custkey"), C + "segment", "c_mktsegment", L),
    Column("supplier", _key("supplier", "s_suppkey"), t.TYPE, f"'{K}Supplier'", IRI),
    Column("supplier", _key("supplier", "s_suppkey"), t.TYPE, f"'{K}Customer'", IRI, where="s_suppkey % 10 = 0"),
    Column("supplier", _key("supplier", "s_suppkey"), C + "nation", _key("nation", "s_nationkey"), IRI),
    Column("part", _key("part", "p_partkey"), t.TYPE, f"concat('{K}part_', p_type)", IRI),
    Column("part", _key("part", "p_partkey"), C + "brand", f"concat('{R}brand/', p_brand)", IRI),
    Column("part", _key("part", "p_partkey"), C + "size", "p_size", L, t.XSD + "integer"),
    Column("part", _key("part", "p_partkey"), t.PREF_LABEL, "p_name", L, language="en", where="p_partkey % 3 = 0"),
    Column("orders", _key("order", "o_orderkey"), t.TYPE, f"'{K}Order'", IRI),
    Column("orders", _key("order", "o_orderkey"), C + "customer", _key("customer", "o_custkey"), IRI),
    Column("orders", _key("order", "o_orderkey"), C + "placed", _day, L, t.XSD + "date", where="o_orderstatus <> 'F'"),
    Column("orders", _key("order", "o_orderkey"), C + "placed", f"concat(substr({_day}, 9, 2), '/', substr({_day}, 6, 2), '/', substr({_day}, 1, 4))", L, t.XSD + "date", where="o_orderstatus = 'F'"),
    Column("orders", _key("order", "o_orderkey"), C + "priority", "o_orderpriority", L),
    Column("lineitem", "concat('urn:t/line/', cast(l_orderkey AS string), '-', cast(l_linenumber AS string))", C + "part", _key("part", "l_partkey"), IRI),
    Column("lineitem", "concat('urn:t/line/', cast(l_orderkey AS string), '-', cast(l_linenumber AS string))", C + "flag", "l_returnflag", L),
    Column("lineitem", "concat('urn:t/line/', cast(l_orderkey AS string), '-', cast(l_linenumber AS string))", C + "flag", "l_returnflag", L, language="en", where="l_returnflag = 'A'"),
    Column("events", _key("user", "user_id"), C + "event", _key("event", "event_id"), IRI),
    Column("events", _key("user", "user_id"), C + "pinged", f"concat('{R}user/', cast(event_id % 40 AS string))", IRI),
    Column("events", _key("user", "user_id"), C + "state", f"concat('{K}', event_type)", IRI),
]

_i = lambda s, p, o: (s, IRI, p, o, IRI, None, None)
_l = lambda s, p, o, dt="string", lang=None: (s, IRI, p, o, L, (t.RDF + "langString") if lang else t.XSD + dt, lang)
O = "http://example.org/shop#"  # noqa: E741
ONTOLOGY: list[tuple] = [
    _i(O, t.TYPE, t.ONTOLOGY),
    _i(O, t.OWL + "versionIRI", "https://example.org/shop/1"),
    _i("https://example.org/bare", t.TYPE, t.ONTOLOGY),
    _l(O, t.OWL + "versionInfo", "1"),
    *(_i(K + c, t.TYPE, t.CLASS) for c in ("Region", "Nation", "Customer", "Supplier", "Order", "Place", "Party", "Thing", "Agent", "Empty")),
    _i(O + "Term", t.TYPE, t.CLASS),
    _i(K + "old_Kind", t.TYPE, t.CLASS),
    *(_i(K + a, t.SUBCLASS, K + b) for a, b in (("Region", "Place"), ("Nation", "Place"), ("Place", "Spot"), ("Spot", "Area"), ("Area", "Zone"), ("Zone", "Field"), ("Field", "Extent"), ("Extent", "Thing"), ("Customer", "Party"), ("Supplier", "Party"), ("Party", "Agent"), ("Loop1", "Loop2"), ("Loop2", "Loop1"))),
    _i(K + "Customer", t.OWL + "disjointWith", K + "Supplier"),
    _i(K + "Nation", t.OWL + "disjointWith", K + "Thing"),
    _i(K + "Party", t.OWL + "equivalentClass", K + "Agent"),
    *(_i(C + p, t.TYPE, t.OBJECT_PROPERTY) for p in ("region", "nation", "customer", "part", "pinged", "near", "inside", "holds", "state")),
    *(_i(C + p, t.TYPE, t.DATATYPE_PROPERTY) for p in ("size", "placed", "Segment_code", "flag")),
    _i(C + "part", t.TYPE, t.OWL + "FunctionalProperty"),
    _i(C + "pinged", t.TYPE, t.OWL + "AsymmetricProperty"),
    _i(C + "pinged", t.TYPE, t.OWL + "IrreflexiveProperty"),
    _i(C + "near", t.TYPE, t.OWL + "SymmetricProperty"),
    _i(C + "inside", t.TYPE, t.OWL + "TransitiveProperty"),
    _i(C + "near", t.DOMAIN, K + "Nation"), _i(C + "near", t.RANGE, K + "Region"),
    _i(C + "inside", t.DOMAIN, K + "Place"), _i(C + "inside", t.RANGE, K + "Spot"),
    _i(C + "nation", t.DOMAIN, K + "Party"), _i(C + "nation", t.RANGE, K + "Nation"),
    _i(C + "region", t.DOMAIN, K + "Nation"), _i(C + "region", t.RANGE, K + "Region"),
    _i(C + "customer", t.DOMAIN, K + "Order"), _i(C + "customer", t.RANGE, K + "Customer"),
    _i(C + "placed", t.DOMAIN, K + "Order"), _i(C + "placed", t.RANGE, t.XSD + "dateTime"),
    _i(C + "size", t.DOMAIN, K + "Goods"), _i(C + "size", t.RANGE, t.XSD + "integer"),
    _i(C + "inside", t.OWL + "inverseOf", C + "holds"), _i(C + "keeps", t.OWL + "inverseOf", C + "inside"), _i(C + "near", t.OWL + "inverseOf", C + "near"),
    _l(C + "priority", t.OWL + "deprecated", "true", "boolean"),
    _l(K + "Order", t.LABEL, "Order", lang="en"), _l(K + "Place", t.LABEL, "Place"), _l(K + "Customer", t.PREF_LABEL, "Client", lang="en"), _l(K + "Nation", t.PREF_LABEL, "nation", lang="en"),
    _i(K + "click", t.TYPE, t.OWL + "Nothing"),
    _i(C + "dash-ed", t.TYPE, t.OBJECT_PROPERTY),
    (K + "Party", IRI, t.SUBCLASS, "b01", B, None, None),
    ("b01", B, t.TYPE, t.OWL + "Restriction", IRI, None, None), ("b01", B, t.OWL + "onProperty", C + "nation", IRI, None, None), ("b01", B, t.OWL + "someValuesFrom", K + "Nation", IRI, None, None),
    (K + "Place", IRI, t.OWL + "equivalentClass", "b02", B, None, None), ("b02", B, t.OWL + "unionOf", "b03", B, None, None),
    ("b03", B, t.RDF + "first", K + "Region", IRI, None, None), ("b03", B, t.RDF + "rest", "b04", B, None, None),
    ("b04", B, t.RDF + "first", K + "Nation", IRI, None, None), ("b04", B, t.RDF + "rest", "b05", B, None, None),
    ("b05", B, t.RDF + "first", K + "Zone", IRI, None, None), ("b05", B, t.RDF + "rest", t.RDF + "nil", IRI, None, None),
    (K + "Order", IRI, t.SUBCLASS, "b06", B, None, None), ("b06", B, t.TYPE, t.OWL + "Restriction", IRI, None, None), ("b06", B, t.OWL + "maxCardinality", "2", L, t.XSD + "integer", None), ("b06", B, t.OWL + "onProperty", C + "customer", IRI, None, None),
]
_P, _CELL, _SHELF = f"concat('{K}p/', cast({{}} AS string))", "concat('c', cast({} AS string))", f"concat('{R}shelf/', cast(cast(floor(p_partkey / 8) AS bigint) AS string))"
_p = _P.format("p_partkey")
#: A class hierarchy with cycles and labels, and collections, of as many terms as there are parts.
CATALOGUE = [
    Column("part", _p, t.TYPE, f"'{t.CLASS}'", IRI),
    Column("part", _p, t.SUBCLASS, _P.format("cast(floor(p_partkey / 4) AS bigint)"), IRI, where="p_partkey >= 4"),
    Column("part", _p, t.SUBCLASS, _P.format("p_partkey + 1"), IRI, where="p_partkey % 50 = 0"),
    Column("part", _p, t.SUBCLASS, _P.format("p_partkey - 1"), IRI, where="p_partkey % 50 = 1 AND p_partkey > 1"),
    Column("part", _p, t.OWL + "equivalentClass", _P.format("cast(floor(p_partkey / 4) AS bigint)"), IRI, where="p_partkey % 97 = 0"),
    Column("part", _p, t.LABEL, "p_name", L, language="en", where="p_partkey % 3 = 1"),
    Column("part", _p, t.LABEL, "p_name", L, where="p_partkey % 3 = 2"),
    Column("part", _SHELF, C + "holds", _CELL.format("p_partkey"), B, where="p_partkey % 8 = 0"),
    Column("part", _CELL.format("p_partkey"), t.RDF + "first", _p, IRI, subject_kind=B),
    Column("part", _CELL.format("p_partkey"), t.RDF + "rest", _CELL.format("p_partkey + 1"), B, where="p_partkey % 8 <> 7", subject_kind=B),
    Column("part", _CELL.format("p_partkey"), t.RDF + "rest", f"'{t.RDF}nil'", IRI, where="p_partkey % 8 = 7", subject_kind=B),
]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def shop(spark: SparkSession, sf_dir: str) -> Graph:
    """The mapped tables with their ontology."""
    return Graph(quads(tables(spark, sf_dir), COLUMNS, ONTOLOGY))


def data(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(quads(tables(spark, sf_dir), COLUMNS))


def catalogue(spark: SparkSession, sf_dir: str) -> Graph:
    """The hierarchy and collections of parts, with the ontology."""
    return Graph(quads(tables(spark, sf_dir), CATALOGUE, ONTOLOGY))


def ontology(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([("urn:g/ontology", *x, "inline") for x in ONTOLOGY], t.QUAD))
