"""Checks, conformance, metrics and versions on small graphs, and text queries as a second formulation."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from oriel import findings, fixpoint, registry
from oriel import terms as t
from oriel.graph import Graph
from oriel.operators import checks, conformance, metrics, reasoning, repair, versioning
from oriel.plans import sparql
from oriel.sources import turtle

HEAD = """@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix : <http://x.org/v#> .
"""
N = "http://x.org/v#"


def graph(spark, text, name="g"):
    triples, _ = turtle.parse(HEAD + text, name)
    return Graph(spark.createDataFrame([(name, *x, name) for x in triples], t.QUAD))


def found(g, check_id):
    return sorted((r.focus_node.replace(N, ":"), (r.path or "").replace(N, ":"), r.value.replace(N, ":")) for r in checks.run_check(g, check_id).collect())


CASES = {
    "STR-001": (":a a :Lost . :b a :K . :K a owl:Class . :c a owl:NamedIndividual .", [(":a", "", ":Lost")]),
    "STR-002": (":p a rdf:Property . :a :p 1 ; :q 2 ; skos:note 'x' .", [(":a", ":q", ":a")]),
    "STR-004": (":A a owl:Class . :B a owl:Class . :A owl:disjointWith :B . :C a owl:Class .", [(":C", "", ":C")]),
    "LOG-001": (":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :A owl:disjointWith :C . :B owl:disjointWith :D .", [(":A", "(http://www.w3.org/2000/01/rdf-schema#subClassOf)+", ":C")]),
    "LOG-002": (":p a owl:FunctionalProperty . :a :p 'x', 'y' . :b :p 'x'@en, 'x'@de .", [(":a", ":p", ":a")]),
    "LOG-004": (":p owl:inverseOf :q . :r owl:inverseOf :p . [] owl:inverseOf :p .", [(":p", t.OWL + "inverseOf", ":q, :r")]),
    "QUA-005": (":a :p :b .", [(t.WHOLE_GRAPH, "", t.WHOLE_GRAPH)]),
    "EFF-001": (" ".join(f":c{i} rdfs:subClassOf :c{i + 1} ." for i in range(7)), [(":c0", "", ":c6"), (":c1", "", ":c7")]),
    "EFF-003": (":a :p " + ", ".join(map(str, range(51))) + " . :b :p " + ", ".join(map(str, range(50))) + " .", [(":a", ":p", ":a")]),
    "STY-005": (":a-b a owl:Class . :a_b a owl:Class . :ab a owl:Class .", [(t.WHOLE_GRAPH, "", "-|_")]),
    "DAT-001": (":a :p '15/06/2019'^^xsd:date, '2019-06-15'^^xsd:date, 'yes'^^xsd:boolean, 'twelve'^^xsd:integer, 12 .", [(":a", ":p", "15/06/2019"), (":a", ":p", "twelve"), (":a", ":p", "yes")]),
    "DAT-003": (":a :p 'x', 'x'@en, 'y', 'y' . :b :p 'x' .", [(":a", ":p", ":a")]),
    "REA-001": (":A owl:disjointWith :B . :i a :A, :B . :j a :A .", [(":i", "", ":A, :B")]),
    "REA-002": (":p a owl:AsymmetricProperty . :a :p :b . :b :p :a, :b .", [(":a", ":p", ":b"), (":b", ":p", ":a")]),
    "REA-003": (":p a owl:IrreflexiveProperty . :a :p :a, :b .", [(":a", ":p", ":a")]),
}


@pytest.mark.parametrize("check_id", sorted(CASES))
def test_rule(spark, check_id):
    text, want = CASES[check_id]
    assert found(graph(spark, text), check_id) == want


def test_every_check_has_metadata_and_every_static_one_a_rule():
    assert len(registry.CHECKS) == 50
    elsewhere = {"REA-010", "REA-011", "REA-012", "REA-020", "REA-021", "REA-022", *(f"CNF-00{i}" for i in range(1, 6))}
    assert set(registry.CHECKS) - set(registry.RULES) - elsewhere == {c for c in registry.CHECKS if c not in registry.RULES and c not in elsewhere} == set()


def test_value_space_supplement(spark):
    g = graph(spark, ":a :p '2021-02-30'^^xsd:date, '2021-02-28Z'^^xsd:date, '2021-02-28 junk'^^xsd:date, '1'^^xsd:boolean, 'x'^^:own, '-1'^^xsd:nonNegativeInteger, '25:00:00'^^xsd:time .")
    assert sorted(r.value for r in checks.ill_typed_literals(g).collect()) == ["-1", "2021-02-28 junk", "2021-02-30", "25:00:00"]


def test_merge_keeps_least_message_and_all_sources(spark):
    rows = [("X", "c", "t", "Info", "f", None, "f", m, "r", [s]) for m, s in (("b", "two"), ("a", "one"), ("b", "one"))]
    got = findings.merge(spark.createDataFrame(rows, findings.SCHEMA)).collect()
    assert [(r.message, r.sources) for r in got] == [("a", ["one", "two"])]
    assert findings.gate(spark.createDataFrame(rows, findings.SCHEMA), "Warning") == 0
    assert findings.empty(spark).columns == findings.merge(findings.empty(spark)).columns


def test_own_check_in_text(spark):
    g = graph(spark, ":A a owl:Class ; rdfs:label 'x' . :B a owl:Class .")
    got = sparql.check_rows(g, "PREFIX owl: <http://www.w3.org/2002/07/owl#> SELECT ?focus ?message WHERE { ?focus a owl:Class FILTER NOT EXISTS { ?focus rdfs:label ?l } BIND(CONCAT('no label: ', STR(?focus)) AS ?message) }").collect()
    assert [(r.focus, r.path, r.message) for r in got] == [(N + "B", None, f"no label: {N}B")]


SECOND = {
    "LOG-003": "SELECT ?focus WHERE { ?focus owl:equivalentClass ?d ; rdfs:subClassOf ?d . FILTER(?focus != ?d) }",
    "QUA-001": "SELECT DISTINCT ?focus WHERE { ?focus a ?k . FILTER(?k IN (owl:Class, owl:ObjectProperty)) FILTER(isIRI(?focus)) FILTER NOT EXISTS { ?focus rdfs:label|skos:prefLabel ?l } }",
    "STR-005": "SELECT ?focus WHERE { ?focus rdfs:domain ?d MINUS { ?d a ?k } }",
    "REA-002": "SELECT ?focus WHERE { ?p a owl:AsymmetricProperty . ?focus ?p ?o . ?o ?p ?focus . FILTER(?focus != ?o) }",
    "LOG-001": "SELECT ?focus WHERE { ?focus rdfs:subClassOf+ ?up ; owl:disjointWith ?up }",
    "EFF-003": "SELECT ?focus WHERE { { SELECT ?focus ?p (COUNT(?o) AS ?n) WHERE { ?focus ?p ?o . FILTER(?p != rdf:type) } GROUP BY ?focus ?p HAVING (COUNT(?o) > 50) } }",
}


@pytest.mark.parametrize("check_id", sorted(SECOND))
def test_text_query_agrees_with_the_plan(spark, check_id):
    text = "".join(c[0] for c in CASES.values()) + " :E owl:equivalentClass :F ; rdfs:subClassOf :F . :pp rdfs:domain :Nowhere . :K a owl:Class ."
    g = graph(spark, text).stored()
    want = sorted(r.focus_node for r in checks.run_check(g, check_id).collect())
    assert sorted(r.focus for r in sparql.select(g, SECOND[check_id]).collect()) == want and want


def test_sparql_forms(spark):
    g = graph(spark, ":a :p 1, 2, 3 ; :q 'x'@en . :b :p 5 .")
    run = lambda q: [tuple(r) for r in sparql.select(g, "PREFIX : <http://x.org/v#> " + q).collect()]
    assert run("SELECT ?s (SUM(?v) AS ?n) (MAX(?v) AS ?m) WHERE { ?s :p ?v } GROUP BY ?s ORDER BY ?n") == [(N + "b", "5.0", "5"), (N + "a", "6.0", "3")]
    assert run("SELECT ?v WHERE { ?s :p ?v } ORDER BY DESC(?v) LIMIT 2 OFFSET 1") == [("3",), ("2",)]
    assert run("SELECT ?s ?l WHERE { ?s :p ?v . OPTIONAL { ?s :q ?l } FILTER(?v > 2) } ORDER BY ?s") == [(N + "a", "x"), (N + "b", None)]
    assert run("SELECT ?s WHERE { { ?s :q ?x } UNION { ?s :p 5 } } ORDER BY ?s") == [(N + "a",), (N + "b",)]
    assert run("SELECT ?x WHERE { VALUES ?x { :a :zz } ?x :p 1 }") == [(N + "a",)]
    assert run("SELECT ?l WHERE { ?s :q ?v BIND(IF(LANG(?v) = 'en', UCASE(STR(?v)), 'no') AS ?l) }") == [("X",)]
    assert sparql.ask(g, "ASK { ?s ?p 5 }") and not sparql.ask(g, "ASK { ?s ?p 6 }")
    after, added, removed = sparql.update(g, "PREFIX : <http://x.org/v#> DELETE { ?s :p ?v } INSERT { ?s :big ?v } WHERE { ?s :p ?v FILTER(?v >= 3) }")
    assert (added.count(), removed.count(), after.triples.count()) == (2, 2, 5)
    with pytest.raises(sparql.QueryError):
        sparql.select(g, "SELECT ?s WHERE { ?s zz:p ?o }")


def random_edges(seed, n=30):
    rng = random.Random(seed)
    return [(f":n{i}", f":n{rng.randrange(n)}") for i in range(n) for _ in range(rng.randrange(3))]


def reach(edges):
    nexts = defaultdict(set)
    for a, b in edges:
        nexts[a].add(b)
    out = set()
    for a in list(nexts):
        stack = list(nexts[a])
        seen = set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += nexts.get(x, ())
        out |= {(a, x) for x in seen}
    return out


@pytest.mark.parametrize("limit", [0, 10_000])
def test_closure_and_depth_in_both_forms(spark, limit):
    edges = random_edges(3)
    df = spark.createDataFrame(edges, "a string, b string")
    want = reach(edges)
    assert {tuple(r) for r in fixpoint.transitive_closure(df, limit).collect()} == want
    group = {n: min([n, *(m for m in {x for e in edges for x in e} if (n, m) in want and (m, n) in want)]) for e in edges for n in e}
    ups = {(group[a], group[b]) for a, b in edges if group[a] != group[b]}

    def deep(n):
        return max((deep(b) + 1 for a, b in ups if a == n), default=0)

    assert {tuple(r) for r in fixpoint.depth(df, limit).collect()} == {(n, deep(group[n])) for n in group}


def test_deep_chain(spark):
    chain = spark.range(20_000).selectExpr("concat('n', id) AS a", "concat('n', id + 1) AS b")
    assert fixpoint.depth(chain).where("node = 'n0'").first().depth == 20_000


def test_components_and_lists(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f")] + [(f"x{i:03}", f"x{i + 1:03}") for i in range(60)]
    got = {r.node: r.component for r in fixpoint.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {n: got[n] for n in "abcde"} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"} and got["x060"] == "x000"
    g = graph(spark, ":a :p (" + " ".join(map(str, range(37))) + ") .")
    rows = fixpoint.list_members(g.of(t.RDF + "first").selectExpr("s as a", "o as b"), g.edges(t.RDF + "rest"), t.RDF + "nil").collect()
    assert [r.member for r in sorted(rows, key=lambda r: r.position)] == [str(i) for i in range(37)]


def test_conformance(spark):
    onto = graph(spark, ":P a owl:Class . :D a owl:Class . :D rdfs:subClassOf :P . :X a owl:Class . :p a owl:ObjectProperty ; rdfs:domain :P, :Y ; rdfs:range :X . :v a owl:DatatypeProperty ; rdfs:range xsd:integer . :any a owl:ObjectProperty ; rdfs:domain owl:Thing .")
    data = graph(spark, ":d a :D ; :p :x . :x a :X . :x :p :d ; :v 'no', 3 ; :any :d ; :zz 1 ; rdfs:label 'x' . :u :p :x . :w a :Lost .")
    result = conformance.conformance(conformance.declarations(onto), data)
    got = sorted((r.check_id, r.focus_node.replace(N, ":"), r.value.replace(N, ":")) for r in result.findings().collect())
    assert got == [("CNF-001", ":Lost", ":Lost"), ("CNF-002", ":zz", ":zz"), ("CNF-003", ":p", ":x"), ("CNF-004", ":p", ":d"), ("CNF-004", ":v", "no"), ("CNF-005", ":P", ":P")]
    assert [tuple(r) for r in result.unverifiable_domain.collect()] == [(N + "p", 1)]


def test_version_steps(spark):
    base = ":A a owl:Class . :B a owl:Class ; rdfs:subClassOf :A . :p a owl:ObjectProperty ; rdfs:domain :B ."
    level = lambda more: versioning.bump(versioning.diff(versioning.snapshot(graph(spark, base)), versioning.snapshot(graph(spark, more)))).first().bump
    assert level(base) == "NONE"
    assert level(base + " :A rdfs:label 'a'@en .") == "PATCH"
    assert level(base + " :C a owl:Class .") == "MINOR"
    assert level(base.replace("rdfs:domain :B", "rdfs:domain :A")) == "MINOR"
    assert level(base + " :p a owl:FunctionalProperty .") == "MAJOR"
    assert level(base.replace(":B a owl:Class ; rdfs:subClassOf :A .", "")) == "MAJOR"


def test_renames(spark):
    old, new = graph(spark, ":Engineer a owl:Class . :Site a owl:Class . :Gone a owl:Class ."), graph(spark, "<http://y.org/v#Site> a owl:Class . :Engineers a owl:Class . :Fresh a owl:Class ; owl:equivalentClass :Gone .")
    got = versioning.match(versioning.rename_candidates(versioning.snapshot(old), versioning.snapshot(new), new))
    assert [(r.old.replace(N, ":"), r.new.replace(N, ":"), r.reason) for r in got] == [(":Gone", ":Fresh", "annotation"), (":Site", "http://y.org/v#Site", "same name"), (":Engineer", ":Engineers", "similar name")]
    assert got[0].confidence == 1.0 and 0.5 < got[2].confidence < 0.85


def test_closure_finds_hidden_contradictions(spark):
    g = graph(spark, ":Dog rdfs:subClassOf :Animal . :Animal owl:disjointWith :Thing2 . :i a :Dog, :Thing2 . :p rdfs:domain :Dog . :j :p :k ; a :Thing2 . :part a owl:TransitiveProperty . :a :part :b . :b :part :c . :c :part :d . :part owl:inverseOf :whole . :f a owl:FunctionalProperty . :m :f :n1, :n2 . :n1 :q :z .")
    closed = reasoning.closure(g)
    facts = {(r.s, r.p, r.o) for r in closed.triples.collect()}
    for s, p, o in ((":a", ":part", ":d"), (":d", ":whole", ":a"), (":n2", ":q", ":z")):
        assert tuple(x.replace(":", N) for x in (s, p, o)) in facts
    got = sorted(r.focus_node.replace(N, ":") for r in reasoning.contradictions(closed).where("check_id = 'REA-001'").collect())
    assert got == [":i", ":j"]
    assert reasoning.consistency(g, "hermit").where("check_id = 'REA-022'").count() == 1


def test_closure_by_collections_chains_keys_and_cardinalities(spark):
    text = """:Both owl:intersectionOf (:A :B) . :Any owl:unionOf (:A :B) . :Few owl:oneOf (:e1 :e2) . :a1 a :A, :B . :a2 a :A . :b3 a :B . :s1 a :Both .
    :uncle owl:propertyChainAxiom (:parent :brother) . :far owl:propertyChainAxiom (:parent :parent :brother) . :x :parent :y . :y :parent :z . :y :brother :w . :z :brother :v .
    :Person owl:hasKey (:name :born) . :p1 a :Person ; :name 'n' ; :born 1 ; :tag :t1 . :p2 a :Person ; :name 'n' ; :born 1 . :p3 a :Person ; :name 'n' ; :born 2 . :p4 :name 'n' ; :born 1 .
    :One owl:maxCardinality 1 ; owl:onProperty :home . :o1 a :One ; :home :h1, :h2 . :o2 :home :h3, :h4 . :h2 :tag :t2 .
    :Only owl:maxQualifiedCardinality 1 ; owl:onProperty :pet ; owl:onClass :Cat . :q1 a :Only ; :pet :c1, :c2, :d1 . :c1 a :Cat . :c2 a :Cat .
    :Red owl:hasValue 'red' ; owl:onProperty :colour . :r1 a :Red . :r2 :colour 'red' . :Made owl:someValuesFrom owl:Thing ; owl:onProperty :maker . :m1 :maker :u .
    :SomeA owl:someValuesFrom :Small ; owl:onProperty :k . :SomeB owl:someValuesFrom :Large ; owl:onProperty :k . :SomeC owl:someValuesFrom :Small ; owl:onProperty :k2 . :Small rdfs:subClassOf :Large . :k rdfs:subPropertyOf :k2 ."""
    closed = reasoning.closure(graph(spark, text))
    got = {(r.s.replace(N, ":"), r.p.replace(N, ":").rpartition("#")[2], r.o.replace(N, ":")) for r in closed.triples.collect()}
    for fact in (
        (":a1", "type", ":Both"), (":a2", "type", ":Any"), (":b3", "type", ":Any"), (":s1", "type", ":A"), (":s1", "type", ":Any"), (":Both", "subClassOf", ":A"), (":A", "subClassOf", ":Any"), (":e2", "type", ":Few"), (":x", ":uncle", ":w"), (":x", ":far", ":v"),
        (":p2", "sameAs", ":p1"), (":p2", ":tag", ":t1"), (":h2", "sameAs", ":h1"), (":h1", ":tag", ":t2"), (":c2", "sameAs", ":c1"), (":r1", ":colour", "red"), (":r2", "type", ":Red"), (":m1", "type", ":Made"), (":SomeA", "subClassOf", ":SomeB"), (":SomeA", "subClassOf", ":SomeC"),
    ):
        assert fact in got, fact
    assert not got & {(":a2", "type", ":Both"), (":x", ":uncle", ":v"), (":x", ":far", ":w"), (":b3", "type", ":Few")}
    assert {(s, o) for s, p, o in got if p == "sameAs"} == {(":p2", ":p1"), (":h2", ":h1"), (":c2", ":c1")}
    with pytest.raises(RuntimeError):
        reasoning.closure(graph(spark, ":C rdfs:subClassOf :D . :a a :C ."), rounds=1)


@pytest.mark.parametrize("check_id", ["STR-001", "STR-002", "STR-005", "STR-007", "QUA-001", "QUA-002", "QUA-004", "QUA-005", "QUA-007", "LOG-003", "STY-003"])
def test_repair_settles_its_findings(spark, check_id):
    text = ":a a :Lost ; :q 1 ; rdfs:label 'plain' . :p rdfs:domain :Nowhere ; a owl:ObjectProperty . :E owl:equivalentClass :F ; rdfs:subClassOf :F ."
    g = graph(spark, text if check_id == "QUA-005" else text + " :o a owl:Ontology .").stored()
    before = checks.run_check(g, check_id)
    assert not before.isEmpty()
    after = repair.apply(g, repair.repair(g, before, check_id)).stored()
    left = checks.run_check(after, check_id)
    assert left.join(before.select("focus_node", "value"), ["focus_node", "value"], "left_semi").isEmpty()


def test_metrics_of_a_small_graph(spark):
    g = graph(spark, ":a a :K ; :p :b ; :v 1, 2 . :b a :K, :L . :c :p :a .")
    assert metrics.graph_sizes(g).first().asDict() == {"triple_count": 7, "class_count": 2, "property_count": 2, "type_triple_count": 3, "literal_triple_count": 2, "object_triple_count": 2, "entity_count": 3}
    assert tuple(metrics.graph_degrees(g).first()) == (2.0, 4)
    assert tuple(metrics.graph_components(g).first()) == (1, 3, 0)
