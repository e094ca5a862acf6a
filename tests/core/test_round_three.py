"""Joins on predicates that move no triples, counts of repeated triples, closures, components, descriptions and filters at size."""

import pytest
from pyspark.sql import functions as F

from oriel import demo
from oriel import terms as t
from oriel.graph import Graph
from oriel import fixpoint
from oriel.operators import checks, metrics, reasoning
from oriel.plans import sparql

X = "http://example.org/"


def graph(spark, *triples):
    rows = [("urn:g", X + s, 0, X + p if ":" not in p else p, str(o), 2 if isinstance(o, int) else 0, t.XSD + "integer" if isinstance(o, int) else None, None, "x") for s, p, o in triples]
    return Graph(spark.createDataFrame(rows, t.QUAD))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("check_id", ["LOG-002", "STR-007", "QUA-003", "REA-002", "REA-003", "STR-002"])
def test_predicates_are_sent_to_the_triples(spark, check_id):
    """One predicate may have most triples: a join that moves them by predicate gives these to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(checks.apply_rule(demo.shop(spark, "/root/testdata/sf0.001"), check_id))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_literals_are_grouped_in_one_exchange(spark):
    g = demo.shop(spark, "/root/testdata/sf0.001")
    assert plan(checks.apply_rule(g, "DAT-003")).count("Exchange hashpartitioning") == 1
    rows = [("urn:g", X + "a", 0, X + "p", "v", 2, dt, lang, src) for dt, lang in ((t.XSD + "string", None), (t.RDF + "langString", "en")) for src in "xy"] + [("urn:g", X + "b", 0, X + "p", "v", 2, None, None, src) for src in "xy"]
    assert [r.focus for r in checks.apply_rule(Graph(spark.createDataFrame(rows, t.QUAD)), "DAT-003").collect()] == [X + "a"]


def test_sizes_do_not_multiply_triples(spark):
    """Distinct counts beside each other would copy every triple."""
    g = demo.shop(spark, "/root/testdata/sf0.001")
    text = plan(metrics.graph_sizes(g))
    assert text.index("keys=[p#") > text.index("Expand")
    none = graph(spark, ("a", "p", "b")).triples.limit(0).select(F.lit("g").alias("g"), "*", F.lit("x").alias("src"))
    assert tuple(metrics.graph_sizes(Graph(none)).first()) == (0,) * 7


def test_typing_without_a_join(spark):
    g = demo.shop(spark, "/root/testdata/sf0.001")
    text = plan(metrics.graph_typing(g))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_degrees_leave_a_subject_as_one_row(spark):
    """Repeated triples count once, types not at all; triples are moved by subject alone."""
    g = graph(spark, ("a", "p", X + "b"), ("a", "p", X + "c"), ("a", "q", 1), ("b", t.TYPE, X + "B"), ("d", t.TYPE, X + "B"))
    twice = Graph(g.quads.unionAll(g.quads))
    assert tuple(metrics.graph_degrees(twice).first()) == (1.25, 3)
    text = plan(metrics.graph_degrees(twice))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and all("hashpartitioning(s#" in line or "hashpartitioning(n#" in line for line in moved)
    assert not any("p#" in line for line in moved)


def test_schema_is_found_without_storing_the_graph(spark):
    g = graph(spark, ("a", t.TYPE, X + "A"), ("a", "p", X + "b"), ("b", t.TYPE, X + "B"), ("c", "p", X + "b"), ("a", "q", 1))
    twice = Graph(g.quads.unionAll(g.quads))
    schema = metrics.Schema(twice)
    assert {(r.p[-1], r.c[-1]) for r in schema.domain.collect()} == {("p", "A"), ("p", ")"), ("q", "A")}
    assert {(r.p[-1], r.c[-1]) for r in schema.range.collect()} == {("p", "B")}
    assert schema.domain.inputFiles()


def pairs(spark, *edges):
    return spark.createDataFrame(list(edges), "a string, b string")


def counted(monkeypatch, run):
    """Rows written for each kind of intermediate table."""
    rows, real = {}, fixpoint.materialise

    def spy(df, label):
        out = real(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "materialise", spy)
    return run(), rows


def test_components_shrink_stars(spark, monkeypatch):
    """Long paths, stars and loops; after two rounds a star has no edges left."""
    path = [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)]
    star = [("hub", f"s{i:02}") for i in range(40)]
    got = {r.node: r.component for r in fixpoint.connected_components(pairs(spark, *path, *star, ("x", "x"), ("y", None))).collect()}
    assert got == {f"p{i:02}": "p00" for i in range(31)} | {n: "hub" for n in ("hub", *(f"s{i:02}" for i in range(40)))}
    _, rows = counted(monkeypatch, lambda: fixpoint.component_ids(pairs(spark, *star)))
    assert len(rows["components"]) <= 6


def test_descriptions_write_only_blank_nodes(spark, monkeypatch):
    g = demo.catalogue(spark, "/root/testdata/sf0.001").loose()
    _, rows = counted(monkeypatch, lambda: fixpoint.frontier(None, g.triples, ["s", "p", "o"]).count())
    assert max(rows["description"]) < g.where("s_kind = 0").count() / 2


def test_closure_makes_each_pair_of_a_tree_once(spark):
    tree = [(f"n{i}", f"n{i // 2}") for i in range(2, 64)]
    got = [tuple(r) for r in fixpoint.transitive_closure(pairs(spark, *tree), one_task=0).collect()]
    assert len(got) == len(set(got)) == sum(i.bit_length() - 1 for i in range(1, 64))


def test_cycles_without_the_closure_of_all(spark, monkeypatch):
    tree = [(f"n{i}", f"n{i // 2}") for i in range(2, 128)]
    got, rows = counted(monkeypatch, lambda: fixpoint.cyclic(pairs(spark, *tree, ("n9", "n8"), ("n8", "n9"), ("n3", "n3")), one_task=0).collect())
    assert {tuple(r) for r in got} == {("n8", "n8"), ("n8", "n9"), ("n9", "n8"), ("n9", "n9"), ("n3", "n3")}
    assert max(rows.get("closure", [0])) < 60


def test_depth_level_by_level_and_below(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "LEVELS", 3)
    edges = pairs(spark, *[(f"n{i + 1}", f"n{i}") for i in range(9)], ("n9", "n2"), ("n4", "n5"), ("z", "n9"))
    want = {f"n{i}": i if i < 4 else 4 if i < 6 else i - 1 for i in range(10)} | {"z": 9}
    got, rows = counted(monkeypatch, lambda: {r.node: r.depth for r in fixpoint.depth(edges, one_task=0).collect()})
    assert got == want


def test_findings_without_messages(spark, monkeypatch):
    """Only the wanted columns are written, and the same findings are found with triples stated twice."""
    quads = demo.ontology(spark).quads
    want = {tuple(r) for r in checks.run_all(Graph(quads), ["QUA-001", "REA-001", "EFF-002", "LOG-004"], literals=False).select("check_id", "category", "severity", "focus_node", "path", "value").collect()}
    got = checks.run_all(Graph(quads.unionAll(quads)), ["QUA-001", "REA-001", "EFF-002", "LOG-004"], literals=False, columns=["check_id", "category", "severity", "focus_node", "path", "value"])
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    assert checks.run_all(Graph(quads), ["QUA-001"], columns=["focus_node"]).columns == ["focus_node"]


def test_optional_filter_compares_terms_once(spark):
    """Rows meet by equalities; the comparison is made between distinct terms, and repeats are kept."""
    rows = [("a", "brand", "x"), ("a", "n", 1), ("b", "brand", "x"), ("b", "n", 9), ("c", "brand", "x"), ("c", "n", 9), ("d", "brand", "y"), ("d", "n", 9)]
    q = f"SELECT ?s ?t WHERE {{ ?s <{X}brand> ?b ; <{X}n> ?n . OPTIONAL {{ ?t <{X}brand> ?b ; <{X}n> ?m . FILTER(?m > ?n + 4) }} }}"
    found = sparql.select(graph(spark, *[(s, p, X + o if isinstance(o, str) else o) for s, p, o in rows]), q)
    assert sorted((r.s[-1], r.t and r.t[-1]) for r in found.collect()) == [("a", "b"), ("a", "c"), ("b", None), ("c", None), ("d", None)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    outer = next(line for line in text.splitlines() if "Join LeftOuter" in line)
    assert ">" not in outer.replace("<=>", "")


def test_closed_types_without_pairs_of_equal_individuals(spark, monkeypatch):
    """Parts that functional links chain together are one in all rounds; classes and predicates may be equal as well."""
    n, facts = 30, [(X + "part", t.TYPE, t.OWL + "FunctionalProperty"), (X + "part", t.RANGE, X + "Part"), (X + "Part", t.SUBCLASS, X + "Thing"), (X + "Other", t.OWL + "sameAs", X + "Part"), (X + "also", t.OWL + "sameAs", X + "part")]
    facts += [(f"{X}line{i:02}", X + ("part" if i % 2 else "also"), f"{X}p{i + k:02}") for i in range(n) for k in (0, 1)] + [(f"{X}p{n:02}", t.TYPE, X + "Rare")]
    g = Graph(spark.createDataFrame([("urn:g", s, 0, p, o, 0, None, None, "x") for s, p, o in facts], t.QUAD))
    rows, real = [], reasoning.materialise

    def spy(df, label):
        out = real(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(reasoning, "materialise", spy)
    got = [tuple(r) for r in reasoning.closed_types(g).collect()]
    parts = {(f"{X}p{i:02}", X + c) for i in range(n + 1) for c in ("Part", "Other", "Thing", "Rare")}
    assert len(got) == len(set(got)) and set(got) == parts | {(X + p, t.OWL + "FunctionalProperty") for p in ("part", "also")}
    assert max(rows) < 5 * n
    monkeypatch.undo()
    closed = [(r.s, r.p, r.o) for r in reasoning.closure(g).triples.collect()]
    assert len(closed) == len(set(closed)) and {(s, o) for s, p, o in closed if p == t.TYPE} == set(got)
    assert {(s, p, o) for s, p, o in closed if s.startswith(X + "line")} == {(f"{X}line{i:02}", X + p, f"{X}p{j:02}") for i in range(n) for p in ("part", "also") for j in range(n + 1)}
