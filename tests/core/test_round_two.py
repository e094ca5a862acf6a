"""Escapes, filters over optional parts, order before limits, own checks, failures, and views without shuffles."""

import json

import pytest
from pyspark.sql import functions as F

from oriel import demo
from oriel import terms as t
from oriel.graph import Graph
from oriel.operators import checks
from oriel.plans import sparql
from oriel.registry import RULES
from oriel.sources import reader

X = "http://example.org/"


def graph(spark, *triples):
    rows = [("urn:g", X + s, 0, X + p, str(o), 2 if isinstance(o, int) else 0, t.XSD + "integer" if isinstance(o, int) else None, None, "x") for s, p, o in triples]
    return Graph(spark.createDataFrame(rows, t.QUAD))


def test_ntriples_escapes(spark, tmp_path):
    lines = [
        (r'<http://x/a> <http://x/p> "a\\nb" .', "a\\nb"),
        (r'<http://x/b> <http://x/p> "tab\there\nline \"q\" \\" .', 'tab\there\nline "q" \\'),
        (r'<http://x/c> <http://x/p> "café \U0001F642 🙂" .', "café 🙂 🙂"),
        (r"<http://x/d> <http://x/p> <http://x/café> .", "http://x/café"),
        ('<http://x/e> <http://x/p> "plain"@EN . # note', "plain"),
    ]
    (tmp_path / "a.nt").write_text("# head\n\n" + "\n".join(a for a, _ in lines) + "\n")
    got = {r.s: r.o for r in reader.read_ntriples(spark, [str(tmp_path / "a.nt")]).collect()}
    assert got == {f"http://x/{k}": v for k, (_, v) in zip("abcde", lines, strict=True)}


def test_ntriples_malformed_line_fails(spark, tmp_path):
    (tmp_path / "b.nt").write_text('<http://x/a> <http://x/p> "ok" .\n<http://x/a> <http://x/p> broken\n')
    with pytest.raises(Exception, match="not N-Triples"):
        reader.read_ntriples(spark, [str(tmp_path / "b.nt")]).collect()


def test_distinct_before_limit(spark):
    g = graph(spark, *[("s%d" % i, "n", n) for i, n in enumerate((1, 9, 9, 3, 9))])
    q = f"SELECT DISTINCT ?n WHERE {{ ?s <{X}n> ?n }} ORDER BY DESC(?n) LIMIT 2"
    assert [r.n for r in sparql.select(g, q).collect()] == ["9", "3"]


def test_filter_in_optional_sees_outside(spark):
    g = graph(spark, ("a", "n", 1), ("b", "n", 5), ("a", "m", 3), ("b", "m", 3))
    q = f"SELECT ?s ?m WHERE {{ ?s <{X}n> ?n . OPTIONAL {{ ?s <{X}m> ?m . FILTER(?m > ?n) }} }}"
    assert sorted((r.s[-1], r.m) for r in sparql.select(g, q).collect()) == [("a", "3"), ("b", None)]


def test_loose_view_finds_the_same(spark):
    """With every triple stated twice and more."""
    quads = demo.ontology(spark).quads
    g = Graph(quads.unionAll(quads).unionAll(quads.withColumn("src", F.lit("copy"))))
    for check_id in sorted(checks.SET_INSENSITIVE & set(RULES)):
        want = checks.run_check(Graph(quads.dropDuplicates(t.TRIPLE)), check_id).collect()
        assert sorted(map(str, checks.run_check(g, check_id).collect())) == sorted(map(str, want)), check_id


def test_own_checks_and_one_that_fails(spark, tmp_path):
    (tmp_path / "big.rq").write_text(f"SELECT ?focus ?value ?message WHERE {{ ?focus <{X}n> ?value . FILTER(?value > 4) BIND('too large' AS ?message) }}")
    (tmp_path / "own.json").write_text(json.dumps([
        {"id": "OWN-001", "severity": "Warning", "title": "Large", "query": "big.rq"},
        {"id": "OWN-002", "severity": "Info", "title": "Broken", "query": "SELECT ?focus WHERE { nonsense"},
    ]))
    own = checks.own_checks(tmp_path / "own.json")
    outcomes = []
    found = checks.run_all(graph(spark, ("a", "n", 1), ("b", "n", 5)), ["QUA-005"], own=own, outcomes=outcomes).collect()
    assert {(r.check_id, r.focus_node, r.message) for r in found if r.check_id == "OWN-001"} == {("OWN-001", X + "b", "too large")}
    assert {r.check_id for r in found} == {"OWN-001", "QUA-005"}
    assert {o.check_id: bool(o.error) for o in outcomes} == {"QUA-005": False, "OWN-001": False, "OWN-002": True}
    assert checks.outcome_log(outcomes).splitlines()[-1].startswith("OWN-002\tsparql\tfailed")
    for bad in ([{"id": "STR-001", "severity": "Info", "title": "x", "query": "{"}], [{"id": "A", "severity": "x", "title": "x", "query": "{"}], [{"id": "A"}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            checks.own_checks(tmp_path / "bad.json")
