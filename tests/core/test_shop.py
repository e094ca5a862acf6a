"""Fixpoints over the mapped tables against brute force, on a few rows of each table."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from oriel import demo
from oriel import terms as t
from oriel.queries import QUERIES


@pytest.fixture(scope="module")
def shop_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("shop")
    for name in demo.TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(6).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def triples(spark, shop_dir):
    return [tuple(r) for r in demo.shop(spark, shop_dir).triples.select("s", "s_kind", "p", "o", "o_kind").distinct().collect()]


def test_components_of_all_tables(spark, shop_dir, triples):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, _, p, o, kind in triples:
        if p != t.TYPE and kind < 2 and s != o:
            a, b = sorted((root(s), root(o)))
            up[b] = a
    want = {x: root(x) for x in list(up)}
    assert {r.node: r.component for r in QUERIES["components_shop"](spark, shop_dir).collect()} == want
    entities = {s for s, *_ in triples} | {o for _, _, p, o, kind in triples if p != t.TYPE and kind < 2}
    sizes = Counter(want.get(x, x) for x in entities)
    assert tuple(QUERIES["graph_components_shop"](spark, shop_dir).first()) == (len(sizes), max(sizes.values()), sum(n == 1 for n in sizes.values()))


def test_descriptions_of_all_tables(spark, shop_dir, triples):
    of = defaultdict(list)
    for s, _, p, o, kind in triples:
        of[s].append((p, o, kind))
    want = set()
    for start in {s for s, kind, *_ in triples if kind == 0}:
        seen, stack = {start}, [start]
        while stack:
            node = stack.pop()
            for p, o, kind in of[node]:
                want.add((start, node, p, o))
                if kind == 1 and o not in seen:
                    seen.add(o)
                    stack.append(o)
    got = [tuple(r) for r in QUERIES["description_shop"](spark, shop_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(s.startswith("urn:t/line/") for s, *_ in got)


def test_closure_of_all_tables(spark, shop_dir, triples):
    facts = {(s, p, o) if kind < 2 else (s, p, (o,)) for s, _, p, o, kind in triples}
    rest, first = ({s: o for s, p, o in facts if p == t.RDF + x} for x in ("rest", "first"))
    for owner, head in [(s, o) for s, p, o in facts if p == t.OWL + "unionOf"]:
        while head != t.RDF + "nil":
            facts.add((first[head], t.SUBCLASS, owner))
            head = rest[head]
    stated = lambda p: {(s, o) for s, q, o in facts if q == p}
    made = {(a, t.SUBCLASS, b) for a, b in stated(t.OWL + "equivalentClass")} | {(b, t.SUBCLASS, a) for a, b in stated(t.OWL + "equivalentClass")}
    on, some = dict(stated(t.OWL + "onProperty")), stated(t.OWL + "someValuesFrom")
    functional = {s for s, o in stated(t.TYPE) if o == t.OWL + "FunctionalProperty"}
    while made - facts:
        facts |= made
        made = set()
        links = [x for x in facts if isinstance(x[2], str) and x[1] != t.TYPE]
        inverse, domain, range_, sub, types = (stated(x) for x in (t.OWL + "inverseOf", t.DOMAIN, t.RANGE, t.SUBCLASS, t.TYPE))
        made |= {(a, t.SUBCLASS, d) for a, b in sub for c, d in sub if b == c} | {(s, t.TYPE, b) for s, c in types for a, b in sub if a == c}
        made |= {(s, t.TYPE, c) for s, p, _ in facts for q, c in domain if p == q} | {(o, t.TYPE, c) for _, p, o in links for q, c in range_ if p == q and not c.startswith(t.XSD)}
        made |= {(o, b, s) for s, p, o in links for x, y in inverse for a, b in ((x, y), (y, x)) if p == a}
        made |= {(o, p, s) for s, p, o in links if (p, t.OWL + "SymmetricProperty") in types}
        made |= {(s, p, z) for s, p, o in links if (p, t.OWL + "TransitiveProperty") in types for y, q, z in links if q == p and y == o}
        made |= {(s, t.TYPE, r) for r, v in some for s, p, o in links if p == on[r] and (o, v) in types}
    assert all(len({o for s, q, o in facts if q == p and s == x}) == 1 for p in functional for x, q, _ in facts if q == p)
    got = [tuple(r) for r in QUERIES["rl_types_shop"](spark, shop_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, o) for s, p, o in facts if p == t.TYPE}
