"""OWL 2 RL closure, contradictions on it, and profile checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel import findings
from oriel import terms as t
from oriel.fixpoint import ONE_TASK, connected_components, frontier, list_members, nearest_named, transitive_closure
from oriel.graph import Graph
from oriel.operators import checks
from oriel.registry import CHECKS
from oriel.storage import materialise, release, scratch

_KEY = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


def _kind(column: str) -> Column:
    return F.when(F.col(column).contains(":"), t.IRI).otherwise(t.BLANK)


def _edge(df: DataFrame, s: str, p, o: str) -> DataFrame:
    p = F.lit(p) if isinstance(p, str) else p
    return df.select(F.col(s).alias("s"), _kind(s).alias("s_kind"), p.alias("p"), F.col(o).alias("o"), _kind(o).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


#: Predicates whose objects are collections that rules read.
_LISTS = [t.OWL + x for x in ("intersectionOf", "unionOf", "oneOf", "hasKey", "propertyChainAxiom")]
_VALUE = ["v", "v_kind", "v_dt", "v_lang"]


def _lists(g: Graph) -> DataFrame:
    """``kind, key, owner, i, member, n``: members of the collections, from 0, and their number."""
    owned = g.of(*_LISTS).where("o_kind < 2").select(F.concat_ws("\n", "p", "s", "o").alias("key"), F.col("p").alias("kind"), F.col("s").alias("owner"), "o")
    owned = materialise(owned, "rl-owned")
    # a cell before each list's first makes it a head, even where another list goes on with it
    first = g.edges(t.RDF + "first").union(owned.select("key", F.lit("")))
    rest = g.edges(t.RDF + "rest").union(owned.select("key", "o"))
    members = list_members(first, rest, t.RDF + "nil").where("position > 0").withColumnRenamed("head", "key")
    found = owned.drop("o").join(members, "key").select("kind", "key", "owner", (F.col("position") - 1).alias("i"), "member")
    return found.join(found.groupBy("key").agg(F.count("*").alias("n")), "key")


#: Predicates of the terminology, and the types that belong to it.
_TERMINOLOGY = [t.SUBCLASS, t.DOMAIN, t.RANGE, t.RDFS + "subPropertyOf", t.RDF + "first", t.RDF + "rest", *_LISTS]
_TERMINOLOGY += [t.OWL + x for x in ("equivalentClass", "equivalentProperty", "inverseOf", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "maxCardinality", "maxQualifiedCardinality", "onClass")]
_KINDS = [t.OWL + x + "Property" for x in ("Symmetric", "Transitive", "Functional", "InverseFunctional")]


def _terminology(g: Graph) -> Graph:
    """What ``_schema`` reads, written once, so that the mapping of all tables is not planned for each part of it."""
    return Graph(materialise(g.of(*_TERMINOLOGY).union(g.of(t.TYPE).where(F.col("o").isin(_KINDS))), "rl-terminology"), distinct=True)


def _schema(g: Graph) -> dict[str, DataFrame]:
    """The terminological part, closed by itself: hierarchies, inverses, characteristics, restrictions, collections."""
    lists = materialise(_lists(g), "rl-lists")
    of_kind = lambda name: lists.where(F.col("kind") == t.OWL + name)
    equal = g.edges(t.OWL + "equivalentClass")
    same = g.edges(t.OWL + "equivalentProperty")
    subp = materialise(transitive_closure(g.edges(t.RDFS + "subPropertyOf").union(same).union(same.select("b", "a"))), "rl-subp")
    on = g.edges(t.OWL + "onProperty").toDF("r", "p")
    value = lambda p: materialise(on.join(g.edges(t.OWL + p).toDF("r", "v"), "r"), "rl-value")
    some, every = value("someValuesFrom"), value("allValuesFrom")
    has = materialise(on.join(g.of(t.OWL + "hasValue").select("s", "o", "o_kind", "o_dt", "o_lang").toDF("r", *_VALUE), "r"), "rl-has")
    edges = g.edges(t.SUBCLASS).union(equal).union(equal.select("b", "a"))
    edges = edges.union(of_kind("intersectionOf").select("owner", "member")).union(of_kind("unionOf").select("member", "owner"))
    below = subp.select(F.col("a").alias("x_p"), F.col("b").alias("y_p"))
    ends = lambda df, left: df.toDF(*[f"{left}_{c}" for c in df.columns])

    def by_property(df: DataFrame, values: list[str]) -> DataFrame:
        """Restrictions x and y on the same value, x on a property below that of y."""
        x, y = ends(df, "x"), ends(df, "y")
        alike = reduce(lambda p, q: p & q, [F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")) for c in values])
        return x.join(below, ["x_p"]).join(y, ["y_p"]).where(alike)

    r = lambda df, a, b: df.select(F.col(f"{a}_r").alias("a"), F.col(f"{b}_r").alias("b"))
    edges = edges.union(r(by_property(some, ["v"]), "x", "y")).union(r(by_property(every, ["v"]), "y", "x")).union(r(by_property(has, _VALUE), "x", "y"))
    edges = materialise(edges.distinct(), "rl-edges")
    while True:
        sub = materialise(transitive_closure(edges), "rl-sub")
        above = sub.select(F.col("a").alias("x_v"), F.col("b").alias("y_v"))
        more = [r(ends(df, "x").join(above, ["x_v"]).join(ends(df.withColumnRenamed("p", "q"), "y"), ["y_v"]).where("x_p = y_q"), "x", "y") for df in (some, every)]
        more = materialise(more[0].union(more[1]).distinct().join(sub, ["a", "b"], "left_anti").where("a <> b"), "rl-more")
        if more.isEmpty():
            break
        edges = edges.union(more)
    pair = lambda p: g.edges(p).toDF("p", "c")
    with_supers = lambda df: df.union(df.join(sub, F.col("c") == F.col("a")).select("p", F.col("b").alias("c"))).distinct()
    inherit = lambda df: df.union(df.withColumnRenamed("p", "q").join(subp, F.col("q") == F.col("b")).select(F.col("a").alias("p"), "c")).distinct()
    kind = lambda name: g.typed(t.OWL + name).select(F.col("s").alias("p"))
    inverse = g.edges(t.OWL + "inverseOf")
    one = lambda name: on.join(g.of(t.OWL + name).where(F.col("o").try_cast("int") == 1).select(F.col("s").alias("r")), "r")
    return {
        "sub": sub.where("a <> b"), "subp": subp.where("a <> b"), "inverse": inverse.union(inverse.select("b", "a")).distinct(), "domain": with_supers(inherit(pair(t.DOMAIN))), "range": with_supers(inherit(pair(t.RANGE))),
        "symmetric": kind("SymmetricProperty"), "transitive": kind("TransitiveProperty"), "functional": kind("FunctionalProperty"), "inverse_functional": kind("InverseFunctionalProperty"),
        "some": some, "all": every, "has": has, "max": one("maxCardinality"), "max_of": one("maxQualifiedCardinality").join(g.edges(t.OWL + "onClass").toDF("r", "v"), "r"),
        "both": of_kind("intersectionOf").select("key", "owner", "member", "n").distinct(), "one_of": of_kind("oneOf").select("owner", "member"),
        "chain": of_kind("propertyChainAxiom").select("key", "owner", "i", "member", "n"), "keys": of_kind("hasKey").select("key", "owner", "i", "member", "n"),
    }


def _mutual(pairs: DataFrame) -> DataFrame:
    return pairs.intersect(pairs.select("b", "a"))


def _equal(groups: DataFrame, by: list[str], member: str) -> DataFrame:
    """Each member but the least of its group, linked to that."""
    least = groups.groupBy(*by).agg(F.min(member).alias("x"), F.max(member).alias("last")).where("x <> last").drop("last")
    return groups.join(least, by).where(F.col(member) != F.col("x")).select("x", F.col(member).alias("y")).distinct()


def _same(known: DataFrame, fresh: DataFrame, tables: dict[str, DataFrame], some: dict[str, bool]) -> list[DataFrame]:
    """``x, y``: what functional properties, maximum cardinalities of 1 and keys make equal, where a fresh fact may matter."""
    touched = lambda name: some[name] and not fresh.where("o_kind < 2").join(tables[name], "p", "left_semi").isEmpty()
    links = known.where((F.col("p") != t.TYPE) & (F.col("o_kind") < 2)).select("s", "p", "o")
    types = known.where(F.col("p") == t.TYPE).select("s", F.col("o").alias("c"))
    made = []
    if touched("functional"):
        made.append(_equal(links.join(tables["functional"], "p"), ["s", "p"], "o"))
    if touched("inverse_functional"):
        made.append(_equal(links.join(tables["inverse_functional"], "p"), ["o", "p"], "s"))
    for name in ("max", "max_of"):
        if some[name]:
            held = links.join(tables[name], "p").join(types.withColumnRenamed("c", "r"), ["s", "r"])
            if name == "max_of":
                of = types.select(F.col("s").alias("o"), F.col("c").alias("v"))
                held = held.where(F.col("v") == t.OWL + "Thing").select("s", "r", "p", "o").union(held.join(of, ["o", "v"]).select("s", "r", "p", "o"))
            made.append(_equal(held, ["s", "r", "p"], "o"))
    if some["keys"]:
        # tuples of values, one property of the key after the other; a null in to_json is left out, so kinds stay apart
        of = known.select("s", F.col("p").alias("member"), F.to_json(F.struct("o", "o_kind", "o_dt", "o_lang")).alias("value"))
        state = types.join(tables["keys"].where("i = 0").select("key", F.col("owner").alias("c"), "n"), "c").select("key", "n", "s", F.lit("").alias("values"))
        for i in range(tables["keys"].agg(F.max("n")).first()[0]):
            step = state.where(F.col("n") > i).join(tables["keys"].where(F.col("i") == i).select("key", "member"), "key").join(of, ["s", "member"])
            state = state.where(F.col("n") <= i).unionByName(step.select("key", "n", "s", F.concat_ws("\n", "values", "value").alias("values")))
        made.append(_equal(state, ["key", "values"], "s"))
    return made


_SAME = t.OWL + "sameAs"
#: Columns with terms in the tables of rules: equal ones are one there as well.
_TERMS = ["a", "b", "p", "c", "r", "v", "owner", "member"]
#: Columns with predicates of the facts that rules read, and of those that they make.
_READ = {"subp": "a", "inverse": "a", "chain": "member", "keys": "member", **dict.fromkeys(("domain", "range", "symmetric", "transitive", "functional", "inverse_functional", "some", "all", "has", "max", "max_of"), "p")}
_MADE = {"subp": "b", "inverse": "b", "chain": "owner", "symmetric": "p", "transitive": "p", "has": "p"}


def _predicates(tables: dict[str, DataFrame], columns: dict[str, str]) -> Column:
    """Whether a predicate is in one of the columns, a type or an equality; always true where they are many."""
    found = reduce(DataFrame.union, [tables[k].select(F.col(c).alias("p")) for k, c in columns.items()]).distinct().limit(1001).collect()
    return F.lit(True) if len(found) > 1000 else F.col("p").isin(sorted({t.TYPE, _SAME, *(r.p for r in found)}))


def _small(df: DataFrame) -> DataFrame:
    """Sent to all executors if it is small."""
    return F.broadcast(df) if df.limit(ONE_TASK + 1).count() <= ONE_TASK else df


class _Groups:
    """Equal individuals: ``node, rep`` for each but the one that stands for its group, which is the least, or the least
    of the W3C's terms where there is one, as rules look for these by name."""

    def __init__(self):
        self.of: DataFrame | None = None

    def merge(self, equal: DataFrame) -> DataFrame:
        """Takes up ``x, y``, pairs of ones that stand for groups; ``node, rep`` of those that no longer do."""
        with scratch(equal.sparkSession) as keep:
            found = connected_components(equal, "x", "y")
            known = found.where(F.col("node").startswith(t.W3C)).groupBy("component").agg(F.min("node").alias("term"))
            if not known.isEmpty():
                found = found.join(known, "component", "left").select("node", F.coalesce("term", "component").alias("component"))
            moved = keep(materialise(found.where("node <> component").select("node", F.col("component").alias("rep")), "rl-moved"))
        before, self.of = self.of, moved
        if before is not None:
            onward = before.join(_small(moved.toDF("rep", "to")), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
            self.of = materialise(onward.unionByName(moved), "rl-groups")
            release(before)
        return moved

    def _each(self) -> DataFrame:
        return self.of.unionByName(self.of.select(F.col("rep").alias("node"), "rep").distinct())

    def spread(self, df: DataFrame, *columns: str) -> DataFrame:
        """A row for each member of the group of a value; other values as they are."""
        if self.of is None:
            return df
        reps = _small(materialise(self.of.select("rep").distinct(), "rl-reps"))
        for column in columns:
            on = F.col(column) == F.col("rep")
            several = df.join(reps, on, "left_semi")
            if several.isEmpty():
                continue
            more = _small(several).join(self._each(), on).withColumn(column, F.col("node"))
            if column + "_kind" in df.columns:
                more = more.withColumn(column + "_kind", _kind(column))
            df = df.join(reps, on, "left_anti").unionByName(more.drop("node", "rep"))
        return df

    def links(self) -> DataFrame:
        """Each member but the least, linked to the least of its group."""
        each = self._each()
        least = each.groupBy("rep").agg(F.min("node").alias("x"))
        return _edge(each.join(least, "rep").where("node <> x"), "node", _SAME, "x")


def _put(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """The column in terms of those that stand for groups; rows with another term are ``changed``."""
    out = df.join(to.toDF(column, "to"), column, "left").withColumn("changed", F.col("changed") | F.col("to").isNotNull()).withColumn(column, F.coalesce("to", column))
    if column + "_kind" in df.columns:
        out = out.withColumn(column + "_kind", F.when(F.col("to").isNotNull(), _kind(column)).otherwise(F.col(column + "_kind")))
    return out.drop("to")


def _rewritten(df: DataFrame, moved: DataFrame) -> DataFrame:
    """Facts in terms of those that stand for groups, each once, ``changed`` if no fact was that before."""
    to = _small(moved)
    few = lambda df, column: materialise(df.select(F.col(column).alias("node")).distinct().join(to, "node"), "rl-few")
    types, links, literals = df.where((F.col("p") == t.TYPE) & (F.col("o_kind") < 2)), df.where((F.col("p") != t.TYPE) & (F.col("o_kind") < 2)), df.where("o_kind = 2")
    names, classes = few(df, "p"), few(types, "o")
    if not classes.isEmpty():
        types = _put(types, "o", _small(classes))
    facts = _put(_put(links, "o", to).unionByName(types).unionByName(literals), "s", to)
    if not names.isEmpty():
        facts = _put(facts, "p", _small(names))
    return facts.groupBy(*_KEY).agg(F.min("changed").alias("changed"))


def _closed(g: Graph, same_as: bool, rounds: int | None, types_only: bool) -> tuple[DataFrame, _Groups]:
    """The closed facts, said of those that stand for groups of equal individuals, and the groups.

    With ``types_only`` facts are left aside that no rule reads, so what the closure has of them is not told.
    """
    tables = {k: materialise(v, f"rl-{k}") for k, v in _schema(_terminology(g)).items()}
    some = {k: not v.isEmpty() for k, v in tables.items()}
    read, made_by_rules = _predicates(tables, _READ), _predicates(tables, _MADE)
    stated = [g.loose().where(read) if types_only else g.triples, _edge(tables["sub"], "a", t.SUBCLASS, "b"), _edge(tables["subp"], "a", t.RDFS + "subPropertyOf", "b"), _edge(_mutual(tables["sub"]), "a", t.OWL + "equivalentClass", "b"), _edge(_mutual(tables["subp"]), "a", t.OWL + "equivalentProperty", "b")]
    stated += [_edge(tables["domain"], "p", t.DOMAIN, "c"), _edge(tables["range"], "p", t.RANGE, "c"), _edge(tables["one_of"], "member", t.TYPE, "owner")]
    tables["range"] = tables["range"].where(~F.col("c").startswith(t.XSD) & (F.col("c") != t.RDFS + "Literal"))
    past, fresh, groups, done = [], materialise(reduce(DataFrame.unionByName, stated).distinct(), "rl"), _Groups(), 0
    while True:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"the closure is not complete after {rounds} rounds")
        done += 1
        while same_as:
            known = reduce(DataFrame.unionByName, [*past, fresh])
            equal = fresh.where((F.col("p") == _SAME) & (F.col("o_kind") < 2)).select(F.col("s").alias("x"), F.col("o").alias("y"))
            equal = materialise(reduce(DataFrame.unionByName, _same(known, fresh, tables, some), equal).where("x <> y").distinct(), "rl-equal")
            if equal.isEmpty():
                break
            moved = groups.merge(equal)
            as_before = reduce(DataFrame.unionByName, [x.withColumn("changed", F.lit(False)) for x in past], fresh.withColumn("changed", F.lit(True)))
            itself = _edge(moved.select("rep").distinct(), "rep", _SAME, "rep").withColumn("changed", F.lit(True))
            whole = materialise(_rewritten(as_before.unionByName(itself), moved), "rl")
            release(equal, *past, fresh)
            terms = reduce(DataFrame.union, [x.select(F.col(c).alias("node")) for x in tables.values() for c in _TERMS if c in x.columns]).distinct()
            if terms.join(_small(moved), "node", "left_semi").isEmpty():
                past, fresh = [whole.where("not changed").drop("changed")], whole.where("changed").drop("changed")
            else:
                # facts that stay the same may now meet other rows of the tables
                past, fresh = [], whole.drop("changed")
                for k, v in tables.items():
                    out = v.withColumn("changed", F.lit(False))
                    for c in [c for c in _TERMS if c in v.columns]:
                        out = _put(out.where("v_kind < 2"), c, moved).unionByName(out.where("v_kind = 2")) if k == "has" and c == "v" else _put(out, c, moved)
                    tables[k] = materialise(out.select(*v.columns).distinct(), f"rl-{k}")
                made_by_rules = _predicates(tables, _MADE)
        known = reduce(DataFrame.unionByName, [*past, fresh])
        links = fresh.where((F.col("p") != t.TYPE) & (F.col("o_kind") < 2))
        types = fresh.where(F.col("p") == t.TYPE).select("s", F.col("o").alias("c"))
        every_type = known.where(F.col("p") == t.TYPE).select("s", F.col("o").alias("c"))
        every_link = known.where((F.col("p") != t.TYPE) & (F.col("o_kind") < 2)).select("s", "p", "o")
        made = [fresh.limit(0)]
        if some["sub"]:
            made.append(_edge(types.join(tables["sub"], F.col("c") == F.col("a")), "s", t.TYPE, "b"))
        if some["subp"]:
            made.append(fresh.join(tables["subp"], F.col("p") == F.col("a")).select("s", "s_kind", F.col("b").alias("p"), "o", "o_kind", "o_dt", "o_lang"))
        if some["inverse"]:
            made.append(_edge(links.join(tables["inverse"], F.col("p") == F.col("a")), "o", F.col("b"), "s"))
        if some["symmetric"]:
            made.append(_edge(links.join(tables["symmetric"], "p"), "o", F.col("p"), "s"))
        if some["domain"]:
            made.append(_edge(fresh.join(tables["domain"], "p"), "s", t.TYPE, "c"))
        if some["range"]:
            made.append(_edge(links.join(tables["range"], "p"), "o", t.TYPE, "c"))
        if some["transitive"]:
            new, old = links.join(tables["transitive"], "p").select("s", "p", "o"), every_link.join(tables["transitive"], "p")
            step = lambda x, y: x.select("s", "p", F.col("o").alias("m")).join(y.select(F.col("s").alias("m"), "p", "o"), ["p", "m"])
            made += [_edge(step(new, old), "s", F.col("p"), "o"), _edge(step(old, new), "s", F.col("p"), "o")]
        if some["some"]:
            of = every_type.select(F.col("s").alias("o"), F.col("c").alias("v")).join(tables["some"].select("v").distinct(), "v", "left_semi")
            made.append(_edge(every_link.join(tables["some"], "p").join(of, ["o", "v"]), "s", t.TYPE, "r"))
            made.append(_edge(fresh.join(tables["some"].where(F.col("v") == t.OWL + "Thing").select("p", "r"), "p"), "s", t.TYPE, "r"))
        if some["all"]:
            made.append(_edge(every_link.join(tables["all"], "p").join(every_type.select("s", F.col("c").alias("r")), ["s", "r"]), "o", t.TYPE, "v"))
        if some["has"]:
            made.append(types.join(tables["has"], F.col("c") == F.col("r")).select("s", _kind("s").alias("s_kind"), "p", *[F.col(v).alias(o) for v, o in zip(_VALUE, _KEY[3:], strict=True)]))
            alike = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(o)) for v, o in zip(_VALUE, _KEY[3:], strict=True)])
            made.append(_edge(fresh.join(tables["has"], "p").where(alike), "s", t.TYPE, "r"))
        if some["both"]:
            parts = every_type.join(tables["both"], F.col("c") == F.col("member"))
            whole = tables["both"].groupBy("key").agg(F.countDistinct("member").alias("m"))
            made.append(_edge(parts.groupBy("key", "owner", "s").agg(F.countDistinct("member").alias("k")).join(whole, "key").where("k = m"), "s", t.TYPE, "owner"))
        if some["chain"]:
            along = tables["chain"].select("key", "i", F.col("member").alias("p"), "owner", "n")
            path = every_link.join(along.where("i = 0"), "p").select("key", "owner", "n", "s", "o")
            for i in range(1, tables["chain"].agg(F.max("n")).first()[0]):
                step = path.where(F.col("n") > i).select("key", "owner", "n", F.col("s").alias("from"), F.col("o").alias("s")).join(along.where(F.col("i") == i).select("key", "p"), "key").join(every_link, ["s", "p"])
                path = path.where(F.col("n") <= i).unionByName(step.select("key", "owner", "n", F.col("from").alias("s"), "o"))
            made.append(_edge(path, "s", F.col("owner"), "o"))
        # one exchange tells what is new: rules make facts of few predicates
        derived = reduce(DataFrame.unionByName, made).withColumn("new", F.lit(True)).unionByName(known.where(made_by_rules).withColumn("new", F.lit(False)))
        found = materialise(derived.groupBy(*_KEY).agg(F.min("new").alias("new")).where("new").select(*_KEY), "rl")
        past, fresh = [*past, fresh], found
        if found.isEmpty():
            break
        if len(past) > 16:
            before, past = past, [materialise(reduce(DataFrame.unionByName, past), "rl")]
            release(*before)
    if types_only and groups.of is not None:
        unread = g.loose().where(~read).select(F.col("p").alias("node")).distinct()
        if not groups.of.select(F.explode(F.array("node", "rep")).alias("node")).join(F.broadcast(unread), "node", "left_semi").isEmpty():
            return _closed(g, same_as, rounds, False)
    return reduce(DataFrame.unionByName, past), groups


def closure(g: Graph, same_as: bool = True, rounds: int | None = None) -> Graph:
    """The graph with what OWL 2 RL and RDFS rules derive; no axiomatic or datatype triples.

    The terminology is closed first. The assertions are then closed semi-naively: each round joins only
    the triples that the round before added with the small terminological tables, and transitive
    properties, chains, keys and the like with the whole. Individuals that a functional property, a
    maximum cardinality of 1, a key or the graph makes equal are one in all rounds, so that the work does not
    grow with their pairs; at the end facts are copied to each, and each is linked to the least of its
    group. ``same_as=False`` leaves that out. Rounds go on until nothing is new; if ``rounds`` are not
    enough, a RuntimeError is raised. README lists the rules that are left out.
    """
    known, groups = _closed(g, same_as, rounds, False)
    if groups.of is None:
        return Graph(known, distinct=True)
    facts = known.where((F.col("p") != _SAME) | (F.col("o_kind") == 2))
    facts = groups.spread(facts.where("o_kind < 2"), "p", "o", "s").unionByName(groups.spread(facts.where("o_kind = 2"), "p", "s"))
    return Graph(materialise(facts.unionByName(groups.links().unionByName(g.of(_SAME).where("o_kind < 2")).distinct()), "rl"), distinct=True)


def closed_types(g: Graph) -> DataFrame:
    """``s, c``: all types in the closure. No other fact is copied to equal individuals, which may make as many as pairs of them."""
    known, groups = _closed(g, True, None, True)
    return groups.spread(known.where((F.col("p") == t.TYPE) & (F.col("o_kind") < 2)).select("s", F.col("o").alias("c")), "c", "s")


def sample(g: Graph, n: int, seed: int = 0) -> Graph:
    """The descriptions of n subjects, chosen by hash; all where there are no more."""
    subjects = g.where("s_kind = 0").select("s").distinct().orderBy(F.xxhash64("s", F.lit(seed)), "s").limit(n)
    return Graph(frontier(subjects, g.triples).drop("root").distinct(), distinct=True)


def contradictions(g: Graph, source: str = "owl-rl-closure") -> DataFrame:
    """Findings of the checks that stay meaningful on the closure."""
    return findings.merge(findings.union([findings.make(checks.RULES[i](g), CHECKS[i], source) for i in checks.CLOSURE_SAFE], g.quads.sparkSession))


def unavailable(spark, backend: str) -> DataFrame:
    row = spark.createDataFrame([(t.WHOLE_GRAPH, None, None, f"the external reasoner {backend} is not part of this engine")], "focus string, path string, value string, message string")
    return findings.make(row, CHECKS["REA-022"], backend)


def consistency(g: Graph, backend: str = "auto") -> DataFrame:
    """Contradictions of the closed graph; external reasoners are reported as not available."""
    if backend == "none":
        return findings.empty(g.quads.sparkSession)
    found = contradictions(closure(g))
    return found if backend in ("auto", "owlrl-only") else found.unionByName(unavailable(g.quads.sparkSession, backend))


_CARDINALITY = ["cardinality", "minCardinality", "maxCardinality", "qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality"]
_ID = {"EL": "REA-010", "QL": "REA-011", "RL": "REA-012"}


def profiles(g: Graph, wanted: tuple[str, ...] = ("EL", "QL", "RL")) -> DataFrame:
    """``profile, construct, subject``: what takes the ontology beyond a profile, by its nearest named owner."""
    parts = []

    def add(names: str, construct: str, df: DataFrame) -> None:
        for name in names.split():
            if name in wanted:
                parts.append(df.select(F.lit(name).alias("profile"), F.lit(construct).alias("construct"), F.col("s").alias("node")))

    for construct, names in (("unionOf", "EL QL RL"), ("complementOf", "EL QL RL"), ("allValuesFrom", "EL QL"), ("disjointWith", "EL")):
        add(names, construct, g.of(t.OWL + construct))
    for facet in _CARDINALITY:
        add("EL QL RL", facet, g.of(t.OWL + facet).where(F.col("o").try_cast("int") > 1))
    above = g.of(t.SUBCLASS).select(F.col("o").alias("s"))
    add("QL", "someValuesFrom", g.of(t.OWL + "someValuesFrom").join(above, "s", "left_semi"))
    add("QL", "TransitiveProperty", g.typed(t.OWL + "TransitiveProperty"))
    add("EL", "FunctionalProperty", g.typed(t.OWL + "FunctionalProperty"))
    if not parts:
        return g.quads.sparkSession.createDataFrame([], "profile string, construct string, subject string")
    owner = nearest_named(g.triples, 8)
    found = reduce(DataFrame.unionByName, parts)
    return found.join(owner, "node", "left").select("profile", "construct", F.coalesce("owner", "node").alias("subject")).distinct()


def profile_findings(g: Graph, wanted: tuple[str, ...] = ("EL", "QL", "RL")) -> DataFrame:
    found = profiles(g, wanted)
    parts = [findings.make(found.where(F.col("profile") == name).select(F.col("subject").alias("focus"), F.lit(None).cast("string").alias("path"), F.col("construct").alias("value"), F.concat("subject", F.lit(" uses "), "construct", F.lit(f", which {name} lacks")).alias("message")), CHECKS[_ID[name]], "profile") for name in wanted]
    return findings.merge(findings.union(parts, g.quads.sparkSession))
