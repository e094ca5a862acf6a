"""A SPARQL 1.1 subset compiled to DataFrame plans, for checks that projects write themselves.

A solution is a row with one struct column (value, kind, dt, lang) for each variable; null is unbound,
and also the outcome of an expression error, which drops a row in FILTER as the standard asks.
Triple patterns are ordered so that each joins the ones before it, the most selective first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel import terms as t
from oriel.fixpoint import transitive_closure
from oriel.graph import Graph
from oriel.sources.turtle import unescape

_TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)|<(?P<iri>[^<>"{}|^`\\\x00-\x20]*)>|[?$](?P<var>\w+)|(?P<long>\"{3}.*?\"{3}|'{3}.*?'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?)|_:(?P<blank>\w+)|(?P<pname>(?:[A-Za-z][\w.-]*)?:(?:[\w-](?:[\w.-]*[\w-])?)?)|(?P<word>[A-Za-z_]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])""",
    re.X | re.S,
)
TERM = "struct<value:string,kind:int,dt:string,lang:string>"


class QueryError(ValueError):
    pass


@dataclass
class Query:
    form: str
    where: list
    select: list = field(default_factory=list)
    distinct: bool = False
    template: list = field(default_factory=list)
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i, self.fresh, self.prefixes = 0, 0, {"rdf": t.RDF, "rdfs": t.RDFS, "owl": t.OWL, "xsd": t.XSD, "skos": t.SKOS, **(prefixes or {})}

    def peek(self, ahead: int = 0):
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "")

    def word(self, *names: str) -> bool:
        k, v = self.peek()
        return k == "word" and v.upper() in names

    def mark(self, *names: str) -> bool:
        k, v = self.peek()
        return k == "mark" and v in names

    def next(self):
        self.i += 1
        return self.tokens[self.i - 1] if self.i <= len(self.tokens) else ("end", "")

    def accept(self, name: str) -> bool:
        k, v = self.peek()
        if (k == "mark" and v == name) or (k == "word" and v.upper() == name):
            self.i += 1
            return True
        return False

    def expect(self, name: str) -> None:
        if not self.accept(name):
            raise QueryError(f"expected {name}, found {self.peek()[1]!r}")

    def iri(self, k: str, v: str) -> str:
        if k == "iri":
            return v
        prefix, _, local = v.partition(":")
        if k != "pname" or prefix not in self.prefixes:
            raise QueryError(f"unknown prefix or IRI {v!r}")
        return self.prefixes[prefix] + local

    def prologue(self) -> None:
        while self.word("PREFIX", "BASE"):
            if self.next()[1].upper() == "PREFIX":
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1]
            else:
                self.next()

    def query(self) -> Query:
        self.prologue()
        q = self.body()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return q

    def body(self) -> Query:
        k, form = self.next()
        q = Query(form.upper(), [])
        if q.form == "SELECT":
            q.distinct = self.accept("DISTINCT") or self.accept("REDUCED")
            if not self.accept("*"):
                while self.peek()[0] == "var" or self.mark("("):
                    if self.accept("("):
                        e = self.expression()
                        self.expect("AS")
                        q.select.append((self.next()[1], e))
                        self.expect(")")
                    else:
                        v = self.next()[1]
                        q.select.append((v, ("var", v)))
        elif q.form == "CONSTRUCT":
            self.expect("{")
            q.template = self.triples("}", True)
            self.expect("}")
        elif q.form != "ASK":
            raise QueryError(f"{form} is not supported")
        self.accept("WHERE")
        q.where = self.group()
        if self.accept("GROUP"):
            self.expect("BY")
            while self.peek()[0] == "var" or self.mark("("):
                if self.accept("("):
                    e = self.expression()
                    name = self.next()[1] if self.accept("AS") else f"_g{len(q.group)}"
                    self.expect(")")
                    q.group.append((name, e))
                else:
                    v = self.next()[1]
                    q.group.append((v, ("var", v)))
        if self.accept("HAVING"):
            while self.mark("("):
                q.having.append(self.primary())
        if self.accept("ORDER"):
            self.expect("BY")
            while self.peek()[0] == "var" or self.mark("(") or self.word("ASC", "DESC"):
                down = self.accept("DESC")
                self.accept("ASC")
                q.order.append((self.primary(), down))
        while self.word("LIMIT", "OFFSET"):
            which, n = self.next()[1].upper(), int(self.next()[1])
            q.limit, q.offset = (n, q.offset) if which == "LIMIT" else (q.limit, n)
        return q

    def group(self) -> list:
        self.expect("{")
        out: list = []
        while not self.accept("}"):
            if self.word("SELECT"):
                out.append(("sub", self.body()))
            elif self.accept("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.accept("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.accept("MINUS"):
                out.append(("minus", self.group()))
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                out.append(("bind", self.next()[1], e))
                self.expect(")")
            elif self.accept("VALUES"):
                out.append(self.values())
            elif self.mark("{"):
                arms = [self.group()]
                while self.accept("UNION"):
                    arms.append(self.group())
                out.append(("union", arms) if len(arms) > 1 else ("group", arms[0]))
            elif self.accept("."):
                continue
            else:
                out += [("triple", *x) for x in self.triples("}", False)]
        return out

    def values(self):
        if self.peek()[0] == "var":
            names, single = [self.next()[1]], True
        else:
            self.expect("(")
            names, single = [], False
            while not self.accept(")"):
                names.append(self.next()[1])
        self.expect("{")
        rows = []
        while not self.accept("}"):
            if not single:
                self.expect("(")
            row = [None if self.accept("UNDEF") else self.term()[1] for _ in names]
            if not single:
                self.expect(")")
            rows.append(row)
        return ("values", names, rows)

    def constraint(self):
        if self.word("NOT") or self.word("EXISTS"):
            return self.exists()
        return self.primary()

    def exists(self):
        no = self.accept("NOT")
        self.expect("EXISTS")
        return ("exists", self.group(), no)

    def blank(self) -> tuple:
        self.fresh += 1
        return ("var", f"_b{self.fresh}")

    def triples(self, end: str, template: bool) -> list[tuple]:
        out: list[tuple] = []
        while not self.mark(end) and not self.word("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "SELECT", "UNION") and not self.mark("{"):
            s = self.node(out, template)
            if not self.mark(".", end):
                self.predicates(s, out, template)
            if not self.accept("."):
                break
        return out

    def predicates(self, s, out, template) -> None:
        while True:
            p = ("iri", t.TYPE) if self.peek() == ("word", "a") and self.next() else ("var", self.next()[1]) if self.peek()[0] == "var" else self.path()
            while True:
                out.append((s, p, self.node(out, template)))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.mark(".", "]", "}"):
                return

    def node(self, out, template):
        if self.accept("["):
            own = self.blank() if not template else ("new", self.blank()[1])
            if not self.accept("]"):
                self.predicates(own, out, template)
                self.expect("]")
            return own
        if self.peek()[0] == "blank":
            name = self.next()[1]
            return ("new", name) if template else ("var", f"_n{name}")
        if self.peek()[0] == "var":
            return ("var", self.next()[1])
        return self.term()

    def term(self):
        k, v = self.next()
        if k in ("iri", "pname"):
            return ("term", (self.iri(k, v), t.IRI, None, None))
        sign = ""
        if k == "mark" and v in "+-":
            sign, (k, v) = v, self.next()
        if k == "num":
            kind = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
            return ("term", (sign + v, t.LITERAL, t.XSD + kind, None))
        if k == "word" and v in ("true", "false"):
            return ("term", (v, t.LITERAL, t.XSD + "boolean", None))
        if k in ("str", "long"):
            text = unescape(v[3:-3] if k == "long" else v[1:-1])
            if self.peek()[0] == "lang":
                return ("term", (text, t.LITERAL, t.RDF + "langString", self.next()[1].lower()))
            if self.accept("^^"):
                return ("term", (text, t.LITERAL, self.iri(*self.next()), None))
            return ("term", (text, t.LITERAL, t.XSD + "string", None))
        raise QueryError(f"expected a term, found {v!r}")

    def path(self):
        arms = [self.sequence()]
        while self.accept("|"):
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("alt", arms)

    def sequence(self):
        steps = [self.step()]
        while self.accept("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else ("seq", steps)

    def step(self):
        if self.accept("^"):
            return ("inv", self.step())
        if self.accept("("):
            p = self.path()
            self.expect(")")
        elif self.peek() == ("word", "a"):
            self.next()
            p = ("iri", t.TYPE)
        else:
            p = ("iri", self.iri(*self.next()))
        for m in ("+", "*", "?"):
            if self.accept(m):
                return (m, p)
        return p

    def expression(self):
        left = self.conjunction()
        while self.accept("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.relation()
        while self.accept("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self):
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.accept(op):
                return ("cmp", op, left, self.sum())
        no = self.word("NOT") and self.peek(1)[1].upper() == "IN" and bool(self.next())
        if self.accept("IN"):
            self.expect("(")
            items = []
            while not self.accept(")"):
                items.append(self.expression())
                self.accept(",")
            return ("in", left, items, no)
        return left

    def sum(self):
        left = self.product()
        while self.mark("+", "-"):
            left = ("math", self.next()[1], left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.mark("*", "/"):
            left = ("math", self.next()[1], left, self.unary())
        return left

    def unary(self):
        if self.accept("!"):
            return ("not", self.unary())
        return self.primary()

    def primary(self):
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        k, v = self.peek()
        if k == "var":
            self.next()
            return ("var", v)
        if self.word("NOT", "EXISTS"):
            return self.exists()
        if k == "word" and self.peek(1) == ("mark", "("):
            self.i += 2
            distinct = self.accept("DISTINCT")
            args, separator = [], " "
            while not self.accept(")"):
                if self.accept("*"):
                    args.append(("all",))
                elif self.word("SEPARATOR"):
                    self.next()
                    self.expect("=")
                    separator = self.term()[1][0]
                else:
                    args.append(self.expression())
                self.accept(",") or self.accept(";")
            return ("call", v.upper(), args, distinct, separator)
        if k in ("iri", "pname") and self.peek(1) == ("mark", "("):
            name = self.iri(*self.next())
            self.next()
            arg = self.expression()
            self.expect(")")
            return ("cast", name, arg)
        return self.term()


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
NUMERIC = [t.XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "nonNegativeInteger")]


def _make(value: Column, kind: int = t.LITERAL, dt: str | Column | None = t.XSD + "string", lang: Column | None = None) -> Column:
    dt = F.lit(dt).cast("string") if dt is None or isinstance(dt, str) else dt
    made = F.struct(value.cast("string").alias("value"), F.lit(kind).alias("kind"), dt.alias("dt"), (F.lit(None).cast("string") if lang is None else lang).alias("lang"))
    return F.when(value.isNotNull(), made).otherwise(F.lit(None).cast(TERM))


def _constant(term: tuple) -> Column:
    value, kind, dt, lang = term
    return F.struct(F.lit(value).alias("value"), F.lit(kind).alias("kind"), F.lit(dt).cast("string").alias("dt"), F.lit(lang).cast("string").alias("lang"))


class Compiler:
    def __init__(self, g: Graph):
        self.g = g

    # -- expressions: each gives a term struct, or a boolean column for tests ---------------------

    def term(self, e, names: set[str]) -> Column:
        op = e[0]
        if op == "var":
            return F.col(f"v_{e[1]}") if e[1] in names else F.lit(None).cast(TERM)
        if op == "term":
            return _constant(e[1])
        if op == "math":
            a, b = (self.number(x, names) for x in e[2:])
            n = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]]
            return _make(n, dt=t.XSD + "decimal")
        if op == "cast":
            return _make(self.term(e[2], names)["value"], dt=e[1])
        if op == "call" and e[1] not in ("BOUND", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "REGEX", "STRSTARTS", "STRENDS", "CONTAINS", "SAMETERM", "LANGMATCHES"):
            return self.call(e[1], e[2], names)
        return _make(self.test(e, names).cast("string"), dt=t.XSD + "boolean")

    def number(self, e, names) -> Column:
        return self.term(e, names)["value"].try_cast("double")

    def text(self, e, names) -> Column:
        return self.term(e, names)["value"]

    def call(self, name: str, args: list, names) -> Column:
        x = self.term(args[0], names) if args else None
        s = x["value"] if x is not None else None
        if name == "STR":
            return _make(s)
        if name == "DATATYPE":
            return _make(F.when(x["kind"] == 2, x["dt"]), t.IRI, None)
        if name == "LANG":
            return _make(F.when(x["kind"] == 2, F.coalesce(x["lang"], F.lit(""))))
        if name in ("IRI", "URI"):
            return _make(s, t.IRI, None)
        if name == "STRDT":
            return _make(s, dt=self.text(args[1], names))
        if name == "STRLANG":
            return _make(s, dt=t.RDF + "langString", lang=F.lower(self.text(args[1], names)))
        if name == "CONCAT":
            return _make(F.concat(*[self.text(a, names) for a in args]))
        if name in ("LCASE", "UCASE"):
            return _make({"LCASE": F.lower, "UCASE": F.upper}[name](s), dt=x["dt"], lang=x["lang"])
        if name == "REPLACE":
            return _make(F.regexp_replace(s, self.text(args[1], names), self.text(args[2], names)), dt=x["dt"], lang=x["lang"])
        if name == "SUBSTR":
            n = self.number(args[2], names).cast("int") if len(args) > 2 else F.lit(1 << 30)
            return _make(F.substring(s, self.number(args[1], names).cast("int"), n))
        if name == "STRLEN":
            return _make(F.length(s), dt=t.XSD + "integer")
        if name in ("STRBEFORE", "STRAFTER"):
            y, at = self.text(args[1], names), F.instr(s, self.text(args[1], names))
            return _make(F.when(at == 0, "").otherwise(F.substring(s, F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(s, at + F.length(y), F.lit(1 << 30))))
        if name in ("ROUND", "CEIL", "FLOOR", "ABS"):
            return _make({"ROUND": lambda c: F.floor(c + 0.5), "CEIL": F.ceil, "FLOOR": F.floor, "ABS": F.abs}[name](self.number(args[0], names)), dt=x["dt"])
        if name == "IF":
            return F.when(self.test(args[0], names), self.term(args[1], names)).when(~self.test(args[0], names), self.term(args[2], names))
        if name == "COALESCE":
            return F.coalesce(*[self.term(a, names) for a in args])
        if name in ("MD5", "SHA1", "SHA256"):
            return _make({"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256)}[name](s.cast("binary")))
        if name == "ENCODE_FOR_URI":
            return _make(F.url_encode(s))
        raise QueryError(f"function {name} is not supported")

    def test(self, e, names: set[str]) -> Column:
        op = e[0]
        if op in ("and", "or"):
            a, b = self.test(e[1], names), self.test(e[2], names)
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.test(e[1], names)
        if op == "cmp":
            return self.compare(e[1], self.term(e[2], names), self.term(e[3], names))
        if op == "in":
            hit = reduce(lambda x, y: x | y, [self.compare("=", self.term(e[1], names), self.term(i, names)) for i in e[2]], F.lit(False))
            return ~hit if e[3] else hit
        if op == "call":
            name, args = e[1], e[2]
            if name == "BOUND":
                return self.term(args[0], names).isNotNull()
            x = self.term(args[0], names)
            kinds = {"ISIRI": t.IRI, "ISURI": t.IRI, "ISBLANK": t.BLANK, "ISLITERAL": t.LITERAL}
            if name in kinds:
                return x["kind"] == kinds[name]
            if name == "ISNUMERIC":
                return x["dt"].isin(NUMERIC)
            if name == "SAMETERM":
                return x == self.term(args[1], names)
            if name == "LANGMATCHES":
                y = self.text(args[1], names)
                return F.when(y == "*", x["value"] != "").otherwise((F.lower(x["value"]) == F.lower(y)) | F.lower(x["value"]).startswith(F.concat(F.lower(y), F.lit("-"))))
            if name in ("REGEX", "STRSTARTS", "STRENDS", "CONTAINS"):
                s, y = x["value"], self.text(args[1], names)
                if name == "REGEX":
                    flags = args[2][1][0] if len(args) > 2 else ""
                    return F.regexp(s, F.concat(F.lit(f"(?{flags})"), y) if flags else y)
                return {"STRSTARTS": s.startswith, "STRENDS": s.endswith, "CONTAINS": s.contains}[name](y)
        x = self.term(e, names)
        return F.when(x["dt"] == t.XSD + "boolean", x["value"].isin("true", "1")).when(x["dt"].isin(NUMERIC), x["value"].try_cast("double") != 0).when(x["kind"] == 2, x["value"] != "")

    def compare(self, op: str, a: Column, b: Column) -> Column:
        numbers = a["dt"].isin(NUMERIC) & b["dt"].isin(NUMERIC)
        x, y = a["value"].try_cast("double"), b["value"].try_cast("double")
        if op in ("=", "!="):
            same = F.when(F.coalesce(numbers, F.lit(False)), x == y).when(a.isNotNull() & b.isNotNull(), a.eqNullSafe(b))
            return same if op == "=" else ~same
        order = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        return F.when(F.coalesce(numbers, F.lit(False)), order(x, y)).when(a["kind"] == b["kind"], order(a["value"], b["value"]))

    # -- patterns ---------------------------------------------------------------------------------

    def pairs(self, path) -> DataFrame:
        """``s, o`` term structs of a path."""
        op = path[0]
        if op == "iri":
            s = F.struct(F.col("s").alias("value"), F.col("s_kind").cast("int").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
            o = F.struct(F.col("o").alias("value"), F.col("o_kind").cast("int").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
            return self.g.of(path[1]).select(s.alias("s"), o.alias("o"))
        if op == "inv":
            return self.pairs(path[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if op == "alt":
            return reduce(DataFrame.unionByName, [self.pairs(p) for p in path[1]])
        if op == "seq":
            return reduce(lambda x, y: x.withColumnRenamed("o", "m").join(y.withColumnRenamed("s", "m"), "m").select("s", "o").distinct(), [self.pairs(p) for p in path[1]])
        inner = self.pairs(path[1])
        nodes = self.g.triples.select(F.explode(F.array(F.struct(F.col("s").alias("value"), F.col("s_kind").cast("int").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")), F.struct(F.col("o").alias("value"), F.col("o_kind").cast("int").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")))).alias("s")).distinct().select("s", F.col("s").alias("o"))
        if op == "?":
            return inner.union(nodes).distinct()
        key = lambda c: F.to_json(c)
        closed = transitive_closure(inner.select(key("s").alias("a"), key("o").alias("b"))).select(F.from_json("a", TERM).alias("s"), F.from_json("b", TERM).alias("o"))
        return closed if op == "+" else closed.union(nodes).distinct()

    def triple(self, s, p, o) -> tuple[DataFrame, set[str]]:
        if p[0] == "var":
            base = self.g.triples.select(
                F.struct(F.col("s").alias("value"), F.col("s_kind").cast("int").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).alias("s"), _make(F.col("p"), t.IRI, None).alias("p"),
                F.struct(F.col("o").alias("value"), F.col("o_kind").cast("int").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")).alias("o"),
            )
        else:
            base = self.pairs(p)
        columns: dict[str, Column] = {}
        for place, x in (("s", s), ("p", p), ("o", o)):
            if x[0] == "term":
                v = x[1]
                base = base.where((F.col(place)["value"] == v[0]) & (F.col(place)["kind"] == v[1]) & F.col(place)["dt"].eqNullSafe(F.lit(v[2]).cast("string")) & F.col(place)["lang"].eqNullSafe(F.lit(v[3]).cast("string")))
            elif x[0] == "var" and not (place == "p" and p[0] != "var"):
                if x[1] in columns:
                    base = base.where(columns[x[1]].eqNullSafe(F.col(place)))
                else:
                    columns[x[1]] = F.col(place)
        if not columns:
            return base.select(F.lit(1).alias("_one")).limit(1), set()
        return base.select(*[c.alias(f"v_{n}") for n, c in columns.items()]), set(columns)

    def join(self, a: tuple[DataFrame, set, set], b: tuple[DataFrame, set, set], how: str = "inner", tests: list = ()) -> tuple[DataFrame, set, set]:
        """Joins solutions on shared variables; those that may be unbound are compatible with any term.

        ``tests`` are filters that both sides' variables take part in; they are part of the condition.
        """
        (x, xs, xc), (y, ys, yc) = a, b
        shared = sorted(xs & ys)
        y = y.select(*[F.col(f"v_{n}").alias(f"r_{n}" if n in xs else f"v_{n}") for n in sorted(ys)]) if ys else y.select(F.lit(1).alias("_two"))
        on = F.lit(True)
        for n in shared:
            left, right = F.col(f"v_{n}"), F.col(f"r_{n}")
            on = on & ((left == right) if n in xc and n in yc else (left == right) | left.isNull() | right.isNull())
        if tests and shared and set(shared) <= xc & yc:
            y, on = self.matched(x, xs, y, ys, shared, tests)
        else:
            for e in tests:
                on = on & self.test(e, xs | ys)
        if not shared and how == "inner":
            out = x.crossJoin(y)
        else:
            out = x.join(y, on, how)
        if how in ("left_anti", "left_semi"):
            return out, xs, xc
        names = xs | ys
        columns = [(F.coalesce(f"v_{n}", f"r_{n}") if n in shared else F.col(f"v_{n}")).alias(f"v_{n}") for n in sorted(names)]
        out = out.select(*columns) if columns else out.select(F.lit(1).alias("_one"))
        return out, names, (xc | yc) if how == "inner" else xc

    def matched(self, x: DataFrame, xs: set, y: DataFrame, ys: set, shared: list[str], tests: list) -> tuple[DataFrame, Column]:
        """The right side with the left side's terms that it passes the tests with, and a condition of equalities alone.

        Tests are done once for each two combinations of the terms that they read, not for each two rows.
        """
        within = set().union(*(self.used(e) for e in tests))
        left, right = sorted((within & xs) - set(shared)), sorted((within & ys) - xs)
        both = reduce(lambda p, q: p & q, [F.col(f"v_{n}") == F.col(f"r_{n}") for n in shared] + [self.test(e, xs | ys) for e in tests])
        names = lambda prefix, of: [f"{prefix}_{n}" for n in of]
        pairs = x.select(*names("v", shared + left)).distinct().join(y.select(*names("r", shared), *names("v", right)).distinct(), both)
        pairs = pairs.select(*[F.col(f"v_{n}").alias(f"{k}_{n}") for k, of in (("k", shared), ("l", left), ("m", right)) for n in of])
        same = reduce(lambda p, q: p & q, [F.col(f"r_{n}") == F.col(f"k_{n}") for n in shared] + [F.col(f"v_{n}").eqNullSafe(F.col(f"m_{n}")) for n in right])
        on = reduce(lambda p, q: p & q, [F.col(f"v_{n}") == F.col(f"r_{n}") for n in shared] + [F.col(f"v_{n}").eqNullSafe(F.col(f"l_{n}")) for n in left])
        return y.join(pairs, same).select(*y.columns, *names("l", left)), on

    def unit(self) -> tuple[DataFrame, set, set]:
        return self.g.quads.sparkSession.range(1).select(F.lit(1).alias("_one")), set(), set()

    def bgp(self, patterns: list[tuple]) -> tuple[DataFrame, set, set]:
        """Joins patterns, the ones with most constants first, then always one that shares a variable."""
        score = lambda p: -sum(x[0] == "term" for x in (p[0], p[2])) * 2 - (p[1][0] == "iri") + (p[1][0] == "var") * 3
        left = sorted(patterns, key=score)
        df, names = self.triple(*left.pop(0))
        state = (df, names, set(names))
        while left:
            i = next((i for i, p in enumerate(left) if {x[1] for x in p if x[0] == "var"} & state[1]), 0)
            df, names = self.triple(*left.pop(i))
            state = self.join(state, (df, names, set(names)))
        return state

    def pattern(self, group: list) -> tuple[DataFrame, set, set]:
        state, filters, pending = None, [], []

        def flush():
            nonlocal state, pending
            if pending:
                made = self.bgp(pending)
                state, pending = made if state is None else self.join(state, made), []

        for item in group:
            if item[0] == "triple":
                pending.append(item[1:])
                continue
            if item[0] == "filter":
                filters.append(item[1])
                continue
            flush()
            if item[0] in ("optional", "minus"):
                state = state or self.unit()
                # a filter directly in an optional part sees the variables around it
                inside = {n for x in item[1] if x[0] != "filter" for n in self.used(x)}
                over = [x for x in item[1] if item[0] == "optional" and x[0] == "filter" and x[1][0] != "exists" and (self.used(x[1]) & state[1]) - inside]
                right = self.pattern([x for x in item[1] if x not in over])
                if item[0] == "optional":
                    state = self.join(state, right, "left", [x[1] for x in over])
                elif state[1] & right[1]:
                    state = self.join(state, right, "left_anti")
            elif item[0] == "bind":
                df, names, certain = state or self.unit()
                state = df.withColumn(f"v_{item[1]}", self.term(item[2], names)), names | {item[1]}, certain
            else:
                if item[0] == "union":
                    arms = [self.pattern(a) for a in item[1]]
                    names = set().union(*(a[1] for a in arms))
                    fill = [a[0].select(*[(F.col(f"v_{n}") if n in a[1] else F.lit(None).cast(TERM)).alias(f"v_{n}") for n in sorted(names)]) for a in arms]
                    made = reduce(DataFrame.unionByName, fill), names, set.intersection(*(a[2] for a in arms))
                elif item[0] == "values":
                    rows = [tuple(row) for row in item[2]]
                    df = self.g.quads.sparkSession.createDataFrame(rows, ", ".join(f"v_{n} {TERM}" for n in item[1]))
                    made = df, set(item[1]), {n for i, n in enumerate(item[1]) if all(r[i] is not None for r in rows)}
                elif item[0] == "sub":
                    df, names = self.select(item[1])
                    made = df, names, set(names) - {n for n, e in item[1].select if e[0] != "var"}
                else:
                    made = self.pattern(item[1])
                state = made if state is None else self.join(state, made)
        flush()
        df, names, certain = state or self.unit()
        for f in filters:
            if f[0] == "exists":
                inner = [("filter", x[1]) if x[0] == "filter" else x for x in f[1]]
                correlated = [x for x in inner if x[0] == "filter" and x[1][0] != "exists"]
                right = self.pattern([x for x in inner if x not in correlated])
                outer = [x for x in correlated if not self.used(x[1]) <= right[1]]
                right = (reduce(lambda d, x: d.where(self.test(x[1], right[1])), [x for x in correlated if x not in outer], right[0]), *right[1:])
                if outer:
                    df = df.withColumn("_row", F.monotonically_increasing_id())
                    both = self.join((df.drop("_row"), names, certain), right)
                    hit = reduce(lambda d, x: d.where(self.test(x[1], both[1])), outer, both[0]).select(*[f"v_{n}" for n in sorted(names)]).distinct()
                    df, *_ = self.join((df.drop("_row"), names, names), (hit, names, names), "left_anti" if f[2] else "left_semi")
                elif names & right[1]:
                    df, *_ = self.join((df, names, certain), right, "left_anti" if f[2] else "left_semi")
                else:
                    some = right[0].limit(1).agg(F.count("*").alias("_n")).where("_n = 0" if f[2] else "_n > 0")
                    df = df.crossJoin(some).drop("_n")
            else:
                df = df.where(self.test(f, names))
        return df, names, certain

    def used(self, e) -> set[str]:
        if isinstance(e, tuple) and e and e[0] == "var":
            return {e[1]}
        return set().union(*(self.used(x) for x in e)) if isinstance(e, (tuple, list)) else set()

    # -- query forms ------------------------------------------------------------------------------

    def aggregate(self, e, names: set[str]) -> Column:
        _, name, args, distinct, separator = e
        if name == "COUNT":
            if args[0][0] == "all":
                return _make(F.count("*"), dt=t.XSD + "integer")
            x = self.term(args[0], names)
            whole = F.when(x["kind"].isNotNull(), F.concat_ws("\x01", x["value"], x["kind"].cast("string"), F.coalesce(x["dt"], F.lit("")), F.coalesce(x["lang"], F.lit(""))))
            return _make(F.countDistinct(whole) if distinct else F.count(x["kind"]), dt=t.XSD + "integer")
        x = self.term(args[0], names)
        n = x["value"].try_cast("double")
        if name in ("SUM", "AVG"):
            return _make(F.coalesce((F.sumDistinct if distinct and name == "SUM" else {"SUM": F.sum, "AVG": F.avg}[name])(n), F.lit(0.0)), dt=t.XSD + "decimal")
        if name in ("MIN", "MAX", "SAMPLE"):
            # fields one by one: an aggregate that reads a struct both whole and in part is not planned well
            best = (F.max if name == "MAX" else F.min)(F.when(x["kind"].isNotNull(), F.struct(n.alias("n"), *[x[c].alias(c) for c in ("value", "kind", "dt", "lang")])))
            return F.when(best.isNotNull(), F.struct(*[best[c].alias(c) for c in ("value", "kind", "dt", "lang")]))
        values = F.array_sort((F.collect_set if distinct else F.collect_list)(x["value"]))
        return _make(F.array_join(values, separator))

    def split(self, e, found: list) -> tuple:
        """The expression with its aggregates taken out, as variables."""
        if isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
            found.append((f"_a{len(found)}", e))
            return ("var", found[-1][0])
        if isinstance(e, tuple):
            return tuple(self.split(x, found) if isinstance(x, (tuple, list)) else x for x in e)
        return [self.split(x, found) if isinstance(x, (tuple, list)) else x for x in e]

    def select(self, q: Query) -> tuple[DataFrame, set[str]]:
        df, names, _ = self.pattern(q.where)
        wanted = q.select or [(n, ("var", n)) for n in sorted(names) if not n.startswith("_")]
        found: list = []
        wanted = [(n, self.split(e, found)) for n, e in wanted]
        having = [self.split(h, found) for h in q.having]
        order = [(self.split(e, found), down) for e, down in q.order]
        if found or q.group:
            keys = [self.term(e, names).alias(f"v_{n}") for n, e in q.group]
            aggs = [self.aggregate(e, names).alias(f"v_{n}") for n, e in found] or [F.count("*").alias("_n")]
            df = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
            names = {n for n, _ in q.group} | {n for n, _ in found}
            for h in having:
                df = df.where(self.test(h, names))
        for n, e in wanted:
            if e != ("var", n) or n not in names:
                df = df.withColumn(f"v_{n}", self.term(e, names))
        names = names | {n for n, _ in wanted}
        keys = []
        for e, _ in order:
            x = self.term(e, names)
            keys += [x["value"].try_cast("double"), x["value"]]
        shown = [f"v_{n}" for n, _ in wanted]
        out = df.select(*[self.term(("var", n), names).alias(f"v_{n}") for n, _ in wanted], *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
        down = [d for _, d in order for _ in (0, 1)]
        if q.distinct:  # before the order, or a limit would count repeats
            out = out.groupBy(*shown).agg(*[(F.max if d else F.min)(f"_k{i}").alias(f"_k{i}") for i, d in enumerate(down)]) if keys else out.distinct()
        if keys:
            out = out.orderBy(*[F.col(f"_k{i}").desc() if d else F.col(f"_k{i}").asc() for i, d in enumerate(down)])
        out = out.select(*shown)
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out, {n for n, _ in wanted}

    def construct(self, q: Query, template: list | None = None, solutions=None) -> DataFrame:
        """Distinct triples; a part that is unbound drops its triple alone; new blank nodes for each solution."""
        df, names, _ = solutions or self.pattern(q.where)
        if q.limit is not None:
            df = df.limit(q.limit)
        row = F.md5(F.to_json(F.struct(*[F.col(f"v_{n}") for n in sorted(names)]), {"ignoreNullFields": "false"})) if names else F.lit("0")
        triples = []
        for s, p, o in template if template is not None else q.template:
            end = lambda x: _make(F.concat(F.lit("b"), F.substring(F.md5(F.concat(row, F.lit(x[1]))), 1, 16)), t.BLANK, None) if x[0] == "new" else _constant((x[1], t.IRI, None, None)) if x[0] == "iri" else self.term(x, names)
            triples.append(F.struct(end(s).alias("s"), end(p).alias("p"), end(o).alias("o")))
        x = df.select(F.explode(F.array(*triples)).alias("x")).where("x.s is not null and x.p is not null and x.o is not null and x.s.kind < 2 and x.p.kind = 0")
        return x.select(F.col("x.s.value").alias("s"), F.col("x.s.kind").alias("s_kind"), F.col("x.p.value").alias("p"), F.col("x.o.value").alias("o"), F.col("x.o.kind").alias("o_kind"), F.col("x.o.dt").alias("o_dt"), F.col("x.o.lang").alias("o_lang")).distinct()


def select(g: Graph, text: str, prefixes: dict[str, str] | None = None, terms: bool = False) -> DataFrame:
    """Solutions with one column for each variable: its string value, or the whole term."""
    q = Parser(text, prefixes).query()
    df, names = Compiler(g).select(q)
    order = [n for n, _ in q.select] or sorted(names)
    return df.select(*[(F.col(f"v_{n}") if terms else F.col(f"v_{n}")["value"]).alias(n) for n in order])


def construct(g: Graph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    return Compiler(g).construct(Parser(text, prefixes).query())


def ask(g: Graph, text: str, prefixes: dict[str, str] | None = None) -> bool:
    return not Compiler(g).pattern(Parser(text, prefixes).query().where)[0].isEmpty()


def update(g: Graph, text: str, prefixes: dict[str, str] | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """DELETE / INSERT ... WHERE: the new graph, the added and the removed triples."""
    p = Parser(text, prefixes)
    p.prologue()
    gone: list = []
    come: list = []
    if p.accept("DELETE"):
        p.expect("{")
        gone = p.triples("}", True)
        p.expect("}")
    if p.accept("INSERT"):
        p.accept("DATA")
        p.expect("{")
        come = p.triples("}", True)
        p.expect("}")
    where = p.group() if p.accept("WHERE") else []
    c = Compiler(g)
    found = c.pattern(where)
    empty = g.triples.limit(0)
    drop = c.construct(Query("CONSTRUCT", []), gone, found) if gone else empty
    add = c.construct(Query("CONSTRUCT", []), come, found) if come else empty
    same = [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in t.TRIPLE]
    without = lambda a, b: a.alias("x").join(b.alias("y"), reduce(lambda m, n: m & n, same), "left_anti").select(*[f"x.{n}" for n in t.TRIPLE])
    after = without(g.triples, drop).unionByName(add).distinct()
    return Graph(after, distinct=True), without(after, g.triples), without(g.triples, after)


def check_rows(g: Graph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Rows of a check written as SELECT ?focus ?path ?value ?message, any of the last three left out."""
    df = select(g, text, prefixes)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ("focus", "path", "value", "message")])
