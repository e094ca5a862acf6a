"""Mapping of relational tables to quads, and the same mapping as SQL text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel import terms as t


@dataclass(frozen=True)
class Column:
    """One predicate of a table: SQL expressions for subject and object. A null part makes no triple."""

    table: str
    subject: str
    predicate: str
    value: str
    kind: int = t.LITERAL
    datatype: str | None = t.XSD + "string"
    language: str | None = None
    where: str = "true"
    subject_kind: int = t.IRI

    def select(self) -> str:
        dt = "null" if self.kind != t.LITERAL else f"'{t.RDF}langString'" if self.language else f"'{self.datatype}'"
        lang = f"'{self.language}'" if self.language else "null"
        return f"{self.subject} AS s, {self.subject_kind} AS s_kind, '{self.predicate}' AS p, cast({self.value} AS string) AS o, {self.kind} AS o_kind, cast({dt} AS string) AS o_dt, cast({lang} AS string) AS o_lang"


def quads(tables: dict[str, DataFrame], columns: list[Column], triples: list[tuple] = (), graph: str = "urn:g/data") -> DataFrame:
    """Quads of the mapped columns and of literal triples (s, s_kind, p, o, o_kind, datatype, language).

    Each column is a projection of its own with constant predicate and kind, so a filter on the
    predicate prunes every other table from the plan, and each scan reads the columns it needs.
    """
    parts = []
    for c in columns:
        body, condition = c.select(), f"({c.subject}) IS NOT NULL AND ({c.value}) IS NOT NULL AND ({c.where})"
        parts.append(tables[c.table].where(condition).selectExpr(f"'{graph}' AS g", *_split(body), f"'{c.table}' AS src"))
    if triples:
        spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
        parts.append(spark.createDataFrame([(graph, *x, "inline") for x in triples], t.QUAD))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("g", "s", F.col("s_kind").cast("int"), "p", "o", F.col("o_kind").cast("int"), "o_dt", "o_lang", "src")


def _split(select: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:i].strip())
            at = i + 1
    return [*out, select[at:].strip()]


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def quads_sql(columns: list[Column], triples: list[tuple] = ()) -> str:
    """The distinct triples of the mapping as one SQL query."""
    parts = [f"SELECT {c.select()} FROM {c.table} WHERE ({c.subject}) IS NOT NULL AND ({c.value}) IS NOT NULL AND ({c.where})" for c in columns]
    if triples:
        values = ", ".join("(" + ", ".join(_sql(x) for x in row) + ")" for row in triples)
        parts.append(f"SELECT * FROM (VALUES {values}) AS v(s, s_kind, p, o, o_kind, o_dt, o_lang)")
    return " UNION ".join(parts)
