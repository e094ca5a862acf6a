"""Reading RDF: locations, formats, sniffing, distributed parsing, imports."""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel import terms as t
from oriel.graph import Graph
from oriel.ship import ship
from oriel.sources import others, turtle

FORMATS = {".ttl": "turtle", ".turtle": "turtle", ".n3": "n3", ".nt": "nt", ".rdf": "xml", ".xml": "xml", ".owl": "xml", ".jsonld": "json-ld"}
FAMILY = {"turtle": "turtle", "n3": "turtle", "nt": "turtle", "xml": "xml", "json-ld": "json-ld"}
LARGEST = 1 << 30
GLOBS = "*.ttl,*.turtle"


def is_url(source: str) -> bool:
    return urlparse(source).scheme in ("http", "https")


def guess_format(source: str) -> str:
    """By extension, ``.gz`` and a URL's query aside; turtle failing that."""
    path = urlparse(source).path if is_url(source) else source
    path = path[:-3] if path.lower().endswith(".gz") else path
    return FORMATS.get(os.path.splitext(path)[1].lower(), "turtle")


def sniff(data: bytes) -> str | None:
    """The family that the first 8 KiB look like."""
    head = data[:8192].decode("utf-8", "replace").lstrip("\ufeff")
    head = re.sub(r"\A(?:\s+|#[^\n]*(?:\n|\Z))*", "", head)
    if re.match(r"<\?xml|<!DOCTYPE|<!--|<(?:\w+:)?RDF[\s>]", head):
        return "xml"
    if re.match(r"\{|\[\s*[\{\]]", head):
        return "json-ld"
    if re.match(r"@prefix|@base|prefix\s|base\s|<[^>]*>\s|_:|\[|\(|[\w.-]*:[\w.-]*\s", head, re.I):
        return "turtle"
    return None


def resolve_format(source: str, data: bytes) -> str:
    """The extension's format, unless the content is of another family."""
    guess, seen = guess_format(source), sniff(data)
    return guess if seen is None or FAMILY[guess] == seen else seen


def inflate(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_bytes(source: str, allow_network: bool = True) -> bytes:
    if is_url(source):
        if not allow_network:
            raise PermissionError(f"network access is off: {source}")
        with urlopen(source, timeout=60) as response:
            data = response.read(LARGEST + 1)
    else:
        with open(source, "rb") as f:
            data = f.read(LARGEST + 1)
    if len(data) > LARGEST:
        raise ValueError(f"{source} is larger than {LARGEST} bytes")
    return inflate(data)


def parse(data: bytes, source: str) -> tuple[list[tuple], dict[str, str]]:
    kind = resolve_format(source, data)
    try:
        run = {"xml": others.parse_xml, "json-ld": others.parse_json}.get(FAMILY[kind], turtle.parse)
        return run(data.decode("utf-8-sig"), source, source if is_url(source) else "file://" + os.path.abspath(source))
    except ValueError as e:
        raise ValueError(f"{source}: not readable as {kind} (extension says {guess_format(source)}, content looks like {sniff(data)}): {e}") from e


def expand(sources: list[str], patterns: str = GLOBS, must: bool = False) -> list[str]:
    """Files and URLs; folders by pattern, gzip twins included; each once."""
    names = [p.strip() for p in patterns.split(",")]
    out: dict[str, None] = {}
    for source in sources:
        if os.path.isdir(source):
            for p in [*names, *(n + ".gz" for n in names)]:
                out |= dict.fromkeys(sorted(glob.glob(os.path.join(source, p))))
        else:
            out[source] = None
    if must and not out:
        raise FileNotFoundError(f"nothing to read in {sources}")
    return sorted(out) if must else list(out)


def _rows(source: str, data: bytes, graph: str | None) -> list[tuple]:
    return [(graph or source, *x, source) for x in parse(data, source)[0]]


def read_rdf(spark: SparkSession, sources: list[str], graph: str | None = None, allow_network: bool = True) -> Graph:
    """A graph of files, folders and URLs.

    N-Triples without blank nodes are split by lines across the cluster; other files are parsed one to a
    task. Local folders must be readable by all executors; URLs are fetched by the driver.
    """
    ship(spark)
    files = expand(sources)
    remote = [s for s in files if is_url(s)]
    lines = [s for s in files if s not in remote and guess_format(s) == "nt"]
    whole = [s for s in files if s not in remote and s not in lines]
    parts: list[DataFrame] = []
    if whole:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    yield pd.DataFrame(_rows(re.sub(r"^file:/*", "/", path), inflate(bytes(content)), graph), columns=t.QUAD.names)

        parts.append(spark.read.format("binaryFile").load([os.path.abspath(s) for s in whole]).select("path", "content").mapInPandas(run, t.QUAD))
    if lines:
        parts.append(read_ntriples(spark, lines, graph))
    if remote:
        parts.append(spark.createDataFrame([r for s in remote for r in _rows(s, read_bytes(s, allow_network), graph)], t.QUAD))
    if not parts:
        return Graph(spark.createDataFrame([], t.QUAD))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return Graph(out)


def unescape(text: Column) -> Column:
    """N-Triples escapes undone from left to right, each once; surrogate pairs are one character."""
    pieces = F.regexp_extract_all(text, F.lit(r"((?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

    def one(x: Column) -> Column:
        code = F.substring(x, 2, 1)
        out = F.when(~x.startswith("\\"), x).when(code == "u", F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")).when(code == "U", F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"))
        for name, char in plain.items():
            out = out.when(code == name, F.lit(char))
        return out.otherwise(code)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def read_ntriples(spark: SparkSession, paths: list[str], graph: str | None = None) -> DataFrame:
    """Lines of N-Triples by column expressions alone, split anywhere. A line that is none, no comment and not
    blank fails the job."""
    pattern = r'^\s*(?:<([^>]*)>|_:(\S+))\s*<([^>]*)>\s*(?:<([^>]*)>|_:(\S+?)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
    text = spark.read.text(paths).withColumn("src", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    text = text.withColumn("value", F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not N-Triples in "), "src", F.lit(": "), "value"))))
    part = lambda i: F.regexp_extract("value", pattern, i)
    blank = lambda i: F.concat(F.lit("b"), F.substring(F.md5(F.concat("src", F.lit("\x00"), part(i))), 1, 16))
    is_blank, o_kind = part(2) != "", F.when(part(5) != "", t.BLANK).when(F.col("value").rlike(r">\s*\.\s*(?:#.*)?$") & (part(8) == "") & (part(4) != ""), t.IRI).otherwise(t.LITERAL)
    return text.select(
        (F.lit(graph) if graph else F.col("src")).alias("g"), F.when(is_blank, blank(2)).otherwise(unescape(part(1))).alias("s"), F.when(is_blank, t.BLANK).otherwise(t.IRI).alias("s_kind"), unescape(part(3)).alias("p"),
        F.when(o_kind == t.BLANK, blank(5)).when(o_kind == t.IRI, unescape(part(4))).otherwise(unescape(part(6))).alias("o"), o_kind.alias("o_kind"),
        F.when(o_kind == t.LITERAL, F.when(part(7) != "", t.RDF + "langString").when(part(8) != "", part(8)).otherwise(t.XSD + "string")).alias("o_dt"), F.when(part(7) != "", F.lower(part(7))).alias("o_lang"), "src",
    )


@dataclass
class Imports:
    """What became of the imports of an ontology."""

    files: list[str]
    resolved: dict[str, str] = field(default_factory=dict)
    unresolved: list[str] = field(default_factory=list)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)
    unparsable: dict[str, str] = field(default_factory=dict)

    def warnings(self) -> list[str]:
        return [f"import not found: {i}" for i in self.unresolved] + [f"import {i} is claimed by {', '.join(f)}; the first is taken" for i, f in self.ambiguous.items()] + [f"not readable: {f}: {w}" for f, w in self.unparsable.items()]


def resolve_imports(main: list[str], candidates: list[str] = (), allow_network: bool = False, follow: bool = True) -> Imports:
    """Transitive owl:imports, by ontology or version IRI, local files first. Every file is parsed once."""
    out = Imports(list(main))
    facts: dict[str, tuple[set[str], list[str]]] = {}

    def look(source: str) -> tuple[set[str], list[str]]:
        if source not in facts:
            triples, _ = parse(read_bytes(source, allow_network), source)
            own = {x[0] for x in triples if x[2] == t.TYPE and x[3] == t.ONTOLOGY}
            facts[source] = own | {x[3] for x in triples if x[2] == t.OWL + "versionIRI" and x[0] in own}, [x[3] for x in triples if x[2] == t.OWL + "imports"]
        return facts[source]

    by_iri: dict[str, list[str]] = {}
    for path in sorted(set(expand(list(candidates), "*.ttl,*.turtle,*.rdf,*.owl,*.xml,*.n3,*.nt,*.jsonld")) - set(main)):
        try:
            for i in look(path)[0]:
                by_iri.setdefault(i, []).append(path)
        except ValueError as e:
            out.unparsable[path] = str(e)
    work = [i for f in main for i in look(f)[1]]
    claimed = {i for f in main for i in look(f)[0]}
    seen: set[str] = set()
    while work:
        i = work.pop(0)
        if i in seen or i in claimed:
            continue
        seen.add(i)
        if not follow:
            out.unresolved.append(i)
            continue
        found = sorted(by_iri.get(i, []))
        if len(found) > 1:
            out.ambiguous[i] = found
        source = found[0] if found else i if allow_network and is_url(i) else None
        try:
            more = look(source)[1] if source else None
        except (ValueError, OSError):
            more = None
        if more is None:
            out.unresolved.append(i)
            continue
        out.resolved[i] = source
        if source not in out.files:
            out.files.append(source)
        work += more
    return out


def load_ontology(spark: SparkSession, main: list[str], candidates: list[str] = (), allow_network: bool = False, follow: bool = True) -> tuple[Graph, Imports]:
    report = resolve_imports(main, candidates, allow_network, follow)
    return read_rdf(spark, report.files, allow_network=allow_network), report


def without_legend(g: Graph, predicates: list[str]) -> tuple[Graph, int]:
    """The graph without legend triples, and how many those were."""
    legend = F.col("p").isin(predicates)
    return Graph(g.quads.where(~legend)), g.quads.where(legend).count()


def query_prefixes(text: str) -> dict[str, str]:
    return dict(re.findall(r"(?i)\bPREFIX\s+([\w.-]*):\s*<([^>]*)>", text))


def named_graphs(quads: DataFrame) -> DataFrame:
    return quads.select("g").where("g is not null").distinct().orderBy("g")


def graph_usage(quads: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """Distinct types and distinct predicates of a named graph."""
    own = quads.where(F.col("g") == graph)
    return own.where(F.col("p") == t.TYPE).select("o").distinct(), own.select("p").distinct()
