"""A SPARQL protocol client, and manifests of named graphs."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from oriel import terms as t
from oriel.graph import Graph
from oriel.sources import turtle


class EndpointError(RuntimeError):
    pass


@dataclass
class Endpoint:
    query_url: str
    update_url: str | None = None
    user: str | None = None
    password: str | None = None
    timeout: float = 60.0

    def _post(self, url: str, fields: list[tuple[str, str]], accept: str) -> bytes:
        headers = {"Accept": accept, "Content-Type": "application/x-www-form-urlencoded"}
        if self.user:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password or ''}".encode()).decode()
        try:
            with urlopen(Request(url, urlencode(fields).encode(), headers), timeout=self.timeout) as response:
                return response.read()
        except (URLError, OSError) as e:
            raise EndpointError(f"{url}: {e}") from e

    def query(self, text: str, graphs: list[str] = ()):
        """Bindings of SELECT, the answer of ASK, or the triples of CONSTRUCT and DESCRIBE."""
        form = re.search(r"\b(SELECT|ASK|CONSTRUCT|DESCRIBE)\b", re.sub(r"#[^\n]*|<[^>]*>", " ", text), re.I)
        form = form[1].upper() if form else "SELECT"
        table = form in ("SELECT", "ASK")
        body = self._post(self.query_url, [("query", text), *(("default-graph-uri", g) for g in graphs)], "application/sparql-results+json" if table else "text/turtle")
        if not table:
            return turtle.parse(body.decode(), self.query_url)[0]
        answer = json.loads(body)
        return answer["boolean"] if form == "ASK" else [{k: v["value"] for k, v in row.items()} for row in answer["results"]["bindings"]]

    def update(self, text: str, graphs: list[str] = ()) -> None:
        self._post(self.update_url or self.query_url, [("update", text), *(("using-graph-uri", g) for g in graphs)], "*/*")

    def graphs(self) -> list[str]:
        return [r["g"] for r in self.query("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } } ORDER BY ?g")]

    def load(self, spark: SparkSession, graph: str, limit: int | None = None) -> Graph:
        text = f"CONSTRUCT {{ ?s ?p ?o }} WHERE {{ GRAPH <{graph}> {{ ?s ?p ?o }} }}" + (f" LIMIT {limit}" if limit else "")
        return Graph(spark.createDataFrame([(graph, *x, graph) for x in self.query(text)], t.QUAD))


@dataclass
class Binding:
    graph_uri: str
    role: str
    source_tarql: str | None = None
    ontology_graph_uri: str | None = None
    notes: str = ""


@dataclass
class Manifest:
    graphs: list[Binding] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> Manifest:
        return cls([Binding(**g) for g in json.loads(Path(path).read_text())["graphs"]])

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps({"graphs": [asdict(g) for g in self.graphs]}, indent=2))

    def role(self, name: str) -> list[Binding]:
        return [g for g in self.graphs if g.role == name]
