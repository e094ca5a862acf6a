"""The command line: python -m oriel COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from oriel import findings
from oriel.operators import checks, conformance, mapping, metrics, reasoning, repair, versioning
from oriel.report import writers
from oriel.sources import reader, turtle


def session() -> SparkSession:
    return SparkSession.builder.appName("oriel").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="oriel")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, many: tuple[str, ...] = ()):
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", nargs="+", required=True)
        for m in many:
            c.add_argument(f"--{m}", nargs="+", default=[])
        c.add_argument("--out", default="out")
        c.add_argument("--fail-on", choices=list(findings.RANK))
        c.add_argument("--own-namespace")
        c.add_argument("--allow-network", action="store_true")
        c.add_argument("--no-imports", action="store_true")
        return c

    command("ontology", "ontology", many=("imports", "profile"))
    c = command("checks", "ontology", many=("imports", "data"))
    c.add_argument("--registry", help="a JSON list of a project's own checks")
    c.add_argument("--sparql", help="the folder of their queries; that of the registry by default")
    c.add_argument("--only", nargs="+", help="ids of the checks to run")
    command("sketch", "queries")
    command("triplify", "tables", "queries")
    command("data", "ontology", "data", many=("imports",)).add_argument("--reasoner", default="auto")
    command("docgen", "ontology", many=("imports", "data"))
    command("run", "ontology", many=("imports", "data"))
    command("version-diff", "old", "new").add_argument("--fail-at", choices=["PATCH", "MINOR", "MAJOR"])
    command("consistency", "old", "new", "queries").add_argument("--apply", type=float)
    command("pattern-consistency", "queries", "ontology", "taxonomy", "data")
    command("consistency-remote", "manifest", "endpoint", "ontology")
    return p


def _report(found, args) -> int:
    if args.own_namespace:
        found = findings.in_namespace(found, args.own_namespace)
    found = found.persist()
    writers.write_tables(found, args.out)
    writers.write_html(found, f"{args.out}/report.html")
    Path(args.out, "cucumber.json").write_text(json.dumps(writers.cucumber(found)))
    for name, text in writers.gherkin().items():
        Path(args.out, name).write_text(text)
    return findings.gate(found, args.fail_on) if args.fail_on else 0


def _texts(sources: list[str]) -> dict[str, str]:
    return {f: Path(f).read_text() for f in reader.expand(sources, "*.rq,*.sparql,*.tarql")}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session()
    Path(args.out).mkdir(parents=True, exist_ok=True)
    load = lambda paths: reader.load_ontology(spark, reader.expand(paths), getattr(args, "imports", []), args.allow_network, not args.no_imports)
    warn = lambda report: [print(w, file=sys.stderr) for w in report.warnings()]
    if args.command in ("ontology", "checks", "data", "run"):
        g, report = load(args.ontology)
        warn(report)
        data = reader.read_rdf(spark, args.data) if getattr(args, "data", None) else None
        both = (g.union(data) if data else g).stored()
        parts = []
        if args.command == "ontology":
            metrics.expressivity(g).orderBy("feature").show(100, False)
            parts.append(reasoning.profile_findings(g, tuple(args.profile)) if args.profile else findings.empty(spark))
        else:
            own = checks.own_checks(args.registry, args.sparql) if getattr(args, "registry", None) else []
            outcomes: list[checks.Outcome] = []
            parts.append(checks.run_all(both, getattr(args, "only", None), own=own, outcomes=outcomes))
            Path(args.out, "outcomes.tsv").write_text(checks.outcome_log(outcomes))
            print(*(f"{o.check_id} failed: {o.error}" for o in outcomes if o.error), sep="\n", end="", file=sys.stderr)
        if data and args.command in ("data", "run"):
            parts.append(conformance.conformance(conformance.declarations(g), data).findings())
            parts.append(reasoning.consistency(both, getattr(args, "reasoner", "auto")))
            metrics.graph_sizes(data).show(truncate=False)
        return _report(findings.union(parts, spark), args)
    if args.command == "sketch":
        texts = _texts(args.queries)
        prefixes, warnings = mapping.prefix_conflicts(texts)
        print(*warnings, sep="\n", file=sys.stderr)
        triples = sorted({x for text in texts.values() for x in mapping.sketch_triples(text)}, key=str)
        Path(args.out, "sketch.ttl").write_text(turtle.serialise(triples, prefixes))
        Path(args.out, "sketch.dot").write_text(writers.dot(triples))
        return 0
    if args.command == "triplify":
        jobs, warnings = mapping.discover(args.tables, args.queries)
        print(*warnings, sep="\n", file=sys.stderr)
        failed = 0
        for i, job in enumerate(jobs):
            try:
                mapping.triplify(mapping.read_table(spark, job.table), Path(job.query).read_text()).write.mode("overwrite").parquet(f"{args.out}/{i}-{Path(job.table).stem}")
            except ValueError as e:
                failed = 1
                print(f"{job.table}: {e}", file=sys.stderr)
        return failed
    if args.command == "docgen":
        g, report = load(args.ontology)
        warn(report)
        doc = writers.documentation(g, data=reader.read_rdf(spark, args.data) if args.data else None)
        Path(args.out, "documentation.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
        writers.write_documentation(doc, f"{args.out}/documentation.html")
        return 0
    if args.command == "version-diff":
        changes = versioning.diff(versioning.snapshot(reader.read_rdf(spark, args.old)), versioning.snapshot(reader.read_rdf(spark, args.new)))
        level = versioning.bump(changes).first().bump
        changes.orderBy("fact", "change", "k1").write.mode("overwrite").json(f"{args.out}/changes")
        print(level)
        order = ["NONE", "PATCH", "MINOR", "MAJOR"]
        return int(bool(args.fail_at) and order.index(level) >= order.index(args.fail_at))
    if args.command == "consistency":
        old, new = reader.read_rdf(spark, args.old), reader.read_rdf(spark, args.new)
        a, b = versioning.snapshot(old), versioning.snapshot(new)
        texts = _texts(args.queries)
        known = spark.createDataFrame([(f, p, s) for f in reader.expand(args.new) for p, s in reader.parse(reader.read_bytes(f), f)[1].items()], "file string, prefix string, namespace string")
        used = spark.createDataFrame([(f, p, s) for f, x in texts.items() for p, s in reader.query_prefixes(x).items()], "file string, prefix string, namespace string")
        drift = [tuple(r) for r in mapping.prefix_alignment(used, known).orderBy("file", "prefix").collect()]
        missing = [("class" if r.check_id == "CNF-001" else "property", r.focus_node) for r in mapping.undeclared_terms(conformance.declarations(new), mapping.sketch(spark, texts)).findings("sketch").collect()]
        spaces: dict[str, set[str]] = {}
        for r in known.collect():
            spaces.setdefault(r.prefix, set()).add(r.namespace)
        edits = repair.suggest(texts, drift, spaces, versioning.match(versioning.rename_candidates(a, b, new)), missing)
        for i, e in enumerate(edits):
            Path(args.out, f"{i}.patch").write_text(e.patch())
        if args.apply is not None:
            for f, text in repair.apply_suggestions([e for e in edits if e.file in texts], args.apply).items():
                Path(f).write_text(text)
        print(versioning.bump(versioning.diff(a, b)).first().bump, *drift, *missing, sep="\n")
        return int(bool(drift or missing))
    if args.command == "pattern-consistency":
        result = mapping.four_layers(mapping.sketch(spark, _texts(args.queries)), reader.read_rdf(spark, args.ontology), reader.read_rdf(spark, args.taxonomy), reader.read_rdf(spark, args.data))
        for name in ("terms", "references", "membership", "conformance"):
            getattr(result, name).write.mode("overwrite").json(f"{args.out}/{name}")
        return int(not result.clean())
    from oriel.sources.endpoint import Endpoint, Manifest

    gaps, known = 0, conformance.declarations(reader.read_rdf(spark, args.ontology))
    for binding in Manifest.read(args.manifest[0]).role("triplified_data"):
        live = Endpoint(args.endpoint[0]).load(spark, binding.graph_uri)
        found = mapping.named_graph_check(mapping.sketch(spark, _texts([binding.source_tarql])), live.quads, known)
        gaps += found.count()
        found.show(200, False)
    return int(gaps > 0)
