"""Repairs: updates of the graph that settle findings, and edits of query texts."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel import terms as t
from oriel.functions import iri
from oriel.graph import Graph
from oriel.operators.versioning import Rename
from oriel.sources.reader import query_prefixes


@dataclass
class Standards:
    """A project's conventions."""

    language: str = "en"
    base_iri: str = "https://example.org/ontology"
    version: str = "0.1.0"
    category_class: str = t.SKOS + "Concept"
    redundant_equivalence: str = "keepEquivalentClass"
    equivalent_class: str = "subClassOf"


def _triples(df: DataFrame, s, p: str, o, kind: int = t.IRI, dt: str | None = None, lang: str | None = None) -> DataFrame:
    text = lambda x: F.lit(x).cast("string")
    s = F.col(s) if isinstance(s, str) else s
    return df.select(s.alias("s"), F.lit(t.IRI).alias("s_kind"), text(p).alias("p") if isinstance(p, str) else p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), text(dt).alias("o_dt"), text(lang).alias("o_lang"))


@dataclass
class Change:
    """Added and removed triples."""

    added: DataFrame
    removed: DataFrame


def _same(a: str, b: str):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in t.TRIPLE])


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("x").join(b.alias("y"), _same("x", "y"), "left_anti").select(*[f"x.{c}" for c in t.TRIPLE])


INSERTS = ("STR-001", "STR-002", "STR-005", "STR-007", "STR-008", "QUA-001", "QUA-002", "QUA-004", "QUA-005", "QUA-007", "PRJ-REQUIRED")
REPLACES = ("LOG-003", "MDL-001", "MDL-002", "MDL-003", "STY-003")


def repair(g: Graph, found: DataFrame, check_id: str, standards: Standards | None = None) -> Change:
    """What settles all findings of one check at once; raises KeyError for a check without a repair."""
    k = standards or Standards()
    f = found.where(F.col("check_id") == check_id).select("focus_node", "path", "value").distinct()
    focus, value = "focus_node", F.col("value")
    plain = dict(kind=t.LITERAL, dt=t.XSD + "string")
    tagged = dict(kind=t.LITERAL, dt=t.RDF + "langString", lang=k.language)
    label = iri.humanised(F.col("focus_node"))
    none = g.triples.limit(0)
    pick = lambda p, values=True: g.of(p).join(f, (F.col("s") == F.col("focus_node")) & ((F.col("o") == F.col("value")) if values else F.lit(True)), "left_semi")
    if check_id in ("STR-001", "STR-005", "STR-008"):
        add, drop = _triples(f.where(value.contains(":")), value, t.TYPE, F.lit(t.CLASS)), none
    elif check_id == "STR-002":
        add, drop = _triples(f, F.col("path"), t.TYPE, F.lit(t.PROPERTY)), none
    elif check_id == "STR-007":
        add, drop = _triples(f, focus, t.TYPE, F.lit(t.PROPERTY)), none
    elif check_id == "QUA-001":
        add, drop = _triples(f, focus, t.LABEL, label, **tagged), none
    elif check_id == "QUA-004":
        add, drop = _triples(f, focus, t.PREF_LABEL, label, **tagged), none
    elif check_id == "QUA-002":
        add, drop = _triples(f, focus, t.OWL + "versionInfo", F.lit(k.version), **plain), none
    elif check_id == "QUA-005":
        add, drop = _triples(f, F.lit(k.base_iri), t.TYPE, F.lit(t.ONTOLOGY)), none
    elif check_id == "QUA-007":
        add, drop = _triples(f, focus, t.OWL + "versionIRI", F.concat(F.regexp_replace(F.col(focus), "[#/]+$", ""), F.lit("/" + k.version))), none
    elif check_id == "PRJ-REQUIRED":
        add, drop = _triples(f.where(F.col("path").isin(t.LABEL, t.PREF_LABEL)), focus, F.col("path"), label, **tagged), none
    elif check_id == "LOG-003":
        add, drop = none, pick(t.SUBCLASS if k.redundant_equivalence == "keepEquivalentClass" else t.OWL + "equivalentClass")
    elif check_id == "MDL-001":
        add, drop = none, pick(t.OWL + "inverseOf")
    elif check_id == "MDL-002":
        drop = pick(t.OWL + "equivalentClass")
        add = drop.withColumn("p", F.lit(t.SUBCLASS if k.equivalent_class == "subClassOf" else t.SKOS + "closeMatch"))
    elif check_id == "MDL-003":
        drop = pick(t.TYPE, False).where(F.col("o") == t.CLASS)
        add = drop.withColumn("o", F.lit(k.category_class))
    elif check_id == "STY-003":
        drop = pick(t.LABEL).where("coalesce(o_lang, '') = ''")
        add = drop.withColumn("o_dt", F.lit(t.RDF + "langString")).withColumn("o_lang", F.lit(k.language))
    else:
        raise KeyError(f"{check_id} has no repair")
    add = add.distinct()
    return Change(_minus(add, g.triples), _minus(drop, add))


def apply(g: Graph, change: Change) -> Graph:
    return Graph(_minus(g.triples, change.removed).unionByName(change.added).distinct(), distinct=True)


# ---- query texts --------------------------------------------------------------------------------


@dataclass
class Suggestion:
    """An edit of one text, with how sure it is."""

    file: str
    kind: str
    reason: str
    confidence: float
    before: str
    after: str = field(repr=False)

    def patch(self) -> str:
        return "".join(difflib.unified_diff(self.before.splitlines(True), self.after.splitlines(True), self.file, self.file))


def split_iri(value: str) -> tuple[str, str]:
    at = value.rfind("#") if "#" in value else value.rfind("/")
    return value[: at + 1], value[at + 1 :]


def replace_prefix_iri(text: str, prefix: str, space: str) -> str:
    return re.sub(rf"(?i)(\bPREFIX\s+{re.escape(prefix)}:\s*)<[^>]*>", rf"\1<{space}>", text)


def rename_prefix(text: str, old: str, new: str) -> str:
    return re.sub(rf"(?<![\w:<]){re.escape(old)}:", f"{new}:", text)


def replace_term(text: str, old: str, new: str) -> str:
    """The term in both of its forms, full and abbreviated."""
    prefixes = query_prefixes(text)
    show = lambda i: next((f"{p}:{split_iri(i)[1]}" for p, s in prefixes.items() if s == split_iri(i)[0]), f"<{i}>")
    out = text.replace(f"<{old}>", show(new))
    space, local = split_iri(old)
    for p, s in prefixes.items():
        if s == space and local:
            out = re.sub(rf"(?<![\w:]){re.escape(p)}:{re.escape(local)}(?![\w-])", show(new), out)
    return out


def suggest(texts: dict[str, str], drift: list[tuple[str, str, str, str]], known: dict[str, set[str]], renames: list[Rename] = (), undeclared: list[tuple[str, str]] = ()) -> list[Suggestion]:
    """Edits for prefix drift (file, prefix, namespace, kind), renamed terms and undeclared terms (kind, IRI).

    ``known`` has the namespaces of each prefix of the ontology set.
    """
    out = []
    for file, prefix, space, kind in drift:
        text = texts[file]
        if kind == "namespace_mismatch":
            options = sorted(known.get(prefix, ()))
            for option in options:
                out.append(Suggestion(file, kind, f"{prefix}: is <{option}> in the ontology", 1.0 if len(options) == 1 else 0.5, text, replace_prefix_iri(text, prefix, option)))
        elif kind == "prefix_name_mismatch":
            options = sorted(p for p, spaces in known.items() if space in spaces)
            for option in options:
                out.append(Suggestion(file, kind, f"<{space}> is {option}: in the ontology", 0.6 if len(options) == 1 else 0.4, text, rename_prefix(text, prefix, option)))
    for file, text in sorted(texts.items()):
        after, sure = text, []
        for r in renames:
            changed = replace_term(after, r.old, r.new)
            if changed != after:
                after, sure = changed, [*sure, r.confidence]
        if sure:
            out.append(Suggestion(file, "term_rename", f"{len(sure)} renamed terms", min(sure), text, after))
    if undeclared:
        stub = "\n".join(f"<{i}> a <{t.CLASS if kind == 'class' else t.PROPERTY}> ." for kind, i in sorted(set(undeclared))) + "\n"
        out.append(Suggestion("ontology", "ontology_stub", f"{len(set(undeclared))} undeclared terms", 0.7, "", stub))
    return out


def apply_suggestions(suggestions: list[Suggestion], least: float = 0.5) -> dict[str, str]:
    """New texts by file: for each the surest edit at or above the confidence."""
    out: dict[str, Suggestion] = {}
    for s in suggestions:
        if s.confidence >= least and (s.file not in out or s.confidence > out[s.file].confidence):
            out[s.file] = s
    return {f: s.after for f, s in out.items()}
