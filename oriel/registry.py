"""The registry of checks: metadata, and a place for a project's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Check:
    id: str
    category: str
    severity: str
    title: str
    remediation: str

    @property
    def feature(self) -> str:
        return self.category.replace("_", " ").title()

    @property
    def scenario(self) -> str:
        return f"No finding: {self.title.lower()}"


V, W, I = "Violation", "Warning", "Info"
_TABLE = [
    ("STR-001", V, "Class in use is not declared", "Declare the class, or correct the type"),
    ("STR-002", V, "Predicate in use is not declared", "Declare the property, or correct its IRI"),
    ("STR-003", W, "Property has neither domain nor range", "State a domain or a range"),
    ("STR-004", W, "Class is not defined by any axiom", "Relate the class to others, or define it"),
    ("STR-005", V, "Domain is untyped", "Declare the class that the domain names"),
    ("STR-006", V, "Object is untyped", "Give the object a type"),
    ("STR-007", V, "Predicate is untyped", "Give the predicate a type"),
    ("STR-008", V, "Range is untyped", "Declare the class that the range names"),
    ("STR-009", V, "Subject is untyped", "Give the subject a type"),
    ("LOG-001", V, "Class is disjoint with an ancestor", "Drop one of the two axioms"),
    ("LOG-002", V, "Functional property with several values", "Leave one value, or drop the axiom"),
    ("LOG-003", W, "Equivalence makes a subclass axiom redundant", "Keep the equivalence alone"),
    ("LOG-004", V, "Property with several inverses", "Keep one inverse"),
    ("LOG-005", V, "Property is its own inverse", "Declare it symmetric instead"),
    ("LOG-006", V, "Symmetric property whose domain is not its range", "Align domain and range"),
    ("LOG-007", V, "Transitive property whose domain is not its range", "Align domain and range"),
    ("QUA-001", W, "Term without label", "Add a label"),
    ("QUA-002", I, "Ontology without title, version and label", "Describe the ontology"),
    ("QUA-003", W, "Deprecated term in use", "Move to the replacement"),
    ("QUA-004", W, "Resource without label", "Add a label"),
    ("QUA-005", W, "No ontology header", "Declare an ontology"),
    ("QUA-006", W, "Ontology IRI serves as a namespace", "Tell the two apart"),
    ("QUA-007", I, "Ontology without version IRI", "Add a version IRI"),
    ("QUA-008", W, "Ontology identifier without https", "Publish under https"),
    ("EFF-001", W, "Deep subclass chain", "Flatten the hierarchy"),
    ("EFF-002", W, "Many blank nodes", "Name what needs a name"),
    ("EFF-003", I, "Many values of one property", "Check that the fan-out is meant"),
    ("STY-001", W, "Class name is not in upper camel case", "Rename the class"),
    ("STY-002", W, "Property name is not in lower camel case", "Rename the property"),
    ("STY-003", I, "Label without language", "Tag the label"),
    ("STY-004", W, "Label and name have drifted apart", "Align label and name"),
    ("STY-005", W, "Mixed separators in names", "Use one separator"),
    ("DAT-001", V, "Literal outside its datatype", "Correct the literal or its type"),
    ("DAT-002", W, "Reference to nothing", "Describe the target, or correct the reference"),
    ("DAT-003", I, "Literal stated more than once", "Remove the repeats"),
    ("REA-001", V, "Member of disjoint classes", "Correct the types or the axiom"),
    ("REA-002", V, "Asymmetric property both ways", "Remove one direction"),
    ("REA-003", V, "Irreflexive property on itself", "Remove the loop"),
    ("REA-004", V, "Member of the empty class", "Remove the contradiction"),
    ("REA-010", I, "Beyond the EL profile", "Avoid the construct if EL is needed"),
    ("REA-011", I, "Beyond the QL profile", "Avoid the construct if QL is needed"),
    ("REA-012", I, "Beyond the RL profile", "Avoid the construct if RL is needed"),
    ("REA-020", V, "Ontology is inconsistent", "Resolve the contradiction"),
    ("REA-021", V, "Class cannot have members", "Resolve the contradiction"),
    ("REA-022", I, "External reasoner did not run", "Install the reasoner if its verdict is needed"),
    ("CNF-001", W, "Type that the ontology lacks", "Declare it, or correct the data"),
    ("CNF-002", W, "Predicate that the ontology lacks", "Declare it, or correct the data"),
    ("CNF-003", V, "Subject outside the domain", "Correct the data or the domain"),
    ("CNF-004", V, "Object outside the range", "Correct the data or the range"),
    ("CNF-005", I, "Declared class without members", "Drop the class, or extend the data"),
]
_CATEGORY = {"STR": "structural", "LOG": "logical", "QUA": "quality", "EFF": "efficiency", "STY": "style", "DAT": "data", "REA": "reasoning", "CNF": "conformance"}
CHECKS: dict[str, Check] = {i: Check(i, _CATEGORY[i[:3]], s, title, fix + ".") for i, s, title, fix in _TABLE}
#: Functions of a graph that return rows of focus, path, value and message, by check id.
RULES: dict[str, Callable] = {}


def rule(check_id: str, check: Check | None = None):
    """Registers a function as the rule of a check; a new id brings its own ``Check``."""
    if check is not None:
        CHECKS[check_id] = check
    if check_id not in CHECKS:
        raise KeyError(f"{check_id} has no metadata")

    def keep(f):
        RULES[check_id] = f
        return f

    return keep


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.id, c.category, c.title, c.severity, c.remediation) for c in CHECKS.values()], "check_id string, category string, title string, severity string, remediation string")
