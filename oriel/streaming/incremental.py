"""Checks of triples as they arrive: stateless rules on streams, findings appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from oriel import findings
from oriel.graph import Graph
from oriel.operators import checks
from oriel.registry import CHECKS

#: Rules that look at one triple at a time, and so need no state.
TRIPLE_LOCAL = ["DAT-001", "STY-003", "LOG-005", "REA-004"]


def watch(quads: DataFrame, known: Graph, checkpoint: str, write: Callable[[DataFrame, int], None], ids: list[str] | None = None, **trigger) -> StreamingQuery:
    """Runs checks over each micro-batch of a quad stream merged with a known graph.

    Only findings whose focus is in the batch are handed to ``write(findings, batch_id)``, which sees a
    batch again after a failure and must be idempotent by batch_id.
    """

    def batch(df: DataFrame, number: int) -> None:
        own = df.persist()
        try:
            found = checks.run_all(Graph(own).union(known), ids or sorted(checks.RULES), "stream")
            touched = own.select(F.col("s").alias("focus_node")).union(own.select("p")).distinct()
            write(found.join(touched, "focus_node", "left_semi").select(*found.columns), number)
        finally:
            own.unpersist()

    return quads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def local_findings(quads: DataFrame) -> DataFrame:
    """A streaming frame of findings of the rules that need one triple alone, without any state."""
    g = Graph(quads, distinct=True)
    return findings.union([findings.make(checks.RULES[i](g), CHECKS[i], "stream") for i in ("DAT-001", "STY-003")], quads.sparkSession)
