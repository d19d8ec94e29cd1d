"""Changes of edges as a stream, applied to a stored graph whose contributions are kept up with them.

A change is a row ``(sequence, action, dependent, dependency, dep_type)`` with action `add` or `remove`. Batch k turns
version k of the store into version k + 1, so a batch that is done again writes the same version from the same one
before it, and each change counts once. An edge remembers its last sequence, removed or not: a change that comes late, or
twice, is passed over whatever batch it comes in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import Kept
from ..sources.folders import Folder
from ..sources.graph import Graph

_EDGES = "import_id bigint, dependent bigint, dependency bigint, dep_type string, sequence bigint, present boolean"
_STATES = "id bigint, user bigint, many boolean"
_CONTRIBUTIONS = "id bigint, unique_contribution bigint, shared_contribution bigint, total_contribution bigint"


@dataclass(frozen=True)
class StoredGraph:
    """Versions of a graph's edges, states and contributions under ``folder``; nodes are those of ``nodes``."""

    nodes: DataFrame
    folder: str

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def _path(self, version: int, name: str) -> str:
        return f"{self.folder}/version={version:09d}/{name}"

    def _read(self, version: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(version, name))

    def edges(self, version: int) -> DataFrame:
        return self._read(version, "edges", _EDGES)

    def graph(self, version: int) -> Graph:
        edges = self.edges(version).where("present")
        return Graph(self.nodes, edges.select("import_id", F.col("dependency").alias("source_id"), F.col("dependent").alias("target_id"), F.col("dep_type").alias("dependency_type")))

    def kept(self, version: int) -> Kept:
        return Kept(self._read(version, "states", _STATES), self._read(version, "contributions", _CONTRIBUTIONS))

    def latest(self) -> int | None:
        """The highest version that is whole; contributions are written last."""
        folder = Folder(self.spark, self.folder)
        done = [v for v in folder.names() if v.startswith("version=") and folder.has(f"{v}/contributions/_SUCCESS")]
        return int(done[-1].partition("=")[2]) if done else None

    def _write(self, version: int, edges: DataFrame, kept: Kept) -> None:
        edges.write.mode("overwrite").parquet(self._path(version, "edges"))
        self._write_kept(version, kept)

    def start(self, graph: Graph) -> None:
        """Version 0, of a graph whose edges have no sequence yet."""
        edges = graph.deps.groupBy("import_id", "dependent", "dependency").agg(F.min("dep_type").alias("dep_type"))
        self._write(0, edges.select("import_id", "dependent", "dependency", "dep_type", F.lit(-1).cast("bigint").alias("sequence"), F.lit(True).alias("present")), Kept.of(graph))

    def apply(self, changes: DataFrame, version: int) -> None:
        """Version ``version + 1`` from ``version`` and a batch of changes; rows without a sequence, an end or a known action are left out.

        Of changes of an edge the one of highest sequence counts, `remove` before `add` where that is equal.
        """
        good = changes.where("sequence is not null and dependent is not null and dependency is not null and action in ('add', 'remove')")
        last = good.groupBy("dependent", "dependency").agg(F.max_by(F.struct("sequence", "action", "dep_type"), F.struct("sequence", "action")).alias("c"))
        imports = self.nodes.select(F.col("id").alias("dependent"), F.col("import_id").alias("of_import"))
        new = last.join(imports, "dependent").select("of_import", "dependent", "dependency", "c.dep_type", "c.sequence", (F.col("c.action") == "add").alias("present"))
        fresh = [F.col(c).alias(f"new_{c}") for c in ("dep_type", "sequence", "present")]
        both = self.edges(version).join(new.select("of_import", "dependent", "dependency", *fresh), ["dependent", "dependency"], "full_outer")
        newer = F.col("new_sequence").isNotNull() & (F.col("sequence").isNull() | (F.col("new_sequence") > F.col("sequence")))
        pick = lambda c: F.when(newer, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        edges = both.select(F.coalesce("import_id", "of_import").alias("import_id"), "dependent", "dependency", pick("dep_type"), pick("sequence"), pick("present"))
        edges.write.mode("overwrite").parquet(self._path(version + 1, "edges"))
        kept, _ = self.kept(version).changed(self.graph(version), self.graph(version + 1))
        self._write_kept(version + 1, kept)

    def _write_kept(self, version: int, kept: Kept) -> None:
        kept.states.write.mode("overwrite").parquet(self._path(version, "states"))
        kept.contributions.write.mode("overwrite").parquet(self._path(version, "contributions"))


def apply_changes(changes: DataFrame, stored: StoredGraph, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes to a stored graph that ``start`` has begun; ``checkpoint`` belongs to that store alone."""

    def handle(batch: DataFrame, number: int) -> None:
        stored.apply(batch, number)

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
