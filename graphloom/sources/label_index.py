"""A stored index of labels by trigram, for searches that read the lists of their own trigrams only.

Rows ``(gram, import_id, id, size)`` lie in Parquet by bucket of trigrams, in order of trigram, with the number of distinct
trigrams of each label; a small table counts the labels of each trigram. A label that reaches a similarity s to a query of q
trigrams shares ceil(s q) of them at least, so it is in the list of one of the query's rarest ``q - ceil(s q) + 1``; its own
number of trigrams is between s q and q / s. Only such labels are counted in the other lists, which are read with a filter on
bucket, trigram and size. Labels themselves are read for the hits alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folder

#: Buckets of trigrams; labels from which a bucket is dealt to another task.
BUCKETS, DEALT_LABELS = 64, 2_000_000


def query_trigrams(text: str) -> set[str]:
    """The trigrams of a query, as those of a column of labels."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return {padded[i : i + 3] for padded in (f"  {w} " for w in words) for i in range(len(padded) - 2)}


def gram_rows(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``(gram, size)`` in place of ``label``: a row for each distinct trigram, with how many the label has."""
    kept = [c for c in nodes.columns if c != "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [list(query_trigrams(label or "")) for label in batch.column(batch.schema.get_field_index("label")).to_pylist()]
            sizes = np.array([*map(len, grams)], np.int32)
            which = np.repeat(np.arange(len(grams)), sizes)
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(which)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g for row in grams for g in row], pa.string()), pa.array(sizes[which])], names=[*kept, "gram", "size"])

    return nodes.mapInArrow(run, nodes.limit(0).selectExpr(*kept, "cast(null as string) as gram", "cast(null as int) as size").schema)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class LabelIndex:
    """The index in a folder; ``write`` builds it from nodes ``(import_id, id, label)``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, nodes: DataFrame) -> LabelIndex:
        """Lists first and counts last, which say that the index is whole. Labels without letters or digits have no trigrams."""
        labels = nodes.where("label is not null").select("import_id", "id", "label")
        rows = gram_rows(labels).select("gram", "import_id", "id", "size").withColumn("bucket", _bucket(F.col("gram")))
        # a common trigram's list is dealt to tasks by its labels' ids, to more of them as labels grow; each writes one file a bucket
        rows.repartition("bucket", F.pmod("id", F.lit(max(4, nodes.count() // DEALT_LABELS)))).sortWithinPartitions("bucket", "gram", "size").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/lists")
        self.lists.groupBy("gram").agg(F.count("*").alias("labels")).write.mode("overwrite").parquet(f"{self.folder}/counts")
        return self

    @property
    def whole(self) -> bool:
        return Folder(self.spark, self.folder).has("counts/_SUCCESS")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema("gram string, import_id bigint, id bigint, size int, bucket int").parquet(f"{self.folder}/lists")

    def _read(self, grams: list[str], low: int, high: int) -> DataFrame:
        buckets = [r.b for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(_bucket(F.col("g")).alias("b")).distinct().collect()]
        return self.lists.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & F.col("size").between(low, high))

    def similar(self, text: str, least: float = 0.3) -> DataFrame:
        """``(import_id, id, sim)`` of labels whose trigram similarity to ``text`` is ``least`` or more; none for a text without trigrams."""
        if not 0 < least <= 1:
            raise ValueError("least must be above 0, and 1 at most")
        grams = query_trigrams(text)
        if not grams:
            return self.lists.select("import_id", "id", F.lit(0.0).alias("sim")).limit(0)
        q = len(grams)
        counts = {r.gram: r.labels for r in self.spark.read.parquet(f"{self.folder}/counts").where(F.col("gram").isin(sorted(grams))).collect()}
        rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))
        need = max(1, math.ceil(least * q - 1e-9))
        low, high = math.ceil(least * q - 1e-9), math.floor(q / least + 1e-9)
        first, rest = rarest[: q - need + 1], rarest[q - need + 1 :]
        found = self._read(first, low, high).groupBy("import_id", "id", "size").agg(F.count("*").alias("shared"))
        if rest:
            other = self._read(rest, low, high).join(found.select("import_id", "id"), ["import_id", "id"], "left_semi")
            found = found.unionByName(other.groupBy("import_id", "id", "size").agg(F.count("*").alias("shared"))).groupBy("import_id", "id", "size").agg(F.sum("shared").alias("shared"))
        sim = F.col("shared").cast("double") / (F.col("size") + q - F.col("shared"))
        return found.select("import_id", "id", sim.alias("sim")).where(F.col("sim") >= least)

    def search(self, nodes: DataFrame, text: str, limit: int = 20, least: float = 0.3) -> DataFrame:
        """The ``limit`` most similar of ``nodes``, with ``sim``; of equals by label, then id."""
        found = nodes.join(self.similar(text, least), ["import_id", "id"])
        return found.orderBy(F.col("sim").desc(), "label", "id").limit(limit)
