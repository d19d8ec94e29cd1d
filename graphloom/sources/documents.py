"""Long documents as text files in order: tasks write sorted parts, a manifest joins them.

No document stands in one row, one task or the driver. Lines are range-partitioned by their place and sorted in each
partition; a part has a bounded number of lines. The manifest (part, number of its first line, lines) is written last, so
a document whose writing was cut short isn't there. The parts put together in the manifest's order are the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import Folder

#: Most lines of a part.
PART_LINES = 100_000
_MANIFEST = "_manifest"
#: Numbers of the task and of its file in a part's name; what stands between them may have ``-c`` and digits too.
_PART_NAME = "^part-([0-9]+)-.*-c([0-9]+)[^-]*$"


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, text)`` of the whole parts; each line of a text ends in a line feed."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), F.col("value").alias("text"))


def write_document(lines: DataFrame, place: list[str], path: str, part_lines: int = PART_LINES) -> None:
    """Write column ``line`` in the order of the columns in ``place``, which settle it, to a new folder; a line feed in a line becomes a space."""
    spark = lines.sparkSession
    ordered = lines.repartitionByRange(*place).sortWithinPartitions(*place).select(F.translate("line", "\n\r", "  ").alias("line"))
    ordered.write.option("maxRecordsPerFile", part_lines).text(path)
    sizes = _parts(spark, path).select("part", (F.length("text") - F.length(F.translate("text", "\n", ""))).cast("bigint").alias("lines"))
    # parts are named by task, then by file of the task; one row a part
    number = lambda group: F.regexp_extract("part", _PART_NAME, group).cast("bigint")
    before = Window.orderBy(number(1), number(2)).rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.select("part", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("first"), "lines")
    numbered.coalesce(1).write.json(f"{path}/{_MANIFEST}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(part, first, lines)``; an error if the document was not written to its end."""
    if not Folder(spark, path).has(f"{_MANIFEST}/_SUCCESS"):
        raise FileNotFoundError(f"no whole document in {path}")
    return spark.read.schema("part string, first bigint, lines bigint").json(f"{path}/{_MANIFEST}")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """``(number, line)``, numbered from 0."""
    lines = _parts(spark, path).select("part", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("at", "line"))
    return lines.join(manifest(spark, path), "part").select((F.col("first") + F.col("at")).alias("number"), "line")
