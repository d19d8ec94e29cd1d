"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that every word and normalisation rule here means: [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; Spark's reader alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one in local mode, as in tests.

    On a cluster it must be set: a folder of one machine would not do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or _temporary()).rstrip("/")


@cache
def _temporary() -> str:
    return tempfile.mkdtemp()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which is smaller than a checkpoint of long texts."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed(table: DataFrame) -> None:
    """Delete the folder of a table that ``written`` gave and nothing reads any more."""
    for file in table.inputFiles()[:1]:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints of rounds that are over: its cleaner acts when the JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so that other columns cannot clash with its results."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def drawn(df: DataFrame, draw: str, k: int, n: int, low: int, high: int) -> DataFrame:
    """The ``k`` rows of ``n`` whose ``draw``, a hash spread over ``low`` to ``high``, is smallest.

    Only the hashes below a bound that half as many rows again should pass are ordered, so what tasks send is about
    ``k`` rows in all, however many tasks there are. Should fewer than ``k`` pass, all rows are ordered.
    """
    share = min(1.0, (1.5 * k + 100) / max(1, n))
    few = df if share == 1 else df.where(F.col(draw) <= low + int(share * (high - low)))
    if share < 1 and few.count() < min(k, n):
        few = df
    return few.orderBy(draw, *[c for c in df.columns if c != draw]).limit(k)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by place, so that nothing added can clash, and the new names of ``names``."""
    new = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*new), [new[df.columns.index(n)] for n in names]


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, list]], after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` where ``work`` turns a non-empty batch into columns named as in ``schema`` (DDL).

    ``after`` is called when a task has read all its batches, to free what it has kept.
    """
    fields = [field.split() for field in schema.split(", ")]
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
                )
        if after is not None:
            after()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Bitmap:
    """A set of 64-bit numbers as hashed bits of fixed size: what was put in is held, other numbers may be."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def _bit(values: np.ndarray, bits: int) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    @classmethod
    def of(cls, df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> Bitmap:
        """The map of ``values``, unsigned, of all batches; words of 64 bits are OR-ed by Spark, and 2**(bits - 6) at most reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = np.unique(cls._bit(values(batch), bits))
                if len(bit):
                    word = (bit >> np.uint64(6)).astype(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                    ored = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(ored.view(np.int64))], names=["word", "ored"])

        found = df.mapInArrow(run, "word bigint, ored bigint").groupBy("word").agg(F.bit_or("ored").alias("ored")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found["word"].to_numpy()] = found["ored"].to_numpy().view(np.uint64)
        return cls(words, bits)

    def holds(self, values: np.ndarray) -> np.ndarray:
        bit = self._bit(values, self.bits)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
