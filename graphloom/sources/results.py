"""Results that outlive a session: JSON rows by import, kind and key, with a time at which they expire.

A kind of an import is a folder of numbered versions. A version counts once Spark has put ``_SUCCESS`` into it, which is the
last that a write does, so a write that breaks off leaves the version before it in place, and a reader sees one version
whole. A version stays while the next is written, for those who still read it, and goes with the one after.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folder

#: Seconds that a result is good for: near at hand, stored, and of packages that many ask about.
LIFETIMES = {"short": 600, "stored": 3600, "common": 7200}
_ROWS = "key string, result string, computed_at timestamp_ntz, expires_at timestamp_ntz"


def _time(value: str | Column) -> Column:
    return F.to_timestamp_ntz(F.lit(value)) if isinstance(value, str) else value


class ResultStore:
    """``put``, ``get``, ``invalidate`` and ``cleanup`` of results under a folder; times are given, as strings, by the caller."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def _place(self, import_id: int, kind: str) -> str:
        return f"import_id={int(import_id)}/kind={kind}"

    def _versions(self, place: str) -> list[str]:
        return [v for v in self.folder.names(place) if v.startswith("v=") and self.folder.has(f"{place}/{v}/_SUCCESS")]

    def _all(self, place: str) -> DataFrame:
        done = self._versions(place)
        if not done:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.folder.path}/{place}/{done[-1]}")

    def _replace(self, place: str, rows: DataFrame) -> None:
        """The next version; unfinished ones are never reused, so two writers never share a folder."""
        seen = [v for v in self.folder.names(place) if v.startswith("v=")]
        done = self._versions(place)
        name = f"v={int(seen[-1][2:]) + 1 if seen else 0:012d}"
        rows.select("key", "result", "computed_at", "expires_at").write.mode("errorifexists").parquet(f"{self.folder.path}/{place}/{name}")
        for old in done[:-1]:
            self.folder.remove(f"{place}/{old}")

    def places(self) -> list[tuple[int, str]]:
        """Imports and kinds that have results; a few for each import."""
        return [(int(i.partition("=")[2]), k.partition("=")[2]) for i in self.folder.names() if i.startswith("import_id=") for k in self.folder.names(i) if self._versions(f"{i}/{k}")]

    def put(self, import_id: int, kind: str, results: DataFrame, now: str, lifetime: str | int = "stored") -> None:
        """Store ``results(key, ...)``; what was stored under any of their keys goes. A key may have several rows, or be null."""
        seconds = LIFETIMES.get(lifetime, lifetime)
        body = F.to_json(F.struct(*[c for c in results.columns if c != "key"]), {"ignoreNullFields": "false"})
        new = results.select(F.col("key").cast("string").alias("key"), body.alias("result"), _time(now).alias("computed_at"), (_time(now) + F.make_dt_interval(secs=F.lit(int(seconds)))).alias("expires_at"))
        place = self._place(import_id, kind)
        new_keys = new.select(F.col("key").alias("new_key")).distinct()
        rest = self._all(place).join(new_keys, F.col("key").eqNullSafe(F.col("new_key")), "left_anti")
        self._replace(place, rest.unionByName(new))

    def get(self, import_id: int, kind: str, now: str, schema: str | None = None) -> DataFrame:
        """What has not expired: ``(key, result, computed_at, expires_at)``, or with ``schema`` (DDL) its columns in place of the JSON."""
        rows = self._all(self._place(import_id, kind)).where(F.col("expires_at") > _time(now))
        if schema is None:
            return rows
        return rows.withColumn("result", F.from_json("result", schema)).select("key", "result.*")

    def get_or_compute(self, import_id: int, kind: str, key: str, now: str, schema: str, compute: Callable[[], DataFrame], lifetime: str | int = "stored") -> DataFrame:
        """The rows of a key, computed and stored if there are none that are good."""
        found = self.get(import_id, kind, now, schema).where(F.col("key") == key)
        if found.isEmpty():
            self.put(import_id, kind, compute().withColumn("key", F.lit(key)), now, lifetime)
            found = self.get(import_id, kind, now, schema).where(F.col("key") == key)
        return found.drop("key")

    def invalidate(self, import_id: int, kind: str | None = None) -> int:
        """Drop the results of an import, or those of a kind whose name begins so; how many rows went."""
        gone = 0
        for place in [self._place(i, k) for i, k in self.places() if i == import_id and (kind is None or k.startswith(kind))]:
            gone += self._all(place).count()
            self.folder.remove(place)
        return gone

    def cleanup(self, now: str) -> int:
        """Drop what has expired, and versions that were never finished; how many rows went."""
        gone = 0
        for i, k in self.places():
            place, rows = self._place(i, k), self._all(self._place(i, k))
            good = rows.where(F.col("expires_at") > _time(now))
            expired = rows.count() - good.count()
            if expired and good.isEmpty():
                self.folder.remove(place)
            elif expired:
                self._replace(place, good)
            done = self._versions(place)
            for name in self.folder.names(place):
                if name.startswith("v=") and name not in done and done and name < done[-1]:
                    self.folder.remove(f"{place}/{name}")
            gone += expired
        return gone

    def stats(self) -> DataFrame:
        """``(import_id, kind, entries, oldest, newest)`` of what is stored, expired or not."""
        rows = [self._all(self._place(i, k)).select(F.lit(i).cast("bigint").alias("import_id"), F.lit(k).alias("kind"), "key", "computed_at") for i, k in self.places()]
        none = self.spark.createDataFrame([], "import_id bigint, kind string, key string, computed_at timestamp_ntz")
        return reduce(DataFrame.unionByName, rows, none).groupBy("import_id", "kind").agg(F.countDistinct("key").alias("entries"), F.min("computed_at").alias("oldest"), F.max("computed_at").alias("newest"))
