"""Mixing sources to target weights by fitting subset sums.

Documents are counted by source and exact length. A source takes every document a whole number of times and fills
what its target leaves by choosing a count for each length: first in proportion, then by a bounded-knapsack programme
that exchanges documents against others until no choice comes nearer. A length's documents are taken in the order of a
seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, column, numbered, texts

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Hash buckets that a group of equal length is dealt to, so that no task orders the whole group.
BUCKETS = 1024
#: Lengths among which an exchange is sought before it is among all.
FIRST_LENGTHS = 32


def word_sizes(df: DataFrame, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, draw)``: words of each text (null: 0) and a seeded hash of the id."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return _with_sizes(rows, "text", "text").select("doc_id", "source", F.col("_size").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("draw"))


def source_targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)``, one row per source, from ``(source, size)``.

    Sources by code point, null last, have the weights in turn and share ``share`` of all words. A target stops at
    ``most`` times its source's size; what is over is shared again by weight until none is above. The stopped
    sources are those with the least room for their weight, so one ordered pass over the sources (a row each, not
    over documents) finds the level that the others share.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    room = F.col("source_size") * F.lit(most)
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    ranked = (
        per_source.withColumn("weight", weight)
        .withColumn("room", room)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("stopped_before", F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    # the level if all smaller rooms are stopped and this one is not; it holds from the first source it doesn't fill
    level = (F.col("budget") - F.col("stopped_before")) / F.col("weight_from")
    ranked = ranked.withColumn("level", level)
    shared = F.min(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.struct(F.col("room") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    final = ranked.withColumn("final", shared["level"])
    return final.select("source", "source_size", F.coalesce(F.least("room", F.col("final") * F.col("weight")), F.col("room")).alias("target"))


def _parts(n: int) -> Iterator[int]:
    """Numbers that sum to ``n`` and of which some sum to each number below."""
    power = 1
    while n > 0:
        yield min(power, n)
        n -= power
        power *= 2


def _exchange(size: list[int], taken: list[int], left: list[int], gap: int, released: int, among: list[int]) -> np.ndarray:
    """How many more of each length to take so that the words taken grow as far as can be, by at most ``gap``.

    A knapsack programme over sums from ``-released`` to ``gap``: for each sum, which part reached it first. Parts are
    so many documents of a length, first those given back, then those taken.
    """
    first = np.full(released + gap + 1, -1, np.int32)
    first[released] = 0
    parts = [(0, 0)]
    for i in among:
        for part in _parts(min(taken[i], released // size[i])):
            w = part * size[i]
            parts.append((i, -part))
            first[:-w][(first[w:] >= 0) & (first[:-w] < 0)] = len(parts) - 1
    for i in among:
        for part in _parts(min(left[i], (released + gap) // size[i])):
            if first[-1] >= 0:
                break
            w = part * size[i]
            parts.append((i, part))
            first[w:][(first[:-w] >= 0) & (first[w:] < 0)] = len(parts) - 1
    change, at = np.zeros(len(size), np.int64), int(np.flatnonzero(first >= 0)[-1])
    while first[at] > 0:
        i, part = parts[first[at]]
        change[i] += part
        at -= part * size[i]
    return change


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near ``budget`` from below as can be.

    ``lengths`` are distinct and above 0; at most ``counts`` of each are taken. The result is the best there is: with
    documents of at most L words and a gap below L, a best choice gives back L * L words of a choice at most, so
    exchanges are widened until they meet the budget or reach that bound. Memory is four bytes for each word of the
    widest exchange, in units of the lengths' common divisor; exchanges among a few lengths nearly always do.
    """
    total = int((lengths * counts).sum())
    if budget >= total or budget <= 0:
        return counts.astype(np.int64) if budget > 0 else np.zeros(len(lengths), np.int64)
    unit = math.gcd(*lengths.tolist())
    size, have, total, budget = [n // unit for n in lengths.tolist()], counts.tolist(), total // unit, budget // unit
    taken = np.array([c * budget // total for c in have], np.int64)
    gap = budget - sum(n * t for n, t in zip(size, taken.tolist()))
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        more = min(have[i] - int(taken[i]), gap // size[i])
        taken[i] += more
        gap -= more * size[i]
    largest, everything = max(size), sorted(range(len(size)), key=lambda i: size[i])
    released, among = 0, everything[:: -(-len(size) // FIRST_LENGTHS)]
    while gap:
        enough = min(largest * largest, sum(n * t for n, t in zip(size, taken.tolist())))
        last = released >= enough and among is everything
        released = min(enough, max(2 * largest, 4 * released if among is everything else released))
        change = _exchange(size, taken.tolist(), [h - t for h, t in zip(have, taken.tolist())], gap, released, among)
        taken += change
        gap -= sum(n * c for n, c in zip(size, change.tolist()))
        if last:
            break
        among = everything
    return taken


def _with_sizes(df: DataFrame, text: str, *but: str) -> DataFrame:
    """``df`` without the columns ``but``, with a column ``_size``: the words of each text (null: 0)."""
    kept = [f for f in df.schema if f.name not in but]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(t.encode("utf-8").split()) if t else 0 for t in texts(batch, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in kept], sizes], names=[*[f.name for f in kept], "_size"])

    return df.mapInArrow(work, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_size bigint"]))


def _bucket(draw: Column) -> Column:
    return F.pmod(draw, F.lit(BUCKETS)).cast("int")


def _quotas(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per ``(source, size, bucket)``: how often all its documents are taken, and how many of them once more."""
    dealt = checkpointed(sizes.groupBy("source", "size", _bucket(F.col("draw")).alias("bucket")).agg(F.count("*").alias("n")))
    targets = source_targets(dealt.select("source", (F.col("size") * F.col("n")).alias("size")), share=share, most=most, weights=weights)
    # one row per source and length: a source's histogram is as long as its number of distinct lengths
    histogram = dealt.groupBy("source", "size").agg(F.sum("n").alias("n")).join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        whole = min(int(target // size), int(most)) if size else int(share)
        some = part[part["size"] > 0]
        part = part.assign(whole=whole, extra=0)
        if len(some):
            part.loc[some.index, "extra"] = fit_counts(some["size"].to_numpy(np.int64), some["n"].to_numpy(np.int64), int(round(target - whole * size)) if whole < most else 0)
        return part[["source", "size", "source_size", "target", "whole", "extra"]]

    fitted = histogram.groupBy("source").applyInPandas(fit, "source string, size bigint, source_size bigint, target double, whole int, extra bigint")
    # how many of each bucket are taken once more: whole buckets, then part of one
    running = Window.partitionBy("f.source", "f.size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.alias("d")
        .join(fitted.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.size") == F.col("f.size")))
        .withColumn("before", F.coalesce(F.sum("d.n").over(running), F.lit(0)))
        .select("f.source", "f.size", "d.bucket", "source_size", "target", "whole", F.greatest(F.lit(0), F.least("d.n", F.col("extra") - F.col("before"))).alias("quota"))
    )


def _with_copies(rows: DataFrame, quotas: DataFrame, doc_id: str, source: str, size: str, draw: Column) -> DataFrame:
    """``rows`` with ``q.*`` and ``_copies``: of each bucket the first by hash and id are taken once more."""
    # join and window share their keys, so rows are shuffled once; a null source has a name of its own
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit(""))
    met = rows.withColumn("_draw", draw).withColumn("_bucket", _bucket(F.col("_draw"))).withColumn("_name", name(source)).alias("r")
    named = quotas.withColumn("name", name("source")).alias("q")
    met = met.join(named, (F.col("r._name") == F.col("q.name")) & (F.col(f"r.{size}") == F.col("q.size")) & (F.col("r._bucket") == F.col("q.bucket")))
    turn = F.row_number().over(Window.partitionBy("r._name", f"r.{size}", "r._bucket").orderBy("r._draw", f"r.{doc_id}"))
    return met.withColumn("_copies", (F.col("whole") + (turn <= F.col("quota")).cast("int")).cast("bigint"))


def mix(df: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` for each row of ``df``.

    ``copies`` is how often the mix takes the document, 0 to ``most``; ``taken`` is ``copies * size``. A null source
    is a source, the last one. Null and empty texts have size 0; they are taken as often as every document of their
    source. Reruns agree; rows that repeat an id tie and share what their number is given. An empty table gives an
    empty result.
    """
    rows = checkpointed(word_sizes(df, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col))
    chosen = _with_copies(rows, _quotas(rows, share, most, weights), "doc_id", "source", "size", F.col("draw"))
    return chosen.select("r.doc_id", "r.size", "source_size", "target", F.col("_copies").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_to_mix(df: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as often as ``mix`` takes them, with its columns; texts are shuffled once.

    Each row is taken by its own length, also where rows repeat an id, so that the words of each source are those
    ``mix`` gives. Null and empty texts, null sources and ties are as in ``mix``; an empty table gives an empty one.
    """
    sizes = checkpointed(word_sizes(df, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col))
    plain, (doc_id, text, source) = numbered(df, id_col, text_col, source_col)
    named = _with_sizes(plain, text).withColumn("_source", F.col(source).cast("string"))
    chosen = _with_copies(named, _quotas(sizes, share, most, weights), doc_id, "_source", "_size", F.xxhash64(F.lit(seed), F.col(doc_id)))
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("turn")
    return chosen.where("_copies > 0").select(*[F.col(f"r.{c}") for c in plain.columns], again).select(plain.columns).toDF(*df.columns)
