"""Cycle-safe iteration over edge tables: reachability, closures, simple paths and components.

Each level joins only what the level before has found and drops what is known, so a pair is made once. Levels are
checkpointed in ``spark.checkpoint.dir``: plans stay short and a lost executor costs no more than a level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder

#: Rows of a level, of a few numbers each, up to which it is broadcast.
BROADCAST_ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, read by column, its files split evenly."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame) -> DataFrame:
    """A checkpointed level that is broadcast where it is small, so that the steps that it is joined with stay in place."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def reach(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(seed, id, depth)``: what each seed reaches over ``steps(src, dst)``, at its least depth.

    ``seeds`` has a column ``seed``. A seed itself is reached only over a cycle.
    """
    steps = steps.select("src", "dst")
    level = checkpointed(seeds.select("seed", F.col("seed").alias("id")).distinct())
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = small(level)
        new = level.join(steps, level["id"] == steps["src"]).select("seed", F.col("dst").alias("id")).distinct()
        if found is not None:
            new = new.join(found.select("seed", "id"), ["seed", "id"], "left_anti")
        level = checkpointed(new)
        if level.isEmpty():
            break
        now = level.withColumn("depth", F.lit(depth).cast("bigint"))
        found = now if found is None else found.unionByName(now)
    return found if found is not None else seeds.select("seed", F.col("seed").alias("id"), F.lit(0).cast("bigint").alias("depth")).limit(0)


def downward(deps: DataFrame) -> DataFrame:
    """Steps from a dependent to its dependencies."""
    return deps.select(F.col("dependent").alias("src"), F.col("dependency").alias("dst"))


def upward(deps: DataFrame) -> DataFrame:
    """Steps from a dependency to what needs it."""
    return deps.select(F.col("dependency").alias("src"), F.col("dependent").alias("dst"))


def closure_pairs(deps: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``(node, dep)``: each node, or each of ``seeds(seed)``, with all its transitive dependencies."""
    start = seeds if seeds is not None else deps.select(F.col("dependent").alias("seed")).distinct()
    return reach(downward(deps), start).select(F.col("seed").alias("node"), F.col("id").alias("dep"))


def simple_paths(steps: DataFrame, seeds: DataFrame, max_edges: int, stops: DataFrame | None = None) -> DataFrame:
    """``(path, kinds, done)``: paths without repeats from each seed over ``steps(src, dst, kind)``.

    A path ends at the first of ``stops(stop)``; with no stops, all paths of every length are returned.
    """
    steps = steps.select("src", "dst", "kind")
    level = seeds.select(F.array("seed").alias("path"), F.array().cast("array<string>").alias("kinds"))
    found = []
    for _ in range(max_edges):
        end = F.element_at("path", -1)
        longer = level.join(steps, end == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        longer = longer.select(F.array_append("path", F.col("dst")).alias("path"), F.array_append("kinds", F.col("kind")).alias("kinds"))
        if stops is None:
            level = checkpointed(longer)
            found.append(level)
        else:
            marked = checkpointed(longer.join(stops.select("stop", F.lit(True).alias("done")), end == F.col("stop"), "left").select("path", "kinds", F.coalesce("done", F.lit(False)).alias("done")))
            found.append(marked.where("done").select("path", "kinds"))
            level = marked.where("not done").select("path", "kinds")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else level.limit(0)


def strong_components(deps: DataFrame) -> DataFrame:
    """``(id, scc_id)`` of nodes on cycles through other nodes; ``scc_id`` is the smallest id of the component.

    Nodes without a predecessor or a successor are trimmed until none is left, which leaves the loops and what lies
    between them. A component is then what reaches the same nodes that it is reached from.
    """
    edges = checkpointed(deps.select(F.col("dependent").alias("src"), F.col("dependency").alias("dst")).where("src <> dst").distinct())
    while True:
        kept = checkpointed(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if kept.count() == edges.count():
            break
        edges = kept
    # colour rounds: the least id that reaches a node, then whether the node reaches it within its colour
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        colour = checkpointed(nodes.withColumn("colour", F.col("id")))
        while True:
            offered = edges.join(colour, edges["src"] == colour["id"]).groupBy("dst").agg(F.min("colour").alias("offer"))
            after = checkpointed(colour.join(offered, colour["id"] == offered["dst"], "left").select("id", F.least("colour", "offer").alias("colour")))
            if after.join(colour.withColumnRenamed("colour", "was"), "id").where("colour <> was").isEmpty():
                break
            colour = after
        heads, tails = colour.select(F.col("id").alias("src"), F.col("colour").alias("sc")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("dc"))
        within = checkpointed(edges.join(heads, "src").join(tails, "dst").where("sc = dc").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # backwards from the colour's own node, within the colour
        back = colour.where("id = colour").select("id", "colour")
        level = back
        while True:
            level = checkpointed(level.join(within, level["id"] == within["src"]).select(F.col("dst").alias("id"), "colour").distinct().join(back, ["id", "colour"], "left_anti"))
            if level.isEmpty():
                break
            back = checkpointed(back.unionByName(level))
        found = back if found is None else found.unionByName(back)
        rest = edges.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti")
        edges = checkpointed(rest)
    if found is None:
        return deps.select(F.col("dependent").alias("id"), F.col("dependent").alias("scc_id")).limit(0)
    size = F.count("*").over(Window.partitionBy("colour"))
    return found.withColumn("size", size).where("size > 1").select("id", F.min("id").over(Window.partitionBy("colour")).alias("scc_id"))


def top_by(df: DataFrame, groups: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("bigint")).where(F.col(rank) <= k)
