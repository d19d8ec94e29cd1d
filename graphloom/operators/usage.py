"""Which top-level package uses a node, if it is one alone, and contributions kept up by what has changed.

A node's state has three values: no user, one user (`user`), or many. A dependent passes its state on, joined with itself if it is
a top-level package; joining two different users gives many, which is final. A state rises twice at most, so an
edge carries two messages of constant size at most, however many packages use what lies below, and loops need no care.

``Kept`` holds the states and contributions of a graph. After a change of edges or of top-level marks, only the nodes below the
changed edges get new states, from the states of their dependents outside, and only the packages above have their closures
counted again. Of other packages nothing but the number of unique dependencies can change, which follows from the states
that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from .fixpoint import checkpointed, downward, reach, small, stored, upward
from .reachability import reached_counts


def _joined(df: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each key of rows ``(keys, user, many)``; a state with many users names none."""
    low, high = F.min("user"), F.max("user")
    found = df.groupBy(*keys).agg((F.bool_or("many") | (F.count("user") > 0) & (low != high)).alias("many"), low.alias("user"))
    many = F.coalesce("many", F.lit(False))
    return found.select(*keys, F.when(~many, F.col("user")).alias("user"), many.alias("many"))


def _offers(states: DataFrame, tops: DataFrame) -> DataFrame:
    """What nodes pass on: their states ``(id, user, many)``, joined with themselves where they are in ``tops(id)``."""
    marked = states.join(tops.select("id", F.lit(True).alias("top")), "id", "left")
    top = F.coalesce("top", F.lit(False))
    many = F.col("many") | (top & F.col("user").isNotNull() & (F.col("user") != F.col("id")))
    return marked.select("id", F.when(~many, F.when(top, F.col("id")).otherwise(F.col("user"))).alias("user"), many.alias("many"))


def spread(edges: DataFrame, tops: DataFrame, offers: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``(id, user, many)`` of nodes with users: ``offers`` passed down ``edges(dependent, dependency)`` until nothing changes.

    ``within`` are the only nodes ``(id)`` that take offers. Each round joins only the offers that have changed.
    """
    if within is not None:
        edges = checkpointed(edges.join(within.select(F.col("id").alias("dependency")), "dependency", "left_semi"))
    states, offers = None, checkpointed(offers.where("user is not null or many"))
    while not offers.isEmpty():
        sent = edges.join(offers, F.col("dependent") == F.col("id")).select(F.col("dependency").alias("id"), "user", "many")
        new = _joined(sent, ["id"])
        if states is not None:
            was = states.select("id", F.col("user").alias("was_user"), F.col("many").alias("was_many"))
            both = new.join(was, "id", "left")
            many = F.col("many") | F.coalesce("was_many", F.lit(False)) | (F.col("user").isNotNull() & F.col("was_user").isNotNull() & (F.col("user") != F.col("was_user")))
            risen = both.withColumn("many", many).withColumn("user", F.when(~F.col("many"), F.coalesce("was_user", "user")))
            new = risen.where("was_many is null or many <> was_many or not (user <=> was_user)").select("id", "user", "many")
        new = checkpointed(new)
        states = new if states is None else checkpointed(states.join(new.select("id"), "id", "left_anti").unionByName(new))
        offers = checkpointed(_offers(new, tops))
    return states if states is not None else offers


def _tops(graph: Graph) -> DataFrame:
    return graph.nodes.where("is_top_level").select("id")


def leading(graph: Graph, ids: DataFrame) -> DataFrame:
    """Distinct edges ``(dependent, dependency)`` out of ``ids(id)`` and of nodes that something depends on, stored.

    All edges below the ids are among them. The edges of a graph are shuffled here once; rounds go over what is left.
    """
    edges = graph.deps.select("dependent", "dependency")
    sources = ids.select(F.col("id").alias("dependent")).unionByName(edges.select(F.col("dependency").alias("dependent"))).distinct()
    return stored(edges.join(sources, "dependent", "left_semi").distinct())


def states(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """``(id, user, many)`` of all nodes that a top-level package depends on, directly or not; ``edges`` are ``leading`` of these packages."""
    tops = _tops(graph)
    edges = leading(graph, tops) if edges is None else edges
    return spread(edges, tops, tops.select("id", F.col("id").alias("user"), F.lit(False).alias("many")))


def _closures_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, closure_size)`` of ``ids(id)``, counted over what lies below them alone; ``edges`` are ``leading`` of the ids or of more."""
    return reached_counts(below(edges, ids)).join(ids, "id", "left_semi")


def below(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges ``(dependent, dependency)`` out of ``ids(id)`` and of all that they depend on; every node is walked once, not once for each of them."""
    seed = ids.select(F.col("id").alias("start")).distinct()
    found = walk(downward(edges), seed)
    return edges.join(found.select(F.col("id").alias("dependent")), "dependent", "left_semi")


def walk(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """``(id)`` of ``starts(start)`` and all that ``steps(src, dst)`` lead to from any of them."""
    level = checkpointed(starts.select(F.col("start").alias("id")).distinct())
    found, steps = level, steps.select("src", "dst")
    while not level.isEmpty():
        level = small(level)
        level = checkpointed(level.join(steps, level["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti"))
        found = found.unionByName(level)
    return found


def _with_shared(total: DataFrame, unique: DataFrame) -> DataFrame:
    rows = total.join(unique, "id", "left").select("id", F.coalesce("unique_contribution", F.lit(0)).cast("bigint").alias("unique_contribution"), "total_contribution")
    return rows.select("id", "unique_contribution", (F.col("total_contribution") - F.col("unique_contribution")).alias("shared_contribution"), "total_contribution")


def _unique(found: DataFrame) -> DataFrame:
    return found.where("user is not null").groupBy(F.col("user").alias("id")).agg(F.count("*").alias("unique_contribution"))


@dataclass(frozen=True)
class Kept:
    """States ``(id, user, many)`` and contributions ``(id, unique_contribution, shared_contribution, total_contribution)`` of a graph."""

    states: DataFrame
    contributions: DataFrame

    @classmethod
    def of(cls, graph: Graph) -> Kept:
        """Computed in full."""
        edges = leading(graph, _tops(graph))
        found = checkpointed(states(graph, edges))
        total = _closures_of(_tops(graph), edges).select("id", F.col("closure_size").alias("total_contribution"))
        return cls(found, checkpointed(_with_shared(total, _unique(found))))

    def changed(self, before: Graph, after: Graph) -> tuple[Kept, dict[str, DataFrame]]:
        """For the graph ``after``, and what was walked: ``states`` set anew and ``packages`` counted anew.

        What differs between the graphs is found by comparing edges and top-level marks; nothing else need be told, so a
        change applied twice changes nothing.
        """
        # one table of the edges of both, with bit 0 for before and bit 1 for after
        side = lambda graph, bit: graph.deps.select("dependent", "dependency", F.lit(bit).alias("sides"))
        pairs = stored(side(before, 1).unionByName(side(after, 2)).groupBy("dependent", "dependency").agg(F.bit_or("sides").alias("sides")))
        both, now = pairs.select("dependent", "dependency"), pairs.where("sides >= 2").select("dependent", "dependency")
        edges = checkpointed(pairs.where("sides < 3").select("dependent", "dependency"))
        tops_was, tops = _tops(before), _tops(after)
        marks = checkpointed(tops_was.exceptAll(tops).unionByName(tops.exceptAll(tops_was)).distinct())
        # below: ends of changed edges and what a package that was marked or unmarked depends on
        of_marks = both.join(marks.select(F.col("id").alias("dependent")), "dependent", "left_semi").select(F.col("dependency").alias("start"))
        low = checkpointed(walk(both.select(F.col("dependent").alias("src"), F.col("dependency").alias("dst")), edges.select(F.col("dependency").alias("start")).unionByName(of_marks)))
        # above: packages that reach a changed edge
        up = walk(both.select(F.col("dependency").alias("src"), F.col("dependent").alias("dst")), edges.select(F.col("dependent").alias("start")))
        packages = checkpointed(up.unionByName(marks).distinct().join(tops, "id", "left_semi"))
        # states below, from the offers of dependents outside and of packages inside
        rest = self.states.join(low, "id", "left_anti")
        into = now.join(low.select(F.col("id").alias("dependency")), "dependency", "left_semi").select(F.col("dependent").alias("id")).distinct()
        none = into.join(rest, "id", "left").select("id", "user", F.coalesce("many", F.lit(False)).alias("many"))
        fresh = checkpointed(spread(now, tops, _offers(none, tops), within=low))
        found = checkpointed(rest.unionByName(fresh))
        # unique dependencies: one less for each state that was, one more for each that is
        old = self.states.join(low, "id", "left_semi").where("user is not null").select(F.col("user").alias("id"), F.lit(-1).alias("delta"))
        deltas = old.unionByName(fresh.where("user is not null").select(F.col("user").alias("id"), F.lit(1).alias("delta"))).groupBy("id").agg(F.sum("delta").alias("delta"))
        total = _closures_of(packages, leading(after, packages)).select("id", "closure_size")
        # a package has contributions if it has dependencies
        kept = self.contributions.select("id", "unique_contribution", F.col("total_contribution").alias("closure_size")).join(packages, "id", "left_anti").join(tops, "id", "left_semi")
        anew = total.join(self.contributions.select("id", "unique_contribution"), "id", "left").select("id", F.coalesce("unique_contribution", F.lit(0)).alias("unique_contribution"), "closure_size")
        rows = kept.unionByName(anew).join(deltas, "id", "left")
        rows = rows.select("id", F.col("closure_size").alias("total_contribution"), (F.col("unique_contribution") + F.coalesce("delta", F.lit(0))).alias("unique_contribution"))
        return Kept(found, checkpointed(_with_shared(rows.select("id", "total_contribution"), rows.select("id", "unique_contribution")))), {"states": low, "packages": packages}


def contributions_of(graph: Graph, kept: DataFrame, ids: DataFrame) -> DataFrame:
    """Contributions of ``ids(id)`` alone: their closures are counted anew, unique dependencies come from the states kept."""
    wanted = checkpointed(ids.select("id").distinct().join(_tops(graph), "id", "left_semi"))
    total = _closures_of(wanted, leading(graph, wanted)).select("id", F.col("closure_size").alias("total_contribution"))
    return _with_shared(total, _unique(kept.join(wanted.select(F.col("id").alias("user")), "user", "left_semi")))
