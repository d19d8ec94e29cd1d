"""Sizes of transitive closures by sets of numbered targets, a row for a node and a block of targets.

Nodes are peeled in levels from the leaves; what no peeling reaches lies on or above loops, whose components are
contracted before peeling goes on. Every node that something depends on has a number; 65,536 numbers are a block. A node's
set in a block is a sorted list of two-byte offsets, or a bitmap of 8 KB where 4,096 or more are in it, so a row has 8 KB at
most however many nodes are reached. A level's sets are the unions of those of the levels below; tasks unite what
they have before the shuffle. There is no row for a node and a dependency, but in the edges.

Rounds are as many as the longest path is long, between loops.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import checkpointed, stored, strong_components

#: Numbers of a block as a power of two; elements from which a set is a bitmap; bytes of sets that are united at a time.
BLOCK_BITS, DENSE, UNITED_BYTES = 16, 4_096, 4_000_000
#: Elements of a set, and edges of a source, up to which an edge carries its target's set as a list; bits of a number.
SMALL_SET, MANY_EDGES, _NUMBER_BITS = 1_024, 4_096, 40
_BITMAP_BYTES = (1 << BLOCK_BITS) // 8
_SETS = "id bigint, block bigint, members binary"


def encoded(offsets: np.ndarray) -> bytes:
    """A sorted array of distinct offsets as a list or a bitmap."""
    if len(offsets) < DENSE:
        return offsets.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[offsets] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def decoded(members: bytes) -> np.ndarray:
    """The inverse of ``encoded``; a list is always shorter than a bitmap."""
    if len(members) < _BITMAP_BYTES:
        return np.frombuffer(members, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(members, np.uint8), bitorder="little"))


def united(ids: np.ndarray, blocks: np.ndarray, members: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows of equal id and block as one, in order."""
    order = np.lexsort((blocks, ids))
    ids, blocks = ids[order], blocks[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])]))
    sizes = np.diff(np.append(first, len(ids)))
    out: list[bytes] = [b""] * len(first)
    lists: list[tuple[int, list[bytes]]] = []
    for k, (start, n) in enumerate(zip(first.tolist(), sizes.tolist())):
        group = [members[i] for i in order[start : start + n]]
        if n == 1:
            out[k] = group[0]
        elif max(map(len, group)) == _BITMAP_BYTES:
            bits = np.zeros(_BITMAP_BYTES, np.uint8)
            for m in group:
                bits |= np.frombuffer(m if len(m) == _BITMAP_BYTES else np.packbits(np.bincount(decoded(m), minlength=1 << BLOCK_BITS).astype(np.uint8), bitorder="little").tobytes(), np.uint8)
            out[k] = bits.tobytes()
        else:
            lists.append((k, group))
    if lists:  # all groups of lists at once
        rows = [b"".join(group) for _, group in lists]
        owner = np.repeat(np.arange(len(rows)), [len(r) // 2 for r in rows])
        found = np.unique(owner << BLOCK_BITS | np.frombuffer(b"".join(rows), "<u2"))
        cuts = np.searchsorted(found, np.arange(1, len(rows)) << BLOCK_BITS)
        for (k, _), offsets in zip(lists, np.split(found & ((1 << BLOCK_BITS) - 1), cuts)):
            out[k] = encoded(offsets)
    return ids[first], blocks[first], out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()


def _united_by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions within a batch, before the shuffle."""
    for batch in batches:
        ids, blocks, members = _columns(batch)
        part = np.cumsum([len(m) for m in members]) // UNITED_BYTES
        for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(part)) + 1):
            if len(at):
                rows = united(ids[at], blocks[at], [members[i] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.binary())], names=["id", "block", "members"])


def _united_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of rows that come in order of id and block; the last row of a batch waits for the next."""
    held: tuple[np.ndarray, np.ndarray, list[bytes]] | None = None

    def told(rows: tuple) -> pa.RecordBatch:
        n = [len(m) // 2 if len(m) < _BITMAP_BYTES else int(np.bitwise_count(np.frombuffer(m, np.uint64)).sum()) for m in rows[2]]
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.binary()), pa.array(n, pa.int64())], names=["id", "block", "members", "n"])

    for batch in _united_by_task(batches):
        rows = _columns(batch)
        if held is not None:
            rows = united(np.append(held[0], rows[0]), np.append(held[1], rows[1]), [*held[2], *rows[2]])
        if len(rows[0]) > 1:
            yield told((rows[0][:-1], rows[1][:-1], rows[2][:-1]))
        held = rows[0][-1:], rows[1][-1:], rows[2][-1:]
    if held is not None:
        yield told(held)


def unions(sets: DataFrame) -> DataFrame:
    """``(id, block, members, n)``: one row for each id and block of ``sets(id, block, members)``, with the size of the union."""
    rows = sets.select("id", "block", "members").mapInArrow(_united_by_task, _SETS)
    return rows.repartition("id", "block").sortWithinPartitions("id", "block").mapInArrow(_united_by_key, _SETS + ", n bigint")


def dense_numbers(ids: DataFrame, name: str = "number") -> DataFrame:
    """``ids`` (one column ``id``, distinct) with numbers from 0 in order of id; no task sees more than its range."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ids.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id")
    rows = checkpointed(rows.withColumns({"part": F.spark_partition_id(), "turn": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))  # one row a task
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("id", (F.col("before") + F.col("turn")).alias(name))


def topological_levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, component)`` of nodes on loops and ``(component, level)`` of all ends of ``edges(src, dst)``, loops as one.

    A level is above all levels that its nodes depend on; leaves have level 0. A node that is on no loop is a component of its own.
    """
    left = checkpointed(edges.where("src <> dst").distinct())
    members, found, level = None, [], 0
    while not left.isEmpty():
        # what stands only on the right of the edges that are left has nothing below it any more
        leaves = checkpointed(left.select(F.col("dst").alias("component")).distinct().join(left.select(F.col("src").alias("component")), "component", "left_anti"))
        if leaves.isEmpty():
            if members is not None:
                raise AssertionError("loops are left after their components are contracted")
            members = checkpointed(strong_components(left.select(F.col("src").alias("dependent"), F.col("dst").alias("dependency"))).select("id", F.col("scc_id").alias("component")))
            ends = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().join(members, "id", "left").select(F.coalesce("component", "id").alias("component")).distinct()
            left = checkpointed(contracted(left, members))
            # loops that nothing else here depends on, and that depend on nothing that is left
            alone = ends.join(left.select(F.col("src").alias("component")).union(left.select("dst")), "component", "left_anti")
            found.append(alone.withColumn("level", F.lit(level)))
            continue
        found.append(leaves.withColumn("level", F.lit(level)))
        # nodes whose edges all go now come next; those that nothing depends on are in no edge after this one
        after = checkpointed(left.join(leaves.select(F.col("component").alias("dst")), "dst", "left_anti"))
        ended = left.select(F.col("src").alias("component")).distinct().join(after.select(F.col("src").alias("component")), "component", "left_anti").join(after.select(F.col("dst").alias("component")), "component", "left_anti")
        found.append(ended.withColumn("level", F.lit(level + 1)))
        left, level = after, level + 1
    nothing = edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    levels = reduce(DataFrame.unionByName, found) if found else nothing.select("component", F.lit(0).alias("level"))
    return members if members is not None else nothing, checkpointed(levels)


def contracted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` between components; nodes that ``members(id, component)`` doesn't list are their own."""
    of = lambda end: members.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    both = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return both.select(F.coalesce("src_component", "src").alias("src"), F.coalesce("dst_component", "dst").alias("dst")).where("src <> dst").distinct()


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sets as lists of numbers."""
    for batch in batches:
        ids, blocks, members = _columns(batch)
        lists = [(block << BLOCK_BITS) + decoded(m) for block, m in zip(blocks.tolist(), members)]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))], names=["id", "numbers"])


def _counted_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct numbers of rows ``(id, numbers)`` that come in order of id; the last id of a batch waits for the next."""
    owners, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    told = lambda ids, n: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        owners = np.append(owners, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))
        values = np.append(held, batch.column(1).flatten().to_numpy(zero_copy_only=False))
        if not len(owners):
            continue
        new = np.concatenate([[True], owners[1:] != owners[:-1]])
        ids = owners[new]
        found = np.unique((np.cumsum(new) - 1) << _NUMBER_BITS | values)
        counts = np.bincount(found >> _NUMBER_BITS, minlength=len(ids))
        if len(ids) > 1:
            yield told(ids[:-1], counts[:-1])
        held = found[len(found) - counts[-1] :] & ((1 << _NUMBER_BITS) - 1)
        owners = np.full(len(held), ids[-1])
    if len(owners):
        yield told(owners[:1], [len(held)])


def _outer_counts(outer: DataFrame, sets: DataFrame) -> DataFrame:
    """``(id, n)``: how many numbers the sets ``(id, block, members, n)`` have together that each source of ``outer(src, dst)`` leads to.

    A source of few edges to small sets is counted from one list of numbers an edge; others are united by block.
    """
    sizes = sets.groupBy("id").agg(F.sum("n").alias("n"))
    large = checkpointed(sizes.where(F.col("n") > SMALL_SET).select(F.col("id").alias("dst")))
    wide = outer.groupBy("src").agg(F.count("*").alias("edges")).where(F.col("edges") > MANY_EDGES).select("src")
    heavy = checkpointed(wide.unionByName(outer.join(large, "dst", "left_semi").select("src")).distinct())
    few, none = outer, heavy.isEmpty()
    if not none:
        few = outer.join(heavy, "src", "left_anti")
    small = sets.select("id", "block", "members").join(large.select(F.col("dst").alias("id")), "id", "left_anti")
    lists = small.mapInArrow(_numbers, "id bigint, numbers array<bigint>").groupBy(F.col("id").alias("dst")).agg(F.flatten(F.collect_list("numbers")).alias("numbers"))
    rows = few.join(lists, "dst").select(F.col("src").alias("id"), "numbers")
    found = rows.repartition("id").sortWithinPartitions("id").mapInArrow(_counted_by_key, "id bigint, n bigint")
    if none:
        return found
    gathered = outer.join(heavy, "src", "left_semi").join(sets.select(F.col("id").alias("dst"), "block", "members"), "dst")
    return found.unionByName(unions(gathered.select(F.col("src").alias("id"), "block", "members")).groupBy("id").agg(F.sum("n").alias("n")))


def reached_counts(deps: DataFrame) -> DataFrame:
    """``(id, closure_size)`` of the nodes of ``deps(dependent, dependency)`` that depend on something; a node on a loop reaches itself.

    Nodes that nothing depends on are on no loop and in no other set, so levels and sets are made of the others alone.
    """
    given = stored(deps.select(F.col("dependent").alias("src"), F.col("dependency").alias("dst")).where("src is not null and dst is not null"))
    targets = checkpointed(given.select(F.col("dst").alias("id")).distinct())
    marked = stored(given.join(targets.select(F.col("id").alias("src"), F.lit(True).alias("inner")), "src", "left"))
    outer, edges = marked.where("inner is null").select("src", "dst"), stored(marked.where("inner").select("src", "dst").distinct())
    members, levels = topological_levels(edges)
    numbers = checkpointed(dense_numbers(targets))
    loops = not members.isEmpty()
    placed = numbers.join(members, "id", "left").withColumn("component", F.coalesce("component", "id"))
    offset = F.col("number").bitwiseAND((1 << BLOCK_BITS) - 1)
    # two bytes of an offset, the low one first
    two = F.unhex(F.concat(F.lpad(F.hex(offset.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(offset, 8)), 2, "0")))
    own = checkpointed(placed.select(F.col("component").alias("id"), F.shiftright("number", BLOCK_BITS).alias("block"), two.alias("members")))
    between = contracted(edges, members) if loops else edges
    between = checkpointed(between.where("src <> dst").join(levels.select(F.col("component").alias("src"), "level"), "src"))
    top = levels.agg(F.max("level")).first()[0] or 0
    known = own.join(levels.where("level > 0").select(F.col("component").alias("id")), "id", "left_anti")
    below = checkpointed(unions(known))  # sets of what is done, with the node's own members in them
    counted = []
    for level in range(1, top + 1):
        here = between.where(F.col("level") == level)
        gathered = here.join(below.select(F.col("id").alias("dst"), "block", "members"), "dst").select(F.col("src").alias("id"), "block", "members")
        mine = own.join(levels.where(F.col("level") == level).select(F.col("component").alias("id")), "id", "left_semi")
        sets = checkpointed(unions(gathered.unionByName(mine)))
        counted.append(sets.select("id", "n"))
        below = below.unionByName(sets)
    # a component on a loop reaches all its members; any other node is in its own set and not reached but by itself
    itself = edges.where("src = dst").select(F.col("src").alias("id"), F.lit(1).alias("loop"))
    nodes = edges.select(F.col("src").alias("id")).distinct().join(members, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    nodes = nodes.join(sizes, "component", "left").join(itself.join(members, "id", "left_anti"), "id", "left")
    if counted:
        counts = reduce(DataFrame.unionByName, counted).groupBy("id").agg(F.sum("n").alias("n"))
        nodes = nodes.join(counts.withColumnRenamed("id", "component"), "component", "left")
        n = F.coalesce("n", "size", F.lit(1))
    else:
        n = F.coalesce("size", F.lit(1))
    inner = nodes.select("id", (n - F.when(F.col("size").isNull(), 1).otherwise(0) + F.coalesce("loop", F.lit(0))).cast("bigint").alias("closure_size"))
    if loops:
        of = members.select(F.col("id").alias("dst"), F.col("component").alias("dst_component"))
        outer = outer.join(of, "dst", "left").select("src", F.coalesce("dst_component", "dst").alias("dst"))
    return inner.unionByName(_outer_counts(outer, below).select("id", F.col("n").alias("closure_size")))
