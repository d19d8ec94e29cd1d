"""Jaccard join of documents' sets of word n-grams by signature trees.

1. A set is kept once for each slice of texts, with the ids of the documents that have it, as sorted 64-bit hashes of its
   n-grams; equal sets have one digest. Copies thus meet before anything is shuffled, and never as pairs.
2. Two sets that link share one of the first ``s - ceil(0.85 s) + 1`` n-grams of either in any order that holds for all. The
   order is: n-grams not known to repeat, then those that do, by hash; a bitmap of fixed size, filled from the lowest
   hashes of all documents, says which repeat. A passage that many documents share thus comes last and brings none of
   them together. Among the sets that meet, all repeats are counted, and those of like size are brought together once
   more. Sets joined by such n-grams, directly or over others, are a unit; sets of two units don't link.
3. Each unit is cut by size into blocks of bounded size, and a signature tree is built over two neighbouring blocks: a
   leaf holds a few sets, a node the OR of its sets' bitmaps and the range of their sizes. Pairs of nodes are
   traversed from the leaves up; a pair goes when its sizes differ too much, when the bits it has in common are too few
   for any two of its sets, or when all its sets are in one component already. What is left is intersected exactly.
4. Where a unit has three blocks or more, sets outside of its largest component so far meet the blocks further off whose
   sizes fit. A group of near copies, however large, is in one component by then.

Links are emitted as a spanning forest of each tree's sets, so a component loses no link and no group gives all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bitmap, checkpointed, column, freed, id_and_text, removed, written
from .periodic_runs import slices
from .simhash import components

#: Sets and n-grams of a block; one set may have more n-grams.
BLOCK_SETS, BLOCK_GRAMS = 1_000, 2_000_000
#: Share of each set, by hash, whose n-grams are counted to tell which repeat, and bits of the two maps.
PROBED, REPEAT_BITS, UNIT_BITS = 0.3, 26, 26
#: Sets of a leaf, nodes of a node.
LEAF, FAN = 16, 8

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def grams(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word sequences of a text in lower case (A-Z); with fewer words, of all its words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    found = np.full(n, k, np.uint64)
    for i in range(k):
        found = found * _STEP + each[i : i + n]
        found ^= found >> np.uint64(29)
    found *= _MIX
    return np.unique(found ^ found >> np.uint64(32))


def prefix_length(n: int, percent: int) -> int:
    """How many n-grams of a set of ``n`` must be looked at to meet any set that links with it."""
    return n - (percent * n + 99) // 100 + 1


class SignatureTree:
    """Sets under nodes with OR-ed bitmaps and ranges of sizes; ``links`` traverses it against itself."""

    def __init__(self, sets: list[np.ndarray], percent: int, component: np.ndarray):
        """``component``: numbers, equal for sets known to be in one component."""
        order = sorted(range(len(sets)), key=lambda k: (sets[k][0], len(sets[k])))
        self.order, self.percent = np.array(order), percent
        self.sets = [sets[k] for k in order]
        self.component = component[self.order]
        size = np.array([len(s) for s in self.sets], np.int64)
        width = 1 << min(14, max(8, int(4 * size.max() - 1).bit_length()))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, s in zip(bits, self.sets):
            marks = np.zeros(width, np.uint8)
            marks[(s & np.uint64(width - 1)).astype(np.int64)] = 1
            row[:] = np.packbits(marks).view(np.uint64)
        excess = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, excess)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess = self.levels[-1]
            at = np.arange(0, len(bits), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))
            fan = FAN
        self.spans = [1, *(LEAF * FAN**k for k in range(len(self.levels) - 1))]

    def _near(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which nodes ``x`` may hold a set that links with one of nodes ``y``, as a matrix.

        An overlap is the common bits at most and the n-grams that share a bit within the set of fewer such; it is
        no more than either size. A link needs ``percent`` of the larger set, and of both together less the overlap.
        """
        bits, low, high, excess = self.levels[level]
        p = self.percent
        common = np.bitwise_count(bits[x][:, None] & bits[y][None]).sum(2, dtype=np.int64)
        most = np.minimum(common + np.minimum(excess[x][:, None], excess[y][None]), np.minimum(high[x][:, None], high[y][None]))
        larger = np.maximum(low[x][:, None], low[y][None])
        return (100 * most >= p * larger) & ((100 + p) * most >= p * (low[x][:, None] + low[y][None]))

    def _members(self, level: int, node: int) -> slice:
        return slice(node * self.spans[level], (node + 1) * self.spans[level])

    def _settled(self, level: int, x: int, y: int) -> bool:
        """All sets of both nodes are in one component."""
        a, b = self.component[self._members(level, x)], self.component[self._members(level, y)]
        return bool((a == a[0]).all() and (b == a[0]).all())

    def links(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the links, less what ``component`` has told, as numbers of the sets given."""
        for level in range(1, len(self.levels)):
            for node in range(len(self.levels[level][0])):
                below = self._below(level, node)
                yield from self._across(level - 1, below, below, True)

    def _below(self, level: int, node: int) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        return np.arange(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0])))

    def _across(self, level: int, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
        near = self._near(level, x, y)
        if same:
            near = np.triu(near, 1)
        for i, j in np.argwhere(near):
            a, b = int(x[i]), int(y[j])
            if self._settled(level, a, b):
                continue
            if level:
                yield from self._across(level - 1, self._below(level, a), self._below(level, b), False)
            elif self._linked(a, b):
                old, new = self.component[a], self.component[b]
                self.component[self.component == old] = new
                yield int(self.order[a]), int(self.order[b])

    def _linked(self, a: int, b: int) -> bool:
        a, b = self.sets[a], self.sets[b]
        if len(a) > len(b):
            a, b = b, a
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)


_SETS = pa.schema([("digest", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.binary())])


def _hashes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


#: Characters of texts whose sets a task holds at a time.
SLICE_CHARS = 4_000_000

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``(digest, owner, n, doc_ids, hashes)``: each slice's distinct sets with the documents that have them.

    ``owner`` is half of the digest as a number; an empty set has no digest.
    """
    for batch in batches:
        for part in slices(batch, SLICE_CHARS):
            found: dict[bytes, list] = {}
            for doc_id, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist()):
                found.setdefault(grams(text, width).tobytes(), []).append(doc_id)
            digests = [xxhash.xxh3_128_digest(s) if s else None for s in found]
            owners = [int.from_bytes(d[:8], "big", signed=True) if d else None for d in digests]
            columns = digests, owners, [len(s) // 8 for s in found], list(found.values()), list(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SETS)], schema=_SETS)


class Sets:
    """The sets of a table's texts; each reading makes them anew, in the task that uses them, so that they are never stored whole."""

    def __init__(self, df: DataFrame, width: int, id_col: str, text_col: str):
        self.texts, self.width = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")), width

    def map(self, work: Work, schema: str) -> DataFrame:
        """``work`` on batches of ``(digest, owner, n, doc_ids, hashes)``."""
        width = self.width
        return self.texts.mapInArrow(lambda batches: work(_sets(batches, width)), schema)


def with_lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(digest, n, doc_ids, lowest)``: sets with the part of their hashes that is counted."""
    for batch in batches:
        lowest = [h[: 8 * max(int(PROBED * len(h) / 8), 1)] for h in column(batch, "hashes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("digest", "n", "doc_ids")), pa.array(lowest, pa.binary())], names=["digest", "n", "doc_ids", "lowest"])


def repeated_grams(lowest: DataFrame, n_grams: int) -> Bitmap:
    """A map of the n-grams that more than one of the sets ``(lowest binary)`` has; of those most sets have, where all would fill the map.

    Each batch sends an n-gram twice at most, in rows of one range of hashes; ``n_grams`` in all tell how many ranges.
    """
    ranges = max(6, int(n_grams / 500_000).bit_length())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(column(batch, "lowest").to_pylist()), np.uint64)
            if len(found):
                found = np.sort(found)
                found = found[np.concatenate([[True, True], found[2:] != found[:-2]])[: len(found)]]
                part = (found >> np.uint64(64 - ranges)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([x.tobytes() for x in np.split(found, first[1:])], pa.binary())], names=["part", "grams"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(blobs: list[bytes]) -> pa.RecordBatch:
            grams, n = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["gram", "n"])

        part, held = None, []
        for batch in batches:
            for p, blob in zip(column(batch, "part").to_pylist(), column(batch, "grams").to_pylist()):
                if p != part and held:
                    yield told(held)
                    held = []
                part = p
                held.append(blob)
        if held:
            yield told(held)

    rows = lowest.mapInArrow(dealt, "part bigint, grams binary").repartition("part").sortWithinPartitions("part")
    often = written(rows.mapInArrow(counted, "gram bigint, n bigint"))
    least, total = 2, 0
    for n, count in sorted(often.groupBy(F.least("n", F.lit(1_000)).alias("n")).agg(F.count("*").alias("count")).collect(), reverse=True):
        total += count
        if total > 1 << (REPEAT_BITS - 2):
            least = n + 1
            break
    found = Bitmap.of(often.where(F.col("n") >= least).select("gram"), lambda batch: column(batch, "gram").to_numpy(zero_copy_only=False).view(np.uint64), REPEAT_BITS)
    removed(often)
    return found


def size_class(n: int, percent: int) -> int:
    """Sets that link are in one class or in two that follow each other; the base is a trifle more than it need be, for rounding."""
    return int(math.log(n) / math.log(100.01 / percent))


def shared_prefixes(run: Callable[[Work, str], DataFrame], spark: SparkSession, repeated: Bitmap, percent: int, by_size: bool = False) -> DataFrame:
    """``(a, b)``: owners of sets that share an n-gram of their prefixes, each with an owner that was seen with it.

    ``run`` applies a function to batches with the columns ``owner`` and ``hashes``. With ``by_size`` sets meet only if their size
    classes are the same or follow each other. An n-gram leaves a batch with one owner, so one that a third of the sets
    have is shuffled once for each batch.
    """
    shared = spark.sparkContext.broadcast(repeated)

    def first_of(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((owner, gram))
        gram, owner = gram[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], owner[first], np.unique(np.stack([owner, np.repeat(owner[first], np.diff(np.append(first, len(gram))))]), axis=1)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owners = [], []
            for s, owner in zip(map(_hashes, column(batch, "hashes").to_pylist()), column(batch, "owner").to_pylist()):
                if len(s):
                    often = shared.value.holds(s)
                    prefix = np.concatenate([s[~often], s[often]])[: prefix_length(len(s), percent)]
                    if by_size:
                        own = size_class(len(s), percent)
                        prefix = np.concatenate([(prefix ^ np.uint64(c + 1)) * _MIX for c in (own, own + 1)])
                    parts.append(prefix)
                    owners.append(np.full(len(prefix), owner, np.int64))
            if parts:
                gram, owner, met = first_of(np.concatenate(parts).view(np.int64), np.concatenate(owners))
                a, b = met[:, met[0] != met[1]]
                # what met here travels under its own owner, with the other one beside it
                columns = np.concatenate([gram, a]), np.concatenate([owner, a]), np.concatenate([owner, b])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "a", "b"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, least = None, None
        for batch in batches:
            grams, a, b = (column(batch, n).to_numpy(zero_copy_only=False) for n in ("gram", "a", "b"))
            if not len(grams):
                continue
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            hub = a[first].copy()
            if grams[0] == gram:
                hub[0] = least
            gram, least = grams[-1], hub[-1]
            hubs = np.repeat(hub, np.diff(np.append(first, len(grams))))
            out = np.concatenate([np.stack([a, hubs]), np.stack([a, b])], axis=1)
            out = np.unique(out[:, out[0] != out[1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    rows = run(prefixes, "gram bigint, a bigint, b bigint")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(met, "a bigint, b bigint").distinct()


def tree_links(grouped: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: digests of sets that link, a spanning forest for each ``group`` of rows ``(group, digest, hashes, component)``."""

    def linked(digests: list[bytes], hashes: list[bytes], known: list[bytes | None]) -> pa.RecordBatch:
        distinct = {d: (h, c or d) for d, h, c in zip(digests, hashes, known)}
        names = list(distinct)
        _, component = np.unique(np.array([c for _, c in distinct.values()], "S16"), return_inverse=True)
        tree = SignatureTree([_hashes(h) for h, _ in distinct.values()], percent, component)
        pairs = [(names[i], names[j]) for i, j in tree.links()] if len(names) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [])
        for batch in batches:
            for g, *row in zip(*(column(batch, n).to_pylist() for n in ("group", "digest", "hashes", "component"))):
                if g != group:
                    if len(held[0]) > 1:
                        yield linked(*held)
                    group, held = g, ([], [], [])
                for values, value in zip(held, row):
                    values.append(value)
        if len(held[0]) > 1:
            yield linked(*held)

    rows = grouped.select("group", "digest", "hashes", "component").repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(run, "a binary, b binary")


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows ``(unit, n, digest, hashes)`` with their ``block``: by unit, then size, cut where a block is full, a unit or a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit, block, sets, total, last = None, TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            digests = [last, *column(batch, "digest").to_pylist()]
            batch, last = batch.filter(pa.array([x != y for x, y in zip(digests, digests[1:])])), digests[-1]  # a set of many batches is there once
            blocks = []
            for u, n in zip(column(batch, "unit").to_pylist(), column(batch, "n").to_pylist()):
                if u != unit or sets >= BLOCK_SETS or total + n > BLOCK_GRAMS:
                    unit, block, sets, total = u, block + 1, 0, 0
                sets, total = sets + 1, total + n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("unit", "n", "digest", "hashes").repartitionByRange(parts, "unit", "n", "digest").sortWithinPartitions("unit", "n", "digest")
    return rows.mapInArrow(run, "unit bigint, n bigint, digest binary, hashes binary, block bigint")


def roots_of(links: DataFrame) -> DataFrame:
    """``(node, root)`` of checkpointed links, in partitions of some fifty thousand."""
    found = components(links, max(1, links.count() // 50_000))
    freed(links.sparkSession)
    return found


def set_components(sets: Sets, lowest: DataFrame, n_grams: int, percent: int = 85) -> DataFrame:
    """``(digest, root)`` of sets that link with others, when their intersection is ``percent`` of their union or more.

    ``sets`` are made twice, so that none but those that share an n-gram of their prefixes are written whole. Among
    these all repeats are known, so that a second round with size classes leaves small units.
    """
    spark = lowest.sparkSession
    met = shared_prefixes(sets.map, spark, repeated_grams(lowest, n_grams), percent)
    met = checkpointed(met.select(F.explode(F.array("a", "b")).alias("owner")).distinct())
    shared = spark.sparkContext.broadcast(Bitmap.of(met, lambda batch: column(batch, "owner").to_numpy(zero_copy_only=False).view(np.uint64), UNIT_BITS))

    def that_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(column(batch, "owner").is_valid()).select(["digest", "owner", "n", "hashes"])
            yield batch.filter(pa.array(shared.value.holds(column(batch, "owner").to_numpy(zero_copy_only=False).view(np.uint64))))

    freed(spark)
    # a set that many slices have is kept once
    some = written(sets.map(that_met, "digest binary, owner bigint, n bigint, hashes binary").dropDuplicates(["digest"]))
    n_grams = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    repeated = repeated_grams(some.select(F.col("hashes").alias("lowest")), n_grams)
    met = shared_prefixes(some.select("owner", "hashes").mapInArrow, spark, repeated, percent, by_size=True)
    met = checkpointed(met)
    units = roots_of(met).select(F.col("node").alias("owner"), F.col("root").alias("unit"))
    members = written(in_blocks(some.join(units, "owner")))
    removed(some)
    blocks = members.groupBy("unit", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    by_block = Window.partitionBy("unit").orderBy("block")
    blocks = checkpointed(blocks.withColumns({"place": F.row_number().over(by_block), "before": F.lag("block").over(by_block), "after": F.lead("block").over(by_block)}))
    # a tree over each block and the next one; over the block alone where its unit has no other
    group = F.expr("filter(array(before, if(after is not null or before is null, block, null)), x -> x is not null)")
    rows = members.join(blocks.select("block", "before", "after"), "block").select(F.explode(group).alias("group"), "digest", "hashes", F.lit(None).cast("binary").alias("component"))
    links = checkpointed(tree_links(rows, percent))
    found = checkpointed(roots_of(links).select(F.col("node").alias("digest"), "root"))
    wide = blocks.where("place > 2").select("unit").distinct()
    if wide.isEmpty():
        return found
    # blocks that don't follow each other: what is outside of the unit's largest component meets all sets whose sizes fit
    there = members.select("unit", "block", "digest").join(wide, "unit", "left_semi").join(found, "digest", "left")
    there = checkpointed(there.withColumn("component", F.coalesce("root", "digest")).drop("root"))
    largest = there.groupBy("unit", "component").agg(F.count("*").alias("size")).groupBy("unit").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    freed(spark)
    there = checkpointed(there.join(largest, "unit").select("unit", "block", "digest", "component", (F.col("component") != F.col("largest")).alias("loose")))
    ends = blocks.join(there.groupBy("block").agg(F.bool_or("loose").alias("has_loose")), "block").select("unit", "block", "place", "low", "high", "has_loose")
    other = ends.select("unit", *[F.col(c).alias(f"other_{c}") for c in ends.columns[1:]])
    fits = (F.col("place") + 1 < F.col("other_place")) & (100 * F.col("high") >= percent * F.col("other_low")) & (F.col("has_loose") | F.col("other_has_loose"))
    pairs = checkpointed(ends.join(other, "unit").where(fits).withColumn("group", F.xxhash64("block", "other_block")))
    sides = pairs.select("group", "block", F.col("other_has_loose").alias("whole")).unionByName(pairs.select("group", F.col("other_block").alias("block"), F.col("has_loose").alias("whole")))
    asked = there.join(sides, "block").where("whole or loose").select("group", "digest", "component")
    more = checkpointed(tree_links(asked.join(members.select("digest", "hashes").dropDuplicates(["digest"]), "digest"), percent))
    freed(spark)
    return found if more.isEmpty() else roots_of(links.unionByName(more)).select(F.col("node").alias("digest"), "root")


def ngram_components(df: DataFrame, *, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``(doc_id, n_shingles, component_id)``.

    A document's set are its distinct ``width``-word sequences in lower case (A-Z), or all its words where they are fewer. Two
    documents link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest id reachable over links.
    Sequences are compared by 64-bit hashes. Null and empty texts, and those of white space only, have an empty set and
    are alone; repeated rows share a set; a null id names no component unless that has no other. An empty table gives an
    empty result; other columns are ignored. Whole texts are read, whatever their length.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    whole = Sets(df, width, id_col, text_col)
    sets = written(whole.map(with_lowest, "digest binary, n bigint, doc_ids array<bigint>, lowest binary"))
    n_grams = sets.agg(F.coalesce(F.sum(F.length("lowest")), F.lit(0)) / 8).first()[0]
    least = sets.where("n > 0").groupBy("digest").agg(F.min(F.array_min("doc_ids")).alias("least"))
    roots = set_components(whole, sets.where("n > 0").select("lowest"), n_grams, percent)
    placed = least.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = placed.join(names, "root").select("digest", "component_id")
    found = sets.select("digest", "n", "doc_ids").join(by_set, "digest", "left")
    return found.select(F.explode("doc_ids").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
