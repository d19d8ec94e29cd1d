"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments. Two fingerprints at a distance of at most 3 differ by at most 1 bit in one
of them, so each fingerprint stands in two tables, by its segments, and looks up the Hamming ball of radius 1
around each segment. Of a pair that differs by one bit in a segment, one fingerprint has that bit set; it is enough
that this one looks for the other, so only set bits are cleared. Matches are verified by the complete distance.

Where many fingerprints share a segment, their entry is an index of its own: its rows are dealt, before the shuffle,
to the halves of the other segment and the balls of radius 1 around them, as at most 3 bits in two halves leave one half
with at most 1. Only fingerprints that share 48 bits, or nearly, then meet in a task, 65,536 of an exact value at most.

Only distinct fingerprints take part, and a table entry gives a spanning forest of its verified links in place of
all pairs: no component loses a link, and what is emitted grows with the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, freed, id_and_text, map_batches, numbered, texts

#: Shingles hashed at a time; members from which a table entry is dealt to the other segment's halves.
HASH_BLOCK, LARGE_ENTRY = 65_536, 512
#: Comparisons of an entry up to which entries are compared together, and from which values near by are looked up instead.
FEW_COMPARED, MAX_COMPARED = 1 << 12, 1 << 22
#: Comparisons made at a time, some 50 bytes each; links from which a round of stars has another partition.
BLOCK_COMPARED, ROUND_LINKS = 1 << 18, 50_000
#: All differences of at most 3 bits in 16.
_NEAR_16 = np.array(sorted({sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(16), n)}), np.uint64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of ``width``-word shingles with repeats; fewer words make one shingle, none give 0.

    A-Z are lower-cased, words are runs without ASCII white space, and a bit is set if it is set in over half of
    the shingles' XXH64.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for start in range(0, n, HASH_BLOCK):
        part = words[start : start + HASH_BLOCK + width - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(width)]))
        hashes = b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed)))
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint bigint)`` of each whole text; the 64 bits are those of the signed number."""

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, width, seed) for t in texts(batch)], np.uint64)
        return {"doc_id": column(batch, "doc_id"), "fingerprint": pa.array(found.view(np.int64))}

    return map_batches(id_and_text(df, id_col, text_col), "doc_id bigint, fingerprint bigint", work)


class Forest:
    """Trees over numbers; ``join`` tells whether two were apart."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def entry_links(members: np.ndarray, seekers: np.ndarray, distance: int, shift: int | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within ``members`` and between ``seekers`` and ``members``.

    Blocks of members are compared with all. Where that is many pairs and ``shift`` tells the 16 bits that the entry
    has not in common, each fingerprint looks up the members whose 16 bits differ by at most 3.
    """
    seekers = np.setdiff1d(seekers, members)
    all_of, forest = np.concatenate([members, seekers]), Forest()

    def joined(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        for i, j in zip(x.tolist(), y.tolist()):
            if forest.join(i, j):
                yield int(all_of[i]), int(all_of[j])

    if shift is None or len(members) * len(all_of) <= MAX_COMPARED:
        step = max(1, BLOCK_COMPARED // len(all_of))
        for at in range(0, len(members), step):
            x, y = np.nonzero(np.bitwise_count(members[at : at + step, None] ^ all_of) <= distance)
            apart = x + at < y
            yield from joined(x[apart] + at, y[apart])
        return
    low = (all_of >> np.uint64(shift)) & np.uint64(0xFFFF)
    order = np.argsort(low[: len(members)], kind="stable")
    sorted_low = low[order]
    for mask in _NEAR_16:
        first, last = np.searchsorted(sorted_low, low ^ mask, "left"), np.searchsorted(sorted_low, low ^ mask, "right")
        n = last - first
        x = np.repeat(np.arange(len(all_of)), n)
        y = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        near = (x > y) & (np.bitwise_count(all_of[x] ^ all_of[y]) <= distance)
        yield from joined(x[near], y[near])


def _ball(value: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Values with the rows they come from: each as it is, then each with one set bit cleared (true)."""
    yield value, np.arange(len(value)), False
    for bit in range(bits):
        has = np.flatnonzero(value >> np.uint64(bit) & np.uint64(1))
        yield value[has] ^ np.uint64(1 << bit), has, True


#: Bits of a table key: the segment's value, which segment, and of a dealt entry the half's value, which half, and a flag.
_HALF, _WHICH_HALF, _DEALT = 33, 49, 50


def near_links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """``(a, b)``: a spanning forest, per table entry, of the links between distinct fingerprints (column ``fingerprint``).

    ``distance`` is 3 at most: two segments and balls of radius 1 find no more.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be from 0 to 3")

    def rows_of(keys: list[np.ndarray], seek: list[np.ndarray], who: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(keys).astype(np.int64), np.concatenate(seek), np.concatenate(who).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "seeks", "fingerprint"])

    def table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                prints = column(batch.slice(at, 20_000), "fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
                keys, seek, who = [], [], []
                for segment in range(2):
                    value = (prints >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
                    for values, rows, cleared in _ball(value, 32):
                        keys.append(values | np.uint64(segment << 32))
                        seek.append(np.full(len(values), cleared))
                        who.append(prints[rows])
                yield rows_of(keys, seek, who)

    def dealt_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # members and seekers of a large entry alike meet by the halves of the segment they don't share
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                prints, entry = (column(part, n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("fingerprint", "key"))
                other = (prints >> np.where(entry >> np.uint64(32), np.uint64(0), np.uint64(32))) & np.uint64(0xFFFFFFFF)
                keys, seek, who = [], [], []
                for half in range(2):
                    for values, rows, cleared in _ball((other >> np.uint64(16 * half)) & np.uint64(0xFFFF), 16):
                        keys.append(entry[rows] | values << np.uint64(_HALF) | np.uint64(half << _WHICH_HALF | 1 << _DEALT))
                        seek.append(np.full(len(values), cleared))
                        who.append(prints[rows])
                yield rows_of(keys, seek, who)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by key, members before seekers; the last entry of a batch may go on in the next
        held: list[list[np.ndarray]] = []
        for batch in batches:
            now = [column(batch, n).to_numpy(zero_copy_only=False) for n in ("key", "seeks", "fingerprint")]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last or held and held[-1][0][-1] != now[0][0]:
                yield from linked([np.concatenate(c) for c in zip(*held, [x[:last] for x in now])])
                held = []
            held.append([x[last:] for x in now])
        if held:
            yield from linked([np.concatenate(c) for c in zip(*held)])

    def linked(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, seeks, who = rows[0], rows[1], rows[2].view(np.uint64)
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size, members = np.diff(np.r_[first, len(key)]), np.add.reduceat(~seeks, first)
        few = (members > 0) & (size > 1) & (members * size <= FEW_COMPARED)
        a, b, forest = [], [], Forest()
        # every member of a small entry with the rows after it, in blocks
        at = np.flatnonzero(np.repeat(few, size) & ~seeks)
        after = (np.repeat(first + size, size)[at] - at - 1) if len(at) else at
        ends = np.cumsum(after)
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, BLOCK_COMPARED), "left").tolist()
        for low, high in zip(cuts, [*cuts[1:], len(at)]):
            n = after[low:high]
            x = np.repeat(at[low:high], n)
            y = x + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = np.flatnonzero(np.bitwise_count(who[x] ^ who[y]) <= distance)
            for u, v in zip(who[x[near]].tolist(), who[y[near]].tolist()):
                if forest.join(u, v):
                    a.append(min(u, v))
                    b.append(max(u, v))
        use = np.flatnonzero((members > 0) & (size > 1) & ~few)
        for start, n, cut, k in zip(first[use].tolist(), size[use].tolist(), (first + members)[use].tolist(), key[first[use]].tolist()):
            # a dealt entry shares one half of the other segment; the other half's 16 bits are free
            shift = 16 * (1 - (k >> _WHICH_HALF & 1)) + 32 * (1 - (k >> 32 & 1)) if k >> _DEALT else None
            for u, v in entry_links(np.unique(who[start:cut]), who[cut : start + n], distance, shift):
                a.append(min(u, v))
                b.append(max(u, v))
        if a:
            pairs = np.array([a, b], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    prints = F.col("fingerprint")
    low, high = prints.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(prints, 32).bitwiseOR(1 << 32)
    # members of each entry, counted before anything is dealt; a large entry's seekers go to entries with one bit less
    sizes = distinct.select(F.explode(F.array(low, high)).alias("key")).groupBy("key").agg(F.count("*").alias("members"))
    large = checkpointed(sizes.where(F.col("members") >= LARGE_ENTRY))
    rows = distinct.select("fingerprint").mapInArrow(table_rows, "key bigint, seeks boolean, fingerprint bigint")
    if not large.isEmpty():
        bit = F.explode(F.array(*[F.lit(1 << i).cast("bigint") for i in range(32)]))
        below = large.select("key", bit.alias("bit")).where(F.col("key").bitwiseAND(F.col("bit")) != 0).select(F.col("key").bitwiseXOR(F.col("bit")).alias("key"))
        asked = large.select("key").union(below).distinct().join(sizes, "key", "left").select("key", F.col("members").isNotNull().alias("has_members"))
        told = rows.join(checkpointed(asked), "key", "left")
        dealt = told.where("has_members").select("key", "fingerprint").mapInArrow(dealt_rows, "key bigint, seeks boolean, fingerprint bigint")
        rows = told.where("has_members is null").select("key", "seeks", "fingerprint").unionByName(dealt)
    met = rows.repartition("key").sortWithinPartitions("key", "seeks")
    return met.mapInArrow(entries, "a bigint, b bigint").distinct()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``: the smallest node reachable; alternating large and small stars.

    The links shrink to stars around the roots. Each round is checkpointed, so a lost executor costs one round. With
    ``parts``, rounds keep the links in so many partitions at most, which saves files where the links are few.
    """

    def kept(df: DataFrame) -> DataFrame:
        return df if parts is None else df.coalesce(parts)

    edges = checkpointed(kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    before = None
    while True:
        # large star: the larger neighbours of a node point to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours of a node and the node itself point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(kept(small.select("e.*").where("u <> v").distinct()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, *, distance: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``(doc_id, fingerprint bigint, component_id)``.

    ``component_id`` is the smallest id reachable over links of at most ``distance`` bits. Null and empty texts have
    fingerprint 0 and link like any other; repeated rows share a fingerprint; null ids never name a component
    unless it has no other. An empty table gives an empty result; other columns are ignored.
    """
    prints = checkpointed(fingerprints(df, width=width, seed=seed, id_col=id_col, text_col=text_col))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    links = checkpointed(near_links(distinct, distance))
    roots = components(links, max(1, links.count() // ROUND_LINKS)).withColumnRenamed("node", "fingerprint")
    freed(df.sparkSession)
    placed = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(names, "root").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one_of_each_group(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id names their near-duplicate component, with its columns.

    Null and empty texts are near each other, so one such row stays. Rows that repeat the id that stays all stay, as
    nothing but the id tells them apart; a null id stays only where its component has no other. An empty table gives an
    empty result.
    """
    found = near_duplicates(df, id_col=id_col, text_col=text_col)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    plain, (doc_id,) = numbered(df, id_col)
    return plain.join(stay, F.col(doc_id).eqNullSafe(F.col("stays")), "left_semi").toDF(*df.columns)
