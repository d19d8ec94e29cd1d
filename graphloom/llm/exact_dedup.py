"""Exact duplicates by Patricia tries over length-and-content-hash partitions.

A task first puts the texts it reads into tries of its own, so that of many local copies only one representative
with its counts is shuffled; where they outgrow memory, the largest subtrees are emitted and begun anew. Each row
is told its terminal node. Representatives then meet by (length, content hash) and are read in that order, so
the subtree of one (length, hash) prefix is complete as soon as the next prefix begins: it is emitted and dropped.
Spark's sort keeps the rest on disk, so a task never holds more than one subtree. A terminal of the merged tries holds
the owner and the numbers of the tasks' terminals that meet there, by which the rows find their owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, column, id_and_text, numbered, texts, written

#: Bytes of keys, and of rows read, that a task's own tries stand for before they are emitted and emptied.
LOCAL_BYTES, LOCAL_ROW_BYTES = 64_000_000, 256_000_000
#: What a row of a subtree counts for beside its string.
ROW_BYTES = 200
#: Tries of a task, by length and content hash.
LOCAL_TRIES = 1024


class PatriciaTrie:
    """Compressed radix tree over byte strings; a terminal holds a value that equal strings share."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        # a node is [label, children by first byte or None, terminal or None]
        self.root: list = [b"", None, None]

    def terminal(self, key: bytes) -> list:
        """The node of ``key``, made if new; its last entry is free for the caller."""
        node, at = self.root, 0
        while at < len(key):
            if node[1] is None:
                node[1] = {}
            child = node[1].get(key[at])
            if child is None:
                leaf = [key[at:], None, None]
                node[1][key[at]] = leaf
                return leaf
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same
        return node

    def terminals(self) -> Iterator[list]:
        """All values, in no set order; without recursion, as tries of long strings may be deep."""
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node[2] is not None:
                yield node[2]
            if node[1]:
                waiting += node[1].values()


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 without ASCII white space; null is empty."""
    return (text or "").encode("utf-8").translate(None, ASCII_SPACE)


def _better(points: int, doc_id: int | None, than: list) -> bool:
    """More code points first, then the smallest id; a null id comes last."""
    if points != than[0]:
        return points > than[0]
    return doc_id is not None and (than[1] is None or doc_id < than[1])


def _add(trie: PatriciaTrie, key: bytes, points: int, doc_id: int | None, size: int, row: object) -> bool:
    """Put one row in; true if the string is new. A value is [points, id, group size, row that stays, key length]."""
    node = trie.terminal(key)
    if node[2] is None:
        node[2] = [points, doc_id, size, row, len(key)]
        return True
    node[2][2] += size
    if _better(points, doc_id, node[2]):
        node[2][:2], node[2][3] = (points, doc_id), row
    return False


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df``, whole, for each distinct normalised text, with ``_group_size``, ``_length`` and ``_hash``.

    Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row
    with the most code points stays, then the smallest id (null ids last), then any of fully repeated rows. An
    empty table gives an empty result. Columns of any name pass through, except for the three names above.
    """
    schema = df.schema
    extended = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["_group_size bigint", "_length bigint", "_hash bigint"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, PatriciaTrie] = {}
        held, used, read, rows = [], 0, 0, 0
        for batch in batches:
            points = pc.utf8_length(column(batch, text_col)).to_pylist()
            for i, (text, doc_id) in enumerate(zip(texts(batch, text_col), column(batch, id_col).to_pylist())):
                key = normalised(text)
                trie = tries.setdefault((len(key) * 31 ^ xxhash.xxh64_intdigest(key)) % LOCAL_TRIES, PatriciaTrie())
                if _add(trie, key, points[i] or 0, doc_id, 1, rows + i):
                    used += len(key)
            held.append(batch)
            rows += batch.num_rows
            read += batch.nbytes
            if used > LOCAL_BYTES or read > LOCAL_ROW_BYTES:
                yield from emit(tries, held)
                tries, held, used, read, rows = {}, [], 0, 0, 0
        if held:
            yield from emit(tries, held)

    def emit(tries: dict[int, PatriciaTrie], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sorted((v for trie in tries.values() for v in trie.terminals()), key=lambda v: v[3])
        start, at = 0, 0
        for batch in held:
            mine = []
            while at < len(values) and values[at][3] < start + batch.num_rows:
                mine.append(values[at])
                at += 1
            if mine:
                kept = batch.take(pa.array([v[3] - start for v in mine], pa.int64()))
                hashes = [xxhash.xxh64_intdigest(normalised(t)) - (1 << 63) for t in texts(kept, text_col)]
                yield _with(kept, [v[2] for v in mine], [v[4] for v in mine], hashes)
            start += batch.num_rows

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prefix = PatriciaTrie(), None
        for batch in batches:
            done: list[list] = []
            text_list, ids = texts(batch, text_col), column(batch, id_col).to_pylist()
            points = pc.utf8_length(column(batch, text_col)).to_pylist()
            sizes, lengths, hashes = (column(batch, n).to_pylist() for n in ("_group_size", "_length", "_hash"))
            for i in range(batch.num_rows):
                if (lengths[i], hashes[i]) != prefix:
                    done += trie.terminals()
                    trie, prefix = PatriciaTrie(), (lengths[i], hashes[i])
                _add(trie, normalised(text_list[i]), points[i] or 0, ids[i], sizes[i], (batch, i))
            yield from _stay(done)
            for value in trie.terminals():  # what is still open must not keep the whole batch alive
                kept, i = value[3]
                value[3] = (kept.take(pa.array([i], pa.int64())), 0)
        yield from _stay(trie.terminals())

    def _stay(values: Iterable[list]) -> Iterator[pa.RecordBatch]:
        by_batch: dict[int, tuple[pa.RecordBatch, list, list]] = {}
        for _, _, size, (batch, i), _ in values:
            entry = by_batch.setdefault(id(batch), (batch, [], []))
            entry[1].append(i)
            entry[2].append(size)
        for batch, at, sizes in by_batch.values():
            kept = batch.take(pa.array(at, pa.int64()))
            yield _with(kept.select(schema.names), sizes, column(kept, "_length"), column(kept, "_hash"))

    def _with(batch: pa.RecordBatch, sizes: list, lengths, hashes) -> pa.RecordBatch:
        added = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in (sizes, lengths, hashes)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*schema.names, "_group_size", "_length", "_hash"])

    one_of_each = df.mapInArrow(local, extended)
    met = one_of_each.repartition("_length", "_hash").sortWithinPartitions("_length", "_hash")
    return met.mapInArrow(merge, extended)


class _Subtree:
    """A trie of one task with the rows it has read: (id, value of the terminal, code points)."""

    __slots__ = ("trie", "rows", "held")

    def __init__(self) -> None:
        self.trie, self.rows, self.held = PatriciaTrie(), [], 0

    def add(self, key: bytes, points: int, doc_id: int | None, number: Iterator[int]) -> int:
        """Put a row in; the bytes held more. A value is [points, id, rows, row that stays, key, number of the terminal, digest]."""
        node, more = self.trie.terminal(key), ROW_BYTES
        if node[2] is None:
            node[2] = [points, doc_id, 0, len(self.rows), key, next(number), hashlib.sha256(key).hexdigest()]
            more += 2 * len(key)
        elif _better(points, doc_id, node[2]):
            node[2][:2], node[2][3] = (points, doc_id), len(self.rows)
        node[2][2] += 1
        self.rows.append((doc_id, node[2], points))
        self.held += more
        return more

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row for each row read; that which stays of a terminal carries its string."""
        for at in range(0, len(self.rows), 10_000):
            rows = self.rows[at : at + 10_000]
            stays = [value[3] == at + i for i, (_, value, _) in enumerate(rows)]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([v[5] for _, v, _ in rows], pa.int64()), pa.array([v[6] for _, v, _ in rows]), pa.array(stays),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([v[2] for _, v, _ in rows], pa.int64()),
                pa.array([v[4] if s else None for (_, v, _), s in zip(rows, stays)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "terminal", "text_sha256", "stays", "points", "size", "key"])


def _local_terminals(rows: DataFrame) -> DataFrame:
    """Each row with its terminal in the tries of its task; terminals are numbered within the partition's range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, subtrees, held = count(TaskContext.get().partitionId() << 40), {}, 0
        for batch in batches:
            points = pc.utf8_length(column(batch, "text")).to_pylist()
            for n, text, doc_id in zip(points, texts(batch), column(batch, "doc_id").to_pylist()):
                key = normalised(text)
                at = (len(key) * 31 ^ xxhash.xxh64_intdigest(key)) % LOCAL_TRIES
                held += subtrees.setdefault(at, _Subtree()).add(key, n or 0, doc_id, number)
                if held > LOCAL_BYTES:
                    # the largest subtrees make room; equal strings that come later meet theirs in the merge
                    for large in sorted(subtrees, key=lambda k: -subtrees[k].held):
                        if held <= LOCAL_BYTES // 2:
                            break
                        gone = subtrees.pop(large)
                        held -= gone.held
                        yield from gone.batches()
        while subtrees:
            yield from subtrees.popitem()[1].batches()

    return rows.mapInArrow(work, "doc_id bigint, terminal bigint, text_sha256 string, stays boolean, points bigint, size bigint, key binary")


def _owners(terminals: DataFrame) -> DataFrame:
    """``(terminal, keep_id, owner, group_size)`` for each terminal of a task, from the merged tries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prefix = PatriciaTrie(), None
        for batch in batches:
            done: list[list] = []
            rows = zip(*[column(batch, n).to_pylist() for n in ("hash", "key", "points", "doc_id", "size", "terminal")])
            for content, key, points, doc_id, size, terminal in rows:
                if (len(key), content) != prefix:
                    done += trie.terminals()
                    trie, prefix = PatriciaTrie(), (len(key), content)
                node = trie.terminal(key)
                if node[2] is None:
                    node[2] = [points, doc_id, 0, terminal, []]
                elif _better(points, doc_id, node[2]):
                    node[2][:2], node[2][3] = (points, doc_id), terminal
                node[2][2] += size
                node[2][4].append(terminal)
            yield told(done)
        yield told(list(trie.terminals()))

    def told(values: list[list]) -> pa.RecordBatch:
        each = [(terminal, v[1], v[3], v[2]) for v in values for terminal in v[4]]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in each], pa.int64()) for i in range(4)], names=["terminal", "keep_id", "owner", "group_size"])

    met = terminals.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return met.mapInArrow(work, "terminal bigint, keep_id bigint, owner bigint, group_size bigint")


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id (null ids last), then any one of fully repeated rows: one row of
    each group is kept. An empty table gives an empty result; other columns are ignored.
    """
    placed = written(_local_terminals(id_and_text(df, id_col, text_col)))
    found = placed.where("stays").select("terminal", "key", "points", "doc_id", "size", F.length("key").alias("length"), F.xxhash64("key").alias("hash"))
    # terminals are as many as a task's distinct strings, so no number is shared by more rows than a task has read
    return placed.select("doc_id", "terminal", "text_sha256", "stays").join(_owners(found), "terminal").select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("terminal") == F.col("owner"))).alias("kept"), "text_sha256"
    )


def keep_one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns; one text shuffle and no join.

    One row of each group stays, as ``exact_duplicates`` keeps it: null and empty texts are one group, of fully repeated
    rows one stays. An empty table gives an empty result; columns of any name pass through.
    """
    plain, (doc_id, text) = numbered(df, id_col, text_col)
    return distinct_texts(plain, doc_id, text).select(plain.columns).toDF(*df.columns)
