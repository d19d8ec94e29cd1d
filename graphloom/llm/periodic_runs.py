"""Periodic runs of words by partition refinement, and texts without their repetitions.

Positions of a text start in one class. At length L two positions are in one class if the L words from them are
equal. Going from L to L + 1, a class splits by the classes of its members' successors; all successors stood in one
class before, so it is enough to look at the parts that this class has fallen into, but for the largest one. Each
position is looked at only when its class has halved: n log n in all. Members of a class are linked in order of
position. Neighbours at a distance of exactly L show a square (L words, twice in succession) with a root that is
itself no repetition; squares at successive positions make up a run.

Texts of one slice are refined together, as arrays, a length at a time; no class holds positions of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_and_text

#: Characters of text refined at a time, unless one text alone has more.
SLICE_CHARS = 6_000_000
#: Lengths up to which neighbours at that distance are looked for among all positions; above, they wait by distance.
_SCANNED = 8


def _first(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins; ``values`` is not empty."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``sizes[k]`` numbers each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


class Partition:
    """Classes of equal factors over the positions of many texts, each text followed by a mark that equals nothing."""

    def __init__(self, codes: np.ndarray, begins: np.ndarray):
        """``codes``: equal where words are equal, all different between texts; ``begins``: true at each text's first position."""
        n = len(codes)
        self.begins = begins
        self.members = np.argsort(codes, kind="stable").astype(np.int32)  # class by class
        sorted_codes = codes[self.members]
        first = _first(sorted_codes)
        sizes = np.diff(np.append(first, n))
        self.count = len(first)
        self.start, self.size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.start[: self.count], self.size[: self.count] = first, sizes
        self.of, self.place = np.empty(n, np.int32), np.empty(n, np.int32)
        self.of[self.members] = np.repeat(np.arange(self.count, dtype=np.int32), sizes)
        self.place[self.members] = np.arange(n, dtype=np.int32)
        self.next, self.before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        same = sorted_codes[1:] == sorted_codes[:-1]
        a, b = self.members[:-1][same], self.members[1:][same]
        self.next[a], self.before[b] = b, a
        self.moving = np.zeros(n, bool)

    def refine(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Make factors one word longer.

        ``small``, in order, are the positions of the parts that are not the largest of a class that split the last
        time. Returns those of this time, in order, and the positions that have another next member now.
        """
        none = np.empty(0, np.int32)
        p = small[~self.begins[small]] - 1
        p = p[self.size[self.of[p]] > 1]
        if not len(p):
            return none, none
        # groups: members of one class whose successors are in one small part
        key = self.of[p].astype(np.int64) << 32 | self.of[p + 1]
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        group_first = _first(key)
        group_size = np.diff(np.append(group_first, len(p)))
        group_class = self.of[p[group_first]]
        class_first = _first(group_class)
        split = group_class[class_first]
        rest = self.size[split] - np.add.reduceat(group_size, class_first)
        largest = np.maximum.reduceat(group_size, class_first)
        number = np.repeat(np.arange(len(split)), np.diff(np.append(class_first, len(group_first))))
        at = np.flatnonzero(group_size == largest[number])
        largest_group = at[_first(number[at])]
        # the class keeps its name for what has no small successor, or else for its largest group; the other groups move
        moves = np.ones(len(group_first), bool)
        moves[largest_group[rest == 0]] = False
        moving = np.repeat(moves, group_size)
        moved = p[moving]
        if not len(moved):
            return none, none
        moved_class, sizes = np.repeat(group_class, group_size)[moving], group_size[moves]
        names = np.arange(self.count, self.count + len(sizes), dtype=np.int32)
        self.count += len(sizes)
        gone = np.bincount(number[moves], sizes, len(split)).astype(np.int64)
        # take the moved out of their lists, chain by chain, and link them in lists of their own
        out = moved[np.argsort(moved_class.astype(np.int64) << 32 | moved)]
        after, ahead = self.next[out], self.before[out]
        breaks = after[:-1] != out[1:]
        a, b = ahead[np.concatenate([[True], breaks])], after[np.concatenate([breaks, [True]])]
        self.next[a[a >= 0]], self.before[b[b >= 0]] = b[a >= 0], a[b >= 0]
        new = np.repeat(names, sizes)
        same = new[1:] == new[:-1]
        self.next[moved] = self.before[moved] = -1
        x, y = moved[:-1][same], moved[1:][same]
        self.next[x], self.before[y] = y, x
        changed = np.concatenate([a[(a >= 0) & (b >= 0)], x])
        # members of a class lie together: the moved change places with what lies at the end of their class
        tail = self.start[split] + self.size[split] - gone
        slots = _spans(tail, gone)
        self.moving[moved] = True
        swapped = slots[~self.moving[self.members[slots]]]
        outside = out[self.place[out] < np.repeat(tail, gone)]
        kept, holes = self.members[swapped], self.place[outside]
        self.members[holes], self.place[kept] = kept, holes
        self.members[slots], self.place[moved] = moved, slots
        self.moving[moved] = False
        self.of[moved] = new
        self.start[names], self.size[names] = slots[_first(new)], sizes
        self.size[split] -= gone.astype(np.int32)
        # all parts but the largest
        smaller = (rest > 0) & (rest < largest)
        spared = np.zeros(len(group_first), bool)
        spared[largest_group[smaller]] = True
        parts = [moved[~np.repeat(spared[moves], sizes)]]
        if smaller.any():
            stayed = split[smaller]
            parts.append(self.members[_spans(self.start[stayed], self.size[stayed])])
        return np.sort(np.concatenate(parts)), changed


def runs_in(codes: np.ndarray, begins: np.ndarray, longest: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(starts, lengths, period)`` of the runs of ``least`` words and ``times`` periods or more, by period.

    ``longest``: at each position, the longest period that its text has room for.
    """
    if not len(codes) or not longest.max():
        return
    part = Partition(codes, begins)
    small = np.arange(len(codes), dtype=np.int32)
    waiting: dict[int, list[np.ndarray]] = {}

    def wait(at: np.ndarray, length: int) -> None:
        gap = part.next[at] - at
        use = (gap >= length) & (gap <= longest[at])
        at, gap = at[use], gap[use]
        if len(at):
            order = np.argsort(gap, kind="stable")
            at, gap = at[order], gap[order]
            first = _first(gap)
            for distance, positions in zip(gap[first].tolist(), np.split(at, first[1:])):
                waiting.setdefault(distance, []).append(positions)

    every, last = np.arange(len(codes), dtype=np.int32), int(longest.max())
    for length in range(1, last + 1):
        if length < _SCANNED:
            squares = np.flatnonzero((part.next - every == length) & (longest >= length))
        else:
            if length == _SCANNED:
                wait(every[part.next >= 0], length)
            found = waiting.pop(length, None)
            squares = np.empty(0, np.int32)
            if found is not None:
                squares = np.unique(np.concatenate(found))
                squares = squares[part.next[squares] - squares == length]
        if len(squares):
            first = np.flatnonzero(np.concatenate([[True], np.diff(squares) != 1]))
            lengths = np.diff(np.append(first, len(squares))) - 1 + 2 * length
            use = lengths >= max(least, times * length)
            if use.any():
                yield squares[first[use]], lengths[use], length
        if length == last:
            break
        small, changed = part.refine(small[longest[small] > length])
        if not len(small):
            break
        if length + 1 > _SCANNED:
            wait(changed, length + 1)


def find_runs(texts: list[str | None], least: int = 24, times: int = 3) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Of each text its words and its runs ``(start, length, period)`` by start, then period."""
    words = [(t or "").encode("utf-8").split() for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    use = [k for k, w in enumerate(words) if len(w) >= max(least, times)]
    if use:
        sizes = np.array([len(words[k]) + 1 for k in use])
        offsets = np.cumsum(sizes) - sizes
        codes, names = np.empty(sizes.sum(), np.int64), 0
        for offset, k in zip(offsets.tolist(), use):
            seen: dict[bytes, int] = {}
            codes[offset : offset + len(words[k])] = [seen.setdefault(w, len(seen)) for w in words[k]]
            codes[offset : offset + len(words[k])] += names
            codes[offset + len(words[k])] = names + len(seen)
            names += len(seen) + 1
        begins = np.zeros(len(codes), bool)
        begins[offsets] = True
        longest = np.repeat((sizes - 1) // times, sizes).astype(np.int32)
        for starts, lengths, period in runs_in(codes, begins, longest, least, times):
            texts_of = np.searchsorted(offsets, starts, "right") - 1
            for k, start, length in zip(texts_of.tolist(), (starts - offsets[texts_of]).tolist(), lengths.tolist()):
                found[use[k]].append((start, length, period))
    return [(w, sorted(f, key=lambda r: (r[0], r[2]))) for w, f in zip(words, found)]


def without_repetitions(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by a space, less what lies in a run after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def slices(batch: pa.RecordBatch, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``chars`` characters of its column ``text``; a longer text is a part alone."""
    sizes = [len(t or "") for t in column(batch, "text").to_pylist()]
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > chars:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def periodic_runs(df: DataFrame, *, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed)``.

    A run is a stretch of words with smallest period q and ``max(least, times * q)`` words or more that no neighbouring
    word extends; ``collapsed`` is the text's words, joined by a space, without those that lie in a run after its first
    period. Words are runs without ASCII white space; numbers are of words, from 0. Null and empty texts have no
    words, no runs and an empty ``collapsed``. Repeated rows and null ids give a row each; an empty table gives an empty
    result; other columns are ignored. Whole texts are read, whatever their length; a task holds a slice of texts,
    or one text, at a time.
    """
    if times < 2 or least < 1:
        raise ValueError("a run needs two periods and a word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = find_runs(column(part, "text").to_pylist(), least, times)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id").cast(pa.int64()),
                        pa.array([len(w) for w, _ in found], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r in found], _RUNS),
                        pa.array([without_repetitions(w, r).decode("utf-8") for w, r in found], pa.string()),
                    ],
                    schema=_SCHEMA,
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Of each row of ``periodic_runs``: its number of runs, the run of most periods and digests of the runs and of the collapsed text.

    Of runs with equally many periods the first counts, then that of the smallest period; with no run its four columns are null.
    """
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` where about a tenth of the texts repeat a stretch of their words up to their end.

    With h the CRC-32 of the id in decimal and g = h div 10, texts of n words with h mod 10 = 0 have word a + (i - a) mod p
    in place of each word i from a on, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Null ids and texts without words stay.
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for k, doc_id in enumerate(column(batch, "doc_id").to_pylist()):
                h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
                words = (texts[k] or "").encode("utf-8").split() if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode("utf-8")
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    plain = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return plain.mapInArrow(run, "doc_id bigint, text string")
