"""Phrase collocations: sorted and counted n-grams of dictionary numbers, scored by their weakest cut.

1. Words are counted for each language; those counted often enough get numbers. A phrase holds no rarer word, so texts break there.
2. Pairs of numbers are packed into 8-byte keys. Slices of texts are radix-sorted and run-length counted; the counts are
   written as a table, dealt to ranges of keys, sorted and counted once more.
3. Longer phrases hold frequent pairs only, so texts break at other pairs too, and 3 to 5 numbers in keys of 20 bytes are
   counted likewise. Pairs are looked up in a bitmap of fixed size; a false hit costs a count and changes nothing.
4. Joins on parts of keys give each cut its counts, and those of longer phrases tell which phrases are mere parts.

The dictionary of numbers is broadcast up to a stated number of words; the words beyond it are numbered by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, checkpointed, column, numbered, removed, written
from .periodic_runs import slices

#: Words of the dictionary that are broadcast (some 100 bytes each); rarer ones are joined.
MAX_BROADCAST_WORDS = 300_000
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Bytes of numbers that are sorted at a time.
SLICE_BYTES = 8_000_000
#: Bits of the map of frequent pairs.
PAIR_BITS = 26

_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_SPACES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b" " * 10)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian bytes, two bytes a round from the last; ``keys`` is an array (rows, even width) of bytes."""
    digits = keys.view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for k in range(digits.shape[1] - 1, -1, -1):
        digit = digits[order, k]
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` in order and how often each is there, or the sum of its ``counts``."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts[order], first)


def packed(ids: np.ndarray) -> np.ndarray:
    """Rows of numbers as rows of bytes, four to a number, the highest first."""
    return np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(len(ids), -1)


def _binary(keys: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes as an Arrow column; numbers of zero at the end, which no word has, are left out."""
    used = (keys.reshape(len(keys), width // 4, 4).any(2).sum(1) * 4).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(used)]).astype(np.int32)
    data = keys[np.arange(width) < used[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _rows(found: pa.Array, width: int) -> np.ndarray:
    """The inverse of ``_binary``."""
    found = found.cast(pa.binary())
    offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    sizes = np.diff(offsets)
    keys = np.zeros((len(found), width), np.uint8)
    keys[np.arange(width) < sizes[:, None]] = np.frombuffer(found.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return keys


def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over ``(lang, text)``: how often each lower-cased word stands in the language's texts."""

    def emitted(held: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, counts in held.items() for w, n in counts.items()]
        langs, words, ns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
                held.setdefault(lang, Counter()).update(text.encode("utf-8").lower().translate(_SPACES).split())
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield emitted(held)
                    held = {}
        if any(held.values()):
            yield emitted(held)

    return texts.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbers_by_task(texts: DataFrame, dictionary: list[tuple[str, str, int]], keep_unknown: bool) -> DataFrame:
    """``(ids binary, unknown array<struct<at, word>>, lang, words)``: each text's words as 4-byte numbers, 0 between pieces and for words not known.

    With ``keep_unknown`` the words that are not in the dictionary are listed with their places.
    """
    known: dict[str, dict[bytes, int]] = {}
    for lang, word, number in dictionary:
        known.setdefault(lang, {})[word.encode("utf-8")] = number
    shared = texts.sparkSession.sparkContext.broadcast(known)
    listed = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                coded, unknown, total = [], [], []
                for lang, text in zip(column(part, "lang").to_pylist(), column(part, "text").to_pylist()):
                    number, ids, words, n = shared.value.get(lang, {}).get, [], [], 0
                    for piece in text.encode("utf-8").lower().translate(_BREAKS).split(b"\n"):
                        found = piece.split()
                        ids += [number(w, 0) for w in found]
                        ids.append(0)
                        n += len(found)
                        if keep_unknown:
                            words += [*found, b""]
                    total.append(n)
                    coded.append(np.array(ids, "<u4").tobytes())
                    unknown.append([{"at": k, "word": words[k].decode("utf-8")} for k in range(len(ids)) if not ids[k] and words[k]] if keep_unknown else [])
                yield pa.RecordBatch.from_arrays([pa.array(coded, pa.binary()), pa.array(unknown, listed), column(part, "lang"), pa.array(total, pa.int64())], names=["ids", "unknown", "lang", "words"])

    return texts.mapInArrow(run, "ids binary, unknown array<struct<at: int, word: string>>, lang string, words bigint")


def with_joined_numbers(coded: DataFrame, rest: DataFrame) -> DataFrame:
    """``(ids, lang, words)`` where words that the broadcast dictionary lacks have their numbers from ``rest(lang, word, number)``.

    Rows are written first, so that their numbers stay as they are when a task runs again.
    """
    rows = written(coded.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.select("row", "lang", F.explode("unknown").alias("u")).select("row", "lang", F.col("u.at").alias("at"), F.col("u.word").alias("word"))
    told = asked.join(rest, ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("at", "number")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, found in zip(column(batch, "ids").to_pylist(), column(batch, "found").to_pylist()):
                numbers = np.frombuffer(ids, "<u4").copy()
                for f in found or []:
                    numbers[f["at"]] = f["number"]
                out.append(numbers.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), column(batch, "lang"), column(batch, "words")], names=["ids", "lang", "words"])

    found = rows.select("row", "ids", "lang", "words").join(told, "row", "left").select("ids", "found", "lang", "words")
    return found.mapInArrow(run, "ids binary, lang string, words bigint")


def slice_counts(coded: DataFrame, lengths: range, width: int, pairs: Bitmap | None = None) -> DataFrame:
    """``(key binary, n)``: n-grams of ``lengths`` numbers with no 0 among them, counted a slice at a time.

    With ``pairs``, n-grams hold only pairs of that map.
    """
    shared = coded.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = column(batch, "ids").to_pylist()
            part = np.cumsum([len(c) for c in coded]) // SLICE_BYTES
            for at in np.split(np.arange(len(coded)), np.flatnonzero(np.diff(part)) + 1):
                ids = np.frombuffer(b"".join(coded[at[0] : at[-1] + 1]), "<u4") if len(at) else np.empty(0, "<u4")
                good = ids != 0
                if shared is not None:
                    two = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:]
                    linked = good[:-1] & good[1:] & shared.value.holds(two)
                else:
                    linked = good[:-1] & good[1:]
                rows, ok = [], linked
                for n in range(2, lengths.stop):
                    if n > 2:
                        ok = ok[:-1] & linked[n - 2 :]
                    if n in lengths:
                        first = np.flatnonzero(ok)
                        grams = np.zeros((len(first), width // 4), np.uint32)
                        for k in range(n):
                            grams[:, k] = ids[first + k]
                        rows.append(grams)
                grams = np.concatenate(rows)
                if len(grams):
                    keys, counts = run_lengths(packed(grams))
                    yield pa.RecordBatch.from_arrays([_binary(keys, width), pa.array(counts, pa.int64())], names=["key", "n"])

    return coded.select("ids").mapInArrow(run, "key binary, n bigint")


def total_counts(counts: DataFrame, width: int, least: int) -> DataFrame:
    """``(key, n)`` of keys counted ``least`` times or more in all: dealt to ranges of keys, sorted, and runs summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_n = np.zeros((0, width), np.uint8), np.empty(0, np.int64)

        def told(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            use = n >= least
            return pa.RecordBatch.from_arrays([_binary(keys[use], width), pa.array(n[use], pa.int64())], names=["key", "n"])

        for batch in batches:
            keys = np.concatenate([held_key, _rows(column(batch, "key"), width)])
            n = np.concatenate([held_n, column(batch, "n").to_numpy(zero_copy_only=False)])
            keys, n = run_lengths(keys, n)
            if len(keys):
                yield told(keys[:-1], n[:-1])  # the last key may go on in the next batch
                held_key, held_n = keys[-1:], n[-1:]
        if len(held_key):
            yield told(held_key, held_n)

    table = written(counts, "zstd")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(table.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key binary, n bigint"))
    removed(table)
    return found


def phrase_counts(df: DataFrame, *, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", max_broadcast_words: int = MAX_BROADCAST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lang, total)``, ``(number, lang, word, n)`` and ``(key, n)``: words of each language, frequent words, frequent phrases of 2 words or more.

    ``key`` holds a phrase's word numbers, four bytes each.
    """
    plain, (lang, text) = numbered(df, lang_col, text_col)
    texts = plain.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    often = checkpointed(word_counts(texts).where(F.col("n") >= least))
    # the most frequent are broadcast, up to the bound, and numbered here; the others get numbers by ranges of words
    top = often.orderBy(F.col("n").desc(), "lang", "word").limit(max_broadcast_words).select("lang", "word").toPandas()
    listed = [(lang, word, k + 1) for k, (lang, word) in enumerate(zip(top["lang"], top["word"]))]
    langs, heads, ranks = zip(*listed) if listed else ((), (), ())
    known = df.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "word": pa.array(heads, pa.string()), "number": pa.array(ranks, pa.int64())}))
    more = often.count() - len(listed)
    if more:
        rest = often.join(known, ["lang", "word"], "left_anti").repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
        rest = written(rest.withColumn("part", F.spark_partition_id()).withColumn("turn", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
        sizes = rest.groupBy("part").agg(F.max("turn").alias("last"))
        before = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a task
        rest = rest.join(F.broadcast(sizes.withColumn("before", before)), "part").select("lang", "word", (F.col("before") + F.col("turn") + 1 + len(listed)).alias("number"))
        if len(listed) + more >= 1 << 32:
            raise ValueError("more frequent words than four bytes can number")
        ids = written(with_joined_numbers(numbers_by_task(texts, listed, True), rest), "zstd")
        known = known.unionByName(rest)
    else:
        ids = written(numbers_by_task(texts, listed, False).select("ids", "lang", "words"), "zstd")
    totals = checkpointed(ids.groupBy("lang").agg(F.sum("words").alias("total")).where("total > 0"))
    vocabulary = checkpointed(often.join(known, ["lang", "word"]).select("number", "lang", "word", "n"))
    pairs = total_counts(slice_counts(ids, range(2, 3), 8), 8, least)
    if longest == 2:
        return totals, vocabulary, pairs
    found = Bitmap.of(pairs.select("key"), lambda batch: _rows(column(batch, "key"), 8).view(">u8")[:, 0].astype(np.uint64), PAIR_BITS)
    width = 4 * longest
    longer = total_counts(slice_counts(ids, range(3, longest + 1), width, found), width, least)
    removed(ids)
    return totals, vocabulary, pairs.unionByName(longer)


def collocations(df: DataFrame, *, least: int = 100, longest: int = 5, k: int = 2_000, lang_col: str = "lang", text_col: str = "text", max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """The first ``k`` phrases of each language by score: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at spaces and tabs. A
    phrase of 2 to ``longest`` words counted a times in pieces, ``least`` or more, is cut after each of its words; l and r
    count the two parts, n all words of the language, and the score is the least floor(1000 a n / (l r)), that of the
    first cut among equals. Phrases that stand within a longer one counted as often are left out. Order: score and a
    from high to low, then the phrase by its bytes. Products are decimals of 38 digits, so nothing overflows or is rounded.

    A null language counts as ``und``, a null or empty text has no words, repeated rows count as often as they are there, and an
    empty table gives an empty result. Other columns are ignored.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    totals, vocabulary, phrases = phrase_counts(df, least=least, longest=longest, lang_col=lang_col, text_col=text_col, max_broadcast_words=max_broadcast_words)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    number = F.unhex(F.lpad(F.hex("number"), 8, "0"))
    parts = phrases.unionByName(vocabulary.select(number.alias("key"), "n"))
    size, words_of = F.length("key"), (F.length("key") / 4).cast("int")
    # phrases within a longer one that is counted as often
    start, words = F.col("start"), F.col("words")
    inner = phrases.where(size > 8).select("key", "n", F.explode(F.sequence(F.lit(2), words_of - 1)).alias("words"))
    inner = inner.select("key", "n", "words", F.explode(F.sequence(F.lit(0), words_of - words)).alias("start"))
    inner = inner.groupBy(F.substring("key", start * 4 + 1, words * 4).alias("key")).agg(F.max("n").alias("longer"))
    kept = phrases.join(inner, "key", "left").where("longer is null or longer < n").select("key", F.col("n").alias("a"))
    lang_of = vocabulary.select(number.alias("head"), "lang")
    kept = kept.join(lang_of, F.substring("key", 1, 4) == F.col("head")).join(F.broadcast(totals), "lang")  # a row a language
    cuts = kept.select("lang", "key", "a", "total", F.explode(F.sequence(F.lit(1), words_of - 1)).alias("cut"))
    left, right = F.substring("key", F.lit(1), F.col("cut") * 4), F.substring("key", F.col("cut") * 4 + 1, size)
    sides = cuts.withColumns({"left": left, "right": right}).join(parts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    top = (big("a") * big("total")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    scored = sides.withColumns({"top": top.cast("decimal(38,0)"), "below": (big("l") * big("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("top div below"))
    least_cut = scored.groupBy("lang", "key", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # phrases in words
    spelled = least_cut.select("key", F.explode(F.sequence(F.lit(0), words_of - 1)).alias("place"))
    spelled = spelled.withColumn("head", F.substring("key", F.col("place") * 4 + 1, F.lit(4))).join(vocabulary.select(number.alias("head"), "word"), "head")
    spelled = spelled.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    found = least_cut.join(spelled, "key").select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("total").alias("n"), F.col("m.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))  # Spark keeps k rows of a task before it shuffles
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
