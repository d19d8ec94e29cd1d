"""Quality by distribution divergence.

Character-class and common-word histograms of a text are compared with those of each language by Jensen-Shannon
distance. The references are sums over all texts of a language that pass the base rules and are near a first such sum. A text is kept if, in both
histograms, it is near at least one language; a text too short for a histogram passes that test.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, texts

#: Common words of the languages, by which all texts are described.
COMMON_WORDS = {
    "en": "the of and to in a is was that for it on with as are by be at this from or an have not he his they which you we but were her she all their has been if more when will would who so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux cette mais comme nous on sa fait été aussi leur bien peut ces y".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
_PLACE = {w.encode("utf-8"): i for i, w in enumerate(WORDS)}
#: lower, upper, other letters, marks, space, sentence marks, symbols, the rest; digits depend on the subject and don't count
CLASSES = 8
_SENTENCE = set(".,;:'\"!?()-’“”«»¿¡–—…")
_SYMBOLS = "#*$%&|<>"
#: Sentence marks and symbols that end up at the edges of words.
_EDGES = b".,;:'\"!?()-"

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Least characters and words for a histogram to be judged, and the largest distances that are kept.
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 250, 40, 0.15, 0.45


@lru_cache(maxsize=None)
def _class_of() -> np.ndarray:
    kinds = np.full(0x110000, 7, np.uint8)
    for point in range(0x20000):
        char = chr(point)
        kind = unicodedata.category(char)
        if char in _SYMBOLS:
            kinds[point] = 6
        elif char.isspace():
            kinds[point] = 4
        elif char in _SENTENCE:
            kinds[point] = 5
        elif kind in ("Ll", "Lu"):
            kinds[point] = 0 if kind == "Ll" else 1
        elif kind[0] in "LMN":
            kinds[point] = {"L": 2, "M": 3, "N": CLASSES}[kind[0]]
    kinds[0x20000:0x40000] = 2
    return kinds


def class_histogram(text: str) -> np.ndarray:
    return np.bincount(_class_of()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=CLASSES + 1)[:CLASSES]


def word_histogram(words: list[bytes]) -> np.ndarray:
    """Counts of the common words, lower-cased and without sentence marks at their edges; last, all other words."""
    found = np.zeros(len(WORDS) + 1, np.int64)
    for word in words:
        place = _PLACE.get(word)
        found[-1 if place is None else place] += 1
    return found


def base_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in _SYMBOLS)
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*[words[i:] for i in range(WINDOW)]))
        first: dict[tuple, int] = {}
        covered = np.zeros(n + 1, np.int64) if len(set(windows)) < len(windows) else None
        if covered is not None:
            for i, window in enumerate(windows):
                at = first.setdefault(window, i)
                if at != i:
                    for start in (at, i):
                        covered[start] += 1
                        covered[start + WINDOW if start + WINDOW <= n else n] -= 1
            repeated = int((np.cumsum(covered)[:n] > 0).sum())
    return words, (n, chars, symbols, again, repeated)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance from 0 to 1 between rows of ``p`` and the distribution ``q``; rows without counts are at 1."""
    total = p.sum(1, keepdims=True)
    p = p / np.where(total > 0, total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((left + right) / 2, 0)), 1.0)


def describe(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and packed histograms of each whole text; packed counts stop at 2**32 - 1."""

    def pack(counts: np.ndarray) -> bytes:
        used = np.flatnonzero(counts)
        return np.stack([used, np.minimum(counts[used], 2**32 - 1)]).astype("<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            numbers, classes, words = [], [], []
            for text in texts(batch):
                found, counts = base_counts(text)
                numbers.append(counts)
                classes.append(pack(class_histogram(text or "")))
                words.append(pack(word_histogram([w.strip(_EDGES) for w in b" ".join(found).lower().split()])))
            columns = [pa.array([row[i] for row in numbers], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "lang"), *columns, pa.array(classes, pa.binary()), pa.array(words, pa.binary())],
                names=["doc_id", "lang", *names, "classes", "words"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes binary, words binary"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(work, schema).withColumn("base_failed", failed)


def _unpacked(packed: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(packed), size))
    for row, raw in enumerate(packed.to_pylist()):
        place, counts = np.frombuffer(raw, "<u4").reshape(2, -1)
        out[row, place] = counts
    return out


References = dict[str, tuple[np.ndarray, np.ndarray]]


def distances(classes: np.ndarray, words: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of each text to a language, by classes and by words; not a number where a text is too short or nothing is known."""
    out = []
    for counts, least, place in ((classes, MIN_CHARS_FOR_CLASSES, 0), (words, MIN_WORDS_FOR_WORDS, 1)):
        near = np.min([jensen_shannon(counts, ref[place]) for ref in refs.values()], axis=0) if refs else np.full(len(counts), np.nan)
        out.append(np.where(counts.sum(1) >= least, near, np.nan))
    return out[0], out[1]


def _near(by_class: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    return ~(by_class > MAX_CLASS_DISTANCE) & ~(by_word > MAX_WORD_DISTANCE)


def references(described: DataFrame, first: References | None = None) -> References:
    """Class and word distributions of each language over all texts that pass the base rules; tasks send sums.

    Given ``first`` references, texts that are far from all of those are left out.
    """
    width = CLASSES + len(WORDS) + 1
    shared = described.sparkSession.sparkContext.broadcast(first)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            classes, words = _unpacked(column(batch, "classes"), CLASSES), _unpacked(column(batch, "words"), len(WORDS) + 1)
            use = _near(*distances(classes, words, shared.value)) if shared.value else np.ones(len(classes), bool)
            both, langs = np.hstack([classes, words]), np.array(texts(batch, "lang"), object)
            for lang in set(langs[use].tolist()):
                sums[lang] = sums.get(lang, 0) + both[use & (langs == lang)].sum(0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * width), pa.array(np.arange(width)), pa.array(total.astype(np.int64))], names=["lang", "place", "n"])

    good = described.where(~F.col("base_failed") & F.col("lang").isNotNull()).select("lang", "classes", "words")
    sums = good.mapInArrow(work, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for lang, part in sums.groupby("lang"):
        counts = np.zeros(width)
        counts[part["place"].to_numpy(np.int64)] = part["n"]
        classes, words = counts[:CLASSES], counts[CLASSES:]
        out[lang] = classes / max(1.0, classes.sum()), words / max(1.0, words.sum())
    return out


def judge_quality(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, ``base_failed``, both distances and ``kept`` for each row of ``df``.

    Null and empty texts have no words and fail the base rules. A text under ``MIN_CHARS_FOR_CLASSES`` or
    ``MIN_WORDS_FOR_WORDS`` isn't judged by that histogram, and none is if no language has a reference; the distance
    is null then. A text exactly at a limit is kept. Repeated rows get equal results; an empty table gives none.
    """
    described = checkpointed(describe(df, id_col=id_col, text_col=text_col, lang_col=lang_col))
    shared = df.sparkSession.sparkContext.broadcast(references(described, references(described)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, words = _unpacked(column(batch, "classes"), CLASSES), _unpacked(column(batch, "words"), len(WORDS) + 1)
            by_class, by_word = distances(classes, words, shared.value)
            kept = _near(by_class, by_word) & ~column(batch, "base_failed").to_numpy(zero_copy_only=False)
            columns = [column(batch, n) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept), pa.array(by_class, from_pandas=True), pa.array(by_word, from_pandas=True)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return described.mapInArrow(work, schema)
