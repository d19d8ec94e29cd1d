"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit, a binary classifier over hashed byte trigrams tells the
languages with +1 from those with -1; its weights are log odds of the mean trigram distributions of the two sides.
A text goes to the codeword of the least weighted loss, where a bit weighs as much for a language as the classifier
parts that language from the other side. A text that two codewords fit almost as well is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, numbered, texts

BUCKETS = 1 << 14
#: Steepness of the loss and of the score; gap of scores below which a text is ambiguous; words of random codes.
LOSS_SCALE, SCORE_SCALE, AMBIGUOUS_GAP, SMOOTHING = 4.0, 8.0, 0.2, 0.5
_NO_LETTERS = re.compile(r"[\W\d_]+")


def trigram_buckets(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, where all but letters is one space."""
    raw = np.frombuffer(f" {_NO_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8"), np.uint8).astype(np.uint32)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords: all distinct splits for up to 7 languages, else the most distant of some seeded random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        splits = [s for s in product((1.0, -1.0), repeat=n) if s[0] > 0 and min(s) < 0]
        return np.array(splits).T
    draw, bits = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n)))
    codes = [draw.choice([1.0, -1.0], (n, bits)) for _ in range(50)]
    codes = [c[:, np.abs(c.sum(0)) < n] for c in codes]
    return max(codes, key=lambda c: -max((c @ c.T)[np.triu_indices(n, 1)]))


@dataclass
class LanguageModel:
    """Languages, their codewords, weights by bucket and bit, and the weight of each bit for each language."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray) -> LanguageModel:
        codes = codewords(len(languages))
        shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
        weights = np.zeros((counts.shape[1], codes.shape[1]))
        for bit in range(codes.shape[1]):
            up = codes[:, bit] > 0
            weights[:, bit] = np.log(shares[up].mean(0)) - np.log(shares[~up].mean(0))
        margin = np.maximum(codes * (shares @ weights), 0.0)
        total = margin.sum(1, keepdims=True)
        return cls(languages, codes, weights.astype(np.float32), np.where(total > 0, margin / np.where(total > 0, total, 1), 1 / max(1, codes.shape[1])))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is ambiguous; `und` and 0 without a letter or a model."""
        if not has_letter(text) or not self.languages:
            return "und", 0.0, True
        seen = np.bincount(trigram_buckets(text), minlength=BUCKETS)
        used = np.flatnonzero(seen)
        bits = (seen[used] @ self.weights[used]) / max(1, seen[used].sum())
        loss = (self.bit_weights * np.exp(-LOSS_SCALE * self.codes * bits)).sum(1)
        chance = np.exp(-SCORE_SCALE * (loss - loss.min()))
        chance /= chance.sum()
        order = np.argsort(-chance, kind="stable")
        gap = 1.0 if len(order) < 2 else float(chance[order[0]] - chance[order[1]])
        return self.languages[order[0]], float(chance[order[0]]), gap < AMBIGUOUS_GAP


def learns(id_col: str = "doc_id", folds: int = 5, held: int = 0) -> Column:
    """Whether a row may teach: CRC-32 of its id as text does not leave the held-out remainder. Null ids don't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held, F.lit(False))


def fit_languages(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams by language over all rows of ``df`` that have both columns; tasks send sums.

    What reaches the driver is one row per language and bucket, however many documents there are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch), texts(batch, "lang")):
                if has_letter(text):
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts[lang] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        for lang, seen in counts.items():
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(seen[used])], names=["lang", "bucket", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sums = rows.mapInArrow(work, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[[place[x] for x in sums["lang"]], sums["bucket"].to_numpy(np.int64)] = sums["n"]
    return LanguageModel.from_counts(languages, counts)


def add_language(df: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``ambiguous`` behind its columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in texts(batch, text_col)]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return df.mapInArrow(work, schema)


def identify_languages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` of each whole text.

    Learns from rows with text and language that are not held out (see ``learns``). A null text or one without a
    letter is `und` with score 0, as is every text if there is nothing to learn from. Equal losses go to the language
    that sorts first. Repeated rows get equal results; an empty table gives an empty result.
    """
    model = fit_languages(df.where(learns(id_col)), text_col=text_col, lang_col=lang_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(~learns("doc_id"), F.lit(True))
    return add_language(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose language is told: no `und`, none both ambiguous and below ``least_score``."""
    model = fit_languages(df.where(learns(id_col)), text_col=text_col, lang_col=lang_col)
    plain, (text,) = numbered(df, text_col)
    found = add_language(plain, model, text_col=text)
    sure = (F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") < least_score))
    return found.where(sure).select(plain.columns).toDF(*df.columns)
