"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, searched with a block-max inverted index.

Terms are all words, and four-letter word beginnings, of the indexed examples; none is left out. A term weighs its TF-IDF
times its z-score, the log-odds of its documents between the labels over their deviation: plain TF-IDF is ruled by terms
that say nothing of the label. The index holds posting lists over blocks of examples and, for each list and block,
the largest weight. A query scores its most promising blocks, then those whose upper bound still reaches its k-th best
similarity, so the neighbours are exact. Votes weighted by similarity are shrunk to the share of toxic labels and
calibrated by isotonic regression on leave-one-out votes of the examples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, drawn, id_and_text, texts
from .language_id import learns

#: Bounds of the fit: labelled rows of each label whose terms are counted, and indexed examples of each label.
MAX_LABELLED, MAX_EXAMPLES = 6_000, 500
NEIGHBOURS, BLOCK, SHRINK, THRESHOLD = 15, 64, 0.2, 0.3
#: Documents that each term is given beforehand, so that rare terms weigh little; blocks scored first; postings read at a time.
BEFOREHAND, FIRST_BLOCKS, MAX_POSTINGS = 20.0, 4, 150_000
_WORD = re.compile(r"[^\W\d_]+")


def feature_counts(text: str | None) -> Counter:
    """How often each lower-cased word, and each beginning of four letters (before a `*`), stands in the text."""
    found: Counter = Counter()
    for token, n in Counter((text or "").lower().split()).items():
        for word in (token,) if token.isalpha() else _WORD.findall(token):
            found[word] += n
            if len(word) > 4:
                found[word[:4] + "*"] += n
    return found


def term_weight(n: np.ndarray, n_toxic: np.ndarray, total: int, toxic: int, prior: float) -> np.ndarray:
    """Weights of terms in ``n`` of ``total`` labelled documents, ``n_toxic`` of them among the ``toxic`` ones.

    IDF is that of documents with ``prior`` as their share of toxic ones, whatever the sample's share is. With one label
    only, or none, all terms weigh their IDF.
    """
    clean, n_clean = total - toxic, n - n_toxic
    share = np.maximum(prior * n_toxic / max(1, toxic) + (1 - prior) * n_clean / max(1, clean), 1e-9)
    idf = np.log(1 + 1 / share)
    if not toxic or not clean:
        return idf
    t, c = n_toxic + BEFOREHAND * toxic / total, n_clean + BEFOREHAND * clean / total
    odds = np.log(t / (toxic + BEFOREHAND - n_toxic)) - np.log(c / (clean + BEFOREHAND - n_clean))
    return idf * np.abs(odds) / np.sqrt(1 / t + 1 / c)


@dataclass
class BlockMaxIndex:
    """Posting lists of unit vectors over blocks of examples, and the votes' calibration."""

    feature: dict[str, int]
    term: np.ndarray  # weight of each feature
    labels: np.ndarray
    ids: np.ndarray
    cells: np.ndarray  # where the cells of each feature begin; a cell is a feature in a block
    block: np.ndarray  # of each cell: its block, its largest weight and where its postings begin
    largest: np.ndarray
    begin: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    prior: float
    knots: tuple[np.ndarray, np.ndarray]

    @classmethod
    def build(cls, vectors: list[dict[str, int]], labels: list[int], ids: list[int], weights: dict[str, float], prior: float) -> BlockMaxIndex:
        names = sorted(weights)
        feature, term = {f: i for i, f in enumerate(names)}, np.array([weights[f] for f in names], float)
        # examples of one label and one heaviest term stand together, so that blocks are alike and their bounds tight
        heaviest = [max((f for f in v if f in weights), default="", key=lambda f: (weights[f], f)) for v in vectors]
        order = sorted(range(len(labels)), key=lambda i: (labels[i], heaviest[i], ids[i]))
        none = np.zeros(0, np.int64)
        index = cls(feature, term, np.array([labels[i] for i in order], np.int64), np.array([ids[i] for i in order], np.int64), np.zeros(len(names) + 1, np.int64), none, np.zeros(0), np.zeros(1, np.int64), none, np.zeros(0), prior, (np.array([0.0, 1.0]), np.array([prior, prior])))
        f, q, rows = index.vectors([vectors[i] for i in order])
        at = np.lexsort((rows, f))
        f, index.weight, index.example = f[at], q[at], rows[at]
        if len(f):
            key = f * (len(order) // BLOCK + 1) + index.example // BLOCK
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            index.block, index.largest, index.begin = index.example[first] // BLOCK, np.maximum.reduceat(index.weight, first), np.r_[first, len(f)]
            index.cells = np.searchsorted(f[first], np.arange(len(names) + 1))
        index.knots = index._calibrated([vectors[i] for i in order])
        return index

    def vectors(self, counted: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, unit weights and row numbers of the non-zero entries."""
        f, n, rows, known = [], [], [], self.feature.get
        for row, counts in enumerate(counted):
            here = [(i, c) for name, c in counts.items() if (i := known(name)) is not None]
            f += [i for i, _ in here]
            n += [c for _, c in here]
            rows += [row] * len(here)
        f, rows = np.array(f, np.int64), np.array(rows, np.int64)
        q = (1 + np.log(np.array(n, float))) * self.term[f] if len(f) else np.zeros(0)
        norm = np.sqrt(np.bincount(rows, q * q, minlength=len(counted)))
        return f, q / np.where(norm[rows] > 0, norm[rows], 1) if len(f) else q, rows

    def nearest(self, counted: list[dict[str, int]], but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exact similarities and positions of the nearest examples of each row; position -1 and 0 where there are fewer.

        ``but`` names an example that each row must not take, for leave-one-out.
        """
        best, who = np.zeros((len(counted), NEIGHBOURS)), np.full((len(counted), NEIGHBOURS), -1, np.int64)
        f, q, rows = self.vectors(counted)
        if not len(f) or not len(self.labels):
            return best, who
        first = np.searchsorted(rows, np.arange(len(counted) + 1))
        postings = np.r_[0, np.cumsum(self.begin[self.cells[f + 1]] - self.begin[self.cells[f]])][first]
        low = 0
        while low < len(counted):
            high = max(low + 1, min(low + 256, int(np.searchsorted(postings, postings[low] + MAX_POSTINGS, "right")) - 1))
            part = slice(first[low], first[high])
            best[low:high], who[low:high] = self._nearest(f[part], q[part], rows[part] - low, high - low, None if but is None else but[low:high])
            low = high
        return best, who

    def _nearest(self, f: np.ndarray, q: np.ndarray, rows: np.ndarray, n: int, but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        m, k, blocks = len(self.labels), min(NEIGHBOURS, len(self.labels)), -(-len(self.labels) // BLOCK)
        lengths = self.cells[f + 1] - self.cells[f]
        cell, row, weigh = np.repeat(self.cells[f], lengths) + _within(lengths), np.repeat(rows, lengths), np.repeat(q, lengths)
        place = row * blocks + self.block[cell]
        bound = np.bincount(place, weigh * self.largest[cell], minlength=n * blocks).reshape(n, blocks)
        score, kth = np.zeros((n, m)), np.zeros(n)

        def read(chosen: np.ndarray) -> None:
            some = chosen.ravel()[place]
            start, size = self.begin[cell[some]], self.begin[cell[some] + 1] - self.begin[cell[some]]
            posting = np.repeat(start, size) + _within(size)
            at = np.repeat(row[some] * m, size) + self.example[posting]
            score.ravel()[:] += np.bincount(at, np.repeat(weigh[some], size) * self.weight[posting], minlength=n * m)
            if but is not None:
                score[np.arange(n), but] = 0.0

        early = np.zeros((n, blocks), bool)
        np.put_along_axis(early, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, 1)
        read(early)
        kth = np.partition(score, m - k, axis=1)[:, m - k]
        # a bound is rounded too, so one a trifle below may still belong to a similarity that reaches
        read(~early & (bound > 0) & (bound * (1 + 1e-9) >= kth[:, None]))
        take = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best, who = np.zeros((n, NEIGHBOURS)), np.full((n, NEIGHBOURS), -1, np.int64)
        best[:, :k] = np.minimum(np.take_along_axis(score, take, 1), 1.0)
        who[:, :k] = np.where(best[:, :k] > 0, take, -1)
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of similarity on toxic neighbours, shrunk to the prior."""
        toxic = np.where(who >= 0, self.labels[np.maximum(who, 0)] if len(self.labels) else 0, 0)
        return ((best * toxic).sum(1) + SHRINK * self.prior) / (best.sum(1) + SHRINK)

    def _calibrated(self, counted: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        if len(set(self.labels.tolist())) < 2:
            return self.knots
        vote = self.votes(*self.nearest(counted, np.arange(len(counted))))
        share = self.labels.mean()
        weigh = np.where(self.labels == 1, self.prior / share, (1 - self.prior) / (1 - share))
        order = np.argsort(vote, kind="stable")
        pools: list[list[float]] = []  # pool adjacent violators: [sum of votes, weight, toxic weight]
        for v, w, y in zip(vote[order], weigh[order], self.labels[order]):
            pools.append([v * w, w, y * w])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])

    def score(self, counted: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and similarities and positions of the neighbours."""
        best, who = self.nearest(counted)
        return np.interp(self.votes(best, who), *self.knots), best, who


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> BlockMaxIndex:
    """Index of a bounded, seeded sample of the labelled rows whose CRC-32 remainder by 4 is not 2.

    Terms are counted over at most ``MAX_LABELLED`` rows of each label, of which ``MAX_EXAMPLES`` are indexed. A row
    labelled more than once is toxic if any label says so; rows without label or text don't teach.
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    once = named.where(learns("doc_id", 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64(F.lit(5), "doc_id"))
    counts = dict(once.groupBy("toxic").count().collect())
    sample = None
    for label in (0, 1):
        part = drawn(once.where(F.col("toxic") == label), "draw", MAX_LABELLED, counts.get(label, 0), -(2**63), 2**63 - 1)
        sample = part if sample is None else sample.unionByName(part)
    # at most two times MAX_LABELLED rows of three numbers, so this broadcast has a bound
    rows = checkpointed(id_and_text(docs, id_col, text_col).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id"))
    totals = dict(rows.groupBy("toxic").count().collect())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(texts(batch), column(batch, "toxic").to_pylist()):
                found = feature_counts(text).keys()
                seen.update(found)
                if label:
                    toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64()), pa.array([toxic[f] for f in seen], pa.int64())], names=["feature", "n", "n_toxic"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_counts(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "toxic"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "features", "counts"],
            )

    first = None
    for label in (0, 1):
        part = rows.where(F.col("toxic") == label).orderBy("draw", "doc_id", "text").limit(MAX_EXAMPLES)
        first = part if first is None else first.unionByName(part)
    described = checkpointed(first.select("doc_id", "text", "toxic").mapInArrow(describe, "doc_id bigint, toxic int, features array<string>, counts array<bigint>"))
    # both collects are as large as the indexed examples and their terms
    known = described.select(F.explode("features").alias("feature")).distinct()
    tallies = rows.mapInArrow(tally, "feature string, n bigint, n_toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    terms = tallies.join(known, "feature", "left_semi").toPandas()
    examples = described.collect()
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.0
    weight = term_weight(terms["n"].to_numpy(float), terms["n_toxic"].to_numpy(float), sum(totals.values()), totals.get(1, 0), prior)
    return BlockMaxIndex.build([dict(zip(e["features"], e["counts"])) for e in examples], [e["toxic"] for e in examples], [e["doc_id"] for e in examples], dict(zip(terms["feature"], weight.tolist())), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` of each whole text.

    ``evidence`` lists up to three nearest examples as ``doc_id:label:similarity``. Null and empty texts, and texts
    without a known term, score by the share of toxic labels; with nothing labelled all score 0. Equal similarities go to
    the example that stands first in the index. Repeated rows get equal results; an empty table gives none.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                score, best, who = model.score([feature_counts(t) for t in texts(batch)])
                evidence = [", ".join(f"{model.ids[w]}:{model.labels[w]}:{s:.3f}" for w, s in zip(ws[:3], ss[:3]) if w >= 0) for ws, ss in zip(who.tolist(), best.tolist())]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(score), pa.array(evidence)], names=["doc_id", "score", "evidence"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, score double, evidence string")
    held = F.coalesce(~learns("doc_id", 4, 2), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
