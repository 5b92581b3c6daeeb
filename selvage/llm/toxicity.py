"""Toxicity grades by cumulative-link (proportional odds) regression on sparse text features.

Features of a text are its distinct words and the beginnings (4 to 6 bytes) of its longer words, as 64-bit hashes. From a
bounded sample of labelled documents those that stand out in toxic ones are chosen, and one weight vector is fitted for
all thresholds: P(grade > k) = sigmoid(w.x - t_k), with t_1 <= t_2 <= ... The result is the expected grade.

Labels of 0 and 1 are refined to grades 0 (clean), 1 and 2 (toxic, with fewer or more chosen features for their length
than the median toxic document); labels of more values are grades as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm.common import BYTE_VALUES, RangeHash, chunks, mix, tune

#: Labelled documents to learn from, at most so many of each: clean ones and toxic ones.
SAMPLE = 1500
#: Features kept, at most; the least share of the toxic documents, and number of them, that have one.
KEPT, LEAST_SHARE, LEAST = 3000, 0.01, 4
#: Chance of any toxic grade from which a text is graded toxic: to miss one costs more than to lose a clean text.
REJECT = 0.15
_LETTER = np.array([c >= 128 or 97 <= c <= 122 for c in range(256)])
_PREFIXES = (4, 5, 6)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (place of the text) and hash of every word and word beginning, and the number of words of each text."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    on = np.r_[False, _LETTER[raw], False]
    edge = np.flatnonzero(on[1:] != on[:-1])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(ends, start, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(start):
        return owner, np.zeros(0, dtype=np.uint64), n_words
    sums = RangeHash(BYTE_VALUES[raw])
    own, out = [owner], [sums(start, end)]
    for n in _PREFIXES:
        long = end - start > n
        own.append(owner[long])
        out.append(mix(sums(start[long], start[long] + n) + np.uint64(n)))
    return np.concatenate(own), np.concatenate(out), n_words


def sketches(owner: np.ndarray, h: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The least hash of each text's three-word shingles; near copies mostly share it, other texts do not."""
    total = int(n_words.sum())
    own, h = owner[:total], h[:total]  # words come first, in the order of the text
    out = np.zeros(len(n_words), dtype=np.uint64)
    if total > 2:
        same = own[2:] == own[:-2]
        shingle = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[same]
        out[:] = np.iinfo(np.uint64).max
        np.minimum.at(out, own[2:][same], shingle)
    return out


def _distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, dtype=bool)
    return owner[new], h[new]


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the thresholds between grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """For each text, P(grade > k) for each threshold."""
        owner, h, _ = hashed(texts)
        score = np.zeros(len(texts))
        if len(self.features) and len(h):
            p = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[p] == h
            own, place = _distinct(owner[hit], p[hit].astype(np.uint64))
            score = np.bincount(own, weights=self.weights[place.astype(np.int64)], minlength=len(texts))
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, top: int, ridge: float = 0.001, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of greatest penalised likelihood, by Adam. grades: 0 to top."""
    w = np.zeros(x.shape[1])
    raw = np.zeros(top)  # t_1, then the logarithms of the steps
    raw[0] = 1.0
    m1, m2 = np.zeros(len(w) + top), np.zeros(len(w) + top)
    rows = np.arange(len(x))
    for step in range(1, rounds + 1):
        t = raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))]
        above = np.c_[np.ones(len(x)), 1 / (1 + np.exp(np.clip(t[None, :] - (x @ w)[:, None], -30, 30))), np.zeros(len(x))]
        p = np.maximum(above[rows, grades] - above[rows, grades + 1], 1e-9)
        slope = above * (1 - above)
        g_score = (slope[rows, grades] - slope[rows, grades + 1]) / p
        g_t = np.array([(((grades == k) * 1.0 - (grades == k + 1)) * slope[:, k + 1]) @ (1 / p) for k in range(top)])
        g_raw = np.r_[g_t.sum(), [np.exp(raw[k]) * g_t[k:].sum() for k in range(1, top)]]
        g = np.r_[x.T @ g_score / len(x) - ridge * w / len(x), g_raw / len(x)]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, raw = w + move[: len(w)], raw + move[len(w) :]
    return w, raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))]


def fit(rows: list[tuple[np.ndarray, int, int]], kept: int = KEPT) -> Model:
    """rows: distinct feature hashes, number of words, label of each document."""
    labels = np.array([y for _, _, y in rows], dtype=np.int64)
    toxic = labels > 0
    none = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([30.0]))
    if not toxic.any() or toxic.all():
        return none
    size = np.array([len(h) for h, _, _ in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    every, place = np.unique(np.concatenate([h for h, _, _ in rows]), return_inverse=True)
    a = np.bincount(place[toxic[owner]], minlength=len(every))
    b = np.bincount(place, minlength=len(every)) - a
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    sure = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = np.flatnonzero((sure > 3) & (odds > 2.5) & (a >= max(LEAST, LEAST_SHARE * toxic.sum())))
    best = np.sort(best[np.argsort(-sure[best], kind="stable")[:kept]])
    if not len(best):
        return none
    column = np.full(len(every), -1)
    column[best] = np.arange(len(best))
    c = column[place]
    x = np.zeros((len(rows), len(best)), dtype=np.float32)
    x[owner[c >= 0], c[c >= 0]] = 1
    grades = labels
    if labels.max() == 1:
        dense = x.sum(axis=1) / np.log(2 + np.array([n for _, n, _ in rows]))
        grades = np.where(toxic, 1 + (dense > np.median(dense[toxic])), 0)
    weights, thresholds = fit_ordinal(x, grades, int(grades.max()))
    return Model(every[best], weights, thresholds)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        owner, h, n = hashed(texts)
        sketch = sketches(owner, h, n)
        owner, h = _distinct(owner, h)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        yield pa.record_batch([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array(n.astype(np.int64)), pa.array(sketch.view(np.int64))], names=["label", "features", "n_words", "sketch"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` clean and `sample` toxic documents, whole texts, chosen by the hash of their id.

    Labels that are null, or whose document is missing, are left out; of several labels of a document the highest holds.
    Only the sample's ids (broadcast, at most 2 x sample of them) and its features reach the driver.
    """
    tune(docs.sparkSession)
    own = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    draw = F.xxhash64(F.lit(11), "id")
    some = own.where("label > 0").orderBy(draw, "id").limit(sample).union(own.where("label <= 0").orderBy(draw, "id").limit(sample))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(some), "id")
    # an id that several documents share gives all of them; repeated rows count once
    texts = texts.withColumn("draw", F.xxhash64(F.lit(11), "id", "text")).dropDuplicates(["id", "draw"]).orderBy("draw", "id").limit(3 * sample).select("label", "text")
    got = texts.mapInArrow(_features, "label int, features binary, n_words bigint, sketch bigint")
    rows = [(max(0, r["label"]), r["sketch"], np.frombuffer(bytes(r["features"]), dtype=np.uint64), r["n_words"]) for r in got.toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1], r[3], len(r[2]), int(r[2].sum()) if len(r[2]) else 0))  # the order of rows must not matter
    # a group of near copies must not make its own words look toxic: one of them counts
    own = {(label, sketch if n > 2 else i): (h, n, label) for i, (label, sketch, h, n) in enumerate(rows)}
    return fit(list(own.values()))


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(b) if (b := x.as_buffer()) is not None else 0 for x in batch.column(1).cast(pa.binary())]
            for a, b in chunks(sizes):
                p = model.chances(batch.column(1).slice(a, b - a).to_pylist())
                grade = (p[:, 0] >= REJECT) + (p[:, 1:] >= 0.5).sum(axis=1)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(grade.astype(np.int32))], names=["row", "severity", "chance", "grade"])

    return run


def score(docs: DataFrame, model: Model, row: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, severity (expected grade), chance (of a grade over 0), grade (0 below a chance of REJECT, else 1 and one
    more for each further threshold that is more likely passed than not): a row for each row of docs, no shuffle.

    Null and empty texts have no feature: severity next to 0 and grade 0. Null ids and repeated rows stay.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"]]).add("severity", "double").add("chance", "double").add("grade", "integer")
    return rows.mapInArrow(_score(model), schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose grade is 0, with all their columns."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return score(packed, model, "row", "text").where("grade = 0").select(*[F.col("row").getField(c).alias(c) for c in names])
