"""Language identification by error-correcting output codes.

Each language has a codeword; one binary logistic classifier on byte trigrams predicts each bit. A text gets the
language whose codeword has the least loss, each bit weighted by how well its classifier separates the training rows,
and is flagged ambiguous when the second best codeword is nearly as close.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm.common import chunks, tune

#: Labelled documents to learn from (whole texts), trigram buckets, bits of a codeword at least.
SAMPLE, BUCKETS, BITS = 4000, 4096, 15
#: Below this chance the prediction is flagged ambiguous.
SURE = 0.75
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def counts(text: str | None) -> np.ndarray:
    """Numbers of a text's byte trigrams by bucket: A-Z in lower case, runs of anything but letters as one space."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", dtype=np.uint8)
    c = _FOLD[raw]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    if len(c) < 3:
        return np.zeros(BUCKETS, dtype=np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=BUCKETS)


def normalise(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def codewords(n: int, bits: int = BITS, tries: int = 400, seed: int = 3) -> np.ndarray:
    """n rows of +1 and -1 far apart: the best of some random codes without constant columns."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int64)
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(tries):
        code = rng.choice([-1, 1], (n, bits))
        flat = np.abs(code.sum(axis=0)) == n
        code[0, flat] *= -1
        apart = (bits - code @ code.T) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language, and the chance of each, for rows of normalised counts."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        return loss.argmin(axis=1), chance


def fit(x: np.ndarray, languages: list[str], rounds: int = 120, ridge: float = 1e-4) -> Model:
    """x: rows of normalised counts with their language. One logistic classifier for each bit, by Adam."""
    names = sorted(set(languages))
    code = codewords(len(names))
    y = code[[names.index(v) for v in languages]].astype(np.float32) if names else np.zeros((0, 1), dtype=np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1] if names else 1), dtype=np.float32), np.zeros(code.shape[1] if names else 1, dtype=np.float32)
    if len(names) > 1:
        m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for step in range(1, rounds + 1):
            g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
            gw, gb = x.T @ g + ridge * w, g.sum(axis=0)
            m1, m2, c1, c2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw, 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
            s1, s2 = 1 - 0.9**step, 1 - 0.99**step
            w -= 0.3 * (m1 / s1) / (np.sqrt(m2 / s2) + 1e-8)
            b -= 0.3 * (c1 / s1) / (np.sqrt(c2 / s2) + 1e-8)
        right = ((x @ w + b) * y > 0).mean(axis=0)
        trust = np.clip(2 * right - 1, 0.01, 1)
    else:
        trust = np.ones(w.shape[1])
    return Model(names, code, w.astype(np.float32), b, trust)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.minimum(counts(t), 65535).astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` of the rows that have a language and a text, as many for each language if it has them.

    They are chosen by a hash of id and text; repeated rows count once. Of more than `sample` languages the most frequent
    ones are learned. The languages' counts and the sample's features reach the driver.
    """
    tune(rows.sparkSession)
    own = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id"))
    own = own.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64(F.lit(13), "id", "text").alias("draw"))
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    quota = max(1, sample // max(1, len(sizes)))
    share = [(r["lang"], int(min(1.0, 0.9 * quota / max(1, r["n"])) * (1 << 20))) for r in sizes]
    limits = F.broadcast(rows.sparkSession.createDataFrame(share, "lang string, most int"))  # at most `sample` rows
    some = own.join(limits, "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("most")).dropDuplicates(["lang", "draw"]).orderBy("draw", "lang").limit(sample)
    got = [(r["lang"], bytes(r["x"])) for r in some.select("lang", "text").mapInArrow(_counted, "lang string, x binary").toLocalIterator()]
    got = sorted((g for g in got if any(g[1])), key=lambda g: g)
    x = normalise(np.frombuffer(b"".join(g[1] for g in got), dtype="<u2").reshape(-1, BUCKETS))
    return fit(x, [g[0] for g in got])


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                lettered = np.array([has_letter(t) for t in texts])
                if model.languages:
                    place, chance = model.predict(normalise(np.array([counts(t) for t in texts])))
                    top = np.sort(chance, axis=1)
                    score, names = top[:, -1], np.array(model.languages, dtype=object)[place]
                else:
                    score, names = np.zeros(len(texts)), np.full(len(texts), "und", dtype=object)
                names, score = np.where(lettered, names, "und"), np.where(lettered, score, 0.0)
                yield pa.record_batch([part.column(0), pa.array(names.tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array(score < SURE)], names=["row", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (chance of that language), ambiguous: a row for each row of docs, from the whole text alone.

    A null text, or one without a letter, is `und` with score 0; so is any if nothing was learned. Null ids and repeated
    rows stay. No shuffle.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(_predict(model), schema).withColumnRenamed("row", "id")
