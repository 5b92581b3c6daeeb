"""Helpers that the operators share: session settings, byte hashing, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators.graph import components, cut, cut_rows, shared_folder  # noqa: F401

#: Rows in an Arrow batch; with BATCH_BYTES it bounds what a Python worker holds at once.
BATCH_ROWS = 1000
#: Operators work on texts in chunks of about so many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20
#: Rows of one value that a join leaves in one task, and values with more that it broadcasts at most.
SHARE, HOTTEST = 1000, 100_000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be very long, and a worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder, wherever the cluster keeps it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_spread(rows: DataFrame, told: DataFrame, by: list[str], tie: list[str], groups: DataFrame | None = None, size: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with told on `by` (inner or left). groups (or told itself): cheap to read, one row for each value of `by`, with `size`,
    how many of the rows have it.

    The rows of a value that has over SHARE of them are dealt, by a hash of `tie`, to several tasks. Such values are
    broadcast: they are those over one HOTTEST-th of all rows where there are more rows than SHARE * HOTTEST, so never
    more than HOTTEST of them.
    """
    groups = told if groups is None else groups
    total, top = groups.agg(F.sum(size), F.max(size)).first()
    share = max(SHARE, (total or 0) // HOTTEST)
    if (top or 0) <= share:
        return rows.join(told, by, how)
    hot = F.broadcast(groups.where(F.col(size) > share).select(*by, F.ceil(F.col(size) / share).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(hot, by, "left").withColumn("part", F.pmod(F.xxhash64(*tie), parts).cast("int")).drop("parts")
    told = told.join(hot, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(told, [*by, "part"], how).drop("part")


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# --- polynomial hashes of byte ranges, modulo 2**64 ---------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=np.uint64)
    return _powers[kind][:n]


class RangeHash:
    """Hashes of any ranges of one array of symbols after one pass over it."""

    def __init__(self, values: np.ndarray) -> None:
        """values: uint64, one for each symbol."""
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


# --- union-find ---------------------------------------------------------------------------------------------------


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n items reaches over the links a-b (and over an earlier result)."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # hook the roots, not only the ends, so that chains close in few rounds
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(label, before):
            return label
