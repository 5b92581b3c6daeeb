"""Retrieval: chunks, embeddings, BM25 and vector ranking, fusion, neighbours."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selvage.functions.similarity import cosine
from selvage.functions.text import collapsed
from selvage.operators.graph import cut


def chunk_hash(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_windows(text: Column, size: int = 900, overlap: float = 0.15) -> Column:
    """Windows of `size` words that overlap by that share; a text of up to `size` words is one window, of none none."""
    every = F.filter(F.split(text, "[ \t\n\r\f\u000b]+"), lambda w: w != "")
    step = int(size * (1 - overlap))
    n = F.size(every)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(every, s + 1, F.lit(size)), " "))


def headings(html: Column) -> Column:
    """array(heading, body) of each part of a page that starts with a heading; what comes before the first one, and parts without
    text, are left out."""
    plain = lambda c: collapsed(F.regexp_replace(c, "<[^>]*>", " "))
    parts = F.slice(F.split(html, "(?i)<h[1-6][^>]*>"), F.lit(2), F.greatest(F.size(F.split(html, "(?i)<h[1-6][^>]*>")) - 1, F.lit(0)))
    both = F.transform(parts, lambda p: F.struct(plain(F.split(p, "(?i)</h[1-6]>", 2)[0]).alias("heading"), plain(F.coalesce(F.get(F.split(p, "(?i)</h[1-6]>", 2), F.lit(1)), F.lit(""))).alias("body")))
    return F.filter(both, lambda b: b["body"] != "")


def embed(text: Column, dimensions: int = 8) -> Column:
    """A deterministic pseudo-embedding of a text: 64-bit words of keyed digests scaled to [-1, 1), then of unit length."""
    norm = F.lower(collapsed(text))
    words = []
    for counter in range(-(-dimensions // 4)):
        digest = F.sha2(F.concat(norm, F.lit(f"|{counter}")), 256)
        words += [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 63) - 1.0 for k in range(4)]
    raw = F.array(*words[:dimensions])
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def bm25(documents: DataFrame, query: list[str], id_col: str, text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, score of the documents with a positive score. A term that the query repeats counts each time.

    One pass finds each document's length and its counts of the query's terms, which are kept for both uses; statistics
    over the whole corpus are two numbers and a count for each term of the query, joined back as one row. Nothing is
    exploded by word.
    """
    asked = [t for q in query for t in _plain_terms(q)]
    distinct = sorted(set(asked))
    spark = documents.sparkSession
    if not asked:
        return spark.createDataFrame([], f"{id_col} {dict(documents.dtypes)[id_col]}, score double")
    words = terms(F.col(text_col))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    tf = [count(t).alias(f"tf{i}") for i, t in enumerate(distinct)]
    rows = documents.select(id_col, F.coalesce(words, F.array().cast("array<string>")).alias("w")).select(id_col, F.size("w").alias("len"), *tf)
    rows = cut(rows)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(distinct))])
    joined = rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(stats))  # one row, whatever the corpus
    score = F.lit(0.0)
    for t in asked:
        i = distinct.index(t)
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return joined.select(id_col, score.alias("score")).where("score > 0")


def _plain_terms(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", text.lower())


def vector_scores(rows: DataFrame, query: list[float], id_col: str, vector_col: str = "embedding") -> DataFrame:
    """id, score: cosine with a query vector in double precision."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, cosine(F.col(vector_col), asked).alias("score"))


def top(scores: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best rows by score, ties by id: a bounded heap in each partition, no shuffle of the rest."""
    return scores.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def ranked(scores: DataFrame, id_col: str) -> DataFrame:
    """id, rank from 1 by score, ties by id, of any number of rows: sorted by range, numbered in each range, offsets added."""
    order = (F.desc("score"), F.asc(id_col))
    dealt = cut(scores.select(id_col, "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    placed = dealt.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    return placed.join(F.broadcast(before), "part").select(id_col, (F.col("before") + F.col("place")).alias("rank"))


def fuse(rankings: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings(id, rank): id, score."""
    every = rankings[0]
    for r in rankings[1:]:
        every = every.unionByName(r)
    return every.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hybrid(words: DataFrame, vectors: DataFrame, id_col: str, k: int = 25, pool: int = 10_000, rrf: int = 60, digits: int | None = None) -> DataFrame:
    """id, score: the k best of two scorings (id, score), fused by rank. `pool` is the search's own limit on the vectors;
    words are ranked over all rows. digits: decimals to which fused scores are compared."""
    fused = fuse([ranked(words, id_col), ranked(top(vectors, pool, id_col), id_col)], id_col, rrf)
    return top(fused if digits is None else fused.withColumn("score", F.round("score", digits)), k, id_col)


def search(chunks: DataFrame, query: str, query_vector: list[float], id_col: str, k: int = 25, pool: int = 10_000, text_col: str = "text", vector_col: str = "embedding", rrf: int = 60) -> DataFrame:
    """Hybrid search of BM25 and vectors over the same rows."""
    return hybrid(bm25(chunks, [query], id_col, text_col), vector_scores(chunks, query_vector, id_col, vector_col), id_col, k, pool, rrf)


#: Bytes of query vectors that are broadcast at once, and query rows that are compared with a batch at once.
QUERY_BYTES, QUERY_STEP = 16 << 20, 1024


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors; rows that are null, of another length or hold a null or a number that is not finite are zero."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    size = np.sqrt((out * out).sum(axis=1))
    fine = np.isfinite(size) & (size > 0)
    return np.where(fine[:, None], out / np.where(fine, size, 1)[:, None], 0.0)


def _nearest(asked: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows id, vector to query, id, score: the k best of a partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = asked.value
        best_id, best, kind = None, None, None
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            kind = batch.schema.field(0).type
            ids = np.array(batch.column(0).to_pylist(), dtype=None if len(batch) else names.dtype)
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], _vectors(batch.column(1), unit.shape[1])[order]
            if best is None:
                best_id, best = np.zeros((len(names), 0), dtype=ids.dtype), np.zeros((len(names), 0))
            found_id, found = [], []
            for at in range(0, len(names), QUERY_STEP):
                score = np.round(unit[at : at + QUERY_STEP] @ rows.T, 12)
                score[names[at : at + QUERY_STEP, None] == ids[None]] = -np.inf
                near = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                every_id = np.concatenate([best_id[at : at + QUERY_STEP], ids[near]], axis=1)
                every = np.concatenate([best[at : at + QUERY_STEP], np.take_along_axis(score, near, axis=1)], axis=1)
                rank = np.lexsort((every_id, -every), axis=-1)[:, :k]
                found_id.append(np.take_along_axis(every_id, rank, axis=1))
                found.append(np.take_along_axis(every, rank, axis=1))
            best_id, best = np.concatenate(found_id), np.concatenate(found)
        if best is not None:
            for at in range(0, len(names), 256):
                good = np.isfinite(best[at : at + 256])
                query = np.repeat(names[at : at + 256], good.sum(axis=1))
                columns = [pa.array(query.tolist(), kind), pa.array(best_id[at : at + 256][good].tolist(), kind), pa.array(best[at : at + 256][good])]
                yield pa.record_batch(columns, names=["query", "id", "score"])

    return run


def neighbours(queries: DataFrame, rows: DataFrame, id_col: str, k: int = 25, vector_col: str = "embedding") -> DataFrame:
    """query, id, score, rank: the k nearest other rows of each query row by cosine, ties by id.

    Scores are in double precision; those that agree in 12 decimals are ties. Vectors that are null, zero, of another
    length than the queries or not finite have the score 0. Ids are numbers or strings; null ids take no part. Queries are
    read and broadcast in blocks of QUERY_BYTES, each compared with all rows by matrix products; a partition gives its k
    best of each query, so what moves is queries x partitions x k rows.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    data = rows.select(id_col, vector_col)
    found, block, size = [], [], 0

    def compare() -> None:
        width = max(len(v or []) for _, v in block)
        names = np.array([i for i, _ in block])
        asked = spark.sparkContext.broadcast((names, _vectors(pa.array([v for _, v in block]), width)))
        found.append(data.mapInArrow(_nearest(asked, k), f"query {kind}, id {kind}, score double"))

    for r in queries.where(F.col(id_col).isNotNull()).select(id_col, vector_col).toLocalIterator():
        block.append((r[0], r[1]))
        size += 8 * len(r[1] or [])
        if size > QUERY_BYTES:
            compare()
            block, size = [], 0
    if block:
        compare()
    if not found:
        return spark.createDataFrame([], f"query {kind}, {id_col} {kind}, score double, rank int")
    every = functools.reduce(DataFrame.unionAll, found)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", F.col("id").alias(id_col), "score", "rank")


def attribute(attributes: DataFrame, attribute_id: str, id_col: str = "attributeId") -> DataFrame:
    """The row of an attribute; empty if there is none."""
    return attributes.where(F.col(id_col) == attribute_id)


def neighbours_of(attributes: DataFrame, attribute_id: str, k: int = 25, vector_col: str = "embedding", id_col: str = "attributeId") -> DataFrame:
    """id, score, rank: the attributes nearest to one of them, which is left out; empty for an unknown one."""
    return neighbours(attribute(attributes, attribute_id, id_col), attributes, id_col, k, vector_col).drop("query")
