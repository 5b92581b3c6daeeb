"""Benchmark decontamination: a broadcast hash set of the windows of test items, scanned over every document.

The words of an item set get small numbers; a document's words are mapped to them (0: not in any item). Rolling hashes
of its windows are looked up in the sorted hashes of the items' windows, and each hit is verified on the words
themselves. The item side is broadcast in blocks of a bounded number of windows, so a large benchmark costs more passes
over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm.common import RangeHash, mix, tune

#: Most bytes of item text that one broadcast block holds; larger item sets are scanned in several blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are compared with one block after the other, where there are several.
SCAN_BYTES = 32 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


class WindowSet:
    """The windows of `width` words of a block of items (of all words of a shorter item)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.width = width
        found: dict[int, dict[bytes, set[int]]] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        place = {i: n for n, i in enumerate(self.ids)}
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], dtype=np.int32)
            n = min(width, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(ids[at : at + n].tobytes(), set()).add(place.get(item, -1))
        self.windows = {n: {k: tuple(v) for k, v in w.items()} for n, w in found.items()}
        self.hashes = {n: np.sort(self._hash(np.concatenate([np.frombuffer(k, np.int32) for k in w]), n)[::n]) for n, w in self.windows.items()}

    def _hash(self, ids: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(len(ids) - n + 1)
        return RangeHash(mix(ids.astype(np.uint64)))(at, at + n)

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which of them are inside an occurrence of a window, and the places of the items."""
        words = words_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
        hit = np.zeros(len(ids) + 1, dtype=np.int64)
        items: set[int] = set()
        if len(ids):
            known = np.r_[0, np.cumsum(ids > 0)]
            for n, windows in self.windows.items():
                if len(ids) < n:
                    continue
                at = np.flatnonzero(known[n:] - known[:-n] == n)
                if not len(at):
                    continue
                hashes, sums = self.hashes[n], RangeHash(mix(ids.astype(np.uint64)))
                h = sums(at, at + n)
                p = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for i in at[hashes[p] == h]:
                    if (of := windows.get(ids[i : i + n].tobytes())) is not None:
                        items.update(of)
                        hit[i] += 1
                        hit[i + n] -= 1
        return len(words), np.cumsum(hit[:-1]) > 0, items


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a text."""
    on = np.r_[False, np.frombuffer(text.translate(_FOLD), np.uint8) != 32, False]
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge[::2], edge[1::2]


def scan_texts(texts: list[bytes | None], sets: Iterator[WindowSet]) -> list[tuple[int, np.ndarray, list[str]]]:
    """For each text its number of words, which of them are hit, and the ids of the items found, over all blocks."""
    out = [(n := len(words_of(t)), np.zeros(n, dtype=bool), set()) for t in texts]
    for windows in sets:
        for k, text in enumerate(texts):
            _, hit, items = windows.scan(text)
            out[k][1][hit] = True
            out[k][2].update(windows.ids[i] for i in items if i >= 0)
    return [(n, hit, sorted(items)) for n, hit, items in out]


def _found(blocks: list, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]]:
    """Batches (row, text) with what scan_texts finds in each of their texts.

    The windows of one block are built once for a task; those of several, of which a worker holds one at a time, for every
    SCAN_BYTES of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        single = [WindowSet(blocks[0].value, width)] if len(blocks) == 1 else None
        held, size = [], 0

        def done() -> Iterator[tuple[pa.RecordBatch, list]]:
            texts = [t for batch in held for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found, at = scan_texts(texts, single or (WindowSet(b.value, width) for b in blocks)), 0
            for batch in held:
                yield batch, found[at : at + len(batch)]
                at += len(batch)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(blocks) < 2 or size >= SCAN_BYTES:
                yield from done()
                held, size = [], 0
        yield from done()

    return run


def _scan(blocks: list, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _found(blocks, width)(batches):
            spans = []
            for text, (_, hit, _) in zip(batch.column(1).cast(pa.binary()).to_pylist(), found):
                spans.append([])
                if hit.any():
                    start, end = word_spans(text)
                    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                    spans[-1] = [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in zip(edge[::2], edge[1::2])]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([int(hit.sum()) for _, hit, _ in found], pa.int64()),
                    pa.array([items for _, _, items in found], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["row", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcast blocks of at most BLOCK_BYTES of item text each, read one after the other."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8").alias("t"))
    out, block, size = [], [], 0
    for row in rows.toLocalIterator():
        text = bytes(row["t"] or b"")
        if block and size + len(text) > BLOCK_BYTES:
            out.append(sc.broadcast(block))
            block, size = [], 0
        block.append((row["i"], text))
        size += len(text)
    return [*out, sc.broadcast(block)] if block else out


def scan(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """row, n_words, n_hit (words inside an occurrence of an item's window), items (ids as strings, sorted), spans (byte
    ranges of maximal runs of hit words, from the first to the last word): a row for each row of docs, no shuffle.

    `row` is any column, structs too. Null and empty texts have no words. An item of fewer words than `width` is one window, one
    without words is never found. Items of a null id mark words but are not listed. Repeated rows stay; an empty
    benchmark hits nothing.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = T.StructType([rows.schema["row"]]).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", span)
    return rows.mapInArrow(_scan(_blocks(benchmark, item_col, item_text_col), width), schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", width: int = 10) -> DataFrame:
    """docs with every hit passage cut out of its text; a document of which no word is left goes.

    Documents without a hit are kept as they are (null and empty ones too). `chars_col`, where docs have it, is set to
    the new length. Other columns stay, whatever their names.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = _blocks(benchmark, "item_id", "text")
    tune(docs.sparkSession)
    find = _found(blocks, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in find(batches):
            texts, keep = [], []
            for text, (n, hit, _) in zip(batch.column(1).to_pylist(), found):
                if hit.any():
                    raw, at, parts = text.encode(), 0, []
                    start, end = word_spans(raw)
                    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                    for a, b in zip(edge[::2], edge[1::2]):
                        parts.append(raw[at : int(start[a])])
                        at = int(end[b - 1])
                    text = b"".join([*parts, raw[at:]]).decode()
                texts.append(text)
                keep.append(not (n and hit.all()))
            hits = pa.array([int(hit.sum()) for _, hit, _ in found], pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), hits], names=["row", "text", "n_hit"]).filter(pa.array(keep, pa.bool_()))

    done = packed.mapInArrow(run, T.StructType([packed.schema["row"]]).add("text", "string").add("n_hit", "long"))
    new = {text_col: F.when(F.col("n_hit") > 0, F.col("text")).otherwise(F.col("row").getField(text_col))}
    if chars_col in names:
        new[chars_col] = F.when(F.col("n_hit") > 0, F.char_length("text").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row").getField(chars_col))
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])
