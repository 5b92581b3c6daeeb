"""Packing of tokenised documents into sequences: first-fit decreasing on a tournament tree of bin capacities.

Documents are tokenised and cut into pieces of at most the sequence length; the pieces are dealt at random to groups of
a bounded number of tokens, and each group is packed on its own: pieces in decreasing length, each into the first open
sequence with room. The tree holds the most room below each node, so a sequence is found in logarithmic time.
"""

from __future__ import annotations

import functools
import itertools
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm.common import tune

#: Documents of a group, about. A group holds its pieces' ids (2 or 4 bytes each) in one task.
GROUP_DOCS = 1000
#: Bytes of text of a group, if its documents are long.
GROUP_BYTES = 32 << 20
#: Distinct words whose ids a worker remembers.
REMEMBERED = 600_000


class Tournament:
    """First-fit on a tree of capacities: each inner node holds the largest room among the bins below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size`, and the room that it had."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        had = room[i]
        room[i] -= size
        at = i - self.leaves
        self.used = max(self.used, at + 1)
        i //= 2
        while i:
            room[i] = max(room[2 * i], room[2 * i + 1])
            i //= 2
        return at, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; every size is 1 to capacity. Ties keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = Tournament(max(1, len(sizes) - full), capacity)
    for i in order[full:].tolist():
        at, had = tree.place(int(sizes[i]))
        bins[i], offsets[i] = full + at, capacity - had
    return bins, offsets


def classes_of_chars() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = k
    out[0xD800:0xE000] = 0
    return out


class Encoder:
    """Ids of a byte-level BPE file (tokenizers JSON, GPT-2 split), the same as `tokenizers` gives with add_special_tokens=False.

    The text is cut into words by vector operations on its code points; each distinct word is encoded once by BPE over
    the file's own vocabulary and remembered. Texts that hold an added token, and files of any other make, are left to `tokenizers` itself. (`tokenizers` takes over 2.5 times as long.)
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.slow.get_vocab_size()
        self.kind = "H" if self.size <= 1 << 16 else "I"
        self.words: dict[str, bytes] = {}
        #: Texts that hold one of these are cut at it, by the file's own rules for it.
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.core = self._core(spec)
        self.kinds = classes_of_chars() if self.core else None
        self.few = self.kinds[:256].copy() if self.core else None

    def _core(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if any(x >= y for x, y in itertools.pairwise(ids)):  # ids must stand in the order of the merges
            return None
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        return tiktoken.Encoding("own", pat_str=r"\s\S", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def pieces(self, text: str) -> list[str]:
        """The words of a text: contractions, runs of letters, numbers or others with one space before, white space."""
        try:
            code = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
            kind = self.few[code]
        except UnicodeEncodeError:
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            kind = self.kinds[code]
        n = len(code)
        start = np.ones(n + 1, dtype=bool)
        start[1:n] = kind[1:] != kind[:-1]
        white = kind == 3
        # a run of white space gives its last character away: a space joins the next run, any other stands alone
        last = np.flatnonzero(white[:-1] & ~white[1:])
        start[last] = True
        joins = last[code[last] == 32]
        start[joins + 1] = False
        # 's 't 're 've 'm 'll 'd where an apostrophe starts a run of its own and no space was joined to it
        tick = np.flatnonzero((code[:-1] == 39) & (kind[1:] == 1) & start[:-2][: n - 1]) if n > 1 else []
        for i in tick:
            for c in ("s", "t", "re", "ve", "m", "ll", "d"):
                if text.startswith(c, i + 1):
                    start[i + 1] = False
                    start[i + 1 + len(c)] = True
                    break
        cut = np.flatnonzero(start).tolist()
        return [text[a:b] for a, b in itertools.pairwise(cut)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 16-bit numbers (32-bit ones if the file has over 65,536 ids)."""
        if not text:
            return b""
        if self.core is None or any(x in text for x in self.added):
            return array(self.kind, self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        words, cut = self.words, self.pieces(text)
        try:
            return b"".join([words[w] for w in cut])
        except KeyError:
            pass
        if len(words) >= REMEMBERED:
            words.clear()
        core, kind = self.core.encode_single_piece, self.kind
        for w in cut:
            if w not in words:
                words[w] = array(kind, core(w.encode())).tobytes()
        return b"".join([words[w] for w in cut])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process: what it remembers serves later tasks."""
    return Encoder(path)


def _tokenise(path: str, end_id: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = array(own.kind, [end_id]).tobytes()
        width = len(end)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                row, start, total, ids = [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    every = own.encode(text or "") + end
                    for a in range(0, len(every), length * width):
                        row.append(k)
                        start.append(a // width)
                        total.append(len(every) // width)
                        ids.append(every[a : a + length * width])
                yield pa.record_batch(
                    [*(part.column(c).take(pa.array(row, pa.int64())) for c in (0, 2)), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(row), pa.int32())],
                    names=["row", "group", "start", "doc_tokens", "ids", "width"],
                )

    return run


def _pack(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        width = group["width"].to_numpy().astype(np.int64)
        sizes = np.array([len(x.as_buffer()) for x in group["ids"]], dtype=np.int64) // width
        bins, offsets = first_fit_decreasing(sizes, capacity)
        wide = [np.frombuffer(x, dtype=np.uint16 if w == 2 else np.uint32).astype("<u4").tobytes() for x, w in zip(group["ids"].to_pylist(), width)]
        out = pa.table(
            {
                "row": group["row"], "start": group["start"], "length": pa.array(sizes), "doc_tokens": group["doc_tokens"],
                "sequence_id": pa.array((group["group"].to_numpy().astype(np.int64) << 32) + bins), "offset": pa.array(offsets), "ids": pa.array(wide, pa.binary()),
            }
        )
        yield from out.combine_chunks().to_batches(max_chunksize=1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else []
            for a, b in itertools.pairwise(edges):
                if rest and rest[-1].column("group")[0].as_py() != int(group[a]):
                    yield from one(pa.Table.from_batches(rest))
                    rest = []
                rest.append(batch.slice(a, b - a))
        if rest:
            yield from one(pa.Table.from_batches(rest))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, group_docs: int = GROUP_DOCS) -> DataFrame:
    """id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit), a row for each piece.

    tokenizer: path of a tokenizers JSON file, readable on every executor. A document is its ids and then end_id, so a null or
    empty text is one token. Pieces of a document hold each id once, in order; offsets in a sequence have no gap. Every
    sequence is padded to `length` by the reader. Null ids and repeated rows are packed like any other; an empty table
    gives no piece. Documents are dealt to random groups of about group_docs of them, fewer where they are long, so that a
    group has about GROUP_BYTES of text at most, or one document more; equal rows, however many, spread over all groups.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("bigint"))).first()
    groups = max(1, -(-n // group_docs), -(-(size or 0) // GROUP_BYTES))
    rows = rows.withColumn("group", F.floor(F.rand(17) * groups).cast("bigint"))
    cut_schema = T.StructType([rows.schema["row"]]).add("group", "long").add("start", "long").add("doc_tokens", "long").add("ids", "binary").add("width", "integer")
    pieces = rows.mapInArrow(_tokenise(tokenizer, end_id, length), cut_schema)
    dealt = pieces.repartition("group").sortWithinPartitions("group")
    schema = T.StructType([rows.schema["row"]])
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return dealt.mapInArrow(_pack(length), schema.add("ids", "binary")).withColumnRenamed("row", "id")
