"""Removal of repeated byte strings by sparse enhanced suffix arrays.

Every string of LENGTH bytes picks an anchor: the start of its CORE-byte substring of least hash. The choice depends on
the string alone, so equal strings have equal cores at equal places, and only suffixes that start at anchors need be
sorted. The suffixes of one core, wherever they are in the corpus, form a group: an interval of the corpus' suffix
array. Only cores that occur twice go on, and copies of the same surroundings (LENGTH - CORE bytes to either side) are
combined. A group's distinct surroundings are sorted by what is right of the core, a stack scan over their common
prefixes builds the interval tree, and for each interval the left extensions are compared: an interval whose members
extend differently to the left is a maximal repeat, and a member is repeated as far as its common prefix and its longest
common left extension with another member reach, if together with the core they have LENGTH bytes. All occurrences come
out, not just neighbours in the order.

A group of more than MOST distinct surroundings is cut into intervals of deeper common prefixes and left extensions
(PIECES of them), each a group of its own with a longer core and narrower surroundings, and so on until they fit.

Hashes of 64 bits only choose anchors and filter. Whatever decides that bytes go is a comparison of the bytes or of
their 128-bit BLAKE2b digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm.common import BYTE_VALUES, RangeHash, chunks, cut, cut_rows, join_spread, mix, tune

#: Bytes of a repeat, of the core that a group shares, distinct surroundings of a group that one task compares, and
#: parts of a group that has more.
LENGTH, CORE, MOST, PIECES = 400, 250, 4096, 13
#: Members that one task cuts in parts.
CUT_MEMBERS = 5000
#: Bytes of text that are hashed at once: some ten arrays of eight times that size.
CHUNK_BYTES = 1 << 18


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + width] for each i with a whole window (running blocks forwards and backwards)."""
    n = len(x)
    wide = -(-n // width) * width
    edge = np.zeros(wide, dtype=x.dtype) if op is np.maximum else np.full(wide, np.iinfo(x.dtype).max, dtype=x.dtype)
    edge[:n] = x
    blocks = edge.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of a chunk of documents: place in the chunk, document, 64-bit hash of the core."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, core: int = CORE) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.whole = b"".join(texts)
        raw = np.frombuffer(self.whole, dtype=np.uint8)
        self.place = self.doc = np.zeros(0, dtype=np.int64)
        self.key = np.zeros(0, dtype=np.int64)
        if len(raw) < length or sizes.max() < length:
            return
        at = np.arange(len(raw) - core + 1)
        h = RangeHash(BYTE_VALUES[raw])(at, at + core)
        width = length - core + 1
        least = _slide(h, width, np.minimum)  # for each string of `length` bytes, by its start
        end = np.repeat(self.starts[1:], sizes)
        whole = np.arange(len(least)) + length <= end[: len(least)]
        seen = np.where(whole, least, np.uint64(0))
        # a core is an anchor if it is the least of some whole string around it
        padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), seen, np.zeros(width - 1, dtype=np.uint64)])
        self.place = np.flatnonzero(_slide(padded, width, np.maximum)[: len(h)] == h)
        self.doc = np.searchsorted(self.starts, self.place, side="right") - 1
        self.key = mix(h[self.place] ^ np.uint64(core)).view(np.int64)


def _digest(x: bytes | memoryview, left: int = 0) -> bytes:
    """128 bits that stand for a string and the place of the anchor in it."""
    return hashlib.blake2b(x, digest_size=16, salt=left.to_bytes(4, "little")).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, d1, d2, text to the same with the text compressed; the rest of the job moves and stores texts in that form."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [squeeze(x or b"") for x in batch.column(3).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([*batch.columns[:3], pa.array(texts, pa.binary())], names=["id", "d1", "d2", "z"])


def _binary(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def _keys(length: int, core: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """z to key, n: how often a core's hash is an anchor in a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch.column(0))
            each = [Anchors(texts[a:b], length, core).key for a, b in chunks([len(t) for t in texts], CHUNK_BYTES)]
            key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    return run


def _anchors(length: int, core: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """d1, d2, z to key, c1, c2 (digest of the surroundings), d1, d2, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch.column(2))
            for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
                found = Anchors(texts[a:b], length, core)
                lo = np.maximum(found.starts[found.doc], found.place - (length - core))
                hi = np.minimum(found.starts[found.doc + 1], found.place + length)
                view = memoryview(found.whole)
                around = _halves([_digest(view[x:y], left) for x, y, left in zip(lo.tolist(), hi.tolist(), (found.place - lo).tolist())])
                rows = pa.array(found.doc + a)
                pos = pa.array((found.place - found.starts[found.doc]).astype(np.int32))
                yield pa.record_batch([pa.array(found.key), *around, batch.column(0).take(rows), batch.column(1).take(rows), pos], names=["key", "c1", "c2", "d1", "d2", "pos"])

    return run


# --- the interval tree of one group ------------------------------------------------------------------------------------


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], dtype=np.int64)
    out = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    return out, size


def _ordered(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order, and the common prefix of each string with the one before it in that order (the first: 0)."""
    rows, size = _matrix(strings, width)
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable") if width else np.arange(len(strings))
    rows, size = rows[order], size[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.r_[0, np.minimum(lcp, np.minimum(size[1:], size[:-1]))]


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """depth, first and last place of each interval of the common-prefix tree, by a scan with a stack; deeper ones first."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp[1:].tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


class RangeMin:
    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of x[a..b], both included; a <= b."""
        out = np.zeros(len(a), dtype=self.levels[0].dtype)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.levels[k][a[m]], self.levels[k][b[m] - (1 << int(k)) + 1])
        return out


def reaches(lefts: list[bytes], rights: list[bytes], copies: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """How far beyond the core, to the left and right, each of a group's distinct surroundings is repeated (-1: not at all).

    lefts: the bytes before the core, reversed; rights: those behind it; copies: how often the surroundings occur;
    slack: bytes that a repeat has beyond the core.
    """
    m = len(rights)
    lo, hi = np.full(m, -1, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    left_size, right_size = (np.array([len(s) for s in x], dtype=np.int64) for x in (lefts, rights))
    many = (copies > 1) & (left_size + right_size >= slack)
    lo[many], hi[many] = left_size[many], right_size[many]
    order, lcp = _ordered(rights, slack)
    left_order, left_lcp = _ordered(lefts, slack)
    rank = np.empty(m, dtype=np.int64)
    rank[left_order] = np.arange(m)
    least = RangeMin(left_lcp)
    for depth, first, last in intervals(lcp):
        if first == last:
            continue
        by_left = np.sort(rank[order[first : last + 1]])
        common = least(by_left[:-1] + 1, by_left[1:])
        # left-extension diversity: how far each member extends with the member most like it
        extent = np.maximum(np.r_[-1, common], np.r_[common, -1])
        fits = extent + depth >= slack
        member = left_order[by_left[fits]]
        lo[member] = np.maximum(lo[member], extent[fits])
        hi[member] = np.maximum(hi[member], depth)
    return lo, hi


_MEMBERS = "g1 bigint, g2 bigint, c1 bigint, c2 bigint, copies bigint, m bigint, left int, bytes binary"


def _groups(slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _MEMBERS (sorted by g1, g2) to g1, g2, c1, c2, lo, hi for what is repeated."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        g1, g2, copies, left = (rows[c].to_numpy() for c in ("g1", "g2", "copies", "left"))
        text = rows["bytes"].to_pylist()
        lefts = [t[:n][::-1] for t, n in zip(text, left)]
        rights = [t[n:] for t, n in zip(text, left)]
        lo, hi = np.full(len(g1), -1, dtype=np.int64), np.full(len(g1), -1, dtype=np.int64)
        first = np.flatnonzero(np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
        size = np.diff(np.r_[first, len(g1)])
        twos = first[size == 2]
        for at in range(0, len(twos), 2000):  # trees of one interval, side by side
            a = twos[at : at + 2000]
            far = []
            for strings in (rights, lefts):
                x, n = _matrix([strings[i] for i in a], slack)
                y, k = _matrix([strings[i + 1] for i in a], slack)
                differ = x != y
                far.append(np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), slack), np.minimum(n, k)))
            fits = far[0] + far[1] >= slack
            for shift in (0, 1):
                all_left, all_right = (np.array([len(strings[i]) for i in a + shift]) for strings in (lefts, rights))
                many = (copies[a + shift] > 1) & (all_left + all_right >= slack)
                lo[a + shift] = np.where(many, all_left, np.where(fits, far[1], -1))
                hi[a + shift] = np.where(many, all_right, np.where(fits, far[0], -1))
        for f, n in zip(first[size != 2].tolist(), size[size != 2].tolist()):
            lo[f : f + n], hi[f : f + n] = reaches(lefts[f : f + n], rights[f : f + n], copies[f : f + n], slack)
        hit = pa.array(np.flatnonzero(hi >= 0))
        whole = rows.take(hit).combine_chunks().select(["g1", "g2", "c1", "c2"])
        ends = [pa.array(x.astype(np.int32)).take(hit) for x in (lo, hi)]
        return pa.record_batch([*(c.combine_chunks() for c in whole.columns), *ends], names=["g1", "g2", "c1", "c2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = batch.column(0)[len(batch) - 1], batch.column(1)[len(batch) - 1]
            if (batch.column(0)[0], batch.column(1)[0]) == last and len(held) > 1 and (held[0].column(0)[0], held[0].column(1)[0]) == last:
                continue
            whole = pa.Table.from_batches(held)
            g1, g2 = whole["g1"].to_numpy(), whole["g2"].to_numpy()
            end = len(g1) - int(np.argmax(np.r_[((g1 != last[0].as_py()) | (g2 != last[1].as_py()))[::-1], True]))
            if end:  # all groups but the last one are complete
                yield solve(whole.slice(0, end))
            held = whole.slice(end).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _cut_out(length: int, core: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """z, at (list of c1, c2, copies, m, pos) to _MEMBERS: the group is the digest of the core, bytes what surrounds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = length - core
        for batch in batches:
            # rows of docs that are repeated come one after the other
            at = batch.column(1)
            new = [i for i in range(len(at)) if not i or at[i] != at[i - 1]]
            texts, at = _binary(batch.column(0).take(pa.array(new, pa.int64()))), at.take(pa.array(new, pa.int64()))
            flat, owner = at.flatten(), np.repeat(np.arange(len(at)), [len(x) for x in at])
            for a in range(0, len(flat), 2000):
                part = flat.slice(a, 2000)
                pos = part.field("pos").to_pylist()
                of = owner[a : a + 2000].tolist()
                group = _halves([_digest(texts[o][p : p + core]) for o, p in zip(of, pos)])
                left = pa.array([min(p, side) for p in pos], pa.int32())
                around = [texts[o][max(0, p - side) : p] + texts[o][p + core : p + length] for o, p in zip(of, pos)]
                yield pa.record_batch([*group, *(part.field(c) for c in ("c1", "c2", "copies", "m")), left, pa.array(around, pa.binary())], names=["g1", "g2", "c1", "c2", "copies", "m", "left", "bytes"])

    return run


def _narrow(slack: int, ranges: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _MEMBERS to p1, p2, q1, q2 (their group and surroundings) and, for each range (a, b) of left extensions, a
    member of the group of those that agree in what every repeat of that range covers; its surroundings are what some cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row in enumerate(batch.to_pylist()):
                left, right = row["bytes"][: row["left"]], row["bytes"][row["left"] :]
                for k, (a, b) in enumerate(ranges):
                    if len(left) < a or len(right) < slack - b:
                        continue
                    here, there = left[max(0, len(left) - b) :], right[: slack - a]
                    before, behind = here[: len(here) - a], there[slack - b :]
                    shared = here[len(here) - a :] + there[: slack - b]
                    origin = b"%d %d %d " % (k, row["g1"], row["g2"])
                    out.append((i, _digest(origin + shared), _digest(origin + here + there, len(here)), a, slack - b, row["copies"], len(before), before + behind))
            for at in range(0, len(out), 2000):
                part = out[at : at + 2000]
                of = pa.array([r[0] for r in part], pa.int64())
                owner = [batch.column(c).take(of) for c in ("g1", "g2", "c1", "c2")]
                numbers = [pa.array([r[k] for r in part], kind) for k, kind in ((3, pa.int32()), (4, pa.int32()), (5, pa.int64()), (6, pa.int32()))]
                columns = [*owner, *_halves([r[1] for r in part]), *_halves([r[2] for r in part]), *numbers, pa.array([r[7] for r in part], pa.binary())]
                yield pa.record_batch(columns, names=["p1", "p2", "q1", "q2", "g1", "g2", "c1", "c2", "a", "b", "copies", "left", "bytes"])

    return run


_PARTS = "p1 bigint, p2 bigint, q1 bigint, q2 bigint, g1 bigint, g2 bigint, c1 bigint, c2 bigint, a int, b int, copies bigint, left int, bytes binary"


def sized(each: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """each (materialised) with m, the rows that share its values of `by`; the rows of one value are dealt over several tasks."""
    return join_spread(each, each.groupBy(*by).agg(F.count("*").alias("m")), by, tie, size="m")


def settle(each: DataFrame, surroundings: Callable[[DataFrame], DataFrame], slack: int, most: int, pieces: int = PIECES) -> DataFrame:
    """g1, g2, c1, c2, lo, hi: how far beyond the core what is repeated of `each` is so.

    each: a row, with m, for each member; m is at least the size of its group. surroundings: those rows to _MEMBERS.
    """
    if slack == 0:  # the cores are the repeats
        return each.where("copies > 1").select("g1", "g2", "c1", "c2", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    fit = surroundings(each.where(F.col("m") <= most)).repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    done = fit.mapInArrow(_groups(slack), "g1 bigint, g2 bigint, c1 bigint, c2 bigint, lo int, hi int")
    large = each.where(F.col("m") > most)
    if not (many := large.count()):
        return done
    # ranges of left extensions, all of one width; the last two may overlap
    values = -(-(slack + 1) // pieces)
    ranges = [(a, a + values - 1) for a in (min(k * values, slack + 1 - values) for k in range(-(-(slack + 1) // values)))]
    many *= len(ranges)
    parts = cut_rows(surroundings(large).mapInArrow(_narrow(slack, ranges), _PARTS), many, CUT_MEMBERS)
    member = ["g1", "g2", "c1", "c2"]
    narrow = cut_rows(parts.groupBy(*member).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.min("left").alias("left"), F.min("bytes").alias("bytes")), many)
    each = narrow.withColumn("m", F.lit(1).cast("bigint"))
    if values > 1 and not narrow.groupBy("g1", "g2").agg(F.count("*").alias("m")).where(F.col("m") > most).isEmpty():
        each = cut_rows(sized(narrow, ["g1", "g2"], ["c1", "c2"]), many)
    names = [x.split()[0] for x in _MEMBERS.split(", ")]
    found = settle(each, lambda rows: rows.select(names), values - 1, most, pieces)
    back = join_spread(parts.drop("bytes"), found, member, ["q1", "q2"], narrow)
    back = back.groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2"), F.col("q1").alias("c1"), F.col("q2").alias("c2")).agg(F.max(F.col("lo") + F.col("a")).alias("lo"), F.max(F.col("hi") + F.col("b")).alias("hi"))
    return done.union(back)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, z, ranges to id, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        out = []
        for text, ranges in zip(_binary(batch.column(1)), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for r in sorted((max(0, x["a"]), min(len(text), x["b"])) for x in ranges or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            out.append((len(text), sum(b - a for a, b in merged), len(merged), b"".join([*kept, text[at:]]) if merged else text))
        for lo in range(0, len(out), 250):
            part = out[lo : lo + 250]
            yield pa.record_batch([batch.column(0).slice(lo, 250), *(pa.array([r[k] for r in part], pa.int64()) for k in range(3)), pa.array([r[3] for r in part], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, core: int = CORE, most: int = MOST) -> DataFrame:
    """d1, d2, ranges: byte ranges (a, b), perhaps overlapping or past the ends, of docs(d1, d2, z: compressed text) that
    strings repeated anywhere cover."""
    slack = length - core
    keys = docs.select("z").mapInArrow(_keys(length, core), "key bigint, n bigint")
    often = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").persist(StorageLevel.DISK_ONLY)
    total = often.agg(F.sum("n")).first()[0] or 0
    spots = docs.select("d1", "d2", "z").mapInArrow(_anchors(length, core), "key bigint, c1 bigint, c2 bigint, d1 bigint, d2 bigint, pos int")
    met = cut_rows(join_spread(spots, often, ["key"], ["d1", "pos"]).drop("n"), total)
    often.unpersist()
    # copies of the same surroundings are one member, combined before the shuffle
    each = cut_rows(met.groupBy("key", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("d1", "d2", "pos")).alias("at")), total)
    each = cut_rows(sized(each, ["key"], ["c1", "c2"]).where("m > 1 OR copies > 1"), total)

    def surroundings(rows: DataFrame) -> DataFrame:
        by_doc = rows.groupBy("at.d1", "at.d2").agg(F.collect_list(F.struct("c1", "c2", "copies", "m", "at.pos")).alias("at"))
        return docs.join(by_doc, ["d1", "d2"]).select("z", "at").mapInArrow(_cut_out(length, core), _MEMBERS)

    # the groups proper are those of the core's digest; a key may hold several of them by a collision
    members = each.where("m > 1").withColumns({"g1": F.lit(None).cast("bigint"), "g2": F.lit(None).cast("bigint")})
    reach = settle(members, surroundings, slack, most).select("c1", "c2", "lo", "hi")
    same = each.where("m = 1").select("c1", "c2", F.lit(slack).alias("lo"), F.lit(slack).alias("hi"))
    covered = join_spread(met.drop("key"), reach.union(same), ["c1", "c2"], ["d1", "pos"], each, "copies")
    span = F.struct((F.col("pos") - F.col("lo")).alias("a"), (F.col("pos") + core + F.col("hi")).alias("b"))
    return cut_rows(covered.groupBy("d1", "d2").agg(F.collect_set(span).alias("ranges")), total)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE, most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary): a row for each row of docs.

    Each byte goes that a string of `length` bytes covers which also starts anywhere else in the texts, judged on the
    input. Null and empty texts have no bytes, texts shorter than `length` keep all theirs. Repeated rows, null ids too,
    are occurrences like any other. An empty table gives an empty one.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("d1"), F.xxhash64("text", F.lit(1), "id").alias("d2"), "text")
    # one shuffle of the texts, compressed, dealt by document for good: both joins with them find them in place
    kinds = T.StructType([rows.schema["id"]]).add("d1", "long").add("d2", "long").add("z", "binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.select("id", "d1", "d2", "text").mapInArrow(_pack, kinds).repartition(parts, "d1", "d2"))
    ranges = repeated_ranges(rows.select("d1", "d2", "z"), length, core, most)
    done = rows.join(ranges, ["d1", "d2"], "left").select("id", "z", "ranges")
    schema = T.StructType([rows.schema["id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return done.mapInArrow(_remove, schema)
