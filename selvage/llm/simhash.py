"""SimHash near-duplicate detection on a Gray-order hierarchical index.

A fingerprint has 64 bits a word, one word or several. Fingerprints are first reduced to distinct ones, so exact copies
cost one row. Each distinct fingerprint goes to a few tables by the value of some of its bits (by the pigeonhole
principle no link within the radius is lost with one word). The rows of one table and value are sorted by Gray rank and
searched by an index whose upper nodes hold the bits that all fingerprints below share; the differences found on the
way down add up, and a group is left as soon as they exceed the radius. Each group gives a forest of links, never all
pairs, and the links of all groups are joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import CHUNK_BYTES, chunks, components, cut, cut_rows, forest, join_spread, mix, tune

#: Sequences longer than this are hashed in parts, to bound memory.
PART = 1 << 16
#: Children of an index node, and fingerprints of a leaf.
FANOUT = 8
#: A value that more distinct fingerprints share is dealt out by further bits.
MOST = 1 << 13

#: Each bit of a byte in a byte lane of its own; up to 255 such words add up without carry.
_LANES = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words of a text, A-Z in lower case, joined by single spaces.

    Words are separated by space and U+0009 to U+000D. A text of fewer words is one shingle, a text of none has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, 42)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:])]


def vote(hashes: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints (rows of `words` uint64) of documents that have the next sizes[i] hashes each: a bit is set if over
    half of its document's hashes have it. No hashes: zero."""
    counts = np.zeros((len(sizes), words * 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), PART):
        h, own = hashes[at : at + PART], owner[at : at + PART]
        # parts of at most 255 hashes of one document
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        run = np.arange(len(h)) - np.repeat(new, np.diff(np.r_[new, len(h)]))
        first = np.flatnonzero(run % 255 == 0)
        for w in range(words):
            bits = h if w == 0 else mix(h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            lanes = _LANES[bits.astype(">u8").view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(lanes, first, axis=0)
            np.add.at(counts[:, w * 64 : w * 64 + 64], own[first], sums.view(np.uint8).reshape(len(first), 64))
    on = counts * 2 > sizes[:, None]
    return np.packbits(on, axis=1).view(">u8").astype(np.uint64).reshape(len(sizes), words)


def _fingerprint(width: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = [len(t) if (t := x.as_buffer()) is not None else 0 for x in texts]
            for a, b in chunks(sizes, CHUNK_BYTES):
                each = [shingle_hashes(x, width) for x in texts.slice(a, b - a).to_pylist()]
                n = np.array([len(h) for h in each], dtype=np.int64)
                flat = np.fromiter((v for h in each for v in h), dtype=np.uint64, count=int(n.sum()))
                prints = vote(flat, n, words)
                out = pa.array(prints.astype("<u8").view(np.int64).ravel())
                if words > 1:
                    out = pa.array([p.astype(">u8").tobytes() for p in prints], type=pa.binary())
                yield pa.record_batch([batch.column(0).slice(a, b - a), out, pa.array(n)], names=["id", "fp", "n_shingles"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """id, fp (long for one word, else binary, big-endian), n_shingles, a row for each row of docs.

    Null and empty texts and texts of white space have no shingle and the fingerprint zero. Null ids and repeated rows
    are kept as they are. Other columns are not read.
    """
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint(width, words), f"id {kind}, fp {'bigint' if words == 1 else 'binary'}, n_shingles bigint")


# --- the index ---------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Distinct fingerprints (rows of uint64 words) in Gray order under nodes that hold what all below them share."""

    def __init__(self, prints: np.ndarray) -> None:
        self.order = np.lexsort([gray_rank(prints[:, w]) for w in reversed(range(prints.shape[1]))])
        self.prints = prints[self.order]
        mask, value = np.full_like(self.prints, np.uint64(0xFFFFFFFFFFFFFFFF)), self.prints
        self.levels = []  # from the leaves up: the bits that a node fixes beyond its parent, and their values
        while len(value) > FANOUT:
            at = np.arange(0, len(value), FANOUT)
            up_and = np.bitwise_and.reduceat(value, at, axis=0)
            up_or = np.bitwise_or.reduceat(value, at, axis=0)
            up_mask = np.bitwise_and.reduceat(mask, at, axis=0) & ~(up_and ^ up_or)
            up_value = up_and & up_mask
            parent = np.arange(len(value)) // FANOUT
            self.levels.append((mask & ~up_mask[parent], value))
            mask, value = up_mask, up_value & up_mask
        self.levels.append((mask, value))

    def search(self, queries: np.ndarray, radius: int, own: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in self.order) of at most `radius` differing bits, but for those already joined.

        own: the component of each query so far; label: that of each place. A node whose places are all of the
        query's own component is left, so a dense group costs little more than its first queries.
        """
        alike = [label]
        for _ in self.levels[1:]:
            at = np.arange(0, len(alike[-1]), FANOUT)
            low, high = np.minimum.reduceat(alike[-1], at), np.maximum.reduceat(alike[-1], at)
            alike.append(np.where((low == high) & (low >= 0), low, -1))
        n = len(self.levels[-1][1])
        q = np.repeat(np.arange(len(queries)), n)
        node = np.tile(np.arange(n), len(queries))
        far = np.zeros(len(q), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, value = self.levels[depth]
            keep = alike[depth][node] != own[q]
            q, node, far = q[keep], node[keep], far[keep]
            far = far + np.bitwise_count((queries[q] ^ value[node]) & mask[node]).sum(axis=1, dtype=np.int64)
            keep = far <= radius
            q, node, far = q[keep], node[keep], far[keep]
            if depth:
                below = len(self.levels[depth - 1][1])
                q, far = np.repeat(q, FANOUT), np.repeat(far, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < below
                q, node, far = q[inside], node[inside], far[inside]
        return q, node


def link_forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each distinct fingerprint of a group, the first one of its component by links of at most `radius` bits."""
    index = GrayIndex(prints)
    label = np.arange(len(prints))
    at, step, most = 0, 16, max(16, (1 << 19) // (len(prints) * prints.shape[1]))
    while at < len(prints):
        q, found = index.search(prints[at : at + step], radius, label[at : at + step], label[index.order])
        if len(q):
            label = forest(len(prints), q + at, index.order[found], label)
        at, step = at + step, min(most, step * 2)
    return label


def _group_links(radius: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows key, fp (sorted by key) to links a, b of fingerprints; a group is held only as far as its own key."""

    def links(key: np.ndarray, fp: pa.Array) -> pa.RecordBatch:
        if words == 1:
            prints = fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
        else:
            prints = np.frombuffer(b"".join(fp.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        a_all, b_all = [], []
        # groups that fit a leaf are a leaf: compare them side by side
        small = np.repeat(size <= FANOUT, size)
        place = np.repeat(first + size, size)
        for shift in range(1, FANOUT):
            i = np.flatnonzero(small[: len(key) - shift] & (np.arange(len(key) - shift) + shift < place[: len(key) - shift])) if len(key) > shift else np.empty(0, int)
            near = np.bitwise_count(prints[i] ^ prints[i + shift]).sum(axis=1, dtype=np.int64) <= radius
            a_all.append(i[near])
            b_all.append(i[near] + shift)
        for f, n in zip(first[size > FANOUT], size[size > FANOUT]):
            label = link_forest(prints[f : f + n], radius)
            i = np.flatnonzero(label != np.arange(n))
            a_all.append(f + i)
            b_all.append(f + label[i])
        a, b = np.concatenate(a_all).astype(np.int64), np.concatenate(b_all).astype(np.int64)
        return pa.record_batch([fp.take(pa.array(a)), fp.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = pa.int64()
        rest: list[pa.Table] = []
        for batch in batches:
            rest.append(pa.table({"key": batch.column(0).cast(key_type), "fp": batch.column(1)}))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys) or keys[0] == keys[-1] and sum(len(t) for t in rest) < 1 << 22:
                continue
            whole = pa.concat_tables(rest).combine_chunks()
            key = whole["key"].to_numpy()
            end = int(np.searchsorted(key, key[-1])) if np.all(key[1:] >= key[:-1]) else len(key) - int(np.argmax((key != key[-1])[::-1]))
            if end:
                yield links(key[:end], whole["fp"].slice(0, end).combine_chunks())
            rest = [whole.slice(end)]
        if rest:
            whole = pa.concat_tables(rest).combine_chunks()
            if len(whole):
                yield links(whole["key"].to_numpy(), whole["fp"].combine_chunks())

    return run


def _pairs_of(n: int, k: int) -> list[tuple[int, ...]]:
    import itertools

    return list(itertools.combinations(range(n), k))


def block_masks(radius: int = 2, blocks: int = 4) -> list[int]:
    """64-bit masks: every choice of blocks - radius of the blocks; two words of at most `radius` differing bits agree
    on one of the masks."""
    width = 64 // blocks
    return [sum(((1 << width) - 1) << (width * i) for i in kept) for kept in _pairs_of(blocks, blocks - radius)]


def finer_masks(mask: int, radius: int = 2, blocks: int = 4) -> list[int]:
    """Masks that fix the bits of `mask` and all but `radius` of the blocks of the other bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [free[len(free) * i // blocks : len(free) * (i + 1) // blocks] for i in range(blocks)]
    return [mask | sum(1 << i for k in kept for i in parts[k]) for kept in _pairs_of(blocks, blocks - radius)]


def _long(x: int) -> str:
    return f"CAST({x - (1 << 64) if x >> 63 else x} AS BIGINT)"


def _keyed(masks: list[int], salt: int) -> str:
    return "array(" + ", ".join(f"xxhash64(fp & {_long(m)}, {salt + i})" for i, m in enumerate(masks)) + ")"


def radius_links(prints: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """Links a, b (a forest for each group) among distinct 64-bit fingerprints prints(fp) of at most `radius` bits apart.

    A key is a hash of the masked bits; groups that fall together by a collision of hashes are only compared in vain.
    Keys of over `most` fingerprints are dealt out by finer masks, up to twice: then 8 of 64 bits are free for a radius
    of 2, so no group can outgrow a task.
    """
    keys = prints.select("fp", F.posexplode(F.expr(_keyed(block_masks(radius), 0))).alias("i", "key"))
    ready = None
    for level in (1, 2):
        hot = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        marked = keys.join(hot, "key", "left")
        cool = marked.where("hot IS NULL").select("key", "fp")
        ready = cool if ready is None else ready.union(cool)
        top = block_masks(radius)
        finer = [[m for t in top for m in finer_masks(t, radius)]] if level == 1 else [[f for t in top for m in finer_masks(t, radius) for f in finer_masks(m, radius)]]
        per = len(finer[0]) // (len(top) if level == 1 else len(top) * len(finer_masks(top[0], radius)))
        table_of = F.array(*[F.expr(_keyed(finer[0][i : i + per], 1000 * level + i)) for i in range(0, len(finer[0]), per)])
        keys = marked.where("hot").select("fp", "i", F.posexplode(table_of[F.col("i")]).alias("j", "key")).select("fp", (F.col("i") * per + F.col("j")).alias("i"), "key")
    ready = keys.select("key", "fp") if ready is None else ready.union(keys.select("key", "fp"))
    dealt = ready.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_group_links(radius, 1), "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """id, fp (long), component_id (the smallest id reachable by links, itself included): a row for each row of docs.

    Links join fingerprints of at most `radius` (up to 2) differing bits, equal ones too. Documents without a word have
    the fingerprint zero and are linked like any other. Rows of a null id are linked like any other; a component of null
    ids only has a null component_id. Repeated rows stay. An empty table gives an empty one.
    """
    own = cut(fingerprints(docs, id_col, text_col, width).select("id", "fp"))
    distinct = cut(own.groupBy("fp").agg(F.min("id").alias("low")))
    found = components(radius_links(distinct.select("fp"), radius))
    labelled = distinct.join(found, distinct.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    of = labelled.join(least, "label").select("fp", "component_id")
    return own.join(of, "fp").select("id", "fp", "component_id")


# --- near copies: candidates by minima and wide fingerprints, links by the sets themselves ---------------------------

#: Words of 64 bits of a wide fingerprint. Minima of the shingle hashes that make a key: two sets of similarity s agree on a
#: key with s**ROWS. The share of pairs at the required similarity that may have no key in common.
WIDE, ROWS, LOST = 8, 4, 1e-4
#: Texts of a checkpointed partition.
TEXT_ROWS = 2000


def similar_radius(similarity: float, words: int = WIDE) -> int:
    """Differing bits that shingle sets of that Jaccard similarity (and equal sizes) have on average."""
    cosine = 2 * similarity / (1 + similarity)
    return round(words * 64 * math.acos(min(1.0, cosine)) / math.pi)


def candidate_radius(similarity: float, words: int = WIDE) -> int:
    """The mean plus 6.5 deviations: sets of few shingles, whose bits are often ties, have a mean up to 2.3 deviations higher
    (four shingles of five: 96 bits at a similarity of 0.8)."""
    mean = similar_radius(similarity, words)
    return mean + math.ceil(6.5 * math.sqrt(mean * (1 - mean / (words * 64))))


def key_count(similarity: float) -> int:
    """Keys of which pairs of that similarity share one but for a part of LOST."""
    return 1 if similarity >= 1 else math.ceil(math.log(LOST) / math.log1p(-(similarity**ROWS)))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def minima_keys(hashes: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """`count` keys (rows of int64) of each set; sets[i] are the next sizes[i] hashes. Those of empty sets mean nothing."""
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), count), dtype=np.uint64)
    if not len(full):
        return out.view(np.int64)
    first = (np.cumsum(sizes) - sizes)[full]
    odd = mix(np.arange(1, count * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(count):
        key = np.full(len(full), k, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key + np.minimum.reduceat(hashes * odd[k * ROWS + r], first) + np.uint64(0x9E3779B97F4A7C15))
        out[full, k] = key
    return out.view(np.int64)


def _profiles(width: int, count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows id, text to id, node (a hash of the set), n (its size), fp, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = [len(t) if (t := x.as_buffer()) is not None else 0 for x in texts]
            for a, b in chunks(sizes, CHUNK_BYTES):
                each = [shingle_set(x, width) for x in texts.slice(a, b - a).to_pylist()]
                n = np.array([len(h) for h in each], dtype=np.int64)
                flat = np.concatenate(each)
                node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in each], dtype=np.uint64).view(np.int64)
                prints = pa.array([p.astype(">u8").tobytes() for p in vote(flat, n, WIDE)], type=pa.binary())
                at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * count)
                keys = pa.ListArray.from_arrays(at, pa.array(minima_keys(flat, n, count).ravel()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(node), pa.array(n), prints, keys], names=["id", "node", "n", "fp", "keys"])

    return run


def _spanning(a: np.ndarray, b: np.ndarray, parent: list[int]) -> list[int]:
    """Places of the links a-b (a < b), by a and b, that join what was not joined; parent is brought up to date."""
    out = []
    for i in np.lexsort([b, a]).tolist():
        x, y = int(a[i]), int(b[i])
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _candidates(radius: int, similarity: float, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows key, node, n, fp, own (sorted by key and node) to a few pairs of nodes a < b of one key that may be similar: every
    node that has such a pair is in one that comes out.

    every: to the rows (as a, b: key, node) that have such a pair with a node of a different `own`.
    """

    def may(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(n[a], n[b]) / np.maximum(n[a], n[b]) >= similarity

    def large(prints: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(prints)
        m = len(prints)
        label, parent = own if every else np.arange(m), list(range(m))
        at, step, most = 0, 16, max(16, (1 << 19) // (m * prints.shape[1]))
        a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while at < m:
            q, found = index.search(prints[at : at + step], radius, label[at : at + step], label[index.order])
            q, found = q + at, index.order[found]
            if every:
                keep = (q < found) & (label[q] != label[found])
            else:
                keep = q != found
            q, found = q[keep], found[keep]
            keep = may(n, q, found)
            a, b = np.minimum(q, found)[keep], np.maximum(q, found)[keep]
            if not every and len(a):
                new = _spanning(a, b, parent)
                a, b = a[new], b[new]
                label = forest(m, a, b, label)
            if every:
                a = b = np.unique(np.r_[a, b])
            a_all.append(a)
            b_all.append(b)
            at, step = at + step, min(most, step * 2)
        return np.concatenate(a_all), np.concatenate(b_all)

    def links(t: pa.Table) -> pa.RecordBatch:
        key, node, n, own = (t[c].to_numpy() for c in ("key", "node", "n", "own"))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        end = np.repeat(first + size, size)
        fit = np.repeat((size > 1) & (size <= FANOUT), size)
        prints = np.frombuffer(b"".join(t["fp"].to_pylist()), dtype=">u8").astype(np.uint64).reshape(len(key), -1)
        a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for shift in range(1, FANOUT):
            i = np.flatnonzero(fit[:-shift] & (np.arange(len(key) - shift) + shift < end[:-shift])) if len(key) > shift else np.empty(0, np.int64)
            i = i[(own[i] != own[i + shift]) & may(n, i, i + shift)]
            i = i[np.bitwise_count(prints[i] ^ prints[i + shift]).sum(axis=1, dtype=np.int64) <= radius]
            a_all.append(i)
            b_all.append(i + shift)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        if not every and len(a):  # the first partner of each row
            low = np.full(len(key), len(key))
            np.minimum.at(low, a, b)
            np.minimum.at(low, b, a)
            i = np.flatnonzero(low < len(key))
            a, b = np.minimum(i, low[i]), np.maximum(i, low[i])
        a_all, b_all = [a], [b]
        for f, m in zip(first[size > FANOUT].tolist(), size[size > FANOUT].tolist()):
            x, y = large(prints[f : f + m], n[f : f + m], np.unique(own[f : f + m], return_inverse=True)[1])
            a_all.append(f + x)
            b_all.append(f + y)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        if every:
            i = np.unique(np.r_[a, b])
            return pa.record_batch([pa.array(key[i]), pa.array(node[i])], names=["a", "b"])
        a, b = node[a], node[b]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _whole_keys(links, 1 << 15)


def _whole_keys(links: Callable[[pa.Table], pa.RecordBatch], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by key to the result of links on tables of whole keys; about `most` rows or one key are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            rest.append(pa.Table.from_batches([batch]))
            held += len(batch)
            if held < most or batch.column(0)[0] == batch.column(0)[len(batch) - 1]:
                continue
            whole = pa.concat_tables(rest).combine_chunks()
            end = int(np.searchsorted(whole["key"].to_numpy(), whole["key"][len(whole) - 1].as_py()))
            yield links(whole.slice(0, end).combine_chunks())
            rest, held = [whole.slice(end)], len(whole) - end
        if rest:
            yield links(pa.concat_tables(rest).combine_chunks())

    return run


def _settle(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows key, node, own, text (sorted by key and node) to links of nodes of one key of that similarity, that with `own`
    join all such nodes."""

    def group(node: np.ndarray, own: np.ndarray, texts: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
        each = [shingle_set(x.cast(pa.binary()).as_py(), width) for x in texts]
        size = np.array([len(x) for x in each])
        start = np.cumsum(size) - size
        flat = np.concatenate(each)
        del each
        label = np.unique(own, return_inverse=True)[1]
        for q in range(len(node) - 1):
            j = q + 1 + np.flatnonzero(label[q + 1 :] != label[q])
            j = j[np.minimum(size[j], size[q]) / np.maximum(size[j], size[q]) >= similarity]
            if not len(j):
                continue
            mine = flat[start[q] : start[q] + size[q]]
            common = np.empty(len(j), dtype=np.int64)
            for a, b in chunks(size[j].tolist(), 1 << 16):
                n = size[j[a:b]]
                first = np.cumsum(n) - n
                other = flat[np.arange(n.sum()) + np.repeat(start[j[a:b]] - first, n)]
                place = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                common[a:b] = np.add.reduceat((mine[place] == other).astype(np.int64), first)
            j = j[common / (size[j] + size[q] - common) >= similarity]
            for x, k in zip(*(v.tolist() for v in np.unique(label[j], return_index=True))):
                yield int(node[q]), int(node[j[k]])
                label[label == x] = label[q]

    def links(t: pa.Table) -> pa.RecordBatch:
        key, node, own = (t[c].to_numpy() for c in ("key", "node", "own"))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
        found = [x for a, b in zip(first, first[1:]) for x in group(node[a:b], own[a:b], t["text"].slice(a, b - a))]
        return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _whole_keys(links, 1000)


def _verify(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows a, b, text_a, text_b to those a, b whose shingle sets are that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[int, np.ndarray]] = {}

        def of(side: str, node: int, text: pa.Scalar) -> np.ndarray:
            if side not in last or last[side][0] != node:
                last[side] = node, shingle_set(text.cast(pa.binary()).as_py(), width)
            return last[side][1]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                one, two = of("a", a, x), of("b", b, y)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common / (len(one) + len(two) - common) >= similarity)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of pairs(a, b), materialised, whose texts(node, text) have shingle sets of at least that similarity.

    The pairs of a node that has many are dealt to several tasks.
    """
    read = pairs
    for side in ("a", "b"):
        told = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
        read = join_spread(read, told, [side], ["a", "b"], pairs.groupBy(side).agg(F.count("*").alias("n")))
    return read.select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, similarity), "a bigint, b bigint")


def block_pairs(rows: DataFrame, most: int) -> DataFrame:
    """rows(key, node, ...) with a key of over `most` rows cut in blocks: a row goes to a key of its own for each pair of its
    block with a block, so any two rows of the key still meet, and no key has more than about 2 * most rows.

    Keys that collide by their hash are only compared in vain.
    """
    hot = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
    if hot.isEmpty():
        return rows
    hot = cut(hot)
    met = join_spread(rows, hot, ["key"], ["node"], size="size", how="left")
    blocks = F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int")
    dealt = met.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.when(blocks > 1, F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.col("key"))
    return dealt.select(*[key.alias(c) if c == "key" else F.col(c) for c in rows.columns])


def similar_links(sets: DataFrame, text_of: Callable[[DataFrame], DataFrame], width: int, similarity: float, most: int = MOST) -> DataFrame:
    """Links a, b among distinct sets(node, n, fp, keys) whose components are those of all pairs of that similarity.

    First a few candidates of each key are compared. The nodes of a key that may be similar to one they are not joined with
    then meet with their texts, and every such pair of them is compared, but for those joined on the way.
    text_of: nodes to texts(node, text).
    """
    radius = candidate_radius(similarity)

    def candidates(rows: DataFrame, every: bool) -> DataFrame:
        dealt = block_pairs(rows.select(F.explode("keys").alias("key"), "node", "n", "fp", "own"), most).repartition("key").sortWithinPartitions("key", "node")
        return cut(dealt.mapInArrow(_candidates(radius, similarity, every), "a bigint, b bigint").distinct())

    few = candidates(sets.withColumn("own", F.col("node")), False)
    n = few.count()
    near = cut_rows(few.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n)
    texts = cut_rows(text_of(near), 2 * n, TEXT_ROWS)
    links = cut_rows(verified(few, texts, width, similarity), n, TEXT_ROWS // 2)
    joined = components(links).select(F.col("node").alias("m"), "component")
    left = cut_rows(sets.join(near, "node").join(joined, F.col("node") == F.col("m"), "left").withColumn("own", F.coalesce("component", "node")).drop("m", "component"), 2 * n)
    open_ = candidates(left, True).select(F.col("a").alias("key"), F.col("b").alias("node"))
    met = open_.join(left.select("node", "own"), "node").join(texts, "node").select("key", "node", "own", "text")
    more = met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_settle(width, similarity), "a bigint, b bigint")
    return cut(links.union(more))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """docs without near copies: of each group of documents whose sets of `width`-word shingles have a Jaccard similarity of
    at least `similarity`, directly or over others, the row of the smallest id stays.

    Candidates come from minima of the hashed sets and 512-bit fingerprints (of pairs just at the similarity about LOST are
    missed); each link is decided on the sets. Repeats of a shingle in a document do not count.

    Documents without a word (null, empty, white space) have nothing to compare and all stay, but for repeated rows.
    Of rows that agree in id and text the least one stays (by its JSON). Rows of a null id count as larger than any id. All columns are kept,
    whatever their names; an empty table gives an empty one.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = rows.withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.xxhash64("text", F.lit(7), "id"))
    kind = dict(rows.dtypes)["id"]
    tune(docs.sparkSession)
    packed = keyed.select(F.struct("id", "k1", "k2").alias("id"), "text")
    own = packed.mapInArrow(_profiles(width, key_count(similarity)), f"id struct<id:{kind},k1:bigint,k2:bigint>, node bigint, n bigint, fp binary, keys array<bigint>")
    own = cut(own.select("id.*", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n", "fp", "keys"))
    words = own.where("node IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")
    # exact copies meet here: combined before any shuffle
    n = words.count()
    each = cut_rows(words.groupBy("node").agg(first), n)
    sets = cut_rows(words.select("node", "n", "fp", "keys").dropDuplicates(["node"]), n, 4 * TEXT_ROWS)

    def text_of(nodes: DataFrame) -> DataFrame:
        read = each.join(nodes, "node").select("node", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
        return keyed.select("k1", "k2", "text").join(read, ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"))

    found = components(similar_links(sets, text_of, width, similarity, most))
    grouped = each.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").groupBy(F.coalesce("component", "node").alias("label")).agg(F.min("first").alias("first"))
    kept = grouped.select("first.k1", "first.k2").union(own.where("node IS NULL").select("k1", "k2")).groupBy("k1", "k2").agg(F.lit(1).alias("one"))
    repeated = own.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    kept = kept.join(repeated, ["k1", "k2"])
    stays = keyed.select("k1", "k2", "row").join(kept, ["k1", "k2"])
    once = stays.where("n = 1").select("row.*")
    again = stays.where("n > 1").groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.union(again)
