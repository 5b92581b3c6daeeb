"""Each query against a plain statement of its contract, on the smallest tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from selvage.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def reachable(near):
    n = len(near)
    low = np.arange(n)
    while True:
        new = np.array([low[near[i]].min() for i in range(n)])
        if (new == low).all():
            return low
        low = new


def test_op1(spark, sf, docs):
    got = rows(queries.op1_pii(spark, sf), "doc_id")
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    fits = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15]
    names = ["email", "ip", "card", "phone"]
    for i, t in docs:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t) if fits[k](m[0]))
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i][f"n_{n}"] for n in names] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(got[i]["spans"].split(","))


def test_op2(spark, sf, docs):
    got = rows(queries.op2_suffix(spark, sf), "doc_id")
    count = collections.Counter(t[s : s + 400] for _, t in [(i, t.encode()) for i, t in docs] for s in range(len(t) - 399))
    for i, t in docs:
        t = t.encode()
        on = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - 399):
            if count[t[s : s + 400]] > 1:
                on[s : s + 400] = True
        kept = np.frombuffer(t, np.uint8)[~on].tobytes()
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), on.sum(), (np.diff(np.r_[0, on.astype(int)]) == 1).sum(), hashlib.sha256(kept).hexdigest())


def test_op3(spark, sf, docs):
    got = rows(queries.op3_simhash(spark, sf), "doc_id")
    prints = []
    for _, t in docs:
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0)
    p = np.array(prints, dtype=np.uint64)
    low = reachable(np.bitwise_count(p[:, None] ^ p[None]) <= 2)
    for k, (i, _) in enumerate(docs):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[k]:016x}", min(docs[j][0] for j in np.flatnonzero(low == low[k])))


def test_op4(spark, sf, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    pieces = queries.op4_packing(spark, sf).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for i, t in docs:
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        total += len(ids)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert total / (2048 * len(by_sequence)) > 0.97


def test_op5(spark, sf, docs):
    got = rows(queries.op5_decontaminate(spark, sf), "doc_id")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r["text"] or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(r["item_id"]))
    for i, t in docs:
        w, items = split(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit[k : k + n] = [True] * n
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit))


def test_op7(spark, sf):
    got = rows(queries.op7_warc(spark, sf), "page_id")
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    last = {}
    for i, p in pages:
        last[p] = max(i, last.get(p, i))
    for i, p in pages:
        first = last[p] == i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else last[p])
        assert r["whole"]


def test_op8(spark, sf, docs):
    got = queries.op8_sharding(spark, sf).collect()
    text = dict(docs)
    assert len(got) == len(docs)
    slots = collections.defaultdict(list)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r["grown_shard"] == 16 for r in got)


def test_op9(spark, sf):
    got = rows(queries.op9_embeddings(spark, sf), "vec_id")
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in data])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    low = reachable(near)
    for k, r in enumerate(data):
        component = min(data[j]["vec_id"] for j in np.flatnonzero(low == low[k]))
        g = got[r["vec_id"]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (near[k].sum() - 1, component, component == r["vec_id"])


def test_op10(spark, sf):
    got = rows(queries.op10_language(spark, sf), "doc_id")
    right = total = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= g["score"] <= 1
        if g["held_out"]:
            right, total = right + (g["lang_pred"] == r["lang"]), total + 1
    assert right / total > 0.95


def test_op6(spark, larger):
    sf = larger
    got = rows(queries.op6_toxicity(spark, sf), "doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = sum((r["toxic"] > 0) == got[r["doc_id"]]["toxic"] for r in labels)
    assert right / len(labels) > 0.95
    assert all(0 <= g["severity"] <= 2 for g in got.values())
