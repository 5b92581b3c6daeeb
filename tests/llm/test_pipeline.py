import corpus_pipeline


def test_stages_by_hand(spark, larger):
    """Each stage on its own input, against what it promises."""
    sf = larger
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = docs.collect()
        sizes.append(len(rows))
        assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != before[r["doc_id"]])
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]


def test_near_copies_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "").encode().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else None
    low = {i: i for i in sets}
    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if low[i] != low[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = {x: a if y == b else y for x, y in low.items()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()) == sorted(i for i in low if low[i] == i)


def test_benchmark_is_cut_against_brute_force(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    split = lambda t: [(m.group().lower(), m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = [x[0] for x in split(r["text"])]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_benchmark(spark, docs, sf).collect()}
    for r in docs.collect():
        w = split(r["text"])
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(x[0] for x in w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if all(hit) and hit:
            assert r["doc_id"] not in got
            continue
        raw, out, at, i = (r["text"] or "").encode(), b"", 0, 0
        while i < len(w):
            j = i
            while j < len(w) and hit[j]:
                j += 1
            if j > i:
                out, at = out + raw[at : w[i][1]], w[j - 1][2]
            i = max(j, i + 1)
        assert (got[r["doc_id"]] or "") == (out + raw[at:]).decode(), r["doc_id"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_stages_take_odd_rows(spark, sf, odd, none):
    kept = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (kept, none.select(kept.columns)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf).collect()
