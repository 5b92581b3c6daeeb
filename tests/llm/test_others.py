import collections
import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selvage.llm import decontam, langid, packing, queries, sharding, toxicity, warc


def test_encoder_equals_tokenizers():
    own = packing.encoder(queries.tokenizer_path())
    assert own.core is not None
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "s", " ", "  ", "\n", "\t", "a", "é", "ß", "1", "22", "٣", "!", "##", " '", "日本", "\U0001f600", "́", "<|endoftext|>", "\r\n", " ", "\x1c", "\x85", "​"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(own.encode(t), np.uint16).tolist() == own.slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer

    text = "end <|endoftext|> begin"
    own = packing.encoder(queries.tokenizer_path())
    want = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert 50256 in want and np.frombuffer(own.encode(text), np.uint16).tolist() == want


def test_groups_of_long_documents_are_small(spark, monkeypatch):
    """Documents stay together in a group, and long ones make more groups."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    df = spark.createDataFrame([(i, "some words of a long text " * 200) for i in range(40)], "doc_id long, text string")
    pieces = packing.pack(df, queries.tokenizer_path(), length=256).collect()
    group = collections.defaultdict(set)
    for r in pieces:
        group[r["id"]].add(r["sequence_id"] >> 32)
    assert all(len(g) == 1 for g in group.values()) and len(set.union(*group.values())) > 4


def test_sharding_against_plain_python(spark):
    """The weighted draws of each level, worked out again one key at a time."""
    import math
    import struct

    import xxhash

    def place(key, node):
        while node.children:
            def cost(c):
                h = xxhash.xxh64_intdigest(c.name.encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
                return -math.log(((h >> 11) + 0.5) / (1 << 53)) / c.weight

            node = min(node.children, key=cost)
        return node.shard

    root = sharding.tree(16)
    grown = sharding.grow(root, 2.5)
    df = spark.range(3000).select((F.col("id") * 977 - 5000).alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(df, root, grown).collect()
    assert len(got) == 3000 and all((r["shard"], r["grown_shard"]) == (place(r["id"], root), place(r["id"], grown)) for r in got)


def test_toxicity_on_held_out_labels(spark, labelled):
    """Fitted on half of the labels, judged on the other half."""
    docs, labels = (spark.read.parquet(f"{labelled}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = {r["row"]: r["grade"] for r in toxicity.score(docs, toxicity.train(docs, labels.where(half))).collect()}
    rest = labels.where(~half).where("toxic IS NOT NULL").collect()
    missed = sum(r["toxic"] > 0 and not found[r["doc_id"]] for r in rest)
    false = sum(r["toxic"] == 0 and found[r["doc_id"]] > 0 for r in rest)
    assert missed <= 0.25 * sum(r["toxic"] > 0 for r in rest) and false <= 0.02 * len(rest)


def test_rare_languages_are_learned(spark):
    common = [(i, f"the of and to in a is that it was number {i} for on are with as", "en") for i in range(3000)]
    rare = [(5000 + i, f"ja ei se on mutta kun niin kuin myös {i} vain ollut hän ovat", "fi") for i in range(6)]
    model = langid.train(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"), sample=200)
    asked = spark.createDataFrame([(1, "mutta hän ei ollut niin kuin se on"), (2, "that is for the number of it")], "doc_id long, text string")
    assert model.languages == ["en", "fi"] and {r["id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {1: "fi", 2: "en"}


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 65, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 64)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(64)
        assert (bins[i], offsets[i]) == (k, 64 - room[k])
        room[k] -= sizes[i]


def test_packing_odd_rows(odd, none):
    pieces = packing.pack(odd, queries.tokenizer_path(), length=64, group_docs=3).collect()
    for part in collections.defaultdict(list, {s: [r for r in pieces if r["sequence_id"] == s] for s in {r["sequence_id"] for r in pieces}}).values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 64
    assert [r["doc_tokens"] for r in pieces if r["id"] in (2, 3)] == [1, 1]
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "same same"), (3, None), (4, ""), (None, "plain text")], "item_id long, text string")
    got = {r["row"]: r for r in decontam.scan(odd, items).collect()}
    assert got[1]["n_hit"] == 2 and got[1]["items"] == []
    assert got[7]["n_hit"] == 3 and got[7]["items"] == ["2"]
    assert got[5]["n_hit"] == 30_000 and got[5]["items"] == ["1"] and got[2]["n_words"] == 0
    assert decontam.scan(none, items).count() == 0 and {r["n_hit"] for r in decontam.scan(odd, items.where("false")).collect()} == {0}
    docs = spark.createDataFrame([(1, "Keep this. One two THREE four five six, seven eight nine ten! And this.", 70, "r"), (2, "same, SAME", 10, "s"), (3, "clean", 5, None)], "doc_id long, text string, n_chars long, row string")
    out = {r["doc_id"]: r for r in decontam.remove_spans(docs, items).collect()}
    assert out[1]["text"] == "Keep this. ! And this." and out[1]["n_chars"] == len(out[1]["text"]) and 2 not in out and out[3]["text"] == "clean"
    assert decontam.remove_spans(odd, items).columns == odd.columns


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(i, f"word number {w}") for i, w in enumerate(["one two three four five six seven eight nine ten"] * 3 + ["x"])], "item_id long, text string")
    once = decontam.scan(odd, items).collect()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    assert decontam.scan(odd, items).collect() == once and once[4]["items"] == ["0", "1", "2"]


def test_toxicity(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqr')}{rng.choice('stuvwxyz')}" for _ in range(30)) + (" vile rotten" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["row"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["grade"] > 0) == bool(y) for i, _, y in rows)
    assert toxicity.keep_clean(docs, model).count() == 80
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.score(none, model).count() == 0
    for empty in (labels.where("false"), labels.where("toxic = 0")):
        assert toxicity.keep_clean(odd, toxicity.train(docs, empty)).count() == 11
    assert np.all(np.diff(model.thresholds) >= 0)


def test_ordinal_regression_recovers_the_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    w, t = toxicity.fit_ordinal(x, (score > -1).astype(int) + (score > 2), 2, rounds=600)
    assert abs(w - [2, -1, 0]).max() < 0.25 and abs(t - [-1, 2]).max() < 0.25


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(6)
    big = "".join(rng.choice("abc\r\nWARC/1.1 é") for _ in range(30_000))
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "http://c", None), (4, None, ""), (5, "u\r\nv", "WARC/1.1\r\n\r\nx"), (None, "n", "only"), (7, "x", big), (7, "x", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and all(r["whole"] for r in got)
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {(1, "revisit", 7): 1, (2, "revisit", 7): 1, (7, "response", None): 2, (9, "response", None): 1, (4, "revisit", 9): 1, (5, "response", None): 1, (None, "response", None): 1}
    assert {bytes(r["payload"]).decode() for r in got if r["page_id"] == 7} == {big}
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 2)} == {len(big.encode())}
    empty = warc.round_trip(pages.where("false"), str(tmp_path / "b"))
    assert empty.count() == 0
    small = warc.round_trip(pages, str(tmp_path / "c"), least=10**6).collect()
    assert {r["record_type"] for r in small} == {"response"}


def test_warc_segments_in_several_files(spark, tmp_path):
    payloads = {f"urn:page:{i}:0": bytes([97 + i]) * (3000 + i) for i in range(5)}
    parts = [p for name, b in payloads.items() for p in warc.records(name, "u", b, warc.base32_sha1(b), None, 700)]
    random.Random(2).shuffle(parts)
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(p + b"\r\n\r\n" for p in parts[k::3])))
    got = {r["name"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert {n: bytes(r["payload"]) for n, r in got.items()} == payloads and all(r["whole"] for r in got.values())


def test_warc_rows_of_a_common_page(spark, monkeypatch):
    """A page of many rows, with and without ids, has one head; its rows are dealt over several tasks."""
    from selvage.llm import common

    monkeypatch.setattr(common, "SHARE", 5)
    rows = [(i, "u", "common") for i in range(40)] + [(None, "u", "common"), (None, "u", "alone"), (50, "u", "single"), (None, "u", "single"), (60, "u", None), (61, "u", "")]
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i, 6] == ("revisit", 39) for i in range(39)) and got[39, 6] == ("response", None) and got[None, 6] in {("revisit", 39), ("revisit", 50)}
    assert got[50, 6] == ("response", None) and got[None, 5] == ("response", None) and got[60, 0] == ("revisit", 61) and got[61, 0] == ("response", None)


def test_warc_segments_are_verified():
    parts = warc.records("urn:x", "u", b"payload" * 500, warc.base32_sha1(b"payload" * 500), None, 300)
    rows = []
    for f, block in warc.parsed(b"".join(p + b"\r\n\r\n" for p in parts)):
        total = f.get("warc-segment-total-length")
        rows.append({"number": int(f["warc-segment-number"]), "total": int(total) if total else None, "type": f["warc-type"], "refers": None, "url": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "block": block})
    assert len(rows) > 5
    assert warc.reassemble(rows[::-1])[3] == b"payload" * 500 and warc.reassemble(rows)[6]
    assert warc.reassemble(rows + rows[2:3])[6]
    for broken in (rows[:-1], rows[:2] + rows[3:], rows[1:]):
        assert not warc.reassemble(broken)[6]
    members = b"".join(gzip.compress(p + b"\r\n\r\n") for p in parts)
    assert [b for _, b in warc.parsed(members)] == [r["block"] for r in rows]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_sharding(spark, odd, none):
    root = sharding.tree(16)
    ids = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    got = sharding.assign(ids, root, sharding.grow(root)).collect()
    n = collections.Counter(r["shard"] for r in got)
    assert len(n) == 16 and max(n.values()) < 1.25 * 1250 and min(n.values()) > 0.75 * 1250
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 0.8 < len(moved) / (20_000 / 17) < 1.2
    heavier = sharding.Node("root", children=(root.children[0], sharding.Node("region-1", children=(root.children[1].children[0], sharding.Node("rack-3", children=(*root.children[1].children[1].children[:3], sharding.Node("shard-15", 15, 3.0)))))))
    again = {r["id"]: r["shard"] for r in sharding.assign(ids, heavier).collect()}
    changed = [(r["shard"], again[r["id"]]) for r in got if again[r["id"]] != r["shard"]]
    assert changed and all(b >= 8 for _, b in changed)  # rows only come into the region whose weight grew
    assert sharding.assign(odd, root).count() == 11 and sharding.assign(none, root).count() == 0
    null = sharding.assign(odd, root).where("id IS NULL").first()
    assert null["grown_shard"] is None and 0 <= null["shard"] < 16


def test_native_plan_has_no_python(spark, odd):
    root = sharding.tree(16)
    plan = sharding.assign(odd, root, sharding.grow(root))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_language(spark, odd, none):
    words = {"en": "the of and that with", "fr": "le la que une été", "de": "der die und ßig über"}
    rows = [(i, " ".join(random.Random(i).choices(words[la].split(), k=20)), la) for i, la in enumerate(list(words) * 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    x = langid.normalise(np.array([langid.counts(t) for _, t, _ in rows]))
    assert [model.languages[k] for k in model.predict(x)[0]] == [la for _, _, la in rows]
    code = langid.codewords(4)
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[i + 1 :]) >= 6
    got = {r["id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 9)] == ["und"] * 4 and got[8]["lang_pred"] != "und" and got[2]["score"] == 0
    assert langid.predict(none, model).count() == 0
    assert langid.predict(odd, langid.train(none)).where("lang_pred <> 'und'").count() == 0
