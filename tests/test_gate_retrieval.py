import math

import pytest
from pyspark.sql import functions as F

from selvage.functions.digest import token
from selvage.operators import gate, graph, retrieval

KEY = bytes(range(32))


def found(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(gate.spans(F.col("t")).alias("s")).first()
    return sorted((s["detector"], s["value"]) for s in r["s"])


@pytest.mark.parametrize(
    "text,expected",
    [
        ("NI ab123456c here", [("ni-number", "ab123456c")]), ("ssn 123-45-6789", [("us-ssn", "123-45-6789")]), ("GB82WEST12345698765432", [("iban", "GB82WEST12345698765432")]),
        ("card 4111 1111 1111 1111.", [("card-pan", "4111 1111 1111 1111")]), ("card 4111 1111 1111 1112.", []), ("at SW1A 1AA now", [("uk-postcode", "SW1A 1AA")]),
        ("zip 12345-6789", [("us-zip4", "12345-6789")]), ("to a.b@c.de", [("email", "a.b@c.de")]), ("call +442071234567", [("e164-phone", "+442071234567")]),
        ("born on 1980-02-03", [("dob-in-context", "1980-02-03")]), ("on 1980-02-03 only", []), ("seen by John Smith", [("title-case-sequence", "John Smith")]), ("a HIV test", [("sensitive-domain-lexicon", "HIV")]),
        ("DOB " + "x" * 50 + " 1/2/1990 dob", [("dob-in-context", "1/2/1990")]),
    ],
)
def test_detectors(spark, text, expected):
    assert found(spark, text) == expected


def test_classify(spark):
    rows = [(1, "write to a.b@c.de, A. Smith"), (2, "a psychiatric note"), (3, "plain words"), (4, None), (5, "")]
    got = {r["id"]: r for r in gate.classify(spark.createDataFrame(rows, "id int, text string"), KEY).collect()}
    assert [got[i]["verdict"] for i in range(1, 6)] == ["mask", "block", "allow", "allow", "allow"]
    assert got[2]["output"] is None and got[2]["exclusion"] == "policy-blocked" and got[2]["policy"]["rule"] == "block-personal"
    assert "<IDENTIFYING:" in got[1]["output"] and "a.b@c.de" not in got[1]["output"] and not got[1]["residual"]
    assert got[3]["output"] == "plain words" and got[4]["labels"] == ["DOCUMENTARY"]


def test_policy(spark):
    def rule(labels, licence="permitted", masked=True, approved=False):
        c = gate.policy(F.array(*[F.lit(x) for x in labels]), F.lit(licence), F.lit(masked), F.lit(approved))
        return spark.range(1).select(c.alias("p")).first()["p"]["rule"]

    assert rule(["STRUCTURAL"]) == "allow-structural"
    assert rule(["STRUCTURAL"], "unknown") == "block-unlicensed"  # a block beats an allow that stands before it
    assert rule(["DOCUMENTARY"], masked=False) == "default" and rule(["DOCUMENTARY"]) == "allow-documentary-masked"
    assert rule(["OTHER"], approved=True) == "dpo-approved-exception" and rule(["SENSITIVE_DOMAIN"], approved=True) == "block-personal"


def test_longest_value_is_masked_first(spark):
    spans = F.array(*[F.struct(F.lit("L1").alias("rung"), F.lit("X").alias("label"), F.lit(v).alias("value")) for v in ("ab", "abc")])
    r = spark.range(1).select(gate.redact(F.lit("abc ab"), spans, KEY).alias("t"), token(KEY, "X", F.lit("abc")).alias("long"), token(KEY, "X", F.lit("ab")).alias("short")).first()
    assert r["t"] == f"{r['long']} {r['short']}"


def test_ledger(spark):
    rows = spark.createDataFrame([(r, i) for i in range(30) for r in ("us", "uk")], "region string, i int").repartition(7)
    ledger = gate.chain(rows, "region", ["i"], {"i": F.col("i")}, KEY)
    assert gate.verify(ledger, key=KEY).count() == 0 and ledger.count() == 60
    assert [r["entryId"] for r in ledger.where("region = 'us' AND seq <= 2").orderBy("seq").collect()] == ["ledger-us-000001", "ledger-us-000002"]
    again = gate.chain(rows.repartition(3), "region", ["i"], {"i": F.col("i")}, KEY)
    assert sorted(ledger.select("hash").collect()) == sorted(again.select("hash").collect())
    tampered = ledger.withColumn("body", F.when((F.col("seq") == 5) & (F.col("region") == "uk"), '{"i":99}').otherwise(F.col("body")))
    assert [(r["region"], r["seq"]) for r in gate.verify(tampered, key=KEY).collect()] == [("uk", 5)]
    removed = ledger.where("NOT (region = 'us' AND seq = 3)")
    assert {(r["region"], r["seq"]) for r in gate.verify(removed, key=KEY).collect()} >= {("us", 4)}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "the Cat sat"), (2, "the dog"), (3, None), (4, "")], "id int, text string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs, ["cat CAT bird"], "id").collect()}
    idf = math.log(1 + 3.5 / 1.5)
    assert set(got) == {1} and math.isclose(got[1], 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (5 / 4))))
    assert retrieval.bm25(docs, ["?!"], "id").count() == 0 and retrieval.bm25(docs.where("false"), ["cat"], "id").count() == 0


def test_fusion_and_neighbours(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    got = {r["id"]: r["score"] for r in retrieval.fuse([ranks, ranks.where("id = 'b'")], "id").collect()}
    assert math.isclose(got["a"], 1 / 61) and math.isclose(got["b"], 2 / 62)
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id int, embedding array<double>")
    near = retrieval.neighbours(rows.where("id = 0"), rows, "id", 2).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in near] == [(1, 1), (2, 2)]


def test_chunks(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(2000))),), ("a b",), ("",)], "t string")
    got = [r["w"] for r in df.select(retrieval.word_windows(F.col("t")).alias("w")).collect()]
    assert [len(w) for w in got] == [3, 1, 0] and got[0][1].split()[0] == "765" and got[0][2].split()[-1] == "1999"
    html = "before<h1>One</h1><p>text &amp; more</p><h2 class='x'>Two</h2><H3>Three</H3>end"
    r = spark.createDataFrame([(html,)], "t string").select(retrieval.headings(F.col("t")).alias("h")).first()["h"]
    assert [(x["heading"], x["body"]) for x in r] == [("One", "text &amp; more"), ("Three", "end")]


def test_embedding_is_of_unit_length(spark):
    a, b = [r["v"] for r in spark.createDataFrame([("Loss  Date",), ("loss date",)], "t string").select(retrieval.embed(F.col("t"), 8).alias("v")).collect()]
    assert a == b and math.isclose(sum(x * x for x in a), 1)


def test_components_and_lineage(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("d", "e"), ("x", "y")], "from_id string, to_id string")
    reached = graph.lineage(edges, spark.createDataFrame([("a",)], "node string"), 3)
    assert {(r["node"], r["distance"]) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert graph.subgraph(edges, reached).count() == 3
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (2, "e")], "k int, v string")
    assert sorted(map(tuple, graph.upsert(old, new, "k").collect())) == [(1, "a"), (2, "e"), (3, "d")]
    with pytest.raises(Exception, match="unknown type"):
        spark.range(1).select(graph.valid(F.lit("Nothing"), graph.NODE_TYPES)).collect()
