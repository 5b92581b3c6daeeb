import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from selvage.config import Settings
from selvage.operators import emit, evaluation, invariants, match, model
from selvage.sources.parsers import ATTRIBUTE


def attribute(i, name, region="us", kind="string", level="mandatory", parent="Claim", values=(), tier=1, description=None):
    return {
        "attributeId": f"attr://{region}/{i}", "runId": "r", "region": region, "sourceContract": region, "path": f"{parent}.{name}", "localName": name, "dataType": kind, "typeDetail": None, "cardinality": "1..1",
        "obligation": {"level": level, "condition": None}, "enumeration": [{"value": v, "meaning": None, "source": "declared"} for v in values] or None, "constraints": None, "semantics": {"description": description} if description else None,
        "parentPath": parent, "evidenceTier": tier, "inferred": False, "evidenceRefs": [f"evref://{region}/git/{region}@0#/{i}"], "error": None,
    }


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, ATTRIBUTE)


def test_profile(frame):
    rows = [attribute(1, "lossDate"), attribute(2, "reserveAmt", description="One of A, B"), attribute(3, "other", kind="unknown")]
    got = {r["attributeId"][-1]: r for r in match.profile(frame(rows), siblings=True).collect()}
    assert got["1"]["findings"] == ["type-suspicion: string that denotes a date"] and got["1"]["siblings"] == ["other", "reserveAmt"]
    assert got["2"]["findings"][0] == "type-suspicion: string that denotes an amount" and got["2"]["findings"][-1].startswith("undeclared-enum")
    assert got["3"]["findings"] == ["opaque-type: no type declared"] and got["2"]["block_head"] == "amount"


def test_blocks_are_bounded(frame):
    rows = [attribute(f"{i:03}", f"x{i}Date") for i in range(60)]
    got = match.blocks(match.profile(frame(rows))).collect()
    assert [len(r["members"]) for r in got] == [40] and got[0]["members"][0] == "attr://us/000"


def test_synonyms_link_and_homonyms_split(frame):
    rows = [attribute("a", "claimDate", r, "date", parent="Claim") for r in ("us", "uk", "eu")]
    rows += [attribute("b", "claimStatus", "uk", "string", "mandatory", "Claim", ("OPEN", "SHUT")), attribute("b", "claimStatus", "eu", "string", "optional", "Claim", ("open", "shut"))]
    clusters, review = match.run(frame(rows), Settings(link=0.6))
    got = {tuple(m["attributeId"] for m in r["members"]): r for r in clusters.collect()}
    three = got[("attr://eu/a", "attr://uk/a", "attr://us/a")]
    assert three["conflictClass"] is None and three["proposedConcept"] == "claimDate" and sum(m["role"] == "core" for m in three["members"]) == 1
    for one in ("attr://uk/b", "attr://eu/b"):
        assert got[(one,)]["conflictClass"] == "homonym" and got[(one,)]["conflictDetail"] == "split on: obligation-inversion" and got[(one,)]["confidence"] == 1.0
    assert review.count() >= 0


def test_split_against_plain_recursion():
    """The greedy walk, told as its definition."""

    def plain(ids, rows, edges):
        if len(ids) < 2 or not match.signals([rows[i] for i in ids]):
            return [sorted(ids)]
        own = {p: s for p, s in edges.items() if set(p) <= set(ids)}
        if not own:
            return [[i] for i in ids]
        worst = min(own, key=lambda p: (own[p], p))
        rest = {p: s for p, s in own.items() if p != worst}
        return [g for part in match._parts(list(ids), list(rest)) for g in plain(part, rows, rest)]

    rng = random.Random(4)
    for _ in range(60):
        ids = [f"i{k}" for k in range(rng.randint(2, 7))]
        rows = {i: {"attributeId": i, "dataType": rng.choice(["date", "string", "array", "dateTime"]), "level": rng.choice(["mandatory", "mandatory", "optional"]), "parentPath": "A", "head": "h", "values": []} for i in ids}
        edges = {p: rng.choice([0.75, 0.8, 0.9]) for p in itertools.combinations(ids, 2) if rng.random() < 0.7}
        assert match.split(rows, edges) == sorted(plain(ids, rows, edges))


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("date", "mandatory", []), ("date", "conditional", [])], "obligation"), ([("array", "optional", []), ("string", "optional", [])], "granularity"), ([("date", "optional", []), ("dateTime", "optional", [])], "type"),
        ([("string", "optional", ["a", "b"]), ("string", "optional", ["B", "c"])], "enumeration"), ([("string", "optional", []), ("string", "optional", [])], None), ([("string", "optional", [])], None),
    ],
)
def test_conflict_class(rows, expected):
    assert match.conflict([{"dataType": k, "level": v, "values": e, "head": "x", "parentPath": None} for k, v, e in rows])[0] == expected


def test_naming(spark):
    def kinds(entity, attribute, core=True, kind="string", type_name="string", offset=True):
        return spark.range(1).select(model.violations(F.lit(entity), F.lit(attribute), F.lit(core), F.lit(kind), F.lit(type_name), F.lit(offset)).alias("v")).first()["v"]

    assert kinds("Claim", "lossDate") == [] and kinds("claim", "LossDate") == ["case", "case"]
    assert kinds("Claim", "lossAmt") == ["abbreviation"] and kinds("Claim", "status") == ["region-marker"] and kinds("Claim", "status", False) == []
    assert kinds("Claim", "open", kind="boolean") == ["boolean"] and kinds("Claim", "isOpen", kind="boolean") == []
    assert kinds("Claim", "reserveAmount") == ["money"] and kinds("Claim", "reserveAmount", type_name="MonetaryAmount") == []
    assert kinds("Claim", "claimNumber") == ["identifier"] and kinds("Claim", "at", kind="dateTime", offset=False) == ["datetime"]


@pytest.mark.parametrize(
    "regions,tier,flags,expected",
    [
        (["eu", "uk", "us"], 1, {}, ("core", "1")), (["eu", "us"], 1, {}, ("extension:eu", "2")), (["eu", "us"], 1, {"gap": True}, ("core", "2")), (["uk"], 2, {}, ("extension:uk", "3")), (["uk"], 2, {"close": True}, ("core", "3")),
        (["eu", "uk", "us"], 3, {}, ("extension:eu", "5")), (["eu", "uk", "us"], 3, {"ok": True}, ("core", "1")), (["eu", "uk", "us"], 1, {"law": True}, ("extension:eu", "4")), ([], 1, {}, ("extension:us", "3")),
    ],
)
def test_placement(spark, regions, tier, flags, expected):
    p = model.placement(F.array(*[F.lit(r) for r in regions]).cast("array<string>"), F.lit(tier), *[F.lit(bool(flags.get(k))) for k in ("law", "ok", "gap", "close")])
    r = spark.range(1).select(p.alias("p")).select(model.contract_value(F.col("p")).alias("v"), "p.rule").first()
    assert tuple(r) == expected


def test_coverage_example(spark):
    """Five attributes, three clusters, two candidates, one exclusion: a score of 5/13."""
    concepts = spark.createDataFrame(
        [("c1", 5, True, "sme", "core", ["us", "uk", "eu"], False), ("c2", 5, True, None, "core", ["us"], False), ("c3", 3, True, None, "gap", ["us"], True)],
        "conceptId string, weight int, evidenced boolean, sme string, resolution string, regions array<string>, inferred boolean",
    )
    r = model.coverage(concepts).first()
    assert math.isclose(r["score"], 5 / 13) and (r["denominator"], r["weightSum"], r["specified"], r["inferred"]) == (3, 13, 2, 1)
    assert math.isclose(r["us"], 5 / 13) and r["uk"] == r["eu"] == 1 and not (r["gate1Pass"] or r["gate2Pass"] or r["gate3Pass"])
    excluded = spark.createDataFrame([("git://x", "why")], "uri string, detail string")
    got = sorted((g["reason"], g["conceptId"]) for g in model.gaps(concepts, excluded).collect())
    assert got == [("below-region-floor", "c3"), ("excluded", "git://x"), ("unevidenced", "c3"), ("unresolved", "c2")]
    empty = model.coverage(concepts.where("false")).first()
    assert empty["score"] == 0 and empty["gate1Pass"] and not empty["gate2Pass"]


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y")], "item int, p string, t string")
    r = evaluation.pair_scores(rows, F.col("p"), F.col("t")).first()
    assert (r["tp"], r["predicted_pairs"], r["actual_pairs"]) == (1, 3, 2) and math.isclose(r["f1"], 2 * (1 / 3) * (1 / 2) / (1 / 3 + 1 / 2))
    pairs = spark.createDataFrame([(1, 2), (1, 4)], "a int, b int")
    assert evaluation.homonym_recall(pairs, rows.select("item", F.col("p").alias("grp"))).first()["recall"] == 0.5
    assert not evaluation.gate([(0.9, 1.0)] * 4) and evaluation.gate([(0.9, 1.0)] * 5) and not evaluation.gate([(0.9, 1.0)] * 4 + [(0.9, 0.9)])


def test_invariants(spark, frame):
    attributes = frame([attribute(1, "a"), attribute(2, "b")])
    artefacts = spark.createDataFrame([("us",)], "artefactId string")
    assert invariants.evidence_exists(attributes, artefacts).count() == 0 and invariants.evidence_exists(attributes, artefacts.where("false")).count() == 2
    clusters = spark.createDataFrame([("c", [("attr://us/1",), ("attr://us/9",)])], "clusterId string, members array<struct<attributeId:string>>")
    assert [tuple(r) for r in invariants.members_exist(clusters, attributes, "r").collect()] == [("c", "attr://us/9", "missing")]
    candidates = spark.createDataFrame([("x", ["c"]), ("y", ["none"]), ("z", [])], "candidateId string, clusterRefs array<string>")
    assert sorted(r[0] for r in invariants.candidates_grounded(candidates, clusters, attributes).collect()) == ["y", "z"]


def test_emission(spark):
    rows = [("Claim", "lossDate", "date", "1..1", ("mandatory",), "core", "r", 5, ("sme",)), ("Claim", "notes", "string", "0..n", ("optional",), "extension:uk", "because", 1, ("sme",))]
    candidates = spark.createDataFrame(rows, "entity string, attribute string, dataType string, cardinality string, obligation struct<level:string>, placement string, rationale string, weight int, ratification struct<sme:string>").withColumn("clusterRefs", F.array(F.lit("c")))
    import json

    got = {r["scope"]: json.loads(r["document"]) for r in emit.entity_schemas(candidates).collect()}
    assert got["core"]["required"] == ["lossDate"] and got["core"]["properties"]["lossDate"] == {"type": "string", "format": "date"}
    assert got["extension:uk"]["properties"]["notes"] == {"type": "array", "items": {"type": "string"}, "x-owner": "sme", "x-rationale": "because", "x-weight": 1}
    assert emit.logical_model(candidates).count() == 1
    gates = {"gate1Pass": True, "gate2Pass": True, "gate3Pass": True}
    first = emit.release("d", "1.0.0", "r", {"b": b"2", "a": b"1"}, gates, b"k")
    assert first == emit.release("d", "1.0.0", "r", {"a": b"1", "b": b"2"}, gates, b"k") and [a["path"] for a in first["artefacts"]] == ["a", "b"]
    with pytest.raises(ValueError):
        emit.release("d", "1", "r", {}, gates | {"gate2Pass": False}, b"k")
    old = spark.createDataFrame([("core/a", "1"), ("core/b", "1"), ("extension/c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("core/a", "1"), ("core/b", "2"), ("core/d", "1")], "path string, sha256 string")
    assert sorted(map(tuple, emit.difference(old, new).collect())) == [("core/b", "changed", True), ("core/d", "added", False), ("extension/c", "removed", False)]


def test_sibling_overlap_is_that_of_the_name_sets(frame):
    import itertools

    rows = [attribute(i, name, parent=parent) for i, (name, parent) in enumerate([("a", "p"), ("b", "p"), ("b", "p"), ("c", "p"), ("a", "q"), ("c", "q"), ("d", "q"), ("x", "r"), ("a", None), ("b", None), ("y", "s")])]
    ids = [r["attributeId"] for r in rows]
    beside = {r["attributeId"]: {o["localName"] for o in rows if o["attributeId"] != r["attributeId"] and (o["sourceContract"], o["parentPath"]) == (r["sourceContract"], r["parentPath"])} for r in rows}
    profiled = match.profile(frame(rows))
    asked = profiled.sparkSession.createDataFrame(list(itertools.combinations(sorted(ids), 2)), "a string, b string")
    got = {(r["a"], r["b"]): r["overlap"] for r in match.sibling_overlap(asked, profiled).collect()}
    assert len(got) == len(ids) * (len(ids) - 1) // 2
    for (a, b), overlap in got.items():
        union = beside[a] | beside[b]
        assert abs(overlap - (len(beside[a] & beside[b]) / len(union) if union else 0.0)) < 1e-12, (a, b)


def test_core_of_equal_means_is_the_first_id(spark, frame):
    """The last bit of a mean depends on the order of its sum, so it does not decide."""
    profiled = match.profile(frame([attribute("1", "a"), attribute("2", "b"), attribute("3", "c", tier=2)]))
    ids = [f"attr://us/{i}" for i in (1, 2, 3)]
    groups = spark.createDataFrame([("g", 0, i, None, None) for i in ids], "component string, part int, attributeId string, conflictClass string, conflictDetail string")
    for last in (0.75, 0.7500000000000001):
        edges = spark.createDataFrame([(ids[0], ids[2], 0.75), (ids[1], ids[2], last)], "a string, b string, score double")
        members = match.clusters(groups, edges, profiled).first()["members"]
        assert [m["attributeId"] for m in members if m["role"] == "core"] == [ids[0]]


@pytest.mark.parametrize("share", [1 << 30, 50])
def test_siblings_are_those_of_the_definition(frame, monkeypatch, share):
    """Ids that are missing or occur twice, names that are missing or empty, no parent; families of one task and of several."""
    monkeypatch.setattr(match, "SIBLING_BYTES", share)
    rng = random.Random(7)
    rows = [attribute(rng.randint(1, 25), rng.choice(["a", "b", "b", "é", "aa", "", None]), parent=rng.choice(["p", "q", None])) | {"path": str(i)} for i in range(60)]
    rows += [attribute(0, "a", parent="p") | {"attributeId": None, "path": "none"}, attribute(90, "alone", parent="r") | {"path": "alone"}]

    def others(r):
        own = [o["localName"] for o in rows if r["attributeId"] and o["attributeId"] and o["attributeId"] != r["attributeId"] and o["parentPath"] == r["parentPath"]]
        return sorted(n for n in own if n is not None) + [None for n in own if n is None]

    expected = {r["path"]: others(r) for r in rows}
    assert {r["path"]: r["siblings"] for r in match.profile(frame(rows), siblings=True).collect()} == expected
    text = match.beside(frame(rows), text=True).collect()
    assert len(text) == len(rows)
    assert {r["path"]: (r["n_siblings"], r["siblings"]) for r in text} == {k: (len(v), ",".join(n for n in v if n is not None)) for k, v in expected.items()}


def test_siblings_of_a_large_family_take_seconds(spark, tmp_path):
    import time

    from selvage.plans import catalogue

    part = spark.range(12000).select((F.col("id") * 7).alias("p_partkey"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"), F.lit(" bolt")).alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    began = time.perf_counter()
    r = catalogue.sibling_names(spark, str(tmp_path)).agg(F.count("*").alias("rows"), F.min("n").alias("n"), F.sum(F.length("siblings")).alias("length")).first()
    assert time.perf_counter() - began < 60
    names = [x["localName"] for x in catalogue.attributes(spark, str(tmp_path)).collect()]
    assert (r["rows"], r["n"], r["length"]) == (12000, 11999, sum(len(n) + 1 for n in names) * 11999 - 12000)


def test_links_of_whole_blocks_are_those_of_all_pairs(spark, frame):
    """Blocks of over 40 members, compared pair by pair: names of one member, no parent, enumerations, ranges open and
    closed, patterns."""
    rng = random.Random(3)
    said = lambda *c: [{"kind": k, "expression": e, "source": "schema"} for k, e in c] or None
    limits = [said(), said(), said(("range", "minimum=1")), said(("range", "minimum=1"), ("range", "maximum=9")), said(("range", "minimum=2"), ("range", "maximum=9")), said(("pattern", "[a-z]")), said(("pattern", "[a-z]"), ("range", "maximum=9")), said(("range", "any"))]
    rows = []
    for i in range(130):
        r = attribute(f"{i:03}", rng.choice(["lossDate", "lossDate", "eventDate", "claimDate", "lossAmount", f"own{i}Date"]), rng.choice(["us", "uk"]), rng.choice(["date", "dateTime", "string"]), parent=rng.choice(["Claim", "Claim.Loss", None]), values=rng.choice([(), (), ("A", "b"), ("B", "a"), ("A", "c")]), tier=rng.randint(1, 2))
        rows.append(r | {"constraints": rng.choice(limits)})
    profiled = match.profile(frame(rows)).cache()
    keys = {r["attributeId"]: set(r["keys"]) for r in profiled.select("attributeId", match.block_keys().alias("keys")).collect()}
    asked = [(a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] & keys[b]]
    edges = {(r["a"], r["b"]): r["score"] for r in match.compare(spark.createDataFrame(asked, "a string, b string"), profiled).collect() if r["score"] >= Settings().link}
    ends = {}
    for (a, b), s in edges.items():
        ends.setdefault(a, []).append(s)
        ends.setdefault(b, []).append(s)
    by = {r["attributeId"]: r for r in rows}
    expected = set()
    for ids in match._parts(sorted(ends), list(edges)):
        core = min(ids, key=lambda i: (by[i]["evidenceTier"], -round(sum(ends[i]) / len(ends[i]), 9), i))
        expected.add((ids[0], core, len(ids), min((by[i]["localName"] for i in ids), key=lambda n: (len(n), n))))
    linked = match.linked(profiled).cache()
    means = {r["attributeId"]: r["mean"] for r in linked.collect()}
    assert means.keys() == ends.keys() and all(abs(means[i] - sum(s) / len(s)) < 2e-9 for i, s in ends.items())
    assert max(n for _, _, n, _ in expected) > 40
    assert {tuple(r) for r in match.cores(linked, profiled).collect()} == expected


def test_core_member_takes_whole_blocks(spark, tmp_path):
    from selvage.plans import catalogue

    part = spark.range(60).select((F.col("id") * 420).alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    assert [(r["members"], r["concept"]) for r in catalogue.core_member(spark, str(tmp_path)).collect()] == [(60, "redBolt")]
