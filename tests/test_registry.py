import json

import pytest
from pyspark.sql import functions as F

from selvage.config import ConfigError, Settings
from selvage.operators import emit, gate, retrieval
from selvage.plans.registry import Registry
from selvage.plans.run import Conflict, NotFound
from selvage.sources import connectors

PASSES = {"gate1Pass": True, "gate2Pass": True, "gate3Pass": True}


def test_releases_are_stored_listed_and_compared(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    files = {"core/A.schema.json": b"{}", "core/B.schema.json": b"[1]"}
    first = emit.release("claims", "1.0", "run-1", files, PASSES, b"k")
    with pytest.raises(NotFound):
        registry.manifest("claims", "1.0")
    registry.put(first, files)
    with pytest.raises(Conflict):
        registry.put(first, files)
    later = {"core/A.schema.json": b"{}", "core/C.schema.json": b"2"}
    registry.put(emit.release("claims", "1.1", "run-2", later, PASSES, b"k"), later)
    with pytest.raises(Conflict):
        registry.put(emit.release("claims", "2", "run-2", later, PASSES, b"k"), later | {"x": b""})
    with pytest.raises(Conflict):
        registry.put(emit.release("claims", "2", "run-2", later, PASSES, b"k"), later | {"core/A.schema.json": b"!"})
    assert [r["version"] for r in registry.releases("claims").orderBy("version").collect()] == ["1.0", "1.1"] and registry.releases("other").count() == 0
    assert registry.manifest("claims", "1.0") == first and registry.artefact("claims", "1.0", "core/B.schema.json") == ("application/schema+json", b"[1]")
    with pytest.raises(NotFound):
        registry.artefact("claims", "1.0", "core/C.schema.json")
    got = {r["path"]: (r["change"], r["breaking"]) for r in registry.difference("claims", "1.0", "1.1").collect()}
    assert got == {"core/B.schema.json": ("removed", True), "core/C.schema.json": ("added", False)}


def test_a_ledger_goes_on_where_it_ended(spark):
    rows = spark.createDataFrame([(i, "us" if i % 3 else "uk", f"t{i}") for i in range(20)], "i int, region string, t string")
    whole = gate.chain(rows, "region", ["i"], {"t": F.col("t")})
    start = gate.chain(rows.where("i < 9"), "region", ["i"], {"t": F.col("t")})
    rest = gate.chain(rows.where("i >= 9"), "region", ["i"], {"t": F.col("t")}, stored=start)
    key = lambda df: sorted((r["region"], r["seq"], r["hash"]) for r in df.collect())
    assert key(start.union(rest)) == key(whole) and gate.verify(start.union(rest)).count() == 0
    assert key(gate.chain(rows, "region", ["i"], {"t": F.col("t")}, stored=start.where("false"))) == key(whole)


def test_settings_from_file_and_environment(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"link": 0.8, "domain_tokens": ["order"]}))
    own = Settings.load(str(tmp_path / "s.json"), {"SELVAGE_LINK": "0.9", "OTHER": "1"})
    assert own.link == 0.9 and own.domain_tokens == ("order",) and own.review == Settings().review
    for bad in ({"SELVAGE_NOTHING": "1"}, {"SELVAGE_LINK": "0.1"}):
        with pytest.raises(ConfigError):
            Settings.load(None, bad)


def test_policy_from_json():
    version, rules = gate.load_rules('{"version": 7, "rules": [{"id": "a", "verdict": "allow", "all_in": ["STRUCTURAL"]}, {"id": "b", "verdict": "block", "any_in": ["X"], "reason": "no"}]}')
    assert version == 7 and rules == (gate.Rule("a", "allow", all_in=("STRUCTURAL",)), gate.Rule("b", "block", any_in=("X",), reason="no"))
    for bad in ('{"version": 1, "rules": [{"id": "a", "verdict": "maybe"}]}', '{"version": 1, "rules": [{"id": "a", "verdict": "allow", "if": 1}]}'):
        with pytest.raises(ValueError):
            gate.load_rules(bad)


def test_attribute_and_its_neighbours(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "attributeId string, embedding array<double>")
    assert retrieval.attribute(rows, "b").count() == 1 and retrieval.attribute(rows, "x").count() == 0
    got = [(r["attributeId"], r["rank"]) for r in retrieval.neighbours_of(rows, "a", 3).orderBy("rank").collect()]
    assert got == [("b", 1), ("c", 2), ("d", 3)] and retrieval.neighbours_of(rows, "x", 3).count() == 0


def test_health(spark, tmp_path):
    assert connectors.health(spark, str(tmp_path)) == (True, "") and connectors.health(spark, str(tmp_path / "no"))[0] is False
    assert connectors.health(spark, "unknown://x/y")[0] is False
