import json

import pytest
from pyspark.sql import functions as F

from selvage.config import Settings
from selvage.operators import mapping
from selvage.operators.mapping import Entry, RegionField, Spec
from selvage.sources import connectors, parsers
from selvage.streaming import journal


@pytest.mark.parametrize(
    "text,expected",
    [
        ("identity", [("identity", {})]), ("parseDate(fmt='yyyy-MM-dd') -> instantAtStartOfDay(zone='Europe/London')", [("parseDate", {"fmt": "yyyy-MM-dd"}), ("instantAtStartOfDay", {"zone": "Europe/London"})]),
        ('toMonetaryAmount(currency=constant("GBP"))', [("toMonetaryAmount", {"currency": "GBP"})]), ('constant("x")', [("constant", {"const": "x"})]), ("scale(factor=0.5)", [("scale", {"factor": 0.5})]),
        ("x(a=1, b=true, c=bare)", [("x", {"a": 1, "b": True, "c": "bare"})]),
    ],
)
def test_parser(text, expected):
    assert [(c.name, c.args) for c in mapping.parse(text)] == expected


@pytest.mark.parametrize("text", ["", "a -> b -> c -> d", "a(", "a(b)", "a ->", "a(b=1", "1x"])
def test_parser_refuses(text):
    with pytest.raises(ValueError):
        mapping.parse(text)


FIELDS = [RegionField("H.No", "string"), RegionField("H.Date", "string"), RegionField("H.Status", "string", ("NEW", "OLD")), RegionField("C.Limit", "decimal"), RegionField("D.Ref", "string"), RegionField("H.Batch", "string")]
ENTRIES = (
    Entry("H.No", "reference", "toIdentifier(scheme='s', issuer='i')", weight=5, on_failure="reject"),
    Entry("H.Date", "incident.at", "parseDate(fmt='yyyy-MM-dd') -> instantAtStartOfDay(zone='Europe/London')", weight=5, on_failure="reject", note="no time of day"),
    Entry("H.Status", "status", "valueMap(map='m')", weight=5),
    Entry("C.Limit", "limit", 'toMonetaryAmount(currency=constant("GBP"))', weight=3),
    Entry("D.Ref", "extensions.uk.ref", "identity", weight=3, on_failure="skip"),
    Entry("H.Batch", disposition="unmapped", weight=1),
)
SPEC = Spec(ENTRIES, {"m": {"NEW": "NOTIFIED", "OLD": "CLOSED"}})


def steps(spec=SPEC, fields=FIELDS, types=None):
    return mapping.compile_spec(spec, fields, types or {})


def checks(spec, fields=FIELDS, types=None):
    with pytest.raises(mapping.CompilationFailed) as error:
        steps(spec, fields, types)
    return [p.check for p in error.value.problems]


def test_compiler():
    assert len(steps()) == 6
    assert checks(Spec(ENTRIES[1:], SPEC.value_maps)) == ["T1"]
    assert checks(Spec((*ENTRIES[:4], Entry("D.Ref", "x", "identity", weight=5, on_failure="skip"), ENTRIES[5]), SPEC.value_maps)) == ["T2"]
    assert checks(SPEC, types={"reference": "date"}) == ["T3"] and len(steps(types={"limit": "object"})) == 6
    assert checks(Spec(ENTRIES)) == ["T4"] and checks(Spec(ENTRIES, {"m": {"NEW": "A"}})) == ["T4"] and checks(Spec(ENTRIES, {"m": {"NEW": "A", "OLD": "A"}})) == ["T4"]
    assert len(steps(Spec(ENTRIES, {"m": {"NEW": "A"}}, {"m": "passthrough"}))) == 6 and len(steps(Spec(ENTRIES, {"m": {"NEW": "A", "OLD": "A"}}, bidirectional=False))) == 6
    assert checks(Spec((*ENTRIES[:4], Entry("D.Ref", "x", "constant('a')"), ENTRIES[5]), SPEC.value_maps)) == ["D1"]
    assert checks(Spec((*ENTRIES[:5], Entry("H.Batch", "b", "nothing()")), SPEC.value_maps)) == ["PARSE"] and checks(Spec((*ENTRIES[:5], Entry("H.Batch")), SPEC.value_maps)) == ["I5"]


def test_forward_and_back(spark):
    made = mapping.synthesise(spark, FIELDS, 3)
    out = mapping.forward(made, steps(), ["seed"]).orderBy("seed").collect()
    first = out[0]["canonical"].asDict(True)
    assert first["reference"] == {"value": "No-0", "scheme": "s", "issuer": "i"} and first["status"] == "NOTIFIED" and first["limit"] == {"amount": 1.5, "currency": "GBP"} and first["extensions"] == {"uk": {"ref": "Ref-0"}}
    assert out[0]["rejected"]  # a made-up text is no date
    dated = made.withColumn("H", F.col("H").withField("Date", F.lit("2020-07-01")))
    r = mapping.forward(dated, steps(), ["seed"]).orderBy("seed").first()
    assert str(r["canonical"]["incident"]["at"]) == "2020-06-30 23:00:00" and not r["rejected"] and r["escalations"] == []
    back = mapping.reverse(mapping.forward(dated, steps(), ["seed"]), steps(), ["seed"]).orderBy("seed").first()["region"].asDict(True)
    assert back == {"H": {"No": "No-0", "Date": "2020-07-01", "Status": "NEW"}, "C": {"Limit": 1.5}, "D": {"Ref": "Ref-0"}}
    odd = dated.withColumn("H", F.col("H").withField("Status", F.lit("?")).withField("No", F.lit(None).cast("string")))
    r = mapping.forward(odd, steps(), ["seed"]).first()
    assert r["rejected"] and r["escalations"] == ["status"] and r["canonical"]["reference"] is None


def test_round_trip(spark):
    fields = [RegionField("H.Date", "date") if f.path == "H.Date" else f for f in FIELDS]
    summary = mapping.round_trip(spark, steps(fields=fields), fields)
    assert summary == {"cases": 24, "passed": True, "declaredLosses": [{"path": "H.Date", "kind": "precision"}]}
    lossy = Spec((*ENTRIES[:4], Entry("D.Ref", "x", "normaliseCase(mode='upper')"), ENTRIES[5]), SPEC.value_maps)
    with pytest.raises(mapping.RoundTripFailed):
        mapping.round_trip(spark, steps(lossy, fields), fields)


@pytest.mark.parametrize(
    "call,value,there,back",
    [
        ("formatDate(fmt='dd/MM/yyyy')", "CAST('2020-03-04' AS DATE)", "04/03/2020", "2020-03-04"), ("toLocalDate(zone='Europe/London')", "TIMESTAMP'2020-06-30 23:30:00'", "2020-07-01", "2020-06-30 23:00:00"),
        (r"decompose(pattern='(?P<a>[a-z]+)-(?P<b>[0-9]+)', template='{a}-{b}')", "'ab-12'", "Row(a='ab', b='12')", "ab-12"), ("concat(separator='|')", "array('a', 'b')", "a|b", "['a', 'b']"), ("scale(factor=0.5)", "4", "2.0", "4.0"),
        ("coalesce", "array(NULL, 'x', 'y')", "x", None), ("constant('c')", "'x'", "c", None), ("normaliseCase(mode='title')", "\"o'neil x\"", "O'Neil X", "O'Neil X"),
    ],
)
def test_transforms(spark, call, value, there, back):
    (c,) = mapping.parse(call)
    t = mapping.TRANSFORMS[c.name]
    row = spark.range(1).select(t.forward(F.expr(value), **c.args)[0].alias("v"))
    assert str(row.first()["v"]) == there
    if back is None:
        assert t.reverse is None
    else:
        assert str(row.select(t.reverse(F.col("v"), **c.args)[0].alias("v")).first()["v"]) == back


def source(**more):
    return {"artefactId": "a", "runId": "r", "region": "uk", "system": "git", "uri": "x", "mediaType": "application/json", "contentHash": "0" * 64, "evidenceTier": 1} | more


def test_openapi():
    node = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "minLength": 1, "enum": ["A"]}, "tags": {"type": "array", "items": {"type": "integer", "format": "int32"}}, "who": {"$ref": "#/components/schemas/P"}, "in": {"type": "object", "properties": {"x": {"type": ["a"]}}}, "at": {"type": "string", "format": "date-time"}}}
    document = {"components": {"schemas": {"C": node}}, "paths": {"/a/{b}": {"get": {"operationId": "g", "parameters": [{"name": "b", "required": True, "schema": {"type": "string"}}]}}}}
    rows = {r["path"]: r for r in parsers.parse(source(), json.dumps(document).encode())}
    assert set(rows) == {"C.id", "C.tags", "C.who", "C.in", "C.in.x", "C.at", "g.b"}
    assert rows["C.id"]["cardinality"] == "1..1" and rows["C.id"]["obligation"]["level"] == "mandatory" and rows["C.id"]["constraints"][0]["expression"] == "minLength=1"
    assert rows["C.tags"]["cardinality"] == "0..n" and rows["C.tags"]["typeDetail"]["bits"] == 32 and rows["C.who"]["dataType"] == "reference" and rows["C.in.x"]["dataType"] == "unknown"
    assert rows["C.at"]["typeDetail"]["offsetRequired"] and rows["C.in.x"]["parentPath"] == "C.in" and rows["g.b"]["evidenceRefs"] == ["evref://uk/git/a@0000000000000000#/paths/~1a~1{b}/get/parameters/0/schema"]
    assert parsers.parse(source(), b"{")[0]["error"] and parsers.parse(source(mediaType="text/plain"), b"")[0]["error"]


XSD = b"""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="Notice" type="NoticeType"/><xs:element name="Party" type="xs:string"/><xs:element name="Person" type="xs:string" substitutionGroup="Party"/>
<xs:complexType name="Base"><xs:sequence><xs:element name="ref" type="xs:string"/></xs:sequence></xs:complexType>
<xs:complexType name="NoticeType"><xs:complexContent><xs:extension base="Base"><xs:sequence><xs:element name="loss" type="xs:date" nillable="true" minOccurs="0"/><xs:element name="item" type="xs:int" maxOccurs="unbounded"/>
<xs:choice id="by"><xs:element name="phone" type="xs:string"/><xs:element name="mail" type="xs:odd"/></xs:choice></xs:sequence><xs:attribute name="v" type="xs:long" use="required"/></xs:extension></xs:complexContent></xs:complexType></xs:schema>"""


def test_xsd_and_wsdl():
    rows = {r["path"]: r for r in parsers.parse(source(mediaType="application/xml"), XSD)}
    assert rows["Notice"]["dataType"] == "object" and rows["Notice.ref"]["typeDetail"]["inheritedFrom"] == "Base"
    assert rows["Notice.loss"]["typeDetail"]["explicitNull"] and rows["Notice.loss"]["cardinality"] == "0..1" and rows["Notice.item"]["cardinality"] == "1..n"
    assert {rows[f"Notice.{n}"]["typeDetail"]["choiceGroup"] for n in ("phone", "mail")} == {"by"} and rows["Notice.mail"]["obligation"]["level"] == "conditional" and rows["Notice.mail"]["dataType"] == "unknown"
    assert rows["Notice.v"]["obligation"]["level"] == "mandatory" and rows["Party"]["typeDetail"]["substitutionHead"] and rows["Person"]["typeDetail"]["substitutionOf"] == "attr://uk/a/Party"
    wsdl = b'<w:definitions xmlns:w="http://schemas.xmlsoap.org/wsdl/"><w:types>' + XSD + b"</w:types></w:definitions>"
    assert [r["path"] for r in parsers.parse(source(mediaType="application/xml"), wsdl)] == list(rows)
    cyclic = b'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a" type="T"/><xs:complexType name="T"><xs:sequence><xs:element name="t" type="T"/></xs:sequence></xs:complexType></xs:schema>'
    assert 10 < len(parsers.parse(source(mediaType="application/xml"), cyclic)) < 100


def test_avro():
    fields = [{"name": "id", "type": "string"}, {"name": "on", "type": {"type": "int", "logicalType": "date"}}, {"name": "sum", "type": {"type": "bytes", "logicalType": "decimal"}}, {"name": "u", "type": ["null", "string"]}, {"name": "xs", "type": {"type": "array", "items": "long"}}, {"name": "r", "type": {"type": "record", "name": "R", "fields": [{"name": "f", "type": "float"}]}}]
    rows = {r["localName"]: r for r in parsers.parse(source(uri="e.avsc"), json.dumps({"type": "record", "name": "E", "fields": fields}).encode())}
    assert {k: r["dataType"] for k, r in rows.items()} == {"id": "string", "on": "date", "sum": "decimal", "u": "unknown", "xs": "integer", "r": "object", "f": "unknown"}
    assert rows["xs"]["cardinality"] == "0..n" and rows["f"]["parentPath"] == "E.r"


def test_structure(spark):
    text = json.dumps({"title": "A form", "properties": {"claimant": {"type": "string", "example": "A. Smith, SW1A 1AA"}}}).encode()
    structural, examples, prose = parsers.structure(text, "application/json")
    assert examples == ["A. Smith, SW1A 1AA"] and prose == ["A form"] and "string" in structural
    assert parsers.structure(b"just text", "text/plain") == ([], [], ["just text"])
    df = spark.createDataFrame([(1, text, "application/json")], "id int, content binary, mediaType string")
    assert parsers.structures(df, "id").first()["examples"] == examples


def test_relevance(spark):
    rows = [("git://claims/openapi.yaml", "application/yaml"), ("confluence://CLAIMS/1", "text/html"), ("git://menu/lunch.yaml", "application/yaml")]
    listing = spark.createDataFrame(rows, "uri string, media_type string").withColumn("catalogue_domain", F.lit(None).cast("string")).withColumn("has_live_route", F.lit(None).cast("boolean"))
    keep, out = connectors.filter_relevant(listing, "claims")
    assert {r["uri"]: round(r["score"], 2) for r in keep.collect()} == {"git://claims/openapi.yaml": 0.7, "confluence://CLAIMS/1": 0.63}
    assert [tuple(r) for r in out.collect()] == [("git://menu/lunch.yaml", "out-of-domain", "pass1 score 0.10", "pass1")]
    verdicts = lambda df: df.select("uri", F.lit(False).alias("in_domain"), F.lit("no").alias("reason"))
    keep, out = connectors.filter_relevant(listing, "claims", Settings(), verdicts)
    assert keep.count() == 1 and {r["decidedBy"] for r in out.collect()} == {"pass1", "repository-scout"}


def test_files_and_evidence(spark, tmp_path):
    (tmp_path / "repo" / "a").mkdir(parents=True)
    (tmp_path / "repo" / "a" / "x.json").write_text("{}")
    (tmp_path / "repo" / "y.bin").write_text("z")
    folder = str(tmp_path / "repo")
    listing = connectors.list_files(spark, folder, "git", "us", "r", "abc")
    assert sorted((r["uri"], r["media_type"]) for r in listing.collect()) == [("git://r/a/x.json", "application/json"), ("git://r/y.bin", "application/octet-stream")]
    raw = connectors.artefacts(connectors.read_files(spark, folder, listing))
    store = str(tmp_path / "store")
    assert connectors.put_evidence(spark, store, raw) == 2 and connectors.put_evidence(spark, store, raw) == 0
    one = raw.first()
    assert bytes(connectors.get_evidence(spark, store, one["contentHash"]).first()["content"]) == bytes(one["content"])
    page = {"id": "1", "title": "T", "space": {"key": "K"}, "version": {"number": 3}, "body": {"storage": {"value": "<p>Hello <b>x</b></p>"}}}
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "1.json").write_text(json.dumps(page))
    r = connectors.list_wiki(spark, str(tmp_path / "wiki"), "uk").first()
    assert (r["uri"], r["description"], r["version"]) == ("confluence://K/1", "Hello x", "3")
    assert connectors.corpus_hash(raw).first() == connectors.corpus_hash(raw.repartition(3)).first() and connectors.corpus_hash_tree(raw).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 150 AS event_id", "timestamp_seconds(1700000000 + (id % 150) * 120) AS ts", "IF(id % 2 = 0, 'a', 'b') AS kind")
    folder = str(tmp_path / "journal")
    rows.repartition(3).write.parquet(folder)
    query = journal.start(journal.hourly(journal.read(spark, folder, "event_id long, ts timestamp, kind string")), "hours", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, journal.hourly(rows.repartition(1)).collect()))
