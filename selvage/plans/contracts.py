"""Queries of the parsers, chunkers and document gate on interface definitions, written out from the driver's tables.

Every part becomes a small contract of each format; the statements in SQL say what has to be read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators import chunks, gate, match
from selvage.plans.catalogue import _BLOCKS, attributes, query, table
from selvage.sources import parsers


def _k() -> Column:
    return F.col("p_partkey").cast("string")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _artefacts(spark: SparkSession, sf_dir: str, content: Column, media_type: str | Column) -> DataFrame:
    """An artefact x<key> for each part."""
    kind = F.lit(media_type) if isinstance(media_type, str) else media_type
    return table(spark, sf_dir, "part").select(
        _text("x", _k()).alias("artefactId"), F.lit("run-1").alias("runId"), F.lit("us").alias("region"), F.lit("git").alias("system"), F.lit("contract").alias("uri"), kind.alias("mediaType"),
        F.sha2(content, 256).alias("contentHash"), F.lit(1).alias("evidenceTier"), F.encode(content, "UTF-8").alias("content"),
    )


def _xsd() -> Column:
    """A type that extends another, a choice, an attribute, and an element that may stand for another one."""
    many, use = F.when(F.col("p_partkey") % 3 == 0, "unbounded").otherwise("1"), F.when(F.col("p_partkey") % 2 == 0, "required").otherwise("optional")
    return _text(
        '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:complexType name="Base"><xs:sequence><xs:element name="base" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType>',
        '<xs:complexType name="T"><xs:complexContent><xs:extension base="Base"><xs:sequence><xs:element name="size" type="xs:int" maxOccurs="', many, '"/></xs:sequence>',
        '<xs:choice id="pick"><xs:element name="a" type="xs:date"/><xs:element name="b" type="xs:boolean"/></xs:choice><xs:attribute name="code" type="xs:token" use="', use, '"/></xs:extension></xs:complexContent></xs:complexType>',
        '<xs:element name="Head" type="xs:string"/><xs:element name="P', _k(), '" type="T" substitutionGroup="Head" nillable="true"/></xs:schema>',
    )


def _wsdl() -> Column:
    return _text('<w:definitions xmlns:w="http://schemas.xmlsoap.org/wsdl/"><w:types>', _xsd(), "</w:types></w:definitions>")


_XML_SQL = """WITH k AS (SELECT p_partkey AS k, 'P' || p_partkey AS p FROM part),
r AS (SELECT k, p, unnest(['', '.base', '.size', '.a', '.b', '.code']) AS n, unnest(['object', 'string', 'integer', 'date', 'boolean', 'string']) AS data_type FROM k),
e AS (SELECT k, p || n AS path, data_type, CASE WHEN n = '' THEN NULL ELSE p END AS parent_path,
  CASE WHEN n IN ('.a', '.b') THEN 'conditional' WHEN n = '.base' OR n = '.code' AND k % 2 = 1 THEN 'optional' ELSE 'mandatory' END AS level,
  CASE WHEN n = '.base' OR n = '.code' AND k % 2 = 1 THEN '0' ELSE '1' END || CASE WHEN n = '.size' AND k % 3 = 0 THEN '..n' ELSE '..1' END AS cardinality,
  CASE WHEN n = '' THEN 'attr://us/x' || k || '/Head' WHEN n = '.base' THEN 'Base' WHEN n IN ('.a', '.b') THEN 'pick' ELSE '' END AS detail,
  '//' || p || CASE WHEN n = '.code' THEN '/@code' ELSE replace(n, '.', '/') END AS place FROM r
  UNION ALL SELECT k, 'Head', 'string', NULL, 'mandatory', '1..1', 'head', '//Head' FROM k)
SELECT 'attr://us/x' || k || '/' || path AS attribute_id, data_type, level, cardinality, parent_path, detail, place, contains(path, 'P') AND parent_path IS NULL AS explicit_null FROM e"""


def _parsed(rows: DataFrame) -> DataFrame:
    d = F.col("typeDetail")
    detail = F.coalesce(d["inheritedFrom"], d["choiceGroup"], d["substitutionOf"], F.when(d["substitutionHead"], "head"), F.lit(""))
    return rows.select(
        F.col("attributeId").alias("attribute_id"), F.col("dataType").alias("data_type"), F.col("obligation.level").alias("level"), "cardinality", F.col("parentPath").alias("parent_path"), detail.alias("detail"),
        F.element_at(F.split(F.col("evidenceRefs")[0], "#"), -1).alias("place"), F.coalesce(d["explicitNull"], F.lit(False)).alias("explicit_null"),
    )


@query(_XML_SQL)
def parse_xsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parsers.attributes(_artefacts(spark, sf_dir, _xsd(), "application/xml")))


@query(_XML_SQL)
def parse_wsdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same schema inside a service description."""
    return _parsed(parsers.attributes(_artefacts(spark, sf_dir, _wsdl(), "application/xml")))


def _avro() -> Column:
    return _text(
        '{"type":"record","name":"R","fields":[{"name":"s","type":"string","doc":"text ', _k(), '"},{"name":"n","type":{"type":"array","items":"long"}},{"name":"t","type":{"type":"long","logicalType":"timestamp-millis"}},',
        '{"name":"d","type":{"type":"bytes","logicalType":"decimal"}},{"name":"r","type":{"type":"record","name":"Q","fields":[{"name":"i","type":"int"}]}},{"name":"u","type":["null","string"]}]}',
    )


@query("""WITH r AS (SELECT p_partkey AS k, unnest(['s', 'n', 't', 'd', 'r', 'r.i', 'u']) AS n, unnest(['string', 'integer', 'dateTime', 'decimal', 'object', 'integer', 'unknown']) AS data_type, unnest([0, 64, 0, 0, 0, 32, 0]) AS bits FROM part)
SELECT 'attr://us/x' || k || '/R.' || n AS attribute_id, data_type, CASE WHEN n = 'n' THEN '0..n' ELSE '1..1' END AS cardinality, CASE WHEN n = 'r.i' THEN 'R.r' ELSE 'R' END AS parent_path, bits, CASE WHEN n = 's' THEN 'text ' || k END AS description FROM r""")
def parse_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsers.attributes(_artefacts(spark, sf_dir, _avro(), "application/avro+json"))
    return rows.select(
        F.col("attributeId").alias("attribute_id"), F.col("dataType").alias("data_type"), "cardinality", F.col("parentPath").alias("parent_path"), F.coalesce("typeDetail.bits", F.lit(0)).alias("bits"), F.col("semantics.description").alias("description")
    )


@query("""SELECT 'x' || p_partkey AS artefact, CASE WHEN p_partkey % 3 = 1 THEN 'ParseError' ELSE 'ValueError' END AS problem FROM part WHERE p_partkey % 3 > 0""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are cut off, or of no known kind, give one row with the error each."""
    kind = F.col("p_partkey") % 3
    content = F.when(kind == 0, _avro()).when(kind == 1, F.substring(_xsd(), 1, 90)).otherwise(F.lit("plain"))
    media = F.when(kind == 0, "application/avro+json").when(kind == 1, "application/xml").otherwise("text/plain")
    rows = parsers.attributes(_artefacts(spark, sf_dir, content, media)).where("error IS NOT NULL")
    return rows.select(F.col("sourceContract").alias("artefact"), F.split("error", ":")[0].alias("problem"))


# --- places of texts, and the gate on them ----------------------------------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.concat(F.repeat(F.lit('{"a":'), 140), F.lit('{"description":"deep '), _k(), F.lit('@example.org"}'), F.repeat(F.lit("}"), 140))
    flat = _text('{"info":{"title":"t', _k(), '","description":"write to ', _k(), '@example.org"},"example":{"v":"ex-', _k(), '","w":[1,2]},"name":"nm-', _k(), '","type":"object"}')
    content = F.when(F.col("p_partkey") % 50 == 0, deep).otherwise(flat)
    return parsers.structures(_artefacts(spark, sf_dir, content, "application/json"), "artefactId")


@query("""SELECT 'x' || p_partkey AS artefact, 'info,nm-' || p_partkey || ',object' AS structural, 'ex-' || p_partkey || ',1,2' AS examples, 't' || p_partkey || ',write to ' || p_partkey || '@example.org' AS prose FROM part WHERE p_partkey % 50 <> 0""")
def structure_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural texts, examples and prose of a document (all but the deep ones, which query gate_structured has)."""
    joined = [F.array_join(c, ",").alias(c) for c in ("structural", "examples", "prose")]
    return _places(spark, sf_dir).where(F.size("structural") < 100).select(F.col("artefactId").alias("artefact"), *joined)


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 50 <> 0) AS flat FROM part)
SELECT 'L0' AS rung, 'structural-position' AS detector, flat * 3 + (n - flat) * 129 AS n FROM c UNION ALL SELECT 'L3', 'example-literal', flat * 3 FROM c UNION ALL SELECT 'L1', 'email', n FROM c""")
def gate_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the ladder on documents by the place of their texts; what lies too deep to be placed counts as prose."""
    own = _places(spark, sf_dir)
    return gate.hits(own.select(gate.spans(F.array_join("prose", "\n"), F.col("structural"), F.col("examples")).alias("spans")))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS born FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates near a mention of a birth: none without a mention, and none further away than the window."""
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    said = F.when(key % 5 == 0, _text("delivered on ", day)).when(key % 7 == 0, _text("born ", F.repeat(F.lit("then "), 12), day)).otherwise(_text("the customer, born in spring, that is ", day, " in all records"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.explode(gate.births(said)).alias("born"))


# --- chunks ------------------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 3 AS kind, unnest(CASE p_partkey % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['R', 'Q'] ELSE ['Base', 'T'] END) AS name FROM part)
SELECT 'x' || k AS artefact, name, kind = 0 AND name = 'A' OR kind = 1 AND name = 'R' OR kind = 2 AND name = 'T' AS whole FROM c""")
def contract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each component of a contract; `whole`: what it refers to, contains or extends is in it too."""
    kind = F.col("p_partkey") % 3
    openapi = _text('{"components":{"schemas":{"A":{"properties":{"b":{"$ref":"#/components/schemas/B"}}},"B":{"type":"object","title":"t', _k(), '"}}}}')
    content = F.when(kind == 0, openapi).when(kind == 1, _avro()).otherwise(_xsd())
    media = F.when(kind == 0, "application/json").when(kind == 1, "application/avro+json").otherwise("application/xml")
    found = chunks.chunk_contracts(_artefacts(spark, sf_dir, content, media))
    whole = (F.contains("text", F.lit("$inlined"))) | (F.contains("text", F.lit('"name": "Q"')) & (F.col("name") == "R")) | (F.contains("text", F.lit('name="base"')) & (F.col("name") == "T"))
    return found.select(F.col("artefactId").alias("artefact"), "name", whole.alias("whole"))


@query("""WITH c AS (SELECT 'd' || p_partkey AS artefact, p_partkey AS k, p_name || ' ' || p_partkey % 400 AS text FROM part)
SELECT sha256(text) AS chunk_hash, min(artefact) AS artefact, 'run-1' AS run_id FROM c WHERE k % 4 <> 0 AND text NOT IN (SELECT text FROM c WHERE k % 4 = 0) GROUP BY text""")
def chunk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks of a run: one of a hash, and none that the run has stored."""
    own = table(spark, sf_dir, "part").select(_text("d", _k()).alias("artefactId"), F.lit("c").alias("name"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 400).cast("string")).alias("text"), (F.col("p_partkey") % 4 == 0).alias("old"))
    stored = chunks.ingest(own.where("old").drop("old"), None, "run-1")
    return chunks.ingest(own.where("NOT old").drop("old"), stored, "run-1").select("chunk_hash", F.col("artefactId").alias("artefact"), "run_id")


# --- blocks by neighbours --------------------------------------------------------------------------------------------------------------


@query(_BLOCKS + """, n AS (SELECT x.id AS q, list_sort(list_distinct([x.id, y.id, z.id])) AS members FROM b x JOIN b y ON y.key = x.key + 1 JOIN b z ON z.key = x.key + 2 WHERE x.key % 10 = 1)
SELECT 'near:' || q AS block, array_to_string(members, ',') AS members FROM n WHERE members NOT IN (SELECT members FROM blocks WHERE block LIKE 'head:%')""")
def blocks_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that nearest neighbours make: here the two attributes that follow."""
    own = attributes(spark, sf_dir)
    ids = own.select("attributeId", "key")
    near = ids.where("key % 10 = 1").select(F.col("attributeId").alias("query"), F.explode(F.array(F.col("key") + 1, F.col("key") + 2)).alias("key")).join(ids, "key").select("query", "attributeId")
    both = near.groupBy("query").agg(F.count("*").alias("n")).where("n = 2").select("query")
    found = match.blocks(match.profile(own), neighbours=near.join(both, "query"))
    return found.where("key LIKE 'near:%'").select(F.col("key").alias("block"), F.array_join("members", ",").alias("members"))
