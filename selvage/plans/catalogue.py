"""The operators on the driver's tables, each with an independent statement in SQL.

The tables hold no interface metadata, so attribute rows are derived from `part`, a graph from `region`, `nation` and
`supplier`, records from `orders`, a ledger and a journal from `events`. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.config import DATA_TYPES, REGIONS, Settings
from selvage.functions import similarity as sim
from selvage.functions import text as names
from selvage.functions.digest import token
from selvage.operators import emit, evaluation, gate, graph, invariants, mapping, match, model, retrieval
from selvage.sources import connectors, parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = bytes(range(32))
_PADS = [bytes(b ^ p for b in KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where they are fewer files than cores, dealt out first: a file of one row group is read by one task."""
    rows = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- derived rows ---------------------------------------------------------------------------------------------------------------

_SUFFIXES = ("", "Id", "Amount", "Date", "Codes")
_LEVELS = ("mandatory", "conditional", "optional")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))
    key, word = F.col("p_partkey"), F.split("p_name", " ")
    region = pick(REGIONS, key % 3)
    contract = F.concat(F.lit("t"), (key % 7).cast("string"))
    constraint = F.struct(F.lit("range").alias("kind"), F.concat(F.lit("minimum="), F.floor("p_retailprice").cast("string")).alias("expression"), F.lit("schema").alias("source"))
    top = F.struct(F.lit("range").alias("kind"), F.concat(F.lit("maximum="), (F.floor("p_retailprice") + F.col("p_size") * 10).cast("string")).alias("expression"), F.lit("schema").alias("source"))
    value = lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("meaning"), F.lit("declared").alias("source"))
    return part.select(
        F.concat(F.lit("attr://"), region, F.lit("/"), contract, F.lit("/"), key.cast("string")).alias("attributeId"), F.lit("run-1").alias("runId"), region.alias("region"), contract.alias("sourceContract"),
        F.concat(F.col("p_brand"), F.lit("."), "p_name").alias("path"),
        F.concat(word[0], F.initcap(word[1]), pick(_SUFFIXES, key % 5)).alias("localName"), pick(DATA_TYPES, F.col("p_size") % 13).alias("dataType"),
        F.struct(pick(_LEVELS, F.col("p_size") % 3).alias("level")).alias("obligation"), F.concat(F.lit("Part."), "p_type").alias("parentPath"),
        F.when(key % 4 == 0, F.array(constraint, top)).when(key % 4 == 1, F.array(constraint)).otherwise(F.array().cast("array<struct<kind:string,expression:string,source:string>>")).alias("constraints"),
        F.when(key % 6 == 0, F.array(value(F.lit("A")), value(F.col("p_type")))).alias("enumeration"),
        F.struct(F.when(key % 9 == 0, F.concat(F.lit("One of the "), "p_name", F.lit(" values"))).alias("description")).alias("semantics"),
        (1 + key % 4).cast("int").alias("evidenceTier"), (key % 10 == 0).alias("inferred"),
        F.array(F.concat(F.lit("evref://"), region, F.lit("/git/"), contract, F.lit("@0123456789abcdef#/"), key.cast("string"))).alias("evidenceRefs"), key.alias("key"),
    )


_A = f"""WITH a AS (
  SELECT p_partkey AS key, {_sql_list(REGIONS)}[CAST(p_partkey % 3 AS INT) + 1] AS region, 't' || (p_partkey % 7) AS contract,
         split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || {_sql_list(_SUFFIXES)}[CAST(p_partkey % 5 AS INT) + 1] AS localName,
         {_sql_list(DATA_TYPES)}[p_size % 13 + 1] AS dataType, {_sql_list(_LEVELS)}[p_size % 3 + 1] AS level, 'Part.' || p_type AS parentPath,
         CAST(1 + p_partkey % 4 AS INT) AS tier, p_partkey % 10 = 0 AS inferred, p_name, p_type, p_size, p_brand,
         CASE WHEN p_partkey % 9 = 0 THEN 'One of the ' || p_name || ' values' END AS description,
         CASE WHEN p_partkey % 4 <= 1 THEN CAST(floor(p_retailprice) AS DOUBLE) END AS lo,
         CASE WHEN p_partkey % 4 = 0 THEN CAST(floor(p_retailprice) + p_size * 10 AS DOUBLE) END AS hi,
         CASE WHEN p_partkey % 6 = 0 THEN ['A', upper(p_type)] END AS enums
  FROM part),
b AS (SELECT *, 'attr://' || region || '/' || contract || '/' || key AS id,
        string_split(lower(regexp_replace(localName, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' ') AS tokens FROM a)"""

_LEMMA = """CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y'
  WHEN length({t}) > 4 AND regexp_matches({t}, '(ches|shes|xes|zes|ses)$') THEN left({t}, length({t}) - 2)
  WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1)
  WHEN length({t}) > 6 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3)
  WHEN length({t}) > 5 AND {t} LIKE '%ed' THEN left({t}, length({t}) - 2) ELSE {t} END"""
_FAMILY = "CASE WHEN dataType = 'string' THEN 'text' WHEN dataType IN ('integer', 'decimal') THEN 'numeric' WHEN dataType = 'boolean' THEN 'flag' WHEN dataType IN ('date', 'dateTime', 'time', 'duration') THEN 'temporal' WHEN dataType IN ('object', 'array', 'reference') THEN 'structural' ELSE 'opaque' END"
_PREFER = "('date','dateTime','amount','number','code','indicator','description','reference','quantity','claim','policy','time','timestamp','at','when','occurred','datetime','reserve','premium','price','cost','fee','value','sum','total')"
_HEADS = (
    _A
    + f""", l AS (SELECT *, list_transform(tokens, lambda t: {_LEMMA.format(t="t")}) AS stems FROM b),
h AS (SELECT *, {_FAMILY} AS family, coalesce(list_filter(stems, lambda t: t IN {_PREFER})[-1], stems[-1], '') AS head FROM l)"""
)
_BLOCKS = (
    _HEADS
    + """, keyed AS (SELECT id, 'head:' || head AS k FROM h UNION ALL SELECT id, 'type:' || family || '|' || left(head, 3) FROM h),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS place FROM keyed),
grouped AS (SELECT k, list(id ORDER BY id) AS members FROM placed WHERE place <= 40 GROUP BY k HAVING count(*) > 1),
blocks AS (SELECT min(k) AS block, members FROM grouped GROUP BY members)"""
)
_PAIRS = _BLOCKS + """, m AS (SELECT block, unnest(members) AS id FROM blocks), pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM m x JOIN m y ON x.block = y.block AND x.id < y.id)"""
_JACCARD = "(CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({x}), list_distinct({y})))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)"
_INTERVAL = """CASE WHEN {a}lo IS NULL AND {a}hi IS NULL OR {b}lo IS NULL AND {b}hi IS NULL THEN NULL
  WHEN greatest(coalesce({a}hi, 'inf'::DOUBLE), coalesce({b}hi, 'inf'::DOUBLE)) = least(coalesce({a}lo, '-inf'::DOUBLE), coalesce({b}lo, '-inf'::DOUBLE)) THEN 1.0
  WHEN greatest(coalesce({a}hi, 'inf'::DOUBLE), coalesce({b}hi, 'inf'::DOUBLE)) - least(coalesce({a}lo, '-inf'::DOUBLE), coalesce({b}lo, '-inf'::DOUBLE)) = 'inf'::DOUBLE
    THEN CASE WHEN least(coalesce({a}hi, 'inf'::DOUBLE), coalesce({b}hi, 'inf'::DOUBLE)) - greatest(coalesce({a}lo, '-inf'::DOUBLE), coalesce({b}lo, '-inf'::DOUBLE)) = 'inf'::DOUBLE THEN 1.0 ELSE 0.0 END
  ELSE greatest(0.0, least({a}hi, {b}hi) - greatest({a}lo, {b}lo)) / (greatest({a}hi, {b}hi) - least({a}lo, {b}lo)) END"""
_TYPES = """CASE WHEN x.dataType = y.dataType THEN 1.0 ELSE CASE least(x.dataType, y.dataType) || '~' || greatest(x.dataType, y.dataType)
  WHEN 'date~dateTime' THEN 0.85 WHEN 'date~string' THEN 0.55 WHEN 'decimal~integer' THEN 0.70 WHEN 'boolean~string' THEN 0.30 WHEN 'object~string' THEN 0.10 ELSE 0.0 END END"""
_SCORES = f""", s AS (SELECT h.id, coalesce((SELECT list(o.localName) FROM h o WHERE o.contract = h.contract AND o.parentPath = h.parentPath AND o.id <> h.id), []) AS siblings FROM h),
f AS (SELECT h.*, s.siblings FROM h JOIN s ON h.id = s.id),
scored AS (SELECT p.a, p.b, {_JACCARD.format(x="x.tokens", y="y.tokens")} AS lexical, {_TYPES} AS type_score,
  CASE WHEN x.enums IS NOT NULL AND y.enums IS NOT NULL THEN {_JACCARD.format(x="x.enums", y="y.enums")}
       WHEN x.lo IS NULL AND y.lo IS NULL THEN 0.5 WHEN x.lo IS NULL OR y.lo IS NULL THEN 0.3
       ELSE {_INTERVAL.format(a="x.", b="y.")} END AS constraint_score,
  0.5 * {_JACCARD.format(x="string_split(x.parentPath, '.')", y="string_split(y.parentPath, '.')")} + 0.5 * {_JACCARD.format(x="x.siblings", y="y.siblings")} AS context
  FROM pairs p JOIN f x ON p.a = x.id JOIN f y ON p.b = y.id),
final AS (SELECT *, 0.0::DOUBLE + 0.27::DOUBLE * lexical + 0.05::DOUBLE * 0.0 + 0.2::DOUBLE * type_score + 0.27::DOUBLE * constraint_score + 0.21::DOUBLE * context AS score FROM scored)"""
_SCORED = (_PAIRS + _SCORES).replace("WITH a AS", "WITH RECURSIVE a AS", 1)


# --- sources -----------------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT page_id, 0.0::DOUBLE + 0.6::DOUBLE * CASE WHEN len(list_filter(string_split_regex(lower(url), '[^a-z0-9]+'), lambda w: contains(w, 'the') OR contains(w, 'claim'))) > 0 THEN 1.0 ELSE 0.0 END
  + 0.2::DOUBLE * CASE WHEN page_id % 3 = 0 THEN 1.0 ELSE 0.0 END + 0.1::DOUBLE * CASE WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.0 END + 0.1::DOUBLE * CASE WHEN page_id % 5 = 0 THEN 1.0 ELSE 0.3 END AS score FROM pages)
SELECT page_id, round(score::DOUBLE, 6) AS score, CASE WHEN score >= 0.65 THEN 'keep' WHEN score <= 0.2 THEN 'drop' ELSE 'uncertain' END AS bucket FROM s""")
def relevance_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Settings(domain_tokens=("the", "claim"))
    i = F.col("page_id")
    kind, domain = F.when(i % 5 == 0, "application/json").otherwise("text/html"), F.when(i % 3 == 0, "claims")
    score = connectors.relevance(F.col("url"), domain, i % 2 == 0, kind, "claims", own)
    return table(spark, sf_dir, "pages").select("page_id", score.alias("s")).select("page_id", F.round("s", 6).alias("score"), connectors.bucket(F.col("s"), own).alias("bucket"))


@query("SELECT page_id, left('git-us-' || lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 200) AS artefact_id FROM pages")
def artefact_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.slug(F.lit("git"), F.lit("us"), F.col("url")).alias("artefact_id"))


@query("""WITH p AS (SELECT page_id, url || ['.yaml', '.JSON', '.xsd', '.md', '.bin', ''][CAST(page_id % 6 AS INT) + 1] AS path FROM pages)
SELECT page_id, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.yaml' THEN 'application/yaml' WHEN '.json' THEN 'application/json' WHEN '.xsd' THEN 'application/xml' WHEN '.md' THEN 'text/markdown' ELSE 'application/octet-stream' END AS media_type FROM p""")
def media_type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*[F.lit(v) for v in (".yaml", ".JSON", ".xsd", ".md", ".bin", "")]), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", connectors.media_type(F.concat("url", ending)).alias("media_type"))


@query("""SELECT doc_id, ['git', 'catalogue', 'confluence', 'vendor'][CAST(doc_id % 4 AS INT) + 1] AS system, [1, 2, 3, 4][CAST(doc_id % 4 AS INT) + 1] AS tier,
  CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE 'permitted' END AS licence, sha256(text) AS content_hash FROM documents""")
def artefact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.get(F.array(*[F.lit(v) for v in ("git", "catalogue", "confluence", "vendor")]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", system.alias("system"), connectors.tier(system).alias("tier"), connectors.licence(system).alias("licence"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT sha256(CAST(to_json(list_sort(list(sha256(text)))) AS VARCHAR)) AS corpus_hash FROM documents")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.corpus_hash(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("""WITH h AS (SELECT sha256(text) AS h FROM documents), leaf AS (SELECT left(h, 3) AS k, sha256(CAST(to_json(list_sort(list(h))) AS VARCHAR)) AS l FROM h GROUP BY 1)
SELECT sha256(CAST(to_json(list_sort(list(k || ':' || l))) AS VARCHAR)) AS corpus_hash FROM leaf""")
def corpus_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.corpus_hash_tree(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")), "h")


_CONTRACT_TYPES = ("string", "integer", "number", "boolean")


@query("""SELECT 'attr://us/' || p_brand || '/Part.f' || p_partkey AS attribute_id, ['string', 'integer', 'decimal', 'boolean'][CAST(p_partkey % 4 AS INT) + 1] AS data_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'mandatory' ELSE 'optional' END AS level, CASE WHEN p_partkey % 2 = 0 THEN '1..1' ELSE '0..1' END AS cardinality, 'Part' AS parent_path, 'maxLength=' || p_size AS constraint_text FROM part""")
def parse_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OpenAPI contract for each brand, built as JSON and parsed again."""
    kind = F.get(F.array(*[F.lit(v) for v in _CONTRACT_TYPES]), (F.col("p_partkey") % 4).cast("int"))
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    field = F.struct(name.alias("key"), F.struct(kind.alias("type"), F.col("p_size").alias("maxLength")).alias("value"))
    needed = F.when(F.col("p_partkey") % 2 == 0, name)
    # contracts of at most 500 fields, as a brand may have any number of parts
    each = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 500).alias("page")).agg(F.map_from_entries(F.collect_list(field)).alias("properties"), F.collect_list(needed).alias("required"))
    document = F.to_json(F.struct(F.struct(F.struct(F.struct(F.lit("object").alias("type"), "properties", "required").alias("Part")).alias("schemas")).alias("components")))
    contract = each.select(
        F.col("p_brand").alias("artefactId"), F.lit("run-1").alias("runId"), F.lit("us").alias("region"), F.lit("git").alias("system"), F.lit("contract.json").alias("uri"), F.lit("application/json").alias("mediaType"),
        F.sha2(document, 256).alias("contentHash"), F.lit(1).alias("evidenceTier"), F.encode(document, "UTF-8").alias("content"),
    )
    return parsers.attributes(contract).select(
        F.col("attributeId").alias("attribute_id"), F.col("dataType").alias("data_type"), F.col("obligation.level").alias("level"), "cardinality", F.col("parentPath").alias("parent_path"), F.col("constraints")[0]["expression"].alias("constraint_text")
    )


# --- gate ----------------------------------------------------------------------------------------------------------------------------

_LUHN = """list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT)
  ELSE CAST(substr(d, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_FOUND = (
    "WITH raw AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{d}' AS detector, unnest(regexp_extract_all(text, '{_re(p)}')) AS v FROM documents" for d, p in {**gate.PATTERNS, "title-case-sequence": gate.TITLE_CASE, "sensitive-domain-lexicon": gate.LEXICON}.items()
    )
    + f"), digits AS (SELECT *, regexp_replace(v, '[ -]', '', 'g') AS d FROM raw), found AS (SELECT doc_id, detector, v, d FROM digits WHERE detector <> 'card-pan' OR {_LUHN})"
)
# no text of the tables mentions a birth, so that detector is left to the unit tests


@query(_FOUND + " SELECT CASE detector WHEN 'title-case-sequence' THEN 'L2' WHEN 'sensitive-domain-lexicon' THEN 'L4' ELSE 'L1' END AS rung, detector, count(*) AS n FROM found GROUP BY ALL")
def detector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.hits(documents(spark, sf_dir).select(gate.spans(F.coalesce("text", F.lit(""))).alias("spans")))


@query(_FOUND + " SELECT doc_id, d AS card FROM found WHERE detector = 'card-pan'")
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.explode(gate.matches(F.col("text"), "card-pan")).alias("v")).select("doc_id", F.regexp_replace("v", "[ -]", "").alias("card"))


_LABELLED = (
    _FOUND
    + """, l AS (SELECT d.doc_id, d.source, count(*) FILTER (WHERE detector = 'sensitive-domain-lexicon') > 0 AS sensitive, count(*) FILTER (WHERE detector IS NOT NULL AND detector <> 'sensitive-domain-lexicon') > 0 AS identifying
  FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id, d.source)"""
)


@query(_LABELLED + " SELECT CASE WHEN sensitive THEN 'block' WHEN identifying THEN 'mask' ELSE 'allow' END AS verdict, count(*) AS n FROM l GROUP BY 1")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("spans", gate.spans(F.coalesce("text", F.lit(""))))
    return docs.select(gate.verdict(gate.labels(F.col("spans"), F.lit(True))).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(_LABELLED + " SELECT CASE WHEN sensitive THEN 'block-personal' WHEN source IN ('src1', 'src2') THEN 'block-unlicensed' ELSE 'allow-documentary-masked' END AS rule, count(*) AS n FROM l GROUP BY 1")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("spans", gate.spans(F.coalesce("text", F.lit(""))))
    licence = F.when(F.col("source").isin("src1", "src2"), "prohibited").otherwise("permitted")
    return docs.select(gate.policy(gate.labels(F.col("spans"), F.lit(True)), licence, F.lit(True)).alias("p")).groupBy(F.col("p.rule").alias("rule")).agg(F.count("*").alias("n"))


_TOKEN = f"'<IDENTIFYING:' || left(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode('IDENTIFYING:' || {{v}})))), 16) || '>'"


@query(_FOUND + f" SELECT doc_id, v AS email, {_TOKEN.format(v='v')} AS token FROM found WHERE detector = 'email'")
def tokenise_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", F.explode(gate.matches(F.col("text"), "email")).alias("email"))
    return found.select("doc_id", "email", token(KEY, "IDENTIFYING", F.col("email")).alias("token"))


@query(_FOUND + f""", e AS (SELECT doc_id, list(DISTINCT v) AS vs FROM found WHERE detector = 'email' GROUP BY 1),
o AS (SELECT doc_id, list_transform(list_sort(list_transform(vs, lambda v: {{'n': -length(v), 'v': v}})), lambda s: s.v) AS vs FROM e)
SELECT d.doc_id, sha256(CASE WHEN vs IS NULL THEN text ELSE list_reduce(list_prepend(text, vs), lambda acc, v: replace(acc, v, {_TOKEN.format(v='v')})) END) AS sha FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""")
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking by one detector, which SQL can follow; redact_documents masks by all."""
    span = lambda v: F.struct(F.lit("L1").alias("rung"), F.lit("IDENTIFYING").alias("label"), v.alias("value"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(gate.redact(F.col("text"), F.transform(gate.matches(F.col("text"), "email"), span), KEY), 256).alias("sha"))


@query()
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gate.classify(documents(spark, sf_dir).select("doc_id", "text"), KEY)
    return out.select("doc_id", "verdict", F.col("policy.rule").alias("rule"), "exclusion", F.sha2("output", 256).alias("sha"), "residual")


_CHAIN = """WITH RECURSIVE e AS (SELECT event_type AS region, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq,
  '{"eventId":' || event_id || ',"userId":' || user_id || '}' AS body FROM events),
n AS (SELECT *, 'ledger-' || region || '-' || lpad(CAST(seq AS VARCHAR), 6, '0') AS entry FROM e),
c AS (SELECT region, seq, entry, NULL::VARCHAR AS prev, sha256('null|' || entry || '|' || body) AS hash FROM n WHERE seq = 1
  UNION ALL SELECT n.region, n.seq, n.entry, c.hash, sha256(c.hash || '|' || n.entry || '|' || n.body) FROM c JOIN n ON n.region = c.region AND n.seq = c.seq + 1)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.chain(table(spark, sf_dir, "events"), "event_type", ["event_id"], {"eventId": F.col("event_id"), "userId": F.col("user_id")})


@query(_CHAIN + " SELECT region, seq, entry AS entry_id, prev AS prev_hash, hash FROM c")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("region", "seq", F.col("entryId").alias("entry_id"), F.col("prevHash").alias("prev_hash"), "hash")


@query("SELECT event_type AS region, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events QUALIFY seq % 100 = 7")
def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth entry is changed after the fact; exactly those are found."""
    changed = _ledger(spark, sf_dir).withColumn("body", F.when(F.col("seq") % 100 == 7, F.lit("{}")).otherwise(F.col("body")))
    return gate.verify(changed).select("region", "seq")


# --- retrieval -------------------------------------------------------------------------------------------------------------------------

_COLLAPSED = "regexp_replace(regexp_replace({t}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT sha256({_COLLAPSED.format(t='text')}) AS chunk_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def chunk_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(retrieval.chunk_hash(F.col("text")).alias("chunk_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_PLAIN = _COLLAPSED.format(t="regexp_replace({t}, '<[^>]*>', ' ', 'g')")


@query(f"""WITH p AS (SELECT page_id, unnest(string_split_regex(html, '(?i)<h[1-6][^>]*>')[2:]) AS part FROM pages),
q AS (SELECT page_id, {_PLAIN.format(t="string_split_regex(part, '(?i)</h[1-6]>')[1]")} AS heading, {_PLAIN.format(t="coalesce(array_to_string(string_split_regex(part, '(?i)</h[1-6]>')[2:], ''), '')")} AS body FROM p)
SELECT page_id, heading, sha256(body) AS body_hash FROM q WHERE body <> ''""")
def html_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(retrieval.headings(F.col("html"))).alias("c")).select("page_id", F.col("c.heading").alias("heading"), F.sha2("c.body", 256).alias("body_hash"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE generate_series(0, greatest(0, CAST(ceil((len(w) - 900) / 765.0) AS INT)) * 765, 765) END) AS s FROM w)
SELECT doc_id, sha256(array_to_string(w[s + 1 : s + 900], ' ')) AS chunk_hash, count(*) AS n FROM s GROUP BY ALL""")
def word_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", F.explode(retrieval.word_windows(F.col("text"))).alias("c"))
    return own.groupBy("doc_id", F.sha2("c", 256).alias("chunk_hash")).agg(F.count("*").alias("n"))


_QUERY = "the that of thing the"
_BM25 = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT unnest(['the', 'that', 'of', 'thing']) AS t, unnest([2, 1, 1, 1]) AS asked), tf AS (SELECT doc_id, len(w) AS l, t, asked, len(list_filter(w, lambda x: x = t)) AS f FROM w, q),
df AS (SELECT t, count(*) AS df FROM tf WHERE f > 0 GROUP BY t),
bm AS (SELECT doc_id, sum(asked * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (t), stats WHERE f > 0 GROUP BY doc_id)"""


@query("WITH " + _BM25 + " SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieval.bm25(documents(spark, sf_dir), [_QUERY], "doc_id")
    return retrieval.top(scores.withColumn("score", F.round("score", 9)), 25, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


_ASKED = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VECTOR = f"vs AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_ASKED}::DOUBLE[]) AS score FROM embeddings)"


@query("WITH " + _VECTOR + " SELECT vec_id, round(score, 6) AS score FROM vs ORDER BY round(score, 9) DESC, vec_id LIMIT 25")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieval.vector_scores(table(spark, sf_dir, "embeddings"), _ASKED, "vec_id").withColumn("score", F.round("score", 9))
    return retrieval.top(scores, 25, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT q.vec_id AS query, r.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query, vec_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM k WHERE rank <= 10""")
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = retrieval.neighbours(rows.where("vec_id % 20 = 0"), rows, "vec_id", 10)
    return found.select("query", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("WITH " + _BM25 + ", " + _VECTOR + """, ranks AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, true AS word FROM bm UNION ALL SELECT vec_id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id), false FROM vs)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ranks WHERE word OR rank <= 10000 GROUP BY id ORDER BY score DESC, id LIMIT 25""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = retrieval.bm25(documents(spark, sf_dir), [_QUERY], "doc_id").select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    vectors = retrieval.vector_scores(table(spark, sf_dir, "embeddings"), _ASKED, "vec_id").select(F.col("vec_id").alias("id"), F.round("score", 9).alias("score"))
    return retrieval.hybrid(words, vectors, "id", digits=9).select("id", "score")


@query(f"""WITH t AS (SELECT DISTINCT p_name, lower({_COLLAPSED.format(t='p_name')}) AS norm FROM part), d AS (SELECT p_name, sha256(norm || '|0') AS h0, sha256(norm || '|1') AS h1 FROM t),
r AS (SELECT p_name, list_transform([substr(h0, 1, 16), substr(h0, 17, 16), substr(h0, 33, 16), substr(h0, 49, 16), substr(h1, 1, 16), substr(h1, 17, 16), substr(h1, 33, 16), substr(h1, 49, 16)], lambda x: CAST(CAST('0x' || x AS UBIGINT) AS DOUBLE) / 9223372036854775808.0 - 1.0) AS v FROM d)
SELECT p_name, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM r""")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", retrieval.embed(F.col("p_name"), 8).alias("v"))
    return own.select("p_name", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[7], 6).alias("last"))


# --- graph -------------------------------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("from_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("to_id"))
    return edge(nation, "n", "n_nationkey", "r", "n_regionkey").union(edge(supplier, "s", "s_suppkey", "n", "s_nationkey"))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), w AS (SELECT 's0' AS node, 0 AS d UNION SELECT u.y, w.d + 1 FROM w JOIN u ON w.node = u.x WHERE w.d < 6)
SELECT node, min(d) AS distance FROM w GROUP BY node""")
def lineage_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lineage(_edges(spark, sf_dir), spark.createDataFrame([("s0",)], "node string"), 6)


@query("""WITH new AS (SELECT n_nationkey AS k, 'new' AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_regionkey + 1000, 'added' FROM region)
SELECT k, v FROM new UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT k FROM new)""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = old.where("k % 2 = 0").withColumn("v", F.lit("new")).union(table(spark, sf_dir, "region").select(F.col("r_regionkey") + 1000, F.lit("added")))
    return graph.upsert(old, new, "k")


# --- matching ----------------------------------------------------------------------------------------------------------------------------


@query(_HEADS + " SELECT key, array_to_string(tokens, ' ') AS tokens, array_to_string(stems, ' ') AS stems, tokens[-1] AS head, head AS block_head, family FROM h")
def canonical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = match.profile(attributes(spark, sf_dir))
    return own.select("key", F.array_join("tokens", " ").alias("tokens"), F.array_join(names.expanded(F.col("tokens")), " ").alias("stems"), "head", "block_head", "family")


_FINDINGS = _A + """, w AS (SELECT *, list_concat(tokens, coalesce(string_split_regex(lower(description), '[ \\t\\n\\r\\f]+'), [])) AS said FROM b),
f AS (SELECT key, unnest([CASE WHEN dataType = 'string' AND len(list_intersect(said, ['date','time','timestamp','at','when','occurred','datetime'])) > 0 THEN 'type-suspicion: string that denotes a date' END,
  CASE WHEN dataType = 'string' AND len(list_intersect(said, ['amount','reserve','premium','price','cost','fee','value','sum','total'])) > 0 THEN 'type-suspicion: string that denotes an amount' END,
  CASE WHEN dataType = 'unknown' THEN 'opaque-type: no type declared' END,
  CASE WHEN dataType = 'string' AND enums IS NULL AND regexp_matches(description, '(?i)\\b(one of|values?:|either)\\b') THEN 'undeclared-enum: values documented but not declared' END]) AS finding FROM w)
SELECT key, finding FROM f WHERE finding IS NOT NULL"""


@query(_FINDINGS)
def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.profile(attributes(spark, sf_dir)).select("key", F.explode("findings").alias("finding"))


@query(_A + " SELECT x.key, count(y.key) AS n, coalesce(string_agg(y.localName, ',' ORDER BY y.localName), '') AS siblings FROM b x LEFT JOIN b y ON x.contract = y.contract AND x.parentPath = y.parentPath AND x.id <> y.id GROUP BY x.key")
def sibling_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.beside(attributes(spark, sf_dir), text=True).select("key", F.col("n_siblings").alias("n"), "siblings")


@query(_BLOCKS + " SELECT block, CAST(len(members) AS BIGINT) AS n, sha256(array_to_string(members, ',')) AS members FROM blocks")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = match.blocks(match.profile(attributes(spark, sf_dir)))
    return own.select(F.col("key").alias("block"), F.size("members").cast("bigint").alias("n"), F.sha2(F.array_join("members", ","), 256).alias("members"))


@query(_PAIRS + " SELECT a, b FROM pairs")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.pairs(match.blocks(match.profile(attributes(spark, sf_dir))))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = graph.cut(match.profile(attributes(spark, sf_dir)))
    return match.compare(match.pairs(match.blocks(profiled)), profiled)


@query(_SCORED + " SELECT a, b, round(lexical, 6) AS lexical, round(type_score::DOUBLE, 6) AS type_score, round(constraint_score, 6) AS constraint_score, round(context, 6) AS context, floor(score * 1e6 + 0.5) / 1e6 AS score FROM final")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir)
    return own.select("a", "b", *[F.round(c, 6).alias(n) for c, n in (("lexical", "lexical"), ("type", "type_score"), ("constraints", "constraint_score"), ("context", "context"))], (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@query(f"""WITH i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <= 1 THEN p_retailprice END AS lo, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_retailprice + p_size END AS hi FROM part)
SELECT x.k, round({_INTERVAL.format(a='x.', b='y.')}, 6) AS overlap FROM i x JOIN i y ON y.k = x.k + 4""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 4 <= 1, F.col("p_retailprice")).alias("lo"), F.when((k % 4).isin(0, 2), F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    other = rows.select((F.col("k") - 4).alias("k"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return rows.join(other, "k").select("k", F.round(sim.interval(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")), 6).alias("overlap"))


_REACH = """, edges AS (SELECT a, b, score FROM final WHERE score >= 0.72), links AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT x AS node, x AS r FROM links UNION SELECT l.y, reach.r FROM reach JOIN links l ON reach.node = l.x), comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"""
_COMPONENTS = _SCORED + _REACH
#: All pairs that share a block, however large it is.
_ALL_PAIRS = (
    _HEADS
    + """, keyed AS (SELECT id, 'head:' || head AS k FROM h UNION ALL SELECT id, 'type:' || family || '|' || left(head, 3) FROM h),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y ON x.k = y.k AND x.id < y.id)"""
)


@query(_COMPONENTS + " SELECT node, component FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_scored(spark, sf_dir).where(F.col("score") >= Settings().link).select("a", "b"))


@query((_ALL_PAIRS + _SCORES).replace("WITH a AS", "WITH RECURSIVE a AS", 1) + _REACH + """, mean AS (SELECT node, avg(score) AS m FROM (SELECT a AS node, score FROM edges UNION ALL SELECT b, score FROM edges) GROUP BY node)
SELECT c.component, arg_min(c.node, (h.tier, -round(m.m, 9), c.node)) AS core, count(*) AS members, arg_min(h.localName, (length(h.localName), h.localName)) AS concept FROM comp c JOIN h ON c.node = h.id JOIN mean m ON m.node = c.node GROUP BY 1""")
def core_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core and name of each linked group of attributes, as clusters are built from it, before any split; blocks are whole."""
    profiled = graph.cut(match.profile(attributes(spark, sf_dir)))
    return match.cores(match.linked(profiled), profiled)


@query()
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clusters with their split and conflict class; the greedy split is not SQL, tests compare it with brute force."""
    own, _ = match.run(attributes(spark, sf_dir))
    return own.select("clusterId", "proposedConcept", F.size("members").alias("members"), "conflictClass", "conflictDetail", F.round("confidence", 6).alias("confidence"), F.size("evidenceRefs").alias("evidence"))


# --- model -------------------------------------------------------------------------------------------------------------------------------


@query(_A + """, v AS (SELECT key, concat_ws(',', CASE WHEN NOT regexp_full_match(localName, '[a-z][a-zA-Z0-9]*') THEN 'case' END, CASE WHEN NOT regexp_full_match(p_type, '[A-Z][a-zA-Z0-9]*') THEN 'case' END,
  nullif(array_to_string(list_transform(list_filter(tokens, lambda t: t IN ('dt','dttm','amt','nbr','cd','ind','desc','no','qty','sinistre','police')), lambda t: 'abbreviation'), ','), ''),
  CASE WHEN regexp_matches(lower(localName), 'us|uk|eu') AND key % 2 = 0 THEN 'region-marker' END, CASE WHEN dataType = 'boolean' AND NOT regexp_matches(localName, '^(is|has)') THEN 'boolean' END,
  CASE WHEN len(list_intersect(tokens, ['amount','reserve','premium','price','cost','fee','value','sum','total'])) > 0 THEN 'money' END,
  CASE WHEN len(list_intersect(tokens, ['id','identifier','code','number','ref'])) > 0 THEN 'identifier' END, CASE WHEN dataType = 'dateTime' AND key % 3 <> 0 THEN 'datetime' END) AS kinds FROM b)
SELECT key, kinds FROM v WHERE kinds <> ''""")
def naming_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = attributes(spark, sf_dir).withColumn("entity", F.regexp_replace("parentPath", "^Part[.]", ""))
    kinds = model.violations(F.col("entity"), F.col("localName"), F.col("key") % 2 == 0, F.col("dataType"), F.lit("string"), F.col("key") % 3 == 0)
    return own.select("key", F.array_join(kinds, ",").alias("kinds")).where("kinds <> ''")


def _by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster for each name and type of part: regions, tiers and levels of its attributes."""
    return attributes(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "localName", "parentPath", "dataType"))


_G = _A + ", g AS (SELECT localName || '/' || parentPath || '/' || dataType AS cluster, * FROM b)"


@query(_G + """, p AS (SELECT cluster, list_sort(list(DISTINCT region)) AS regions, max(tier) AS tier, bool_or(level = 'conditional') AS regulatory, min(key) % 2 = 0 AS gap, min(key) % 5 = 0 AS closing FROM g GROUP BY cluster)
SELECT cluster, CASE WHEN regulatory THEN 'extension:' || regions[1] WHEN tier = 3 THEN 'extension:' || regions[1] WHEN len(regions) = 3 THEN 'core' WHEN len(regions) = 2 THEN CASE WHEN gap THEN 'core' ELSE 'extension:' || regions[1] END
  WHEN closing THEN 'core' ELSE 'extension:' || regions[1] END AS placement, CASE WHEN regulatory THEN '4' WHEN tier = 3 THEN '5' WHEN len(regions) = 3 THEN '1' WHEN len(regions) = 2 THEN '2' ELSE '3' END AS rule FROM p""")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _by_name(spark, sf_dir).groupBy("cluster").agg(F.array_sort(F.collect_set("region")).alias("regions"), F.max("evidenceTier").alias("tier"), F.some(F.col("obligation.level") == "conditional").alias("regulatory"), F.min("key").alias("key"))
    placed = model.placement(F.col("regions"), F.col("tier"), F.col("regulatory"), F.lit(False), F.col("key") % 2 == 0, F.col("key") % 5 == 0)
    return own.select("cluster", placed.alias("p")).select("cluster", model.contract_value(F.col("p")).alias("placement"), F.col("p.rule").alias("rule"))


_RANK = "CASE level WHEN 'mandatory' THEN 3 WHEN 'conditional' THEN 2 ELSE 1 END"


@query(_G + f" SELECT cluster, arg_max(level, {_RANK}) AS strongest, arg_min(level, {_RANK}) AS weakest FROM g GROUP BY cluster")
def obligation_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("obligation.level")
    return _by_name(spark, sf_dir).groupBy("cluster").agg(model.strongest(level).alias("strongest"), model.weakest(level).alias("weakest"))


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts from clusters by name, candidates for four of five of them, ratified where a document's label says so."""
    rows = _by_name(spark, sf_dir)
    member = F.struct("attributeId", "region")
    own = rows.groupBy("cluster").agg(F.collect_list(member).alias("members"), F.flatten(F.collect_list("evidenceRefs")).alias("evidenceRefs"), F.min("key").alias("key"), model.weakest(F.col("obligation.level")).alias("level")).withColumnRenamed("cluster", "clusterId")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("quality"))
    candidates = own.where("key % 5 <> 0").join(labels, "key", "left").select(
        F.concat(F.lit("cand/"), "clusterId").alias("candidateId"), F.array("clusterId").alias("clusterRefs"), F.when(F.col("key") % 3 == 0, "extension:us").otherwise("core").alias("placement"), model.weight(F.col("level")).alias("weight"),
        F.struct(F.when(F.col("quality") == 0, "rejected").otherwise("approved").alias("status"), F.lit("sme").alias("sme")).alias("ratification"),
    )
    return model.universe(own, candidates, rows)


_U = _G + f""", c AS (SELECT cluster, list_sort(list(DISTINCT region)) AS regions, min(key) AS key, bool_and(inferred) AS inferred, max({_RANK}) AS hi, min({_RANK}) AS lo FROM g GROUP BY cluster),
q AS (SELECT doc_id AS key, max(quality) AS quality FROM labels GROUP BY 1),
u AS (SELECT CASE WHEN c.key % 5 = 0 THEN cluster ELSE 'cand/' || cluster END AS concept, regions, inferred, CASE WHEN c.key % 5 = 0 THEN [1, 3, 5][hi] ELSE [1, 3, 5][lo] END AS weight,
  CASE WHEN c.key % 5 = 0 THEN 'gap' WHEN c.key % 3 = 0 THEN 'extension' ELSE 'core' END AS resolution, c.key % 5 = 0 OR coalesce(quality, 1) = 0 AS unevidenced FROM c LEFT JOIN q ON c.key = q.key),
k AS (SELECT *, CASE WHEN unevidenced THEN 0.0 WHEN resolution = 'core' THEN 1.0 ELSE 0.5 END AS r FROM u), r3 AS (SELECT unnest(['us', 'uk', 'eu']) AS region),
reg AS (SELECT r3.region, coalesce(sum(weight * r)::DOUBLE / sum(weight), 0.0) AS score FROM r3 LEFT JOIN k ON list_contains(k.regions, r3.region) GROUP BY 1)"""


@query(_U + """ SELECT round(sum(weight * r)::DOUBLE / sum(weight), 6) AS score, count(*) AS denominator, CAST(sum(weight) AS BIGINT) AS weight_sum, count(*) FILTER (WHERE weight = 5 AND r < 1) = 0 AS gate1,
  sum(weight * r)::DOUBLE / sum(weight) >= 0.9 AND (SELECT min(round(score, 4)) FROM reg) >= 0.85 AS gate2, count(*) FILTER (WHERE unevidenced) = 0 AS gate3, count(*) FILTER (WHERE NOT inferred) AS specified, count(*) FILTER (WHERE inferred) AS inferred FROM k""")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = model.coverage(_concepts(spark, sf_dir))
    return own.select(F.round("score", 6).alias("score"), "denominator", F.col("weightSum").cast("bigint").alias("weight_sum"), F.col("gate1Pass").alias("gate1"), F.col("gate2Pass").alias("gate2"), F.col("gate3Pass").alias("gate3"), "specified", "inferred")


@query(_U + " SELECT region, round(score, 6) AS score FROM reg")
def coverage_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.by_region(_concepts(spark, sf_dir)).select("region", F.round("score", 6).alias("score"))


@query(_U + """ SELECT concept, weight, 'unresolved' AS reason, array_to_string(regions, ',') AS regions FROM k WHERE weight = 5 AND r < 1
UNION ALL SELECT concept, weight, 'unevidenced', array_to_string(regions, ',') FROM k WHERE unevidenced AND NOT (weight = 5 AND r < 1)
UNION ALL SELECT concept, weight, 'below-region-floor', reg.region FROM k JOIN reg ON list_contains(k.regions, reg.region) AND round(reg.score, 4) < 0.85 WHERE resolution <> 'core'
UNION ALL SELECT url, 1, 'excluded', 'us,uk,eu' FROM pages WHERE page_id % 50 = 0""")
def gap_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = table(spark, sf_dir, "pages").where("page_id % 50 = 0").select(F.col("url").alias("uri"), F.lit("").alias("detail"))
    return model.gaps(_concepts(spark, sf_dir), excluded).select(F.col("conceptId").alias("concept"), "weight", "reason", F.array_join("affectedRegions", ",").alias("regions"))


# --- mapping -----------------------------------------------------------------------------------------------------------------------------

_SPEC = mapping.Spec(
    (
        mapping.Entry("Order.Key", "claimReference", "toIdentifier(scheme='urn:order', issuer='uk')", weight=5, on_failure="reject"),
        mapping.Entry("Order.Date", "incident.occurrence", "parseDate(fmt='yyyy-MM-dd') -> instantAtStartOfDay(zone='Europe/London')", weight=5, on_failure="reject", note="time of day is made up"),
        mapping.Entry("Order.Status", "status", "valueMap(map='status')", weight=5),
        mapping.Entry("Order.Total", "limit", 'toMonetaryAmount(currency=constant("GBP"))', weight=3),
        mapping.Entry("Order.Priority", "priority", r"decompose(pattern='(?P<rank>[0-9])-(?P<name>.+)', template='{rank}-{name}')", weight=1),
        mapping.Entry("Order.Discount", "scaled", "scale(factor=0.01)", weight=1, on_failure="skip"),
        mapping.Entry("Order.Batch", disposition="unmapped", weight=1),
    ),
    {"status": {"F": "FULFILLED", "O": "OPEN"}},
    {"status": "escalate"},
)
_FIELDS = [mapping.RegionField(p, k) for p, k in (("Order.Key", "string"), ("Order.Date", "string"), ("Order.Status", "string"), ("Order.Total", "decimal"), ("Order.Priority", "string"), ("Order.Discount", "decimal"), ("Order.Batch", "string"))]
_CANONICAL = {"claimReference": "Identifier", "incident.occurrence": "dateTime", "status": "string", "limit": "MonetaryAmount"}


def _steps() -> list[mapping.Step]:
    return mapping.compile_spec(_SPEC, _FIELDS, _CANONICAL)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    order = F.struct(
        F.col("o_orderkey").cast("string").alias("Key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Total"),
        F.when(F.col("o_orderkey") % 11 == 0, "none").otherwise(F.col("o_orderpriority")).alias("Priority"), F.col("o_totalprice").alias("Discount"), F.lit("b").alias("Batch"),
    )
    return o.select(F.col("o_orderkey").alias("id"), order.alias("Order"))


_MAPPED = """WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus AS s, o_totalprice AS t, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE o_orderpriority END AS p FROM orders),
m AS (SELECT id, d, p, t, s, CASE s WHEN 'F' THEN 'FULFILLED' WHEN 'O' THEN 'OPEN' END AS status, regexp_full_match(p, '(?:([0-9])-(.+))') AS fits FROM o)"""


@query(_MAPPED + """ SELECT id, CAST(id AS VARCHAR) AS reference, 'urn:order' AS scheme, strftime((d::TIMESTAMP AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS occurrence, status, t AS amount, 'GBP' AS currency,
  CASE WHEN fits THEN left(p, 1) END AS rank, CASE WHEN fits THEN substr(p, 3) END AS name, round(t * 0.01, 6) AS scaled, concat_ws(',', CASE WHEN status IS NULL THEN 'status' END, CASE WHEN NOT fits THEN 'priority' END) AS escalations, FALSE AS rejected FROM m""")
def map_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = mapping.forward(_orders(spark, sf_dir), _steps(), ["id"])
    return out.select(
        "id", c("canonical.claimReference.value").alias("reference"), c("canonical.claimReference.scheme").alias("scheme"), F.date_format("canonical.incident.occurrence", "yyyy-MM-dd HH:mm:ss").alias("occurrence"), c("canonical.status").alias("status"),
        c("canonical.limit.amount").alias("amount"), c("canonical.limit.currency").alias("currency"), c("canonical.priority.rank").alias("rank"), c("canonical.priority.name").alias("name"), F.round("canonical.scaled", 6).alias("scaled"), F.array_join("escalations", ",").alias("escalations"), "rejected",
    )


@query(_MAPPED + """ SELECT id, CAST(id AS VARCHAR) AS key, d AS date, CASE WHEN status IS NOT NULL THEN s END AS status, t AS total, CASE WHEN fits THEN p END AS priority, round(t, 4) AS discount FROM m""")
def map_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.reverse(mapping.forward(_orders(spark, sf_dir), _steps(), ["id"]), _steps(), ["id"])
    r = lambda n: F.col(f"region.Order.{n}")
    return out.select("id", r("Key").alias("key"), r("Date").alias("date"), r("Status").alias("status"), r("Total").alias("total"), r("Priority").alias("priority"), F.round(r("Discount"), 4).alias("discount"))


@query(_MAPPED + """ SELECT 'Order.Status' AS path, FALSE AS declared, count(*) AS n FROM m WHERE status IS NULL UNION ALL SELECT 'Order.Priority', FALSE, count(*) FROM m WHERE NOT fits""")
def roundtrip_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders lose on the way to canonical form and back. Scaled totals are compared by query map_reverse, rounded."""
    steps = [s for s in _steps() if s.entry.canonical != "scaled"]
    return mapping.losses(_orders(spark, sf_dir), steps, ["id"]).groupBy("path", "declared").agg(F.count("*").alias("n"))


def _problems(spark: SparkSession, spec: mapping.Spec, fields: list[mapping.RegionField]) -> DataFrame:
    """What the compiler says of a specification."""
    try:
        mapping.compile_spec(spec, fields, {})
        found = []
    except mapping.CompilationFailed as failed:
        found = [(x.check, x.path, x.message) for x in failed.problems]
    return spark.createDataFrame(found, "code string, place string, detail string")


@query("""SELECT 'T4' AS code, 'status' AS place, 'unmapped values: [' || string_agg(chr(39) || v || chr(39), ', ' ORDER BY v) || ']' AS detail FROM (SELECT DISTINCT o_orderstatus AS v FROM orders EXCEPT SELECT unnest(['F', 'O'])) HAVING count(*) > 0""")
def valuemap_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared values are those of the table; the map must cover them."""
    declared = tuple(r["v"] for r in table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("v")).distinct().collect())
    spec = mapping.Spec((mapping.Entry("Order.Status", "status", "valueMap(map='status')", weight=5),), _SPEC.value_maps)
    return _problems(spark, spec, [mapping.RegionField("Order.Status", "string", declared)])


@query(_A + " SELECT 'T1' AS code, path AS place, 'no mapping entry' AS detail FROM (SELECT DISTINCT contract || '/' || localName AS path FROM b EXCEPT SELECT contract || '/' || localName FROM b WHERE key % 2 = 0)")
def mapping_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without an entry: a specification is compiled on the driver, so its fields are those of its contracts."""
    paths = attributes(spark, sf_dir).groupBy(F.concat_ws("/", "sourceContract", "localName").alias("path")).agg(F.max(F.col("key") % 2 == 0).alias("mapped")).collect()
    spec = mapping.Spec(tuple(mapping.Entry(r["path"], r["path"], "identity") for r in paths if r["mapped"]))
    return _problems(spark, spec, [mapping.RegionField(r["path"], "string") for r in paths])


_ALL = mapping.Spec(
    tuple(
        mapping.Entry(f"O.{a}", b, t, weight=1)
        for a, b, t in (
            ("Id", "same", "identity"), ("Day", "said", "formatDate(fmt='dd/MM/yyyy')"), ("At", "day", "toLocalDate(zone='Europe/London')"), ("Parts", "joined", "concat(separator='|')"), ("Maybe", "first", "coalesce"),
            ("Id2", "fixed", "constant('c')"), ("Name", "shout", "normaliseCase(mode='upper')"), ("Pair", "pair", r"compose(template='{a}-{b}', pattern='(?P<a>[A-Z])-(?P<b>[0-9]+)')"),
        )
    ),
    bidirectional=False,
)


def _all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    at = (F.col("o_orderdate") + F.make_interval(hours=(key % 24).cast("int"))).cast("timestamp")
    row = F.struct(
        key.cast("string").alias("Id"), F.to_date("o_orderdate").alias("Day"), at.alias("At"), F.array(priority, status).alias("Parts"), F.array(F.when(key % 3 == 0, status), priority).alias("Maybe"),
        status.alias("Id2"), F.lower(priority).alias("Name"), F.struct(status.alias("a"), key.cast("string").alias("b")).alias("Pair"),
    )
    return table(spark, sf_dir, "orders").select(key.alias("id"), row.alias("O"))


def _all_steps() -> list[mapping.Step]:
    kinds = {"Day": "date", "At": "dateTime", "Parts": "array", "Maybe": "array", "Pair": "object"}
    return mapping.compile_spec(_ALL, [mapping.RegionField(e.region, kinds.get(e.region[2:], "string")) for e in _ALL.entries], {})


_ALL_SQL = """WITH o AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS t, o_orderstatus AS s, o_orderpriority AS p FROM orders),
m AS (SELECT *, CAST((t AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS DATE) AS london FROM o)"""


@query(_ALL_SQL + """ SELECT id, CAST(id AS VARCHAR) AS same, strftime(d, '%d/%m/%Y') AS said, strftime(london, '%Y-%m-%d') AS day, p || '|' || s AS joined, CASE WHEN id % 3 = 0 THEN s ELSE p END AS first, 'c' AS fixed, upper(p) AS shout, s || '-' || id AS pair FROM m""")
def transforms_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transforms that query map_forward does not use."""
    out = mapping.forward(_all_orders(spark, sf_dir), _all_steps(), ["id"])
    return out.select("id", *[F.col(f"canonical.{c}").cast("string").alias(c) for c in ("same", "said", "day", "joined", "first", "fixed", "shout", "pair")])


@query(_ALL_SQL + """ SELECT id, CAST(id AS VARCHAR) AS same, strftime(d, '%Y-%m-%d') AS day, strftime((london::TIMESTAMP AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, p || ',' || s AS parts, upper(p) AS name, s AS a, CAST(id AS VARCHAR) AS b FROM m""")
def transforms_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And back; coalesce and constant have no reverse."""
    out = mapping.reverse(mapping.forward(_all_orders(spark, sf_dir), _all_steps(), ["id"]), _all_steps(), ["id"])
    r = lambda c: F.col(f"region.O.{c}")
    return out.select("id", r("Id").alias("same"), r("Day").cast("string").alias("day"), F.date_format(r("At"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.array_join(r("Parts"), ",").alias("parts"), r("Name").alias("name"), r("Pair.a").alias("a"), r("Pair.b").alias("b"))


# --- invariants, release, evaluation, journal ----------------------------------------------------------------------------------------


@query(_A + " SELECT id, contract AS artefact FROM b WHERE contract NOT IN ('t0', 't1', 't2', 't3', 't4')")
def inv_i1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = spark.createDataFrame([(f"t{i}",) for i in range(5)], "artefactId string")
    return invariants.evidence_exists(attributes(spark, sf_dir), manifest).select(F.col("attributeId").alias("id"), F.col("artefactId").alias("artefact"))


def _named_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_name(spark, sf_dir).groupBy(F.col("cluster").alias("clusterId")).agg(F.collect_list(F.struct("attributeId")).alias("members"), F.min("key").alias("key"))


@query(_G + " SELECT cluster, id, CASE WHEN key % 10 = 3 THEN 'missing' ELSE 'other-run' END AS problem FROM g WHERE key % 10 IN (3, 4)")
def inv_i2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = attributes(spark, sf_dir).where("key % 10 <> 3").select("attributeId", F.when(F.col("key") % 10 == 4, "run-0").otherwise(F.col("runId")).alias("runId"))
    return invariants.members_exist(_named_clusters(spark, sf_dir), known, "run-1").select(F.col("clusterId").alias("cluster"), F.col("attributeId").alias("id"), "problem")


@query(_G + ", c AS (SELECT cluster, min(key) AS key, bool_or(key % 3 = 0) AS known FROM g GROUP BY 1) SELECT 'cand/' || cluster AS candidate FROM c WHERE NOT known OR key % 7 = 0")
def inv_i3_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _named_clusters(spark, sf_dir)
    candidates = own.select(F.concat(F.lit("cand/"), "clusterId").alias("candidateId"), F.when(F.col("key") % 7 == 0, F.array(F.lit("nowhere"))).otherwise(F.array("clusterId")).alias("clusterRefs"))
    return invariants.candidates_grounded(candidates, own, attributes(spark, sf_dir).where("key % 3 = 0")).select(F.col("candidateId").alias("candidate"))


@query(_U + " SELECT concept FROM k WHERE resolution <> 'gap' AND unevidenced")
def inv_i4_ratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts scored by their resolution alone, to show those that nobody ratified."""
    naive = _concepts(spark, sf_dir).withColumn("r", F.when(F.col("resolution") == "core", 1.0).when(F.col("resolution") == "extension", 0.5).otherwise(0.0))
    return invariants.scored_is_ratified(naive).select(F.col("conceptId").alias("concept"))


@query("SELECT p_partkey AS key FROM part WHERE p_partkey % 6 IN (0, 1, 4)")
def inv_i5_disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    entries = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.when(k.isin(0, 2), "identity").alias("transform"), F.when(k.isin(0, 3, 4, 5), "unmapped").alias("disposition"), F.when(k == 4, "  ").when(k.isin(0, 3, 5), "internal").alias("reason")
    )
    return invariants.mapped_or_disposed(entries).select("key")


@query("""WITH o AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change, o.path IS NOT NULL AS breaking FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h""")
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    old = docs.where("doc_id % 3 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    new = docs.where("doc_id % 4 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return emit.difference(old, new)


@query("""WITH r AS (SELECT d.doc_id, d.lang AS a, l.quality * 2 + l.toxic AS p FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM r GROUP BY a, p)) AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM r GROUP BY p)) AS pp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM r GROUP BY a)) AS ap)
SELECT CAST(tp AS BIGINT) AS tp, CAST(pp AS BIGINT) AS predicted_pairs, CAST(ap AS BIGINT) AS actual_pairs, round(tp / pp, 6) AS "precision", round(tp / ap, 6) AS recall, round(2 * (tp / pp) * (tp / ap) / (tp / pp + tp / ap), 6) AS f1 FROM c""")
def eval_pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    out = evaluation.pair_scores(rows, F.col("quality") * 2 + F.col("toxic"), F.col("lang"))
    return out.select("tp", "predicted_pairs", "actual_pairs", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT event_id AS seq, event_type AS kind, user_id FROM events WHERE event_id >= 200 ORDER BY event_id LIMIT 100")
def journal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the journal: the limit is the operator."""
    return table(spark, sf_dir, "events").where("event_id >= 200").orderBy("event_id").limit(100).select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "user_id")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL""")
def journal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the journal, by the code that the streaming job runs."""
    from selvage.streaming.journal import hourly

    return hourly(table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("kind"))).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "kind", "n")


@query("SELECT p_brand AS entity, 'core' AS scope, count(*) AS attributes FROM part GROUP BY 1")
def entity_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of an entity for each brand; the number of attributes is read back from the emitted document."""
    part = table(spark, sf_dir, "part")
    candidates = part.select(
        F.col("p_brand").alias("entity"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("attribute"), F.lit("string").alias("dataType"), F.lit("0..1").alias("cardinality"), F.struct(F.lit("optional").alias("level")).alias("obligation"),
        F.lit("core").alias("placement"), F.lit("r").alias("rationale"), F.lit(1).alias("weight"), F.struct(F.lit("sme").alias("sme")).alias("ratification"),
    )
    documents = emit.entity_schemas(candidates)
    return documents.select("entity", "scope", F.size(F.json_object_keys(F.get_json_object("document", "$.properties"))).cast("bigint").alias("attributes"))


