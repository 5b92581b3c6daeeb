"""Sources: listing without content, relevance, content of what is kept, manifests, content-addressed evidence."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.config import EVIDENCE_TIER, MEDIA_TYPES, Settings
from selvage.functions.text import lookup, slug, words

CONTRACT_MEDIA_TYPES = ("application/yaml", "application/json", "application/xml")
WIKI_MEDIA_TYPE = "application/vnd.wiki.storage+xml"


def media_type(path: Column) -> Column:
    """By the extension of a path; application/octet-stream for others."""
    return lookup(MEDIA_TYPES, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit("application/octet-stream"))


def tier(system: Column) -> Column:
    return lookup(EVIDENCE_TIER, system)


def licence(system: Column) -> Column:
    return F.when(system == "vendor", "unknown").otherwise("permitted")


def list_files(spark: SparkSession, folder: str, system: str, region: str, repository: str, version: str) -> DataFrame:
    """A row for each file of a checked-out tree at a pinned version: uri, system, region, media_type, path, version.

    Only the listing is read: the content column is not selected, so no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = F.regexp_replace("path", "^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(F.concat(F.lit(f"git://{repository}/"), at).alias("uri"), F.lit(system).alias("system"), F.lit(region).alias("region"), media_type(F.col("path")).alias("media_type"), F.col("path"), F.lit(version).alias("version"))


def health(spark: SparkSession, folder: str) -> tuple[bool, str]:
    """Whether a source can be listed, and why not; nothing is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    except Py4JJavaError as error:
        return False, str(error.java_exception)
    return found, "" if found else f"{folder} does not exist"


def read_files(spark: SparkSession, folder: str, kept: DataFrame) -> DataFrame:
    """kept with the content of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return kept.join(files, "path")


def list_wiki(spark: SparkSession, folder: str, region: str) -> DataFrame:
    """A row for each wiki page (a JSON file): uri, title, description (280 characters without tags), version, content."""
    kind = "id string, title string, space struct<key:string>, version struct<number:int>, body struct<storage:struct<value:string>>"
    pages = spark.read.schema(kind).option("multiLine", True).json(folder)
    body = F.col("body.storage.value")
    return pages.select(
        F.concat(F.lit("confluence://"), F.col("space.key"), F.lit("/"), F.col("id")).alias("uri"), F.lit("confluence").alias("system"), F.lit(region).alias("region"), F.lit(WIKI_MEDIA_TYPE).alias("media_type"),
        "title", F.substring(F.regexp_replace(body, "<[^>]+>", ""), 1, 280).alias("description"), F.col("version.number").cast("string").alias("version"), F.encode(body, "UTF-8").alias("content"),
    )


def token_score(uri: Column, tokens: tuple[str, ...]) -> Column:
    """1 if a domain token is in any word of the address, else 0."""
    parts = F.split(F.lower(uri), "[^a-z0-9]+")
    return F.when(F.exists(parts, lambda w: F.exists(words(*tokens), lambda t: F.contains(w, t))), 1.0).otherwise(0.0)


def relevance(uri: Column, catalogue: Column, live_route: Column, kind: Column, domain: str, settings: Settings = Settings()) -> Column:
    """Weighted sum of the signals path, catalogue, gateway and kind."""
    w = settings.relevance_weights
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    signals = {"path": token_score(uri, settings.domain_tokens), "catalogue": flag(catalogue == domain), "gateway": flag(live_route), "kind": F.when(kind.isin(*CONTRACT_MEDIA_TYPES), 1.0).otherwise(0.3)}
    score = F.lit(0.0)
    for name, signal in signals.items():
        score = score + F.lit(w.get(name, 0.0)) * signal
    return score


def bucket(score: Column, settings: Settings = Settings()) -> Column:
    return F.when(score >= settings.relevance_keep, "keep").when(score <= settings.relevance_drop, "drop").otherwise("uncertain")


def filter_relevant(listing: DataFrame, domain: str, settings: Settings = Settings(), classify: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and exclusions (uri, reason, detail, decidedBy).

    `classify` gives uri, in_domain, reason for the uncertain rows; a row without a verdict, and all rows without
    `classify`, are kept.
    """
    scored = listing.withColumn("score", relevance(F.col("uri"), F.col("catalogue_domain"), F.col("has_live_route"), F.col("media_type"), domain, settings)).withColumn("bucket", bucket(F.col("score"), settings))
    if classify is None:
        scored = scored.withColumn("in_domain", F.lit(True)).withColumn("reason", F.lit(None).cast("string"))
    else:
        verdicts = classify(scored.where("bucket = 'uncertain'")).select("uri", "in_domain", "reason").dropDuplicates(["uri"])
        scored = scored.join(verdicts, "uri", "left").withColumn("in_domain", F.coalesce("in_domain", F.lit(True)))
    keep = F.expr("bucket = 'keep' OR (bucket = 'uncertain' AND in_domain)")
    out = scored.where(~keep).select(
        "uri", F.lit("out-of-domain").alias("reason"), F.when(F.col("bucket") == "drop", F.concat(F.lit("pass1 score "), F.format_number("score", 2))).otherwise(F.col("reason")).alias("detail"),
        F.when(F.col("bucket") == "drop", "pass1").otherwise("repository-scout").alias("decidedBy"),
    )
    return scored.where(keep).drop("in_domain", "reason", "bucket"), out


def artefacts(raw: DataFrame) -> DataFrame:
    """raw(uri, system, region, version, content, media_type) with artefactId, contentHash, evidenceTier, licence."""
    return (
        raw.withColumn("artefactId", slug(F.col("system"), F.col("region"), F.col("uri")))
        .withColumn("contentHash", F.sha2("content", 256))
        .withColumn("evidenceTier", tier(F.col("system")))
        .withColumn("licence", licence(F.col("system")))
    )


def corpus_hash(hashes: DataFrame, column: str = "contentHash") -> DataFrame:
    """One row, corpus_hash: SHA-256 of the JSON array of the sorted hashes, the same in any order.

    The array is the definition of the hash; a manifest lists its artefacts anyway. Corpora that no single list can hold
    are hashed by corpus_hash_tree.
    """
    every = F.array_sort(F.coalesce(F.collect_list(column), F.array().cast("array<string>")))
    return hashes.agg(F.sha2(F.to_json(every), 256).alias("corpus_hash"))


def corpus_hash_tree(hashes: DataFrame, column: str = "contentHash") -> DataFrame:
    """One row, corpus_hash: an order-independent hash in two levels, by the hashes' first three digits; no list is longer
    than 4096 or a 4096th of the corpus."""
    leaf = hashes.groupBy(F.left(column, F.lit(3)).alias("k")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(column))), 256).alias("h"))
    return leaf.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.concat("k", F.lit(":"), "h")))), 256).alias("corpus_hash"))


def put_evidence(spark: SparkSession, folder: str, rows: DataFrame) -> int:
    """Adds rows(contentHash, content) that are not stored yet, under their hash's first two digits; returns how many."""
    new = rows.select(F.col("contentHash").alias("content_hash"), "content").dropDuplicates(["content_hash"]).withColumn("prefix", F.left("content_hash", F.lit(2)))
    try:
        new = new.join(spark.read.parquet(folder).select("prefix", "content_hash"), ["prefix", "content_hash"], "left_anti")
    except Exception as error:  # noqa: BLE001  nothing stored yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    from selvage.operators.graph import cut

    new = cut(new)
    new.write.mode("append").partitionBy("prefix").parquet(folder)
    return new.count()


def get_evidence(spark: SparkSession, folder: str, content_hash: str) -> DataFrame:
    """The stored content of a hash: one folder is read."""
    return spark.read.parquet(folder).where((F.col("prefix") == content_hash[:2]) & (F.col("content_hash") == content_hash)).select("content_hash", "content")
