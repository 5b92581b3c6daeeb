"""Graphs: durable intermediate results, connected components, node and edge tables, lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Delete shuffle files at the end of the execution that wrote them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a checkpointed partition where their number is known.
CUT_ROWS = 50_000

NODE_TYPES = ("Artefact", "Attribute", "Cluster", "CanonicalAttribute", "AcordConcept", "Release", "Decision")
EDGE_TYPES = ("EVIDENCED_BY", "MEMBER_OF", "CANDIDATE_FOR", "ALIGNS_TO", "MAPS_TO", "RELEASED_IN", "DECIDED_BY")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a purely local session without one gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="selvage-checkpoint-")
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that lost executors cost no recomputation.

    What its plan has shuffled is deleted as soon as the files are written: nothing reads it any more. The files themselves
    go when nothing refers to them, if the session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read where a frame is made
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def cut_rows(df: DataFrame, n: int, rows: int = CUT_ROWS) -> DataFrame:
    """cut() of a frame of at most n rows, in no more partitions than have `rows` of them.

    Spark joins small partitions itself where spark.sql.adaptive.coalescePartitions.enabled is on; here it is known
    beforehand that they are small, and every partition of a checkpoint is a file of its own.
    """
    parts = max(1, -(-n // rows))
    return cut(df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b), not null and of one orderable type: node, component (its smallest node).

    Alternates large-star and small-star steps: each is a minimum by node (combined before the shuffle) joined back to
    the links, so a hub is never gathered in one task, and the number of rounds grows with the logarithm of the size.
    Every round is checkpointed; within a round Spark reuses the shuffle of the large-star's links.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, n = None, edges.count()
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m0")).select("node", F.least("node", "m0").alias("m"))
        # large-star: larger neighbours go to the smallest one
        large = both.where("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: smaller neighbours and the node itself go to the smallest one
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("node"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
        edges = cut_rows(small.where("a <> b").distinct(), n)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError("components did not converge")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old with the rows of new by key; the last of new's rows of a key (by all its columns, largest) wins."""
    rest = [c for c in new.columns if c not in key]
    latest = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, *[F.col("r").getField(c).alias(c) for c in rest]) if rest else new.distinct()
    return old.join(latest, list(key), "left_anti").unionByName(latest)


def valid(kind: Column, kinds: tuple[str, ...]) -> Column:
    """Raises for a row of an unknown kind."""
    return F.when(kind.isin(*kinds), kind).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("null")))))


def nodes(ids: Column, kind: str, run: Column, properties: Column) -> list[Column]:
    return [ids.alias("node_id"), valid(F.lit(kind), NODE_TYPES).alias("node_type"), run.alias("run_id"), F.to_json(properties).alias("properties")]


def evidence_edges(attributes: DataFrame) -> DataFrame:
    """An EVIDENCED_BY edge from each attribute to the artefact of each of its evidence references."""
    refs = attributes.select("attributeId", F.explode("evidenceRefs").alias("ref"))
    return refs.select(F.col("attributeId").alias("from_id"), F.regexp_extract("ref", "^evref://[^/]*/[^/]*/([^@]+)", 1).alias("to_id"), F.lit("EVIDENCED_BY").alias("edge_type"), F.lit("{}").alias("properties")).distinct()


def lineage(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """Nodes within `depth` undirected steps of start(node): node, distance (the least).

    A frontier is joined to the edges once a step and what was seen is left out, so a node is expanded once, whatever
    the number of paths to it.
    """
    both = edges.select(F.col("from_id").alias("x"), F.col("to_id").alias("y")).union(edges.select(F.col("to_id").alias("x"), F.col("from_id").alias("y"))).distinct()
    seen = cut(start.select("node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for k in range(1, depth + 1):
        front = cut(front.join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def subgraph(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges with both ends among reached(node)."""
    ids = reached.select("node")
    return edges.join(ids.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node", "to_id"), "to_id", "left_semi")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")
