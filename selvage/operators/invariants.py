"""Constraints across tables. Each check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artefact_of(ref: Column) -> Column:
    """Third part of an evidence reference, up to the @."""
    return F.regexp_extract(ref, "^evref://[^/]*/[^/]*/([^@]+)", 1)


def evidence_exists(attributes: DataFrame, artefacts: DataFrame) -> DataFrame:
    """I1: every evidence reference cites an artefact of the manifest."""
    cited = attributes.select("attributeId", F.explode("evidenceRefs").alias("ref")).withColumn("artefactId", artefact_of(F.col("ref")))
    return cited.join(artefacts.select("artefactId"), "artefactId", "left_anti")


def members_exist(clusters: DataFrame, attributes: DataFrame, run_id: str) -> DataFrame:
    """I2: every member is an attribute of the same run. problem: missing or other-run."""
    member = clusters.select("clusterId", F.explode("members.attributeId").alias("attributeId"))
    joined = member.join(attributes.select("attributeId", "runId"), "attributeId", "left")
    problem = F.when(F.col("runId").isNull(), "missing").when(F.col("runId") != run_id, "other-run")
    return joined.select("clusterId", "attributeId", problem.alias("problem")).where("problem IS NOT NULL")


def candidates_grounded(candidates: DataFrame, clusters: DataFrame, attributes: DataFrame) -> DataFrame:
    """I3: every candidate reaches at least one attribute over its clusters."""
    of = candidates.select("candidateId", F.explode_outer("clusterRefs").alias("clusterId"))
    member = clusters.select("clusterId", F.explode("members.attributeId").alias("attributeId")).join(attributes.select("attributeId"), "attributeId", "left_semi")
    good = of.join(member, "clusterId", "left_semi").select("candidateId")
    return candidates.select("candidateId").join(good, "candidateId", "left_anti")


def scored_is_ratified(concepts: DataFrame) -> DataFrame:
    """I4: what counts has evidence and somebody who ratified it."""
    return concepts.where("r > 0 AND (NOT evidenced OR sme IS NULL)")


def mapped_or_disposed(entries: DataFrame) -> DataFrame:
    """I5: a mapping entry has a transform or else a disposition with a reason, not both."""
    transform, disposition = F.col("transform").isNotNull(), F.col("disposition").isNotNull()
    reasoned = F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0
    return entries.where(~((transform & ~disposition) | (~transform & disposition & reasoned)))
