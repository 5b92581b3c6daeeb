"""Canonical model: naming rules, placement, coverage with gates, gap register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.config import ABBREVIATIONS, ALLOWED_ABBREVIATIONS, IDENTIFIER, MONETARY, OBLIGATION_RANK, OBLIGATION_WEIGHT, REGIONS, Settings
from selvage.functions import text as names


def violations(entity: Column, attribute: Column, is_core: Column, data_type: Column, type_name: Column, offset_required: Column) -> Column:
    """Kinds of naming rule that a name breaks, in the order of the rules (an abbreviation once for each token)."""
    tokens = names.tokens(attribute)
    lexicon = lambda words: F.arrays_overlap(tokens, names.words(*words))
    region = F.lit(False)
    for r in REGIONS:
        region |= F.contains(F.lower(attribute), F.lit(r))
    short = F.filter(tokens, lambda t: t.isin(*ABBREVIATIONS) & ~t.isin(*ALLOWED_ABBREVIATIONS))
    first = F.array(F.when(~attribute.rlike("^[a-z][a-zA-Z0-9]*$"), "case"), F.when(~entity.rlike("^[A-Z][a-zA-Z0-9]*$"), "case"))
    rest = F.array(
        F.when(region & is_core, "region-marker"),
        F.when((data_type == "boolean") & ~attribute.rlike("^(is|has)"), "boolean"),
        F.when(lexicon(MONETARY) & (type_name != "MonetaryAmount"), "money"),
        F.when(lexicon(IDENTIFIER) & (type_name != "Identifier"), "identifier"),
        F.when((data_type == "dateTime") & ~offset_required, "datetime"),
    )
    return F.filter(F.concat(first, F.transform(short, lambda t: F.lit("abbreviation")), rest), lambda v: v.isNotNull())


def placement(regions: Column, max_tier: Column, regulatory: Column, approved: Column, absence_is_gap: Column, to_close: Column) -> Column:
    """struct(kind, region, rule): core or extension, by the first rule that holds.

    regions: sorted distinct regions. A regulatory duty is always an extension (4); evidence of tier 3 alone needs an
    approval (5); three regions are core (1); two are core if the third's absence is a gap (2); one is core if it is meant
    to be adopted (3). Extensions belong to the first region by name.
    """
    n = F.size(regions)
    first = F.coalesce(F.try_element_at(regions, F.lit(1)), F.lit("us"))
    core = lambda rule: F.struct(F.lit("core").alias("kind"), F.lit(None).cast("string").alias("region"), F.lit(rule).alias("rule"))
    extension = lambda rule: F.struct(F.lit("extension").alias("kind"), first.alias("region"), F.lit(rule).alias("rule"))
    return (
        F.when(regulatory, extension("4"))
        .when((max_tier == 3) & ~approved, extension("5"))
        .when(n == 3, core("1"))
        .when(n == 2, F.when(absence_is_gap, core("2")).otherwise(extension("2")))
        .otherwise(F.when(to_close, core("3")).otherwise(extension("3")))
    )


def contract_value(placed: Column) -> Column:
    return F.when(placed["kind"] == "core", "core").otherwise(F.concat(F.lit("extension:"), placed["region"]))


def rank(level: Column) -> Column:
    return names.lookup(OBLIGATION_RANK, level)


def strongest(level: Column) -> Column:
    """Aggregate: the strongest obligation; optional for no row."""
    return F.coalesce(F.max_by(level, rank(level)), F.lit("optional"))


def weakest(level: Column) -> Column:
    return F.coalesce(F.min_by(level, rank(level)), F.lit("optional"))


def weight(level: Column) -> Column:
    return names.lookup(OBLIGATION_WEIGHT, level)


def universe(clusters: DataFrame, candidates: DataFrame, attributes: DataFrame) -> DataFrame:
    """conceptId, weight, evidenced, sme, resolution, regions, inferred: a concept for each cluster.

    A cluster without a candidate is a gap, weighted by its members' strongest obligation. A concept is inferred if all its
    members are.
    """
    member = clusters.select("clusterId", "evidenceRefs", F.explode("members").alias("m")).join(attributes.select("attributeId", "inferred", F.col("obligation.level").alias("level")), F.col("m.attributeId") == F.col("attributeId"), "left")
    each = member.groupBy("clusterId").agg(
        F.first("evidenceRefs").alias("refs"), F.array_sort(F.collect_set("m.region")).alias("regions"),
        F.coalesce(F.every("inferred"), F.lit(False)).alias("inferred"), strongest(F.col("level")).alias("level"),
    )
    of = candidates.select(F.explode("clusterRefs").alias("clusterId"), "candidateId", "placement", F.col("weight").alias("own"), F.when(F.col("ratification.status") == "approved", F.col("ratification.sme")).alias("sme"))
    joined = each.join(of, "clusterId", "left")
    resolution = F.when(F.col("candidateId").isNull(), "gap").when(F.col("placement") == "core", "core").otherwise("extension")
    return joined.select(F.coalesce("candidateId", "clusterId").alias("conceptId"), F.coalesce("own", weight(F.col("level"))).alias("weight"), (F.size("refs") > 0).alias("evidenced"), "sme", resolution.alias("resolution"), "regions", "inferred")


def classified(concepts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """concepts with r (what they count), unevidenced and unresolved."""
    unevidenced = ~F.col("evidenced") | F.col("sme").isNull()
    r = F.when(unevidenced, 0.0).otherwise(names.lookup(settings.resolution, F.col("resolution")))
    return concepts.withColumn("unevidenced", unevidenced).withColumn("r", r).withColumn("unresolved", (F.col("weight") == 5) & (F.col("r") < 1.0))


def _score() -> Column:
    return F.coalesce(F.sum(F.col("weight") * F.col("r")) / F.nullif(F.sum("weight"), F.lit(0)), F.lit(0.0))


def by_region(concepts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """region, score of each of the fixed regions; a region without a concept scores 0."""
    every = concepts.sparkSession.createDataFrame([(r,) for r in REGIONS], "region string")
    own = classified(concepts, settings).select(F.explode("regions").alias("region"), "weight", "r").groupBy("region").agg(_score().alias("score"))
    return every.join(own, "region", "left").select("region", F.coalesce("score", F.lit(0.0)).alias("score"))


def coverage(concepts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: score, denominator, weightSum, us, uk, eu, gate1Pass to gate3Pass, specified, inferred. One pass over concepts.

    Gates compare unrounded scores; round for display only.
    """
    rows = classified(concepts, settings)
    regional = [
        F.coalesce(
            F.sum(F.when(F.array_contains("regions", r), F.col("weight") * F.col("r"))) / F.nullif(F.sum(F.when(F.array_contains("regions", r), F.col("weight"))), F.lit(0)), F.lit(0.0)
        ).alias(r)
        for r in REGIONS
    ]
    out = rows.agg(
        _score().alias("score"), F.count("*").alias("denominator"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weightSum"), *regional,
        (~F.coalesce(F.some("unresolved"), F.lit(False))).alias("gate1Pass"), (~F.coalesce(F.some("unevidenced"), F.lit(False))).alias("gate3Pass"),
        F.count_if(~F.col("inferred")).alias("specified"), F.count_if("inferred").alias("inferred"),
    )
    floor = F.lit(True)
    for r in REGIONS:
        floor &= F.round(F.col(r), 4) >= settings.region_floor
    return out.withColumn("gate2Pass", (F.col("score") >= settings.domain_target) & floor)


def gaps(concepts: DataFrame, exclusions: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """conceptId, weight, reason, affectedRegions, recommendation: a concept may be listed for several reasons, but as
    unevidenced only if it is not unresolved."""
    rows = classified(concepts, settings)
    none = F.lit(None).cast("string").alias("recommendation")
    entry = lambda df, reason, regions: df.select("conceptId", "weight", F.lit(reason).alias("reason"), regions.alias("affectedRegions"), none)
    low = by_region(concepts, settings).where(F.round("score", 4) < settings.region_floor).select("region")
    below = rows.where("resolution <> 'core'").select("conceptId", "weight", F.explode("regions").alias("region")).join(F.broadcast(low), "region")  # at most three rows
    out = entry(rows.where("unresolved"), "unresolved", F.col("regions")).union(entry(rows.where("unevidenced AND NOT unresolved"), "unevidenced", F.col("regions"))).union(entry(below, "below-region-floor", F.array("region")))
    if exclusions is not None:
        out = out.union(exclusions.select(F.col("uri").alias("conceptId"), F.lit(1).alias("weight"), F.lit("excluded").alias("reason"), names.words(*REGIONS).alias("affectedRegions"), F.nullif("detail", F.lit("")).alias("recommendation")))
    return out
