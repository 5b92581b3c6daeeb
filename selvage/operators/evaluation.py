"""Quality of clusters against a labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least pairwise F1, least recall of homonyms, and runs of which the worst counts.
F1_FLOOR, HOMONYM_FLOOR, RUNS = 0.88, 1.00, 5


def pair_scores(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, predicted_pairs, actual_pairs, precision, recall, f1 over all pairs of rows in one group.

    Pairs are counted from group sizes, n(n - 1) / 2, never made.
    """
    of = lambda *keys: rows.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))
    both = of(predicted, actual).withColumnRenamed("p", "tp")
    out = both.crossJoin(of(predicted).withColumnRenamed("p", "predicted_pairs")).crossJoin(of(actual).withColumnRenamed("p", "actual_pairs"))  # three single rows
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumn("precision", ratio("tp", "predicted_pairs")).withColumn("recall", ratio("tp", "actual_pairs"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def homonym_recall(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row, recall: share of pairs(a, b) that must stay apart and do in groups(item, grp). No pair: 1."""
    side = lambda c: groups.select(F.col("item").alias(c), F.col("grp").alias(f"g{c}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = ~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))
    return joined.agg(F.coalesce(F.avg(apart.cast("double")), F.lit(1.0)).alias("recall"))


def gate(runs: list[tuple[float, float]]) -> bool:
    """Whether the worst of the last runs (f1, homonym recall) is good enough."""
    last = runs[-RUNS:]
    return len(last) == RUNS and min(f for f, _ in last) >= F1_FLOOR and min(h for _, h in last) >= HOMONYM_FLOOR
