"""Retrieval evaluation: quality of ranked results against judgements, and nearest-rank latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """A row for each judged case: returned, precision_10, recall_20, reciprocal_20.

    ``ranked``: case, place (from 1), repo, number; ``judged``: case, repo, number. A ticket that is returned again
    counts once, at its first place; precision is always out of ten. A case without results scores 0.
    """
    key = ["case", "repo", "number"]
    first = ranked.groupBy(*key).agg(F.min("place").alias("place"))
    hits = judged.select(*key).distinct().join(first, key, "left").groupBy("case").agg(
        F.count("*").alias("relevant"),
        F.count_if(F.col("place") <= 10).alias("hits_10"),
        F.count_if(F.col("place") <= 20).alias("hits_20"),
        F.min(F.when(F.col("place") <= 20, F.col("place"))).alias("at"),
    )
    returned = ranked.groupBy("case").agg(F.count("*").alias("returned"))
    return hits.join(returned, "case", "left").select(
        "case",
        F.coalesce("returned", F.lit(0).cast("long")).alias("returned"),
        (F.col("hits_10") / 10).alias("precision_10"),
        (F.col("hits_20") / F.col("relevant")).alias("recall_20"),
        F.coalesce(1 / F.col("at"), F.lit(0.0)).alias("reciprocal_20"),
    )


def summary(cases: DataFrame, elapsed: str = "elapsed_ms") -> DataFrame:
    """Means of the scores over the cases, and the 50th and 95th percentile (nearest rank) of ``elapsed``."""
    nearest = lambda p: F.expr(f"percentile_disc({p}) within group (order by {elapsed})")
    return cases.agg(
        *(F.avg(c).alias(f"mean_{c}") for c in ("precision_10", "recall_20", "reciprocal_20")),
        nearest(0.5).alias("p50_ms"),
        nearest(0.95).alias("p95_ms"),
    )
