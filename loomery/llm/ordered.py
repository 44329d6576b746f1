"""Rows dealt into buckets by ranges of a key, each bucket closed by copies of the rows next to it.

So a task sees every row together with its neighbours in the order of all rows, and no task sorts them all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Keys a bucket that are looked at to choose the ranges.
SAMPLE = 40


def in_order(rows: DataFrame, key: str, rank: str, size: str, wrap: bool = False, buckets: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` by ``key`` (not null), ties by ``rank``, with columns bucket and side.

    side is 0, or -1 and 1 for copies of the rows just before and after the bucket; ``wrap``: the first row of all
    comes after the last. A bucket is a partition, sorted. Ranges come from a bounded sample of keys and ranks and hold
    about as many characters of ``size`` each; the order doesn't depend on them. ``prepare`` maps the rows once they are
    dealt, before they travel. Copies are repeated if rows are alike in key and rank; take the nearest.
    """
    n = buckets or partitions(rows.sparkSession)
    drawn = rows.select(key, rank, F.length(size).alias("n"), F.xxhash64(key, rank, F.lit(5)).alias("draw"))
    sample = sorted((r[0], r[1], r[2] or 0) for r in drawn.orderBy("draw", key, rank).limit(SAMPLE * n).collect()) if n > 1 else []
    total, sofar, cuts = sum(x[2] + 1 for x in sample), 0, []
    for k, r, chars in sample:
        sofar += chars + 1
        if sofar * n >= total * (len(cuts) + 1) and len(cuts) < n - 1 and (not cuts or cuts[-1] < (k, r)):
            cuts.append((k, r))

    @F.pandas_udf("int")
    def bucket_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, ranks in batches:
            yield pd.Series([bisect_left(cuts, x) for x in zip(keys, ranks, strict=True)], dtype="int32")

    keyed = rows.withColumn("bucket", bucket_of(key, rank) if cuts else F.lit(0))
    place = F.struct(key, rank)
    ends = keyed.groupBy("bucket").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    w, all_ = Window.orderBy("bucket"), Window.partitionBy()  # a row a bucket
    ends = ends.select("bucket", "low", "high", F.lag("bucket").over(w).alias("before"), F.lead("bucket").over(w).alias("after"), F.max("bucket").over(all_).alias("top"))
    if wrap:
        ends = ends.withColumn("before", F.coalesce("before", "top"))
    ends = materialize(ends.select(F.col("bucket").alias("b"), "low", "high", "before", "after"), "ends")
    both = keyed.join(F.broadcast(ends), F.col("bucket") == F.col("b"), "left")
    at = lambda bucket, side: F.struct(bucket.cast("int").alias("bucket"), F.lit(side).alias("side"))
    sides = F.array(
        at(F.col("bucket"), 0),
        F.when(place.eqNullSafe(F.col("low")) & F.col("before").isNotNull(), at(F.col("before"), 1)),
        F.when(place.eqNullSafe(F.col("high")) & F.col("after").isNotNull(), at(F.col("after"), -1)),
    )
    both = both.withColumn("at", F.explode(F.filter(sides, lambda x: x.isNotNull())))
    both = both.select(*rows.columns, F.col("at.bucket").alias("bucket"), F.col("at.side").alias("side"))
    both = prepare(both) if prepare else both
    return both.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "side", key, rank)
