"""The nearest tickets of a vector without looking at every passage, and without losing one.

Passages are dealt to the nearest of some centres and kept by cluster, with the cluster's radius. No passage of a cluster can be
nearer to a query than its centre and radius allow: the query looks at the most promising clusters, and then at those others whose
bound reaches the last ticket it has. How many that are depends on the vectors: where they fall into groups, few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import cut
from ..sources.store import Store
from . import semantic

#: Centres at most, and vectors that they are fitted to at most: the first by a hash.
CLUSTERS, SAMPLE, ROUNDS = 1024, 16_384, 8
_SLACK = 1e-6


def centres(vectors: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means: ``count`` unit directions; the first are far from each other."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    out = unit[chosen]
    for _ in range(ROUNDS):
        nearest = (unit @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), out)
    return out


def bound(query: np.ndarray, centre: np.ndarray, radius: float, angle: float, norm: float) -> float:
    """The most that a vector within ``radius`` of ``centre``, at most ``angle`` off its direction and at most ``norm`` long can
    have in common with ``query``."""
    size = float(np.linalg.norm(query))
    straight = float(query @ centre) + size * radius
    towards = float(query @ centre) / max(size * float(np.linalg.norm(centre)), 1e-12)
    least = max(0.0, float(np.arccos(np.clip(towards, -1, 1))) - angle)
    turned = size * norm * float(np.cos(least))
    return min(straight, turned) if turned >= 0 else straight


@dataclass
class Clusters:
    """passages (repo, number, field, chunk, vector, cluster) and clusters (cluster, centre, radius, angle, norm, n)."""

    passages: DataFrame
    clusters: DataFrame

    @staticmethod
    def tables(passages: DataFrame, count: int | None = None) -> dict[str, DataFrame]:
        """Centres by a bounded sample; every passage is kept. Null vectors are in no cluster."""
        rows = passages.where("vector is not null")
        sample = rows.orderBy(F.xxhash64("repo", "number", "field", "chunk"), "chunk").select("vector").limit(SAMPLE).toPandas()["vector"]
        count = count or max(1, min(CLUSTERS, int(2 * len(sample) ** 0.5)))
        found = centres(np.array([np.asarray(v, np.float64) for v in sample]), count) if len(sample) else np.zeros((1, 1))
        spark = passages.sparkSession
        shared = spark.sparkContext.broadcast(found)  # at most CLUSTERS vectors

        @F.pandas_udf("cluster int, far double, angle double, norm double")
        def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vectors in batches:
                v, c = np.array([np.asarray(x, np.float64) for x in vectors]), shared.value
                near = v @ c.T
                at, norm = near.argmax(axis=1), np.linalg.norm(v, axis=1)
                cos = np.clip(near[np.arange(len(v)), at] / np.maximum(norm, 1e-12), -1, 1)
                yield pd.DataFrame({"cluster": at.astype(np.int32), "far": np.linalg.norm(v - c[at], axis=1), "angle": np.arccos(cos), "norm": norm})

        rows = rows.withColumn("p", placed("vector")).select("repo", "number", "field", "chunk", "vector", "p.*")
        rows = cut(rows.repartitionByRange("cluster", "chunk").sortWithinPartitions("cluster"))
        stats = rows.groupBy("cluster").agg(F.max("far").alias("radius"), F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.count("*").alias("n"))
        places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cluster int, centre array<double>")
        return {"passages": rows.drop("far", "angle", "norm"), "clusters": stats.join(places, "cluster")}

    @staticmethod
    def of(store: Store) -> Clusters:
        return Clusters(store.read("passages"), store.read("clusters"))

    def top(self, query: list[float], k: int = semantic.TOP) -> tuple[DataFrame, dict[str, int]]:
        """The ``k`` tickets with the nearest passage (repo, number, score), as looking at all would give them; and of how many
        clusters and passages how many were looked at."""
        about, q = self.clusters.collect(), np.asarray(query, np.float64)  # at most CLUSTERS rows
        about = sorted(((bound(q, np.array(r["centre"]), r["radius"], r["angle"], r["norm"]), r["cluster"], r["n"]) for r in about), key=lambda x: (-x[0], x[1]))
        first, seen = [], 0
        for _, c, n in about:
            if seen >= 2 * k:
                break
            first.append(c)
            seen += n

        def scored(own: list[int]) -> DataFrame:
            rows = semantic.passage_scores(self.passages.where(F.col("cluster").isin(own)).drop("cluster"), query)
            return rows.groupBy("repo", "number").agg(F.max("score").alias("score"))

        start = semantic.top(scored(first), n=k).collect()  # at most k
        least = start[-1]["score"] - _SLACK if len(start) == k else -np.inf
        read = sorted({*first, *(c for b, c, _ in about if min(b, 1.0) >= least)})
        looked = {"clusters": len(about), "read": len(read), "passages": sum(n for *_, n in about), "looked_at": sum(n for _, c, n in about if c in set(read))}
        return semantic.top(scored(read), n=k), looked
