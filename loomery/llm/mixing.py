"""Mixing sources to target weights by systematic sampling.

Within a source, documents are put in order of size, each adds its expected copies to a prefix sum that starts at
one random offset, and is emitted once for each integer that the sum passes. In order of size the words taken stray
from the target by less than one of the source's largest documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2
SEED = 20240131
#: Documents of one source and size that are numbered in one task, about.
RUN = 4096


def _sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:  # split() of bytes cuts at the six ASCII white spaces
        yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "h": f["h"], "size": [0 if t is None else len(t.split()) for t in f["text"]]})


def targets(sizes: dict[str | None, int], budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take of each source: shares of ``budget`` times all by weight, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = budget * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def mixed(docs: DataFrame, budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, h (hash of doc_id and text), size, source_size, target, copies.

    ``size`` counts words, 0 for null and blank texts. A null source is a source of its own, the last. Reruns agree;
    rows that are alike in doc_id, source and text may differ in copies by one, in any order. A source without words
    takes nothing. Other columns are ignored. One total for each source is gathered on the driver.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("binary").alias("text"))
    rows = materialize(rows.mapInPandas(_sized, "doc_id long, source string, h long, size long"), "sized")
    spark = docs.sparkSession
    totals = {r["source"]: (r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # a row a source
    aim = targets(totals, budget, weights, most)
    offset = lambda s: xxhash.xxh64_intdigest(f"{seed}:{s}") / 2.0**64
    plan = pd.DataFrame([(s, totals[s], t, t / totals[s] if totals[s] else 0.0, offset(s)) for s, t in aim.items()], columns=["s", "source_size", "target", "rate", "offset"])
    plan = spark.createDataFrame(plan.astype({"s": object}), "s string, source_size long, target double, rate double, offset double")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    sizes = rows.groupBy("source", "size").agg(F.count("*").alias("n")).withColumn("runs", F.ceil(F.col("n") / RUN))
    sizes = materialize(sizes.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "runs"), "sizes")
    rows = rows.join(sizes, same("source", "s1") & (F.col("size") == F.col("z1")))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("runs"))).drop("s1", "z1", "runs")
    rows = materialize(rows, "runs")
    runs = rows.groupBy("source", "size", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("size", "run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("run").alias("r2"), F.coalesce(before, F.lit(0)).alias("before"))
    runs = materialize(runs, "before")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("source", "size", "run").orderBy("h", "doc_id")))
    rows = rows.join(runs, same("source", "s2") & (F.col("size") == F.col("z2")) & (F.col("run") == F.col("r2")))
    rows = rows.join(F.broadcast(plan), same("source", "s"))  # a row a source
    at = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    rank = F.col("before") + F.col("i")
    copies = F.greatest(F.lit(0), F.least(F.lit(most), at(rank) - at(rank - 1)))
    return rows.select("doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"))
