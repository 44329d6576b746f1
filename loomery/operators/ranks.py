"""Ranks over all rows of a table without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import cut

#: ``monotonically_increasing_id`` has the partition in its upper bits and the row's place below.
_ROW_BITS = 33


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: their place from 1 in ``order``, which must tell all rows apart for ranks to be the same in a rerun.

    Rows are dealt into ranges of the order, sorted within and counted; a range begins where those before it end. What is
    added up is a row a range. Places are written to the checkpoint folder before they are counted, since a second run of
    the dealing might choose other ranges.
    """
    spread = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranges = spread.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ranges = ranges.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    out = spread.join(F.broadcast(ranges), part == F.col("_range"))
    return out.select(*rows.columns, (F.col("_before") + place + 1).alias(name))
