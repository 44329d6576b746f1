"""Sorting, keyset pages, cursors, facets and counts."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MOST, FACETS, CURSOR_BYTES = 30, 100, 100, 4096
KEYS = {"relevance": "score", "updated": "updated_s", "created": "created_s"}


class CursorError(ValueError):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def limit_of(limit: int | None) -> int:
    limit = PAGE if limit is None else limit
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit is 1 to {MOST}")
    return limit


def order_by(sort: str, order: str | None = None) -> list[Column]:
    """Ties go by repo and number, ascending; number sorts by both in the order asked for."""
    down = (order or ("asc" if sort == "number" else "desc")) == "desc"
    way = lambda c: F.desc(c) if down else F.asc(c)
    return [way("repo"), way("number")] if sort == "number" else [way(KEYS[sort]), F.asc("repo"), F.asc("number")]


def after(sort: str, order: str | None, key, repo: str, number: int) -> Column:
    """Rows behind the one with these sort keys."""
    down = (order or ("asc" if sort == "number" else "desc")) == "desc"
    r, n = F.col("repo"), F.col("number")
    if sort == "number":
        return (r < repo) | (r == repo) & (n < number) if down else (r > repo) | (r == repo) & (n > number)
    k = F.col(KEYS[sort])
    return ((k < key) if down else (k > key)) | (k == key) & ((r > repo) | (r == repo) & (n > number))


def page(rows: DataFrame, sort: str, order: str | None = None, limit: int | None = None, cursor: dict | None = None) -> DataFrame:
    """One page; fetch a row more than asked to see whether another follows."""
    if cursor:
        rows = rows.where(after(sort, order, cursor["key"], cursor["repo"], cursor["number"]))
    return rows.orderBy(*order_by(sort, order)).limit(limit_of(limit))


def signature(options: dict) -> str:
    kept = {k: v for k, v in options.items() if k not in ("limit", "cursor")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()


def encode(cursor: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(cursor, sort_keys=True).encode()).decode().rstrip("=")


def decode(text: str, kind: str, sign: str, generation: str) -> dict:
    """A search by another engine (kinds search:<engine>): 409; wrong kind or options: 400; another generation: 409."""
    if len(text) > CURSOR_BYTES:
        raise CursorError(400, "the cursor is too long")
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as why:
        raise CursorError(400, "the cursor can't be read") from why
    if kind.startswith("search") and str(got.get("kind")).startswith("search") and got["kind"] != kind:
        raise CursorError(409, "the engine changed; begin again")
    if got.get("kind") != kind or got.get("signature") != sign:
        raise CursorError(400, "the cursor is of another query")
    if got.get("generation") != generation:
        raise CursorError(409, "the data changed")
    return got


def facet(rows: DataFrame, values: Column, distinct: bool = True, top: int = FACETS) -> DataFrame:
    """Tickets a value, most first; ``values`` is an array, counted once a ticket if ``distinct``."""
    each = rows.select("repo", "number", F.explode(F.array_distinct(values) if distinct else values).alias("value")).where("value is not null")
    return each.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def facet_page(rows: DataFrame, values: Column, distinct: bool = True, top: int = FACETS) -> DataFrame:
    """``facet`` with ``truncated``: a value more is looked for than returned."""
    few = facet(rows, values, distinct, top + 1).withColumn("i", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # top + 1 rows
    return few.withColumn("truncated", F.count("*").over(Window.partitionBy()) > top).where(F.col("i") <= top).drop("i")
