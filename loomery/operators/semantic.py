"""Exact cosine search on stored unit vectors, seed vectors, mutual ranks and reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

TOP, MUTUAL, RRF, TICKET = 200, 100, 60, 3
SEED_WEIGHTS = {"title": 4.0, "body": 1.0, "labels": 1.5, "comment": 0.5, "review_comment": 0.5}
TICKET_WEIGHTS = {"title": 4.0, "body": 1.0, "labels": 1.5}
BLEND = 0.8


def dot(a: Column, b: Column) -> Column:
    """In double precision, clamped to [-1, 1]."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def passage_scores(passages: DataFrame, query: list[float]) -> DataFrame:
    return passages.withColumn("score", F.round(dot(F.col("vector"), F.array(*(F.lit(float(x)) for x in query))), 6)).drop("vector")


def ticket_scores(scores: DataFrame) -> DataFrame:
    """repo, number, score (best passage), blended (0.8 best + 0.2 weighted mean of the fields' best)."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in SEED_WEIGHTS.items() for x in kv)), F.col("field"))
    by_field = scores.groupBy("repo", "number", "field").agg(F.max("score").alias("score"))
    out = by_field.groupBy("repo", "number").agg(F.max("score").alias("score"), (F.sum(weight * F.col("score")) / F.sum(weight)).alias("mean"))
    return out.select("repo", "number", "score", F.round(BLEND * F.col("score") + (1 - BLEND) * F.col("mean"), 6).alias("blended"))


def top(scores: DataFrame, by: str = "score", n: int = TOP) -> DataFrame:
    return scores.orderBy(F.desc(by), "repo", "number").limit(n)


def best_passages(scores: DataFrame, limit: int = 3) -> DataFrame:
    """A ticket's best passage of each field, the best ``limit`` of them."""
    one = Window.partitionBy("repo", "number", "field").orderBy(F.desc("score"), "chunk")
    all_ = Window.partitionBy("repo", "number").orderBy(F.desc("score"), "field", "chunk")
    rows = scores.withColumn("i", F.row_number().over(one)).where("i = 1").drop("i")
    return rows.withColumn("ordinal", F.row_number().over(all_)).where(F.col("ordinal") <= limit)


def width(passages: DataFrame) -> int:
    """Numbers of a vector, 0 without one."""
    row = passages.where("vector is not null").select(F.size("vector").alias("n")).first()
    return row["n"] if row else 0


def summed(vectors: Column, n: int, weight: Column | None = None) -> Column:
    """An aggregate: the element-wise sum of arrays of ``n`` numbers, added up before the shuffle like any sum."""
    return F.array(*(F.sum(vectors[i] if weight is None else weight * vectors[i]) for i in range(n)))


def pooled(passages: DataFrame, weights: dict[str, float], main_only: bool = True) -> DataFrame:
    """A unit vector of each ticket: its fields' mean vectors by weight; ``main_only``: only tickets with a title or body.

    Vectors stay whole: a ticket's field is a row of sums, and so is a ticket."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("field"))
    rows = passages.where(F.col("field").isin(list(weights)) & F.col("vector").isNotNull())
    n = width(rows)
    if not n:
        return passages.select("repo", "number", F.array().cast("array<double>").alias("vector")).limit(0)
    rows = rows.select("repo", "number", "field", F.col("vector").cast("array<double>").alias("vector"))
    fields = rows.groupBy("repo", "number", "field").agg(summed(F.col("vector"), n).alias("sum"), F.count("*").alias("n"))
    out = fields.groupBy("repo", "number").agg(summed(F.col("sum"), n, weight / F.col("n")).alias("v"), F.max(F.col("field").isin("title", "body")).alias("main"))
    out = out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return out.where("main and norm > 0" if main_only else "norm > 0").select("repo", "number", F.transform("v", lambda x: x / F.col("norm")).alias("vector"))


def mutual_ranks(vectors: DataFrame, candidates: DataFrame, seed: list[float]) -> DataFrame:
    """rank = 1 + tickets nearer to the candidate than the seed is. At most MUTUAL candidates, against all vectors in
    one pass: the candidates are a bounded query set that is broadcast."""
    few = candidates.orderBy(F.desc("score"), "repo", "number").limit(MUTUAL).select("repo", "number")
    few = few.join(vectors, ["repo", "number"], "left").withColumn("own", F.round(dot(F.col("vector"), F.array(*(F.lit(x) for x in seed))), 6))
    few = F.broadcast(few.select(F.col("repo").alias("r"), F.col("number").alias("n"), F.col("vector").alias("c"), "own"))
    pairs = vectors.join(few.where("c is not null"), (F.col("repo") != F.col("r")) | (F.col("number") != F.col("n")))
    nearer = F.sum((F.round(dot(F.col("vector"), F.col("c")), 6) > F.col("own")).cast("long"))
    found = pairs.groupBy("r", "n").agg((1 + nearer).alias("rank"))
    # A candidate without a vector ranks behind all; one alone among the vectors is first.
    size = vectors.agg((F.count("*") + 1).alias("last"))
    ranks = few.select("r", "n", F.col("c").isNull().alias("bare")).join(found, ["r", "n"], "left").crossJoin(F.broadcast(size))  # one row
    rank = F.when(F.col("bare"), F.col("last")).otherwise(F.coalesce("rank", F.lit(1)))
    return ranks.select(F.col("r").alias("repo"), F.col("n").alias("number"), rank.alias("rank"))


def ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(repo, number, name): ranks over all rows, the highest ``by`` first."""
    return ranks.ranked(rows.select("repo", "number", by), [F.desc(by), F.asc("repo"), F.asc("number")], name).drop(by)


def fused(parts: list[tuple[DataFrame, str, float]], k: int = RRF) -> DataFrame:
    """Sum of weight / (k + rank); a list that lacks a ticket adds nothing."""
    out = None
    for rows, name, weight in parts:
        one = rows.select("repo", "number", (F.lit(weight) / (k + F.col(name))).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("repo", "number").agg(F.round(F.sum("score"), 9).alias("score"))


def hybrid(lexical: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """1 / (60 + lexical rank) + 1 / (60 + semantic rank) + 3 / (60 + ticket rank), each rank over all its tickets.

    A ticket stays if it matches literally, has evidence or is among the first TOP semantic hits; a rank it lacks adds
    nothing. ``evidence`` (repo, number, score) ranks by score, then by semantic rank.
    """
    key = ["repo", "number"]
    lex, sem = ranked(lexical, "score", "lex"), ranked(scores, "blended", "sem")
    told = evidence.where("score is not null").select(*key, "score").join(sem, key, "left")
    told = ranks.ranked(told, [F.desc("score"), F.asc_nulls_last("sem"), F.asc("repo"), F.asc("number")], "ticket").select(*key, "ticket")
    hits = lex.join(sem, key, "full_outer").join(told, key, "left")
    hits = hits.where(F.col("lex").isNotNull() | F.col("ticket").isNotNull() | (F.col("sem") <= TOP))
    part = lambda c, w: F.coalesce(F.lit(float(w)) / (RRF + F.col(c)), F.lit(0.0))
    return hits.select(*key, F.round(part("lex", 1) + part("sem", 1) + part("ticket", TICKET), 9).alias("score"))
