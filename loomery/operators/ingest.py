"""Incremental collection: newest-wins upsert, transfers, reconciliation, orphans, tallies, vector reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: str = "version", payload: str = "payload") -> DataFrame:
    """The newest row of each key. An incoming row wins if newer, or as new with another payload; stale ones lose."""
    both = stored.withColumn("fresh", F.lit(0)).unionByName(incoming.withColumn("fresh", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("fresh"), F.desc(payload))
    return both.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i", "fresh")


def transferred(tickets: DataFrame) -> DataFrame:
    """Of rows with the same node_id the latest is where the ticket lives now."""
    w = Window.partitionBy("node_id").orderBy(F.desc("version"), "repo", "number")
    return tickets.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def rehomed(comments: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Comments of moved tickets follow: old and new are (node_id, repo, number)."""
    moved = old.join(new.withColumnsRenamed({"repo": "to_repo", "number": "to_number"}), "node_id").select("repo", "number", "to_repo", "to_number")
    return comments.join(moved, ["repo", "number"], "left").withColumns({"repo": F.coalesce("to_repo", "repo"), "number": F.coalesce("to_number", "number")}).drop("to_repo", "to_number")


def reconciled(stored: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """What a complete listing no longer has."""
    return stored.join(seen.select(*key), key, "left_anti")


def tallies(old: DataFrame, new: DataFrame, key: list[str], by: str) -> DataFrame:
    """added, updated and removed rows a value of ``by``; an equal payload is no change."""
    a, b = old.select(*key, F.col(by).alias("by_old"), F.col("payload").alias("was")), new.select(*key, F.col(by).alias("by_new"), F.col("payload").alias("now"))
    both = a.join(b, key, "full_outer")
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy(F.coalesce("by_new", "by_old").alias(by)).agg(
        count(F.col("was").isNull()).alias("added"),
        count(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))).alias("updated"),
        count(F.col("now").isNull()).alias("removed"),
    )


def kinds(inventory: DataFrame, tickets: DataFrame, asked: DataFrame) -> DataFrame:
    """The kind of each asked key, from the tickets, else the inventory."""
    key = ["repo", "number"]
    t, i = tickets.select(*key, F.col("kind").alias("kt")), inventory.select(*key, F.col("kind").alias("ki"))
    return asked.join(t, key, "left").join(i, key, "left").select(*key, F.coalesce("kt", "ki").alias("kind"))


def to_encode(passages: DataFrame, dictionary: DataFrame, model: str, version: str = "2") -> DataFrame:
    """Distinct passages whose vector isn't in the dictionary, by content key."""
    zero = F.lit("\x00")
    keyed = passages.withColumn("key", F.sha2(F.concat(F.lit(model), zero, F.lit(version), zero, "text"), 256))
    return keyed.dropDuplicates(["key"]).join(dictionary.select("key"), "key", "left_anti")


def thread_roots(comments: DataFrame) -> DataFrame:
    """(id, root) of each comment: the comment its chain of replies within the ticket begins with. A parent that isn't
    there, or is of another ticket, ends the chain. Links are doubled until none moves; a cycle is an error."""
    ticket = [c for c in ("repo", "number") if c in comments.columns]
    parents = comments.select(F.col("id").alias("p"), *(F.col(c).alias(f"p_{c}") for c in ticket))
    same = F.col("in_reply_to") == F.col("p")
    for c in ticket:
        same = same & (F.col(c) == F.col(f"p_{c}"))
    rows = comments.join(parents, same, "left").select("id", F.coalesce("p", "id").alias("root"), F.col("p").isNotNull().alias("moved"))
    # Links that are no cycle are at an end once they have been doubled as often as their number has binary digits.
    rounds = max(1, rows.where("moved").count().bit_length())
    for _ in range(rounds):
        ends = rows.select(F.col("id").alias("q"), F.col("root").alias("next"), F.col("moved").alias("on"))
        rows = rows.join(ends, F.col("root") == F.col("q")).select("id", F.col("next").alias("root"), F.col("on").alias("moved"))
        rows = rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()
        if rows.where("moved").isEmpty():
            return rows.select("id", "root")
    return rows.select("id", F.when(F.col("moved"), F.raise_error(F.lit("a reply chain has a cycle"))).otherwise(F.col("root")).alias("root"))
