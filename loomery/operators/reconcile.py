"""Removal in two phases, recovery of orphans, and transfers: what a collection does beside newest-wins upserts.

Nothing is removed because a listing lacks it. A listing counts only if it is proven whole; what it lacks is a candidate; a
candidate is asked for on its own; and only one that is answered to be gone is removed, with what hangs on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import cut

KEY = ["repo", "number"]


def whole_listings(pages: DataFrame) -> DataFrame:
    """(repo) of listings that came whole: pages (repo, page, last) from 1 on without a gap, each with one answer for whether it is
    the last, and only the highest is. A page that was read again doesn't count twice."""
    each = pages.groupBy("repo", "page").agg(F.max("last").alias("last"), F.min("last").alias("sure"))
    found = each.groupBy("repo").agg(F.count("*").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"), F.count_if("last").alias("lasts"), F.max_by("last", "page").alias("ended"), F.bool_and(F.col("last") == F.col("sure")).alias("agreed"))
    return found.where((F.col("low") == 1) & (F.col("n") == F.col("high")) & (F.col("lasts") == 1) & F.col("ended") & F.col("agreed")).select("repo")


def candidates(stored: DataFrame, seen: DataFrame, pages: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of ``stored`` in repositories whose listing came whole that the listing lacks: to be asked for one by one."""
    return stored.join(whole_listings(pages), "repo", "left_semi").join(seen.select(*key), key, "left_anti")


def decided(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(repo, number, decision) of candidates by their answers (repo, number, status): remove if it is 404 or 410, keep if it is 200, else
    wait, as without an answer or with several that differ."""
    said = answers.groupBy(*KEY).agg(F.min("status").alias("low"), F.max("status").alias("high"))
    gone = F.col("low").isin(404, 410) & F.col("high").isin(404, 410)
    decision = F.when(gone, "remove").when((F.col("low") == 200) & (F.col("high") == 200), "keep").otherwise("wait")
    return asked.select(*KEY).join(said, KEY, "left").select(*KEY, decision.alias("decision"))


def reconciled(tables: dict[str, DataFrame], seen: DataFrame, pages: DataFrame, answers: DataFrame, seen_comments: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next generation of ``tables`` (tickets and others with repo and number): tickets that are confirmed gone go from each of
    them. Comments go without being asked for if a whole listing of comments (id) lacks them. ``decisions`` says what became
    of the candidates."""
    decisions = cut(decided(candidates(tables["tickets"], seen, pages), answers))
    removed = decisions.where("decision = 'remove'").select(*KEY)
    out = {n: df.join(removed, KEY, "left_anti") for n, df in tables.items()}
    if seen_comments is not None and "comments" in out:
        whole = whole_listings(pages)
        out["comments"] = out["comments"].join(out["comments"].join(whole, "repo", "left_semi").join(seen_comments.select("id"), "id", "left_anti").select("id"), "id", "left_anti")
    return out | {"decisions": decisions}


def adopted(comments: DataFrame, tickets: DataFrame, fetched: DataFrame, waiting: DataFrame | None = None) -> dict[str, DataFrame]:
    """Comments whose ticket isn't there are tried again once their parents were ``fetched`` (rows like ``tickets``): comments that
    have a ticket now, tickets with those that a comment asked for, the missing parents to fetch, and what waits on."""
    every = comments if waiting is None else comments.unionByName(waiting)
    missing = every.join(tickets.select(*KEY), KEY, "left_anti").select(*KEY).distinct()
    new = fetched.join(missing, KEY, "left_semi")
    known = tickets.unionByName(new)
    orphans = every.join(known.select(*KEY), KEY, "left_anti")
    return {"tickets": known, "comments": every.join(known.select(*KEY), KEY, "left_semi"), "missing": orphans.select(*KEY).distinct(), "waiting": orphans}


def followed(moves: DataFrame) -> DataFrame:
    """(repo, number, to_repo, to_number): where each place of ``moves`` ends, along any number of moves.

    Links are doubled, so a chain of n moves takes log n rounds. A place that moved twice is an error, as is a cycle."""
    place = lambda r, n: F.struct(F.col(r).alias("repo"), F.col(n).alias("number"))
    links = moves.select(place("repo", "number").alias("a"), place("to_repo", "to_number").alias("b")).distinct()
    twice = F.count("*").over(Window.partitionBy("a")) > 1
    links = cut(links.withColumn("b", F.when(twice, F.raise_error(F.lit("a ticket moved to two places"))).otherwise(F.col("b"))))
    for _ in range(links.count().bit_length() + 1):
        nxt = links.select(F.col("a").alias("p"), F.col("b").alias("q"))
        longer = cut(links.join(nxt, F.col("b") == F.col("p"), "left").select("a", F.coalesce("q", "b").alias("b"), F.col("p").isNotNull().alias("moved")))
        links = longer.select("a", "b")
        if longer.where("moved").isEmpty():
            return links.select("a.*", F.col("b.repo").alias("to_repo"), F.col("b.number").alias("to_number"))
    raise ValueError("moves go round in a cycle")


def transferred(stored: DataFrame, incoming: DataFrame, comments: DataFrame, redirects: DataFrame | None = None, version: str = "updated_at") -> dict[str, DataFrame]:
    """Tickets and comments once ``incoming`` tickets are taken, some of which are stored ones in another place.

    A ticket lives where the newest row of its node_id is (an incoming one of equal age wins), its rows elsewhere go, and
    comments of all its places follow; so do those along ``redirects`` (repo, number, to_repo, to_number), to the end of
    their chains. An older row of the same place loses as in ``ingest.upsert``."""
    both = stored.withColumn("fresh", F.lit(0)).unionByName(incoming.withColumn("fresh", F.lit(1)))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc(version), F.desc("fresh"), F.desc("payload"), "repo", "number")
    homes = both.withColumn("i", F.row_number().over(best("node_id"))).where("i = 1").drop("i")
    here = cut(homes.select("node_id", F.col("repo").alias("to_repo"), F.col("number").alias("to_number")))
    moves = both.select("node_id", *KEY).distinct().join(here, "node_id").where((F.col("repo") != F.col("to_repo")) | (F.col("number") != F.col("to_number"))).select(*KEY, "to_repo", "to_number")
    moves = moves if redirects is None else moves.unionByName(redirects.select(*moves.columns))
    # A place that another ticket lives in now isn't where the old one's comments are.
    moves = moves.join(here.select(F.col("to_repo").alias("repo"), F.col("to_number").alias("number")), KEY, "left_anti")
    tickets = homes.withColumn("i", F.row_number().over(best(*KEY))).where("i = 1").drop("i", "fresh")
    ends = followed(moves)
    said = comments.join(ends, KEY, "left").withColumns({"repo": F.coalesce("to_repo", "repo"), "number": F.coalesce("to_number", "number")})
    return {"tickets": tickets, "comments": said.select(*comments.columns), "moves": ends}
