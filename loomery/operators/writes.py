"""Write primitives: each gives the table of the next generation from the current one and what changes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import upsert
from .records import valid_json


def checked(rows: DataFrame, needs: dict[str, Column]) -> DataFrame:
    """``rows``, or a failed job that names the first rule a row breaks."""
    broken = F.lit(None).cast("string")
    for name, rule in needs.items():
        broken = F.coalesce(broken, F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)))
    out = rows.withColumn("broken", broken)
    # The guard stands on a column that is read, or it would be pruned.
    first = rows.columns[0]
    return out.withColumn(first, F.when(F.col("broken").isNotNull(), F.raise_error(F.concat(F.lit("invalid row: "), "broken"))).otherwise(F.col(first))).drop("broken")


def checked_tickets(rows: DataFrame) -> DataFrame:
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return checked(rows, {"number": F.col("number") >= 1, "node_id": filled("node_id"), "updated_at": F.try_to_timestamp(F.col("updated_at")).isNotNull(), "url": filled("url"), "payload": valid_json(F.col("payload"))})


def put_tickets(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest wins; rows that break a rule fail the commit."""
    return upsert(stored, checked_tickets(incoming), ["repo", "number"], "updated_at")


def put_comments(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest wins by id; an equal time wins with another payload or ticket."""
    place = F.concat_ws("\x00", "payload", "repo", F.col("number").cast("string"))
    both = upsert(stored.withColumn("content", place), incoming.withColumn("content", place), ["id"], "updated_at", "content")
    return both.drop("content")


def put_extra(tickets: DataFrame, given: DataFrame) -> DataFrame:
    """``fields`` and ``extra`` of the tickets that ``given`` names are replaced; others keep theirs."""
    new = given.select("repo", "number", F.col("fields").alias("f"), F.col("extra").alias("e"), F.lit(True).alias("given"))
    rows = tickets.join(new, ["repo", "number"], "left")
    pick = lambda old, fresh: F.when(F.col("given"), F.col(fresh)).otherwise(F.col(old))
    return rows.withColumns({"fields": pick("fields", "f"), "extra": pick("extra", "e")}).drop("f", "e", "given")


def rebuilt_documents(documents: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Units of ``changed`` tickets (repo, number) are replaced by ``fresh`` ones; a label unit without labels is gone."""
    key = ["repo", "number"]
    new = fresh.join(changed.select(*key).distinct(), key, "left_semi").where("not (family = 'labels' and coalesce(title, '') = '')")
    return documents.join(changed.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_catalog(entries: DataFrame, kind: str, scope: str, new: DataFrame | None) -> DataFrame:
    """A catalogue as a whole; ``new`` None deletes it."""
    rest = entries.where(~((F.col("kind") == kind) & (F.col("scope") == scope)))
    return rest if new is None else rest.unionByName(new.select("id", "payload").withColumns({"kind": F.lit(kind), "scope": F.lit(scope)}).select(*entries.columns))


def issue_refs(tickets: DataFrame, repo: str) -> DataFrame:
    return tickets.where(F.col("repo") == repo).select("number", "node_id", "kind").orderBy("number")


def within_prefix(url: Column, path: str) -> Column:
    """The listing ``path`` with any query, but not longer paths."""
    return (url == path) | url.startswith(path + "?")


def cached(responses: DataFrame, new: DataFrame) -> DataFrame:
    """Responses by url, the new ones first; those of incremental listings aren't kept."""
    fresh = new.where(~F.col("url").rlike(r"[?&]since="))
    return responses.join(fresh.select("url"), "url", "left_anti").unionByName(fresh)


def without_listing(responses: DataFrame, path: str) -> DataFrame:
    return responses.where(~within_prefix(F.col("url"), path))


def without_prefix(responses: DataFrame, prefix: str) -> DataFrame:
    return responses.where(~F.col("url").startswith(prefix))


def scope_reset(old: dict, new: dict) -> list[str]:
    """Repositories whose options changed; all if credentials or the collection version did."""
    if any(old.get(k) != new.get(k) for k in ("credential_identity", "collection_version")):
        return sorted({*old.get("options", {}), *new.get("options", {})})
    a, b = old.get("options", {}), new.get("options", {})
    return sorted(r for r in {*a, *b} if a.get(r) != b.get(r))


def reset(tables: dict[str, DataFrame], repos: list[str]) -> dict[str, DataFrame]:
    """Every table with a repo column without these repositories."""
    return {n: df.where(~F.col("repo").isin(repos)) if repos and "repo" in df.columns else df for n, df in tables.items()}


def since(collected: datetime | None, overlap: timedelta = timedelta(minutes=5)) -> datetime | None:
    """Where the next listing begins: some time before the last one began."""
    return collected - overlap if collected else None


def due(last: datetime | None, every: timedelta, now: datetime) -> bool:
    return last is None or now - last >= every


def renamed_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scope, id, was, now) of catalogue labels that were renamed (now) or deleted (now null)."""
    side = lambda df, c: df.where("kind = 'labels'").select("scope", "id", F.get_json_object("payload", "$.name").alias(c))
    return side(old, "was").join(side(new, "now"), ["scope", "id"], "left").where("now is null or now <> was")


def relabelled(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels of tickets after ``changes``; each ticket's labels are looked up in its repository's changes."""
    table = changes.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("was", "now"))).alias("table"))
    rows = tickets.join(table, F.col("repo") == F.col("scope"), "left")
    moved = F.array_compact(F.transform("labels", lambda x: F.when(F.map_contains_key("table", x), F.element_at("table", x)).otherwise(x)))
    return rows.withColumn("labels", F.when(F.col("table").isNull(), F.col("labels")).otherwise(F.array_distinct(moved))).drop("scope", "table")


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, broken): rows that break uniqueness or point to tickets that aren't there."""
    t, c, d = (tables[n] for n in ("tickets", "comments", "documents"))
    key = ["repo", "number"]
    twice = lambda df, cols: df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("broken"))
    lost = lambda df: df.join(t.select(*key), key, "left_anti").agg(F.count("*").alias("broken"))
    checks = {"ticket twice": twice(t, key), "comment twice": twice(c, ["id"]), "unit twice": twice(d, ["id"]), "comment without ticket": lost(c), "unit without ticket": lost(d)}
    out = None
    for rule, df in checks.items():
        one = df.select(F.lit(rule).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out
