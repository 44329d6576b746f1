"""Budgeted evidence: the description and the comments of tickets that fit a number of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMENT_CHARS = 2048


def chosen_comments(comments: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """At most ``limit`` comments of each ticket, with ``place``: first up to half of them that hold a term, then the
    newest others. Both rankings are limited before the shuffle, so a ticket with very many comments sends few."""
    key, newest = ["repo", "number"], [F.col("created_s").desc(), F.col("id").desc()]
    holds = F.lit(False)
    for t in terms:
        holds = holds | F.contains(F.lower("body"), F.lit(t.lower()))
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*newest))
    matching = comments.where(holds).withColumn("at", at).where(F.col("at") <= max(1, limit // 2)).withColumn("late", F.lit(0))
    recent = comments.withColumn("at", at).where(F.col("at") <= limit).withColumn("late", F.lit(1))
    rows = matching.unionByName(recent)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy(*key, "id").orderBy("late"))).where("again = 1")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("late", "at"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("at", "late", "again")


def budgeted(tickets: DataFrame, comments: DataFrame, budget: int, limit: int, terms: list[str], whole: bool = False) -> DataFrame:
    """A row for each piece of evidence: repo, number, place (0: the description), id, text, chars, truncated.

    The description takes two thirds of ``budget``, at least 1,000 characters (all of it if ``whole``); each comment
    up to COMMENT_CHARS of what is left, in order of place. Comments that nothing is left for are dropped.
    """
    key = ["repo", "number"]
    share = budget if whole else min(budget, max(1000, budget * 2 // 3))
    own = tickets.select(*key, F.lit(0).alias("place"), F.lit(None).cast("string").alias("id"), F.coalesce("body", F.lit("")).alias("text"), F.lit(share).alias("most"))
    said = chosen_comments(comments, terms, limit).join(tickets.select(*key), key, "left_semi")
    said = said.select(*key, "place", "id", F.coalesce("body", F.lit("")).alias("text"), F.lit(COMMENT_CHARS).alias("most"))
    rows = own.unionByName(said).withColumn("wanted", F.least(F.length("text"), "most").cast("long"))
    # What earlier pieces took is what they wanted, up to the budget: no loop is needed.
    before = F.coalesce(F.sum("wanted").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumn("left", F.greatest(F.lit(budget) - before, F.lit(0)).cast("long"))
    rows = rows.where((F.col("place") == 0) | (F.col("left") > 0)).withColumn("chars", F.least("wanted", "left"))
    return rows.select(*key, "place", "id", F.expr("substring(text, 1, int(chars))").alias("text"), "chars", (F.col("chars") < F.length("text")).alias("truncated"))


RELATED_CHARS, MOST_ITEMS = 512, 100


def related(tickets: DataFrame, relations: DataFrame, used: DataFrame, budget: int, limit: int) -> DataFrame:
    """(repo, number, n, to_repo, to_number, missing, chars): the first ``limit`` other tickets that one names (``relations``: repo, number,
    place, to_repo, to_number; the first MOST_ITEMS of them), one hop away, each with up to RELATED_CHARS of its description of
    what ``used`` (repo, number, used) leaves. One that isn't there is missing."""
    key = ["repo", "number"]
    at = F.row_number().over(Window.partitionBy(*key).orderBy("place", "to_repo", "to_number"))
    rows = relations.withColumn("at", at).where(F.col("at") <= MOST_ITEMS).where((F.col("repo") != F.col("to_repo")) | (F.col("number") != F.col("to_number")))
    rows = rows.groupBy(*key, "to_repo", "to_number").agg(F.min("at").alias("at"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).where(F.col("n") <= limit)
    there = tickets.select(F.col("repo").alias("to_repo"), F.col("number").alias("to_number"), F.least(F.length(F.coalesce("body", F.lit(""))), F.lit(RELATED_CHARS)).cast("long").alias("wanted"))
    rows = rows.join(there, ["to_repo", "to_number"], "left").join(used, key)
    before = F.coalesce(F.sum("wanted").over(Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chars = F.when(F.col("wanted").isNotNull(), F.least("wanted", F.greatest(F.lit(budget) - F.col("used") - before, F.lit(0).cast("long"))))
    return rows.select(*key, "n", "to_repo", "to_number", F.col("wanted").isNull().alias("missing"), chars.cast("long").alias("chars"))


def definitions(tickets: DataFrame, catalog: DataFrame, every: bool = False) -> DataFrame:
    """(repo, number, total, definitions): label definitions as JSON of name and description, a ticket's own labels first, then by id, at
    most MOST_ITEMS; of its own labels only unless ``every``. A repository's first MOST_ITEMS are gathered once for all of its tickets."""
    name, about = (F.get_json_object("payload", f"$.{x}") for x in ("name", "description"))
    shown = F.to_json(F.struct(name.alias("name"), about.alias("description")), {"ignoreNullFields": "false"})
    labels = catalog.where("kind = 'labels'").select(F.col("scope").alias("repo"), "id", name.alias("name"), shown.alias("json"))
    own = tickets.select("repo", "number", F.explode(F.array_distinct("labels")).alias("name")).join(labels, ["repo", "name"])
    own = own.groupBy("repo", "number").agg(F.count("*").alias("own"), F.slice(F.array_sort(F.collect_list(F.struct("id", "json"))), 1, MOST_ITEMS).alias("mine"))
    rows = tickets.select("repo", "number").join(own, ["repo", "number"], "left")
    none = F.array().cast("array<struct<id:string,json:string>>")
    rows = rows.withColumn("mine", F.coalesce("mine", none)).withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    if every:
        first = Window.partitionBy("repo").orderBy("id")
        best = labels.withColumn("i", F.row_number().over(first)).where(F.col("i") <= 2 * MOST_ITEMS)
        repos = best.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("id", "json"))).alias("all"))
        repos = repos.join(labels.groupBy("repo").agg(F.count("*").alias("total")), "repo")
        rows = rows.join(repos, "repo", "left").withColumn("mine", F.slice(F.concat("mine", F.array_except(F.coalesce("all", none), "mine")), 1, MOST_ITEMS))
        rows = rows.withColumn("own", F.coalesce("total", F.lit(0)).cast("long"))
    return rows.select("repo", "number", F.col("own").alias("total"), F.transform("mine", lambda x: x["json"]).alias("definitions"))


def fitted(items: Column, left: Column, share: Column) -> Column:
    """(left, kept) after taking ``items`` in order: one that doesn't fit what is left of ``share`` is passed over whole, later ones may
    still fit."""
    start = F.struct(left.cast("long").alias("left"), share.cast("long").alias("share"), F.array().cast("array<string>").alias("kept"))

    def take(a: Column, x: Column) -> Column:
        n = F.length(x).cast("long")
        more = F.struct((a["left"] - n).alias("left"), (a["share"] - n).alias("share"), F.array_append(a["kept"], x).alias("kept"))
        return F.when(n <= a["share"], more).otherwise(a)

    return F.aggregate(items, start, take)


def whole(tickets: DataFrame, comments: DataFrame, relations: DataFrame, catalog: DataFrame, fields: DataFrame, budget: int, limit: int, related_limit: int, terms: list[str], purpose: str = "triage", rules: DataFrame | None = None) -> DataFrame:
    """A row for each ticket: what of it goes into a context of ``budget`` characters.

    In this order, each from what those before leave: the description (two thirds, all for ``proofread``), comments, related
    tickets, label rules (repo, rules as JSON, n: all or none, of 100 at most), label definitions (up to a third of the budget;
    of every label for ``classification``) and custom fields (all or none). What is left out for its size has a warning.
    """
    key = ["repo", "number"]
    said = budgeted(tickets, comments, budget, limit, terms, purpose == "proofread")
    said = said.groupBy(*key).agg(
        F.sum("chars").alias("used"), F.sum(F.when(F.col("place") == 0, F.col("chars"))).alias("description_chars"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "id", "chars", "truncated")))).alias("comments"),
    )
    near = related(tickets, relations, said.select(*key, "used"), budget, related_limit)
    near = near.groupBy(*key).agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("near"), F.array_sort(F.collect_list(F.struct("n", "to_repo", "to_number", "missing", "chars"))).alias("related"))
    rows = said.join(near, key, "left").withColumn("used", F.col("used") + F.coalesce("near", F.lit(0))).join(definitions(tickets, catalog, purpose == "classification"), key).join(fields.select(*key, "fields"), key, "left")
    given = F.lit(None).cast("string")
    if rules is not None:
        rows = rows.join(rules.select("repo", "rules", "n"), "repo", "left")
        given = F.when((F.col("n") > 0) & (F.col("n") <= MOST_ITEMS) & (F.length("rules") <= F.lit(budget) - F.col("used")), F.col("rules"))
    rows = rows.withColumn("label_rules", given).withColumn("left", F.lit(budget) - F.col("used") - F.coalesce(F.length("label_rules"), F.lit(0)))
    rows = rows.withColumn("taken", fitted(F.col("definitions"), F.col("left"), F.least("left", F.lit(budget // 3).cast("long"))))
    fits = F.length(F.coalesce("fields", F.lit("[]"))) <= F.col("taken.left")
    rows = rows.withColumn("shown", F.when(fits, F.coalesce("fields", F.lit("[]"))))
    warn = lambda when, code: F.when(when, F.lit(code))
    codes = [warn(F.col("total") > F.size("taken.kept"), "context_label_definition_omitted"), warn(~fits, "context_fields_omitted")]
    if rules is not None:
        codes = [warn((F.col("n") > 0) & F.col("label_rules").isNull(), "context_label_rules_omitted"), *codes]
    none = F.array().cast("array<struct<n:int,to_repo:string,to_number:bigint,missing:boolean,chars:bigint>>")
    return rows.select(
        *key, "description_chars", "comments", F.coalesce("related", none).alias("related"), "label_rules", F.col("taken.kept").alias("label_definitions"), F.col("shown").alias("fields"),
        F.array_compact(F.array(*codes)).alias("warnings"), (F.lit(budget) - F.col("taken.left") + F.coalesce(F.length("shown"), F.lit(0))).cast("long").alias("text_characters"),
    )
