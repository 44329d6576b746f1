"""Raw records: JSON payloads to typed members, native relations, field values, evidence of comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .represent import project_name

#: Members of a ticket's payload and of its enrichment that summaries take.
PAYLOAD = (
    "number bigint, node_id string, title string, body string, state string, state_reason string, html_url string, created_at string, updated_at string, closed_at string, "
    "draft boolean, type struct<name:string>, user struct<login:string>, labels array<struct<name:string>>, assignees array<struct<login:string>>, "
    "milestone struct<title:string,number:bigint>, pull_request struct<merged_at:string>"
)
_NODE = "struct<number:bigint,url:string,repository:struct<nameWithOwner:string>>"
EXTRA = f"parent {_NODE}, subIssues array<{_NODE}>, blockedBy array<{_NODE}>, blocking array<{_NODE}>, projectItems array<struct<isArchived:boolean,project:struct<url:string,number:bigint,title:string>>>"
#: Members of the enrichment and what they make of a node.
RELATIONS = {"parent": "parent", "subIssues": "child", "blockedBy": "blocked_by", "blocking": "blocks"}
#: Names under which field values of each kind come; the first that is there is the value.
VALUES = ("value", "text", "number", "date", "name")


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def summaries(tickets: DataFrame) -> DataFrame:
    """Typed members of tickets (repo, number, payload, extra). Payloads that aren't JSON fail the job."""
    text = F.when(valid_json(F.col("payload")), F.col("payload")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no JSON payload:"), "repo", "number")))
    rows = tickets.withColumn("p", F.from_json(text, PAYLOAD)).withColumn("e", F.from_json("extra", EXTRA))
    names = lambda c, member: F.coalesce(F.transform(c, lambda x: x[member]), F.array().cast("array<string>"))
    urls = F.transform(F.coalesce("e.projectItems", F.array().cast("array<struct<isArchived:boolean,project:struct<url:string,number:bigint,title:string>>>")), lambda x: project_name(x["project"]["url"]))
    return rows.select(
        "repo", "number", "p.title", "p.state", F.col("p.html_url").alias("url"), F.col("p.type.name").alias("type"), F.col("p.user.login").alias("author"),
        names(F.col("p.labels"), "name").alias("labels"), names(F.col("p.assignees"), "login").alias("assignees"), F.col("p.milestone.title").alias("milestone"),
        "p.state_reason", "p.closed_at", F.col("p.pull_request.merged_at").alias("merged_at"), F.coalesce("p.draft", F.lit(False)).alias("draft"),
        F.when(F.col("p.pull_request").isNotNull(), "pull_request").otherwise("issue").alias("kind"), F.array_distinct(F.array_compact(urls)).alias("projects"), "p.created_at", "p.updated_at",
    )


def viewed(tickets: DataFrame, view: str) -> DataFrame:
    """Raw members only in the full view, so the summary's scan doesn't read them."""
    if view not in ("summary", "full"):
        raise ValueError("view is summary or full")
    return tickets if view == "full" else tickets.drop("payload", "fields", "extra")


def native_relations(tickets: DataFrame) -> DataFrame:
    """(repo, number, place, to_repo, to_number, kind) of the enrichment: parent, children, blockers, blocked."""
    e = F.from_json("extra", EXTRA)
    tagged = lambda c, kind: F.transform(F.coalesce(c, F.array().cast(f"array<{_NODE}>")), lambda n: F.struct(n.alias("n"), F.lit(kind).alias("kind")))
    parts = [tagged(F.array_compact(F.array("e.parent")) if k == "parent" else F.col(f"e.{k}"), kind) for k, kind in RELATIONS.items()]
    rows = tickets.withColumn("e", e).select("repo", "number", F.posexplode_outer(F.concat(*parts)).alias("place", "r"))
    rows = rows.select("repo", "number", "place", F.col("r.n.repository.nameWithOwner").alias("to_repo"), F.col("r.n.number").alias("to_number"), "r.kind")
    return rows.where("to_number >= 1 and to_repo <> ''")


def normalized_values(fields: Column) -> Column:
    """(name, value, option, options) of field values that come under one of several names."""
    node = "struct<field:struct<name:string>,value:string,text:string,number:string,date:string,name:string,options:array<struct<name:string>>>"
    each = F.from_json(fields, f"array<{node}>")
    return F.transform(each, lambda f: F.struct(f["field"]["name"].alias("name"), F.coalesce(*(f[v] for v in VALUES)).alias("value"), f["name"].alias("option"), F.transform(f["options"], lambda o: o["name"]).alias("options")))


def has_value(values: Column, name: str, value: str) -> Column:
    """Whether a field has the value as such, as the name of its option or among its options."""
    return F.coalesce(F.exists(values, lambda f: (f["name"] == name) & ((f["value"] == value) | (f["option"] == value) | F.coalesce(F.array_contains(f["options"], value), F.lit(False)))), F.lit(False))


def enriched(evidence: DataFrame, comments: DataFrame, hunk: int = 1024) -> DataFrame:
    """Evidence units (id, ...) with what their comment adds: comment_id, author, created_s, and path, line and hunk where
    the comments have them."""
    more = [c for c in ("author", "created_s", "path", "line", "original_line", "diff_hunk") if c in comments.columns]
    side = comments.select(F.col("id").alias("comment_id"), *(F.col(c).alias(f"c_{c}") for c in more))
    rows = evidence.join(side, F.concat(F.lit("comment:"), F.col("comment_id")) == F.col("id"), "left")
    if {"line", "original_line"} <= set(more):
        rows = rows.withColumn("c_line", F.coalesce(F.nullif("c_line", F.lit(0)), "c_original_line")).drop("c_original_line")
    if "diff_hunk" in more:
        rows = rows.withColumn("c_diff_hunk", F.substring("c_diff_hunk", 1, hunk))
    return rows.withColumnsRenamed({c: c[2:] for c in rows.columns if c.startswith("c_") and c[2:] not in evidence.columns})
