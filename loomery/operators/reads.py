"""Reading single records: tickets, their comments page by page, batches, catalogues and projects.

Every function returns DataFrames of at most a page, but for ``got`` and ``catalog``, which return all that there is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paging import decode, encode, limit_of, signature
from .records import viewed

BATCH, PREVIEW = 100, 1024
COMMENT_KINDS = ("all", "discussion", "review")


class NotFound(LookupError):
    pass


@dataclass
class Page:
    """Rows of one page and what goes with them."""

    rows: DataFrame
    has_more: bool
    next_cursor: str | None = None
    warnings: list[dict] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


def one(tickets: DataFrame, repo: str, number: int) -> DataFrame:
    return tickets.where((F.col("repo") == repo) & (F.col("number") == number))


def read_ticket(tickets: DataFrame, repo: str, number: int, view: str = "summary") -> DataFrame:
    return viewed(one(tickets, repo, number), view)


def got(tickets: DataFrame, comments: DataFrame, repo: str, number: int) -> tuple[DataFrame, DataFrame]:
    """The ticket and all its comments in order, hidden ones as well."""
    return one(tickets, repo, number), one(comments, repo, number).orderBy("created_s", "id")


def read(tickets: DataFrame, comments: DataFrame, repo: str, number: int, view: str = "full", with_comments: str | None = None, **paging) -> tuple[DataFrame, DataFrame | Page | None]:
    """The ticket, and all, none or a page of its comments; by default all in the full view, none in the summary."""
    with_comments = with_comments or ("all" if view == "full" else "none")
    if with_comments not in ("all", "none", "page") or (paging and with_comments != "page"):
        raise ValueError("comments are all, none or a page; only a page has options")
    ticket = read_ticket(tickets, repo, number, view)
    if with_comments == "none":
        return ticket, None
    return ticket, got(tickets, comments, repo, number)[1] if with_comments == "all" else comments_page(tickets, comments, repo, number, **paging)


def of_kind(comments: DataFrame, kind: str) -> DataFrame:
    if kind not in COMMENT_KINDS:
        raise ValueError(f"a comment kind is one of {', '.join(COMMENT_KINDS)}")
    review = F.col("id").startswith("review:")
    return comments if kind == "all" else comments.where(review if kind == "review" else ~review)


def comment_rows(comments: DataFrame, kind: str = "all", order: str = "asc", hidden: bool = False, after: tuple | None = None, view: str = "summary") -> DataFrame:
    """Comments in order of (created_s, id) behind ``after``; ``visible`` decides unless ``hidden`` ones are asked for.
    Bodies of the summary are cut to PREVIEW characters."""
    rows = of_kind(comments, kind)
    if not hidden and "visible" in rows.columns:
        rows = rows.where("visible")
    way, beyond = (F.asc, lambda a, b: a > b) if order == "asc" else (F.desc, lambda a, b: a < b)
    if after:
        at, i = F.lit(after[0]), F.lit(after[1])
        rows = rows.where(beyond(F.col("created_s"), at) | (F.col("created_s") == at) & beyond(F.col("id"), i))
    if view == "summary":
        rows = rows.withColumn("truncated", F.length("body") > PREVIEW).withColumn("body", F.substring("body", 1, PREVIEW))
    return rows.orderBy(way("created_s"), way("id"))


def numbered(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows with ``place`` and whether more follow: a row more is fetched, in the order given."""
    few = rows.orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a page
    return few.withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def comments_page(tickets: DataFrame, comments: DataFrame, repo: str, number: int, kind: str = "all", order: str = "asc", limit: int | None = None, cursor: str | None = None, generation: str = "", hidden: bool = False, view: str = "summary") -> Page:
    """One page of a ticket's comments; ``excluded`` in extra counts those that the policy hides."""
    if one(tickets, repo, number).isEmpty():
        raise NotFound(f"{repo}#{number}")
    n, sign = limit_of(limit), signature({"repo": repo, "number": number, "kind": kind, "order": order, "hidden": hidden, "view": view})
    at = decode(cursor, "comments", sign, generation) if cursor else None
    own = one(comments, repo, number)
    rows = comment_rows(own, kind, order, hidden, (at["key"], at["id"]) if at else None, view).limit(n + 1).collect()  # a page
    page, more = rows[:n], len(rows) > n
    excluded = of_kind(own, kind).where("not visible").count() if "visible" in own.columns else 0
    after = encode({"kind": "comments", "signature": sign, "generation": generation, "key": page[-1]["created_s"], "id": page[-1]["id"]}) if more else None
    warnings = [{"code": "comments_excluded", "repo": repo, "count": excluded}] if excluded and not hidden else []
    frame = own.sparkSession.createDataFrame(page, comment_rows(own, kind, order, hidden, None, view).schema)
    return Page(frame, more, after, warnings, {"excluded": excluded})


def batch(tickets: DataFrame, asked: list[tuple[str, int]], view: str = "summary") -> tuple[DataFrame, DataFrame]:
    """(found in the order asked, missing); each ticket once."""
    if not 1 <= len(asked) <= BATCH:
        raise ValueError(f"a batch has 1 to {BATCH} tickets")
    first = list(dict.fromkeys(asked))
    ids = tickets.sparkSession.createDataFrame([(r, n, i) for i, (r, n) in enumerate(first)], "repo string, number long, place int")
    found = viewed(tickets, view).join(F.broadcast(ids), ["repo", "number"])  # at most BATCH
    return found.orderBy("place"), ids.join(found.select("repo", "number"), ["repo", "number"], "left_anti").orderBy("place")


#: Kinds of catalogue, and those whose scope is an owner.
CATALOGS, OWNED = ("labels", "milestones", "issue_types", "issue_fields", "projects"), ("issue_types", "issue_fields", "projects")


def catalog(entries: DataFrame, kind: str, scope: str) -> DataFrame:
    if kind not in CATALOGS:
        raise ValueError(f"a catalogue is one of {', '.join(CATALOGS)}")
    return entries.where((F.col("kind") == kind) & (F.col("scope") == scope)).orderBy("id")


def catalog_page(entries: DataFrame, kind: str, scope: str, limit: int | None = None, after: str | None = None) -> DataFrame:
    rows = catalog(entries, kind, scope)
    return numbered(rows.where(F.col("id") > after) if after else rows, limit_of(limit), "id")


def catalog_warnings(options: dict[str, dict[str, bool]], kind: str, scope: str) -> list[dict]:
    """Repositories of the scope that don't collect the catalogue."""
    resource = {"issue_fields": "fields"}.get(kind, kind)
    mine = lambda repo: repo.startswith(scope + "/") if kind in OWNED else repo == scope
    return [{"code": "resource_disabled", "repo": r, "resource": resource} for r in sorted(options) if mine(r) and not options[r].get(resource)]


def project(entries: DataFrame, owner: str, number: int) -> DataFrame:
    return catalog(entries, "projects", owner).where(F.get_json_object("payload", "$.number") == str(number))
