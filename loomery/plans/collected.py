"""Registered queries of reconciliation, orphans and transfers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile
from ..sources.model import Mirror
from .catalogue import COMMENTS, TICKETS, query

#: A listing that skips every tenth ticket, in pages of 50 numbers; that of one repository lacks its last page.
_ASKED = """, pages as (select distinct repo, 1 + number // 50 as page from tickets), ends as (select repo, max(page) as high, count(*) as n from pages group by 1)
, whole as (select repo from ends where n = high and repo <> 'demo/src1'), asked as (select repo, number from tickets where repo in (select repo from whole) and number % 10 = 0)
, said as (select repo, number, case when number % 30 = 0 then 'keep' when number % 20 = 0 then 'remove' else 'wait' end as decision from asked)"""


def _listing(m: Mirror):
    page = F.floor(F.col("number") / 50) + 1
    pages = m.tickets.select("repo", page.alias("page")).distinct()
    high = pages.groupBy("repo").agg(F.max("page").alias("high"))
    pages = pages.join(high, "repo").select("repo", "page", (F.col("page") == F.col("high")).alias("last")).where("not (repo = 'demo/src1' and last)")
    n = F.col("number")
    answers = m.tickets.where("number % 30 = 0 or number % 20 = 0").select("repo", "number", F.when(n % 30 == 0, 200).otherwise(404).alias("status"))
    return m.tickets.where("number % 10 <> 0").select("repo", "number"), pages, answers


@query("with " + TICKETS + _ASKED + " select * from said")
def reconcile_decisions(spark, d):
    """Candidates of whole listings, and what their answers say."""
    m = Mirror(spark, d)
    seen, pages, answers = _listing(m)
    return reconcile.decided(reconcile.candidates(m.tickets, seen, pages), answers)


@query("with " + TICKETS + COMMENTS + _ASKED + " select 'comment' as what, id, repo, number from comments where (repo, number) not in (select (repo, number) from said where decision = 'remove') union all select 'ticket', cast(number as varchar), repo, number from tickets where (repo, number) not in (select (repo, number) from said where decision = 'remove')")
def reconcile_applied(spark, d):
    """Tickets and comments after confirmed removals."""
    m = Mirror(spark, d)
    left = reconcile.reconciled({"tickets": m.tickets, "comments": m.comments}, *_listing(m))
    said = left["comments"].select(F.lit("comment").alias("what"), "id", "repo", "number")
    return said.unionByName(left["tickets"].select(F.lit("ticket").alias("what"), F.col("number").cast("string").alias("id"), "repo", "number"))


@query("with " + TICKETS + COMMENTS + " select id, number % 3 <> 0 or number % 6 = 0 as adopted from comments")
def orphans_adopted(spark, d):
    """Comments that come before every third ticket; half of these parents can be fetched."""
    m = Mirror(spark, d)
    got = reconcile.adopted(m.comments, m.tickets.where("number % 3 <> 0"), m.tickets.where("number % 6 = 0"))
    return got["comments"].select("id", F.lit(True).alias("adopted")).unionByName(got["waiting"].select("id", F.lit(False).alias("adopted")))


@query("with recursive " + TICKETS + """, step as (select repo, number, 'demo/new' as to_repo, number + 1 as to_number from tickets where number % 5 = 1
  union all select 'demo/new', number + 1, 'demo/new', number + 2 from tickets where number % 5 = 1 union all select 'demo/new', number + 2, 'demo/old', number from tickets where number % 10 = 1)
, walk as (select repo, number, to_repo, to_number from step union all select w.repo, w.number, s.to_repo, s.to_number from walk w join step s on s.repo = w.to_repo and s.number = w.to_number)
select w.repo, w.number, w.to_repo, w.to_number from walk w where (w.to_repo, w.to_number) not in (select (repo, number) from step)""")
def transfers_followed(spark, d):
    """Chains of two and three moves."""
    t = Mirror(spark, d).tickets.where("number % 5 = 1")
    move = lambda df, *e: df.selectExpr(*(f"{x} as {n}" for x, n in zip(e, ("repo", "number", "to_repo", "to_number"), strict=True)))
    moves = move(t, "repo", "number", "'demo/new'", "number + 1").unionByName(move(t, "'demo/new'", "number + 1", "'demo/new'", "number + 2"))
    return reconcile.followed(moves.unionByName(move(t.where("number % 10 = 1"), "'demo/new'", "number + 2", "'demo/old'", "number")))
