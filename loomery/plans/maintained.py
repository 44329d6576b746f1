"""Registered queries of tables and indexes that are kept up by small changes, with the DuckDB SQL of what they must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lexical
from ..operators.merge import Buckets
from ..operators.segments import Segments
from ..sources.derived import shared_root
from ..sources.model import Mirror
from ..sources.store import Store
from .catalogue import _BEST, _FEED, BASE, _feed, _hits, query


def _own_store(spark, name: str) -> Store:
    """A new one beside the checkpoints."""
    return Store(spark, f"{shared_root(spark)}/loomery-derived/{name}-{uuid.uuid4().hex}")


def outdated(m: Mirror):
    """The units as they might have been: some aren't there yet, some say something else, some are no more."""
    d = m.documents
    old = F.when(F.col("number") % 11 == 0, F.concat("body", F.lit(" thing stale"))).otherwise(F.col("body"))
    was = d.where("number % 7 <> 0").withColumn("body", old)
    return was.unionByName(d.where("number % 13 = 0").withColumn("id", F.concat(F.lit("old:"), "id")))


@query("with " + BASE + _hits(["thing", "are"]) + "select repo, number, id, score from (" + _BEST.format("scored") + ")")
def lex_after_updates(spark, d):
    """A search on an index that was made of an older state and brought up to date in three segments, two of them merged."""
    m, kept = Mirror(spark, d), Segments(_own_store(spark, "updated"))
    kept.upsert(outdated(m))
    fresh = m.documents
    kept.sync(outdated(m).where("number % 11 <> 0").unionByName(fresh.where("number % 11 = 0 and number % 7 <> 0")))
    kept.sync(fresh)
    kept.compact(2)
    return lexical.search(kept.index(), m.tickets, "thing are").select("repo", "number", "id", "score")


@query(_FEED + " select user_id, event_type, version, event_id from (select *, row_number() over (partition by user_id, event_type order by version desc, event_id % 4 desc, payload desc) as i from feed) where i = 1")
def upsert_batches(spark, d):
    """The feed in four batches into a table of buckets, one of them sent twice."""
    f, to = _feed(spark, d), Buckets(_own_store(spark, "buckets"), "feed", ["user_id", "event_type"], buckets=16)
    for n in (0, 1, 1, 2, 3):
        to.merge(f.where(F.col("event_id") % 4 == n), n)
    return to.read().select("user_id", "event_type", "version", "event_id")


@query(_FEED + """, o as (select user_id, event_type, max(version) as v, max_by(payload, (version, payload)) as p from feed where event_id % 4 < 3 group by 1, 2)
, n as (select user_id, event_type, max(version) as v, max_by(payload, (version, payload)) as p from feed where event_id % 4 = 3 group by 1, 2)
select user_id, event_type, case when o.v is null then 'added' when n.v > o.v or n.v = o.v and n.p <> o.p then 'updated' else 'same' end as change from n left join o using (user_id, event_type)""")
def upsert_changes(spark, d):
    """What a batch would do to a table of buckets."""
    f, to = _feed(spark, d), Buckets(_own_store(spark, "buckets"), "feed", ["user_id", "event_type"], buckets=16)
    to.merge(f.where("event_id % 4 < 3"))
    return to.changes(f.where("event_id % 4 = 3"))
