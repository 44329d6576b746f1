"""The registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import candidates, context, evaluate, ingest, lexical, paging, policy, reads, records, represent, retrieval, semantic
from ..operators import snippets as snippet_windows
from ..operators.filters import Filters
from ..operators.segments import Segments
from ..sources.derived import folder_of, state_of
from ..sources.model import Mirror

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
STOP = candidates.STOP

TICKETS = """tickets as (
  select 'demo/' || source as repo, doc_id + 1 as number,
    case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else substr(text, 1, 60) end as title,
    case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else substr(text, 61) end as body,
    case when doc_id % 3 = 0 then 'open' else 'closed' end as state,
    case when doc_id % 4 = 0 then 'pull_request' else 'issue' end as kind,
    case doc_id % 5 when 0 then 'Bug' when 1 then 'Feature' when 2 then 'Task' end as type,
    'user' || (doc_id % 17) as author, list_distinct(['dev' || (doc_id % 7), 'dev' || (doc_id % 11)]) as assignees,
    case when doc_id % 6 > 0 then 'v' || (doc_id % 6) end as milestone_title,
    list_filter(['lang:' || lang, 'quality:' || q, 'toxic:' || t], lambda x: x is not null) as labels,
    cast(floor(n_chars / 1000) as bigint) as size_k, doc_id % 9 as project,
    doc_id * 3600 + 1704067200 as created_s, doc_id * 3600 + 1704067200 + (doc_id * 7919 % 500) * 3600 as updated_s
  from documents left join (select doc_id, max(quality) q, max(toxic) t from labels group by 1) using (doc_id) where text is not null)"""
COMMENTS = """, comments as (
  select case when turn % 3 = 2 then 'review:' else '' end || (conv_id * 1000 + turn) as id, repo, number, c.text as body, role as author,
    case when role = 'assistant' then 'Bot' else 'User' end as author_type, conv_id * 3600 + turn * 60 + 1704067200 as created_s,
    case when turn % 3 = 2 and turn > 2 then 'review:' || (conv_id * 1000 + turn - 3) end as in_reply_to
  from conversations c join tickets on number = conv_id + 1)"""
UNITS = """, units as (
  select 'issue:' || repo || ':' || number as id, repo, number, 'issue' as family, title, body from tickets
  union all select 'labels:' || repo || ':' || number, repo, number, 'labels', array_to_string(labels, chr(10)), '' from tickets where len(labels) > 0
  union all select 'comment:' || id, repo, number, case when id like 'review:%' then 'review' else 'comment' end, '', body from comments)
, cols as (select id, repo, number, family, 'title' as col, title as text from units union all select id, repo, number, family, 'body', body from units)
, words as (select id, repo, number, family, col, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') as w from cols)
, toks as (select id, repo, number, family, col, unnest(w) as term, generate_subscripts(w, 1) as pos from words)
, lens as (select id, sum(len(w)) as length from words group by 1)
, tot as (select count(*) as total, avg(length) as mean from lens)"""
BASE = TICKETS + COMMENTS + UNITS
_BM25 = """, per as (select id, repo, number, family, p, sum(case col when 'title' then 5.0 else 1.0 end) as f from hits group by all)
, dfs as (select p, count(distinct id) as df from hits group by 1)
, scored as (select id, repo, number, family, sum((case when ln((total - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((total - df + 0.5) / (df + 0.5)) end)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) as score from per join dfs using (p) join lens using (id), tot group by all)
"""
_BEST = "select repo, number, id, family, score from (select *, row_number() over (partition by repo, number order by score desc, family, id) as i from (select repo, number, id, family, round(score, 6) as score from {0})) where i = 1"


def _hits(words: list[str], col: str = "true", prefix: bool = False) -> str:
    """CTE of one row for each occurrence of each word; p numbers the words."""
    parts = [f"select id, repo, number, family, col, {p} as p from toks where {f'starts_with(term, {w!r})' if prefix else f'term = {w!r}'} and {col}" for p, w in enumerate(words)]
    return ", hits as (" + " union all ".join(parts) + ")" + _BM25


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def index_of(spark: SparkSession, folder: str) -> lexical.Index:
    """Kept beside the checkpoints and brought to the state of its tables by their changed units; queries open the postings of
    their terms only."""
    sources = [f"{folder}/{t}.parquet" for t in ("documents", "labels", "conversations")]
    return Segments.current(spark, folder_of(spark, "segments", sources), state_of(spark, sources), lambda: Mirror(spark, folder).documents)


def corpus_of(spark: SparkSession, folder: str) -> retrieval.Corpus:
    m = Mirror(spark, folder)
    return retrieval.Corpus(m.tickets, m.documents, index_of(spark, folder), m.passages)


def repo_of(m: Mirror, number: int) -> str:
    row = m.tickets.where(F.col("number") == number).select("repo").first()
    return row[0] if row else ""


def _search(spark, d, *a, **k):
    return lexical.search(index_of(spark, d), Mirror(spark, d).tickets, *a, **k)


# ---- lexical search


@query("with " + BASE + _hits(["thing", "are"]) + "select repo, number, id, score from (" + _BEST.format("scored") + ") order by score desc, repo, number limit 30")
def lex_any(spark, d):
    return paging.page(_search(spark, d, "thing are"), "relevance").select("repo", "number", "id", "score")


@query("with " + BASE + _hits(["the", "was"]) + ", k as (select repo, number from hits group by 1, 2 having count(distinct p) = 2) select repo, number, id, score from (" + _BEST.format("scored") + ") join k using (repo, number)")
def lex_all(spark, d):
    return _search(spark, d, "the was", match="all").select("repo", "number", "id", "score")


@query("with " + BASE + ", hits as (select a.id, a.repo, a.number, a.family, a.col, 0 as p from toks a join toks b on a.id = b.id and a.col = b.col and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the')" + _BM25 + "select repo, number, id, score from (" + _BEST.format("scored") + ")")
def lex_phrase(spark, d):
    return _search(spark, d, "of the", match="phrase").select("repo", "number", "id", "score")


@query("with " + BASE + _hits(["there"], prefix=True) + "select repo, number, id, score from (" + _BEST.format("scored") + ")")
def lex_prefix(spark, d):
    return _search(spark, d, "there", prefix=True).select("repo", "number", "id", "score")


@query("with " + BASE + _hits(["the"], "col = 'title'") + "select repo, number, id, score from (" + _BEST.format("(select * from scored where family = 'issue')") + ")")
def lex_scope_title(spark, d):
    return _search(spark, d, "the", scopes=["title"]).select("repo", "number", "id", "score")


@query("with " + BASE + _hits(["thing"]) + "select repo, number, id, score from (" + _BEST.format("scored") + ") where (repo, number) not in (select (repo, number) from toks where term = 'with')")
def lex_exclude(spark, d):
    return _search(spark, d, "thing", exclude=["with"]).select("repo", "number", "id", "score")


@query("with " + BASE + _hits(["thing", "are"]) + "select repo, number, id, round(score, 6) as score, cast(ordinal as int) as ordinal from (select *, row_number() over (partition by repo, number order by score desc, family, id) as ordinal from scored) where ordinal <= 3")
def lex_evidence_top3(spark, d):
    index = index_of(spark, d)
    units = lexical.scored(index, lexical.occurrences(index, [["thing"], ["are"]], False, None, None))
    return lexical.evidence(units).select("repo", "number", "id", F.round("score", 6).alias("score"), "ordinal")


@query("with " + BASE + " select term, count(distinct id) as df from toks group by 1")
def lex_df(spark, d):
    return index_of(spark, d).frequencies()


# ---- list, filters, pages, facets


def _listed(spark, d, **options):
    return Mirror(spark, d).tickets.where(Filters(now=NOW, **options).column())


def _list(name: str, where: str, **options) -> None:
    def f(spark, d):
        return _listed(spark, d, **options).select("repo", "number", "title", "state", "updated_s")

    f.__name__ = name
    query(f"with {TICKETS} select repo, number, title, state, updated_s from tickets where {where}")(f)


_list("list_filtered", "repo = 'demo/src3' and state = 'open' and kind = 'issue'", repo="demo/src3", state="open", kind="issue")
_list("list_repositories", "repo in ('demo/src1', 'demo/src2')", repositories=["demo/src1", "demo/src2"])
_list("list_type_author", "type = 'Bug' and author = 'user5'", type="Bug", author="user5")
_list("list_labels_all", "list_contains(labels, 'lang:en') and list_contains(labels, 'quality:1')", labels_all=["lang:en", "quality:1"])
_list("list_labels_any", "list_has_any(labels, ['lang:de', 'toxic:1'])", labels_any=["lang:de", "toxic:1"])
_list("list_exclude_labels", "not list_contains(labels, 'lang:en')", exclude_labels=["lang:en"])
_list("list_assignees", "list_has_any(assignees, ['dev3', 'dev10'])", assignees=["dev3", "dev10"])
_list("list_milestone", "milestone_title = 'v2'", milestone="2")
_list("list_date_day", "created_s >= 1704153600 and created_s < 1704326400", created_after="2024-01-02", created_before="2024-01-03")
_list("list_date_relative", "updated_s >= 1709251200 - 14 * 86400", updated_after="2w")
_list("list_field_values", "size_k = 2", field_values={"size": "2"})


@query("with " + TICKETS + " select repo, number, title, state, updated_s from tickets where number % 3 = 1")
def list_field_option(spark, d):
    """Tickets by the name of a field's option."""
    m = Mirror(spark, d)
    values = m.raw.select("repo", "number", records.normalized_values(F.col("teams")).alias("field_values"))
    rows = m.tickets.drop("field_values").join(values, ["repo", "number"])
    return rows.where(Filters(now=NOW, field_values={"team": "team1"}, field_options=True).column()).select("repo", "number", "title", "state", "updated_s")


_list("list_project", "project = 4", project=("demo", 4))
_list("list_exclude_seed", "not (repo = 'demo/src1' and number = 2)", exclude=("demo/src1", 2))


@query("with " + TICKETS + " select repo, number, updated_s from tickets where state = 'open' order by updated_s desc, repo, number limit 30")
def list_sort_updated(spark, d):
    return paging.page(_listed(spark, d, state="open"), "updated").select("repo", "number", "updated_s")


@query("with " + TICKETS + " select repo, number, updated_s from tickets where updated_s < 1705000000 order by updated_s desc, repo, number limit 20")
def list_page2(spark, d):
    return paging.page(_listed(spark, d), "updated", limit=20, cursor={"key": 1705000000, "repo": "~", "number": 0}).select("repo", "number", "updated_s")


@query("with " + TICKETS + ", e as (select repo, number, unnest(list_distinct(labels)) as value from tickets) select value, count(*) as n from e group by 1 order by n desc, value limit 100")
def facet_labels(spark, d):
    return paging.facet(Mirror(spark, d).tickets, F.col("labels"))


@query("with " + TICKETS + " select type as value, count(*) as n from tickets where type is not null group by 1")
def facet_types(spark, d):
    return paging.facet(Mirror(spark, d).tickets, F.array("type"), distinct=False)


@query("with " + TICKETS + " select 'demo/' || project as value, count(*) as n from tickets group by 1")
def facet_projects(spark, d):
    return paging.facet(Mirror(spark, d).tickets, F.transform("project_urls", represent.project_name))


@query("with " + TICKETS + " select state, kind, count(*) as n from tickets group by 1, 2")
def count_matches(spark, d):
    return Mirror(spark, d).tickets.groupBy("state", "kind").agg(F.count("*").alias("n"))


@query("select o_orderpriority as value, count(*) as n from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '1995-01-01' group by 1")
def facet_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")))
    return o.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))


# ---- reading


@query("with " + TICKETS + ", ids as (select * from (values (3, 0), (1, 1), (999999, 2), (2, 3)) v(number, place)) select repo, ids.number, cast(place as int) as place, repo is not null as found from ids left join tickets on ids.number = tickets.number")
def batch_read(spark, d):
    ids = spark.createDataFrame([(3, 0), (1, 1), (999999, 2), (2, 3)], "number long, place int")
    return F.broadcast(ids).join(Mirror(spark, d).tickets.select("repo", "number"), "number", "left").select("repo", "number", "place", F.col("repo").isNotNull().alias("found"))


@query("with " + TICKETS + COMMENTS + ", c as (select *, row_number() over (order by created_s, id) as place, count(*) over () as n from comments where id not like 'review:%') select id, repo, number, created_s, left(body, 1024) as preview, cast(place as int) as place, n > 30 as has_more from c where place <= 30")
def comments_page(spark, d):
    rows = reads.numbered(reads.comment_rows(Mirror(spark, d).comments, "discussion"), 30, "created_s", "id")
    return rows.select("id", "repo", "number", "created_s", F.col("body").alias("preview"), "place", "has_more")


@query("with " + TICKETS + COMMENTS + ", k as (select repo, number, count(*) as n, sum((id like 'review:%')::int)::bigint as reviews from comments group by 1, 2) select repo, number, coalesce(n, 0) as n, coalesce(reviews, 0) as reviews from tickets left join k using (repo, number)")
def comment_counts(spark, d):
    m = Mirror(spark, d)
    k = m.comments.groupBy("repo", "number").agg(F.count("*").alias("n"), F.count_if(F.col("id").startswith("review:")).alias("reviews"))
    return m.tickets.select("repo", "number").join(k, ["repo", "number"], "left").fillna(0, ["n", "reviews"])


# ---- semantic and hybrid


_VEC = """with {0}, nt as (select count(*) as n from tickets), q as (select embedding as q from embeddings where vec_id = 0)
, pas as (select repo, t.number, vec_id as chunk, ['title','body','labels','comment','review_comment'][vec_id % 5 + 1] as field,
    round(greatest(-1.0, least(1.0, list_dot_product(embedding::double[], (select q from q)::double[]))), 6) as score
  from embeddings, nt join tickets t on t.number = vec_id % nt.n + 1)
, byf as (select repo, number, field, max(score) as score from pas group by all)
, sem as (select repo, number, max(score) as score, round(0.8 * max(score) + 0.2 * (sum(w * score) / sum(w)), 6) as blended
  from (select *, case field when 'title' then 4.0 when 'body' then 1.0 when 'labels' then 1.5 else 0.5 end as w from byf) group by 1, 2)
"""


def _query_vector(spark, d) -> list[float]:
    row = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def _passages(spark, d):
    return semantic.passage_scores(Mirror(spark, d).passages, _query_vector(spark, d))


@query(_VEC.format(TICKETS) + "select repo, number, score, blended from sem order by score desc, repo, number limit 200")
def sem_top200(spark, d):
    return semantic.top(semantic.ticket_scores(_passages(spark, d)))


@query(_VEC.format(TICKETS) + "select repo, number, field, score from byf")
def sem_field_max(spark, d):
    return _passages(spark, d).groupBy("repo", "number", "field").agg(F.max("score").alias("score"))


@query(_VEC.format(TICKETS) + ", o as (select *, row_number() over (partition by repo, number, field order by score desc, chunk) as i from pas) select repo, number, field, chunk, score, cast(ordinal as int) as ordinal from (select *, row_number() over (partition by repo, number order by score desc, field, chunk) as ordinal from o where i = 1) where ordinal <= 3")
def sem_best_passage(spark, d):
    return semantic.best_passages(_passages(spark, d))


@query(_VEC.format(BASE) + _hits(["thing", "are"]) + """, lex as (select repo, number, row_number() over (order by score desc, repo, number) as lex from (""" + _BEST.format("scored") + """))
, se as (select repo, number, row_number() over (order by blended desc, repo, number) as sem from sem)
, every as (select repo, number from lex union select repo, number from se)
, h as (select repo, number, term, max(case when family = 'labels' then 1.5 when col = 'title' then 2.0 when family = 'issue' then 1.0 else 0.6 end) as w
    from toks join every using (repo, number) where term = 'thing' group by all)
, hn as (select count(*) as h from every)
, r as (select ln(1 + (any_value(hn.h) + 1) / (count(h.term) + 1)) as r from hn left join h on true)
, ev as (select repo, number, round(1 + 0.25 * w, 6) as score from h, r where r > 0)
, tk as (select repo, number, row_number() over (order by score desc, sem nulls last, repo, number) as ticket from ev left join se using (repo, number))
select repo, number, round(coalesce(1.0 / (60 + lex), 0) + coalesce(1.0 / (60 + sem), 0) + coalesce(3.0 / (60 + ticket), 0), 9) as score
from every left join lex using (repo, number) left join se using (repo, number) left join tk using (repo, number) where lex is not null or ticket is not null or sem <= 200""")
def rrf_query(spark, d):
    corpus = corpus_of(spark, d)
    return retrieval.hybrid(corpus, corpus.tickets, "thing are", semantic.ticket_scores(_passages(spark, d))).select("repo", "number", "score")


@query("with " + BASE + """, h as (select repo, number, term, max(case when family = 'labels' then 1.5 when col = 'title' then 2.0 when family = 'issue' then 1.0 else 0.6 end) as w from toks where term in ('thing', 'are', 'with') group by all)
, n as (select count(*) as h from (select distinct repo, number from h)), r as (select term, ln(1 + (n.h + 1) / (count(*) + 1)) as r from h, n group by term, n.h), den as (select sum(r) as den from r)
select repo, number, round(sum(r) / max(den) + 0.25 * sum(r * w) / max(den), 6) as score from h join r using (term), den group by 1, 2""")
def ticket_evidence(spark, d):
    words = ["thing", "are", "with"]
    return candidates.term_evidence(index_of(spark, d).of_terms(words), words).select("repo", "number", "score")


_NO_STOP = "length(term) >= 2 and term not in (" + ", ".join(map(repr, STOP)) + ")"
_SEED = "with " + BASE + f""", st as (select *, row_number() over (partition by id, col order by first) as k from (select id, family, col, term, min(pos) as first from toks where number = 2 and family <> 'labels' and {_NO_STOP} group by id, family, col, term))
, lt as (select unnest(list_distinct(regexp_extract_all(strip_accents(lower(label)), '[\\p{{L}}\\p{{N}}]+'))) as term from (select unnest(labels) as label from tickets where number = 2))
, seed as (select term, sum(w) as weight from (select term, case when family <> 'issue' then 0.5 when col = 'title' then 4.0 else 1.0 end as w from st where k <= 1024 union all select term, 1.5 from lt where {_NO_STOP}) group by 1)
, chosen as (select * from seed order by weight desc, term limit 256) """


@query(_SEED + "select term, weight from seed")
def seed_terms(spark, d):
    m = Mirror(spark, d)
    return candidates.seed_terms(m.documents, repo_of(m, 2), 2, STOP)


@query(_SEED + ", n as (select count(*) as total from tickets), dfs as (select term, count(distinct (repo, number)) as df from toks where number <> 2 group by 1) select term, df, score from (select term, df, round(weight * ln(1 + (total + 1) / (df + 1)), 6) as score from chosen join dfs using (term), n) order by score desc, term limit 24")
def seed_term_select(spark, d):
    m = Mirror(spark, d)
    repo = repo_of(m, 2)
    return candidates.select_terms(candidates.seed_terms(m.documents, repo, 2, STOP), index_of(spark, d), repo, 2, m.tickets)


# ---- labels, policy, ingestion


@query("with " + TICKETS + ", e as (select repo, number, unnest(labels) as label from tickets) select repo, number, label, split_part(label, ':', 1) as role, substr(label, instr(label, ':') + 1) as value from e")
def label_attributes(spark, d):
    t = Mirror(spark, d).tickets.select("repo", "number", F.explode_outer(represent.attributes(F.col("labels"))).alias("a"))
    return t.where("a is not null").select("repo", "number", "a.label", "a.role", "a.value")


@query("with recursive " + TICKETS + COMMENTS + """, up as (select id, id as root, in_reply_to from comments union all select up.id, c.id, c.in_reply_to from up join comments c on up.in_reply_to = c.id)
, top as (select id, root from up where in_reply_to is null or in_reply_to not in (select id from comments)) select id, root from top""")
def policy_threads(spark, d):
    return ingest.thread_roots(Mirror(spark, d).comments)


@query("with recursive " + TICKETS + COMMENTS + """, up as (select id, id as root, in_reply_to from comments union all select up.id, c.id, c.in_reply_to from up join comments c on up.in_reply_to = c.id)
, top as (select id, root from up where in_reply_to is null or in_reply_to not in (select id from comments))
select c.id, not (t.kind = 'pull_request' and (c.author = 'assistant' or r.author = 'assistant')) as visible from comments c join top using (id) join comments r on top.root = r.id join tickets t on t.repo = c.repo and t.number = c.number""")
def policy_visible(spark, d):
    m = Mirror(spark, d)
    return policy.decided(m.comments, m.tickets.where("kind = 'pull_request'"), policy.Policy(exclude_authors=["assistant"])).select("id", "visible")


def _feed(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id"), F.col("event_type"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("version"), F.concat_ws("|", "event_type", F.round("value", 4).cast("decimal(20,4)").cast("string"), F.col("event_id").cast("string")).alias("payload"), "event_id")


_FEED = "with feed as (select user_id, event_type, epoch_us(ts) as version, event_type || '|' || cast(cast(round(value, 4) as decimal(20,4)) as varchar) || '|' || event_id as payload, event_id from events)"


@query(_FEED + " select user_id, event_type, version, event_id from (select *, row_number() over (partition by user_id, event_type order by version desc, (event_id >= 1000) desc, payload desc) as i from feed) where i = 1")
def upsert_latest(spark, d):
    f = _feed(spark, d)
    return ingest.upsert(f.where("event_id < 1000"), f.where("event_id >= 1000"), ["user_id", "event_type"]).select("user_id", "event_type", "version", "event_id")


@query("select distinct user_id, event_type from events where ts < timestamp '2024-01-28' and (user_id, event_type) not in (select (user_id, event_type) from events where ts >= timestamp '2024-01-28')")
def reconcile_anti(spark, d):
    """Of all users and types seen before a listing began those that it no longer has."""
    e, began = spark.read.parquet(f"{d}/events.parquet"), F.expr("timestamp_ntz'2024-01-28 00:00:00'")
    return ingest.reconciled(e.where(F.col("ts") < began).select("user_id", "event_type").distinct(), e.where(F.col("ts") >= began), ["user_id", "event_type"])


@query(_FEED + """, o as (select user_id, event_type, max(payload) as payload from feed where event_id % 3 < 2 group by 1, 2), n as (select user_id, event_type, max(payload) as payload from feed where event_id % 3 > 0 group by 1, 2)
select coalesce(n.event_type, o.event_type) as event_type, sum((o.payload is null)::int)::bigint as added, sum((o.payload <> n.payload)::int)::bigint as updated, sum((n.payload is null)::int)::bigint as removed
from o full join n on o.user_id = n.user_id and o.event_type = n.event_type group by 1""")
def change_tallies(spark, d):
    f = _feed(spark, d)
    last = lambda x: x.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.max("payload").alias("payload"), F.first("event_type").alias("event_type"))
    return ingest.tallies(last(f.where("event_id % 3 < 2")), last(f.where("event_id % 3 > 0")), ["user_id", "kind"], "event_type")


@query("with " + TICKETS + COMMENTS + " select id from comments where number not in (select number from tickets where state = 'open')")
def orphans(spark, d):
    m = Mirror(spark, d)
    return m.comments.join(m.tickets.where("state = 'open'").select("repo", "number"), ["repo", "number"], "left_anti").select("id")


@query("with " + TICKETS + ", p as (select distinct sha256('m' || chr(1) || title) as key, title from tickets), had as (select distinct sha256('m' || chr(1) || title) as key from tickets where number <= 100) select count(distinct key) as n from p where key not in (select key from had)")
def vector_dict_reuse(spark, d):
    t = Mirror(spark, d).tickets.select("number", F.col("title").alias("text"))
    zero = F.lit("\x00")
    had = t.where("number <= 100").select(F.sha2(F.concat(F.lit("m"), zero, F.lit("2"), zero, "text"), 256).alias("key")).distinct()
    return ingest.to_encode(t, had, "m").agg(F.count("*").alias("n"))


@query("with " + BASE + " select (select count(*) from tickets where kind = 'issue') as issues, (select count(*) from tickets where kind <> 'issue') as pulls, (select count(*) from comments) as comments, (select count(*) from units) as documents, (select count(*) from embeddings) as vectors")
def status_counts(spark, d):
    m = Mirror(spark, d)
    one = lambda df, n: df.agg(F.count("*").alias(n))
    t = m.tickets.agg(F.count_if(F.col("kind") == "issue").alias("issues"), F.count_if(F.col("kind") != "issue").alias("pulls"))
    return t.crossJoin(one(m.comments, "comments")).crossJoin(one(m.documents, "documents")).crossJoin(one(m.table("embeddings"), "vectors"))  # single rows


# ---- derived text (rows only: Python's text rules)


@query(None)
def references(spark, d):
    return represent.page_references(Mirror(spark, d).documents.withColumn("url", F.lit("https://host.example/")))


@query(None)
def sections(spark, d):
    t = Mirror(spark, d).tickets
    return t.select("repo", "number", F.explode_outer(represent.sections("body")).alias("s")).where("s is not null").select("repo", "number", "s.*")


@query(None)
def chunks(spark, d):
    t = Mirror(spark, d).documents
    return t.select("id", F.explode_outer(represent.chunks("body")).alias("c")).where("c is not null").select("id", "c.start", "c.end", F.length("c.text").alias("runes"))


@query(None)
def snippets(spark, d):
    top = paging.page(_search(spark, d, "thing are"), "relevance").select("id", "score")
    return Mirror(spark, d).documents.join(F.broadcast(top), "id").select("id", "score", snippet_windows.snippets(F.col("body"), [["thing"], ["are"]]).alias("snippet"))  # a page


@query(None)
def attribution(spark, d):
    return Mirror(spark, d).comments.select("id", represent.detected_ai(F.col("body")).alias("declared"))


@query("with " + BASE + " select term, count(*) as n from toks group by 1 order by n desc, term limit 50")
def vocabulary_top(spark, d):
    rows = Mirror(spark, d).documents.select(F.explode_outer(F.concat(tokens(F.col("title")), tokens(F.col("body")))).alias("term")).where("term is not null")
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


# ---- budgeted evidence, evaluation


@query("with " + TICKETS + COMMENTS + """, newest as (
    select *, row_number() over (partition by repo, number order by created_s desc, id desc) as r,
      contains(lower(body), 'thing') as m, row_number() over (partition by repo, number, contains(lower(body), 'thing') order by created_s desc, id desc) as rm
    from comments)
  , picked as (
    select *, row_number() over (partition by repo, number order by case when m and rm <= 3 then 0 else 1 end, created_s desc, id desc) as place
    from newest)
  , pieces as (
    select repo, number, 0 as place, null as id, coalesce(body, '') as text, least(length(coalesce(body, '')), 1333) as wanted from tickets
    union all select repo, number, place, id, coalesce(body, ''), least(length(coalesce(body, '')), 2048) from picked where place <= 6)
  , budget as (
    select *, greatest(2000 - coalesce(sum(wanted) over (partition by repo, number order by place rows between unbounded preceding and 1 preceding), 0), 0) as remains
    from pieces)
  select repo, number, place, id, left(text, cast(least(wanted, remains) as bigint)) as text, cast(least(wanted, remains) as bigint) as chars,
    least(wanted, remains) < length(text) as truncated
  from budget where place = 0 or remains > 0""")
def context_budgeted(spark, d):
    m = Mirror(spark, d)
    return context.budgeted(m.tickets, m.comments, budget=2000, limit=6, terms=["thing"])


@query("with " + TICKETS + """, ranked as (select *, row_number() over (partition by repo order by updated_s desc, number) as place from tickets)
  select repo as "case", least(count(*), 30) as returned, count(*) filter (kind = 'pull_request' and place <= 10) / 10 as precision_10,
    count(*) filter (kind = 'pull_request' and place <= 20) / count(*) filter (kind = 'pull_request') as recall_20,
    coalesce(1 / min(place) filter (kind = 'pull_request' and place <= 20), 0) as reciprocal_20
  from ranked group by repo having count(*) filter (kind = 'pull_request') > 0""")
def eval_ranking(spark, d):
    """How well recency finds pull requests: each repository is a case."""
    t = Mirror(spark, d).tickets.select(F.col("repo").alias("case"), "repo", "number", "kind", "updated_s")
    place = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("updated_s"), "number"))
    return evaluate.scores(t.withColumn("place", place).where("place <= 30"), t.where("kind = 'pull_request'"))


@query("""with calls as (select event_type as "case", value as elapsed_ms from events where value is not null)
  select quantile_disc(elapsed_ms, 0.5) as p50_ms, quantile_disc(elapsed_ms, 0.95) as p95_ms from calls""")
def eval_latency(spark, d):
    rows = Mirror(spark, d).table("events").where("value is not null").select(F.col("value").alias("elapsed_ms"))
    none = F.lit(0.0)
    return evaluate.summary(rows.select("elapsed_ms", none.alias("precision_10"), none.alias("recall_20"), none.alias("reciprocal_20"))).select("p50_ms", "p95_ms")
