"""Registered queries of whole searches: engines, scopes, exclusions, signals, pages and evidence, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, retrieval, semantic, topk
from ..operators.filters import Filters
from ..sources.derived import folder_of, state_of
from ..sources.model import Mirror
from ..sources.store import Store
from .catalogue import _BEST, _NO_STOP, _SEED, _VEC, BASE, TICKETS, _hits, _query_vector, corpus_of, index_of, query, repo_of

MODEL = "stored"


def _corpus(spark, d):
    """Every document is indexed; a query's vector is the table's first."""
    corpus, vector = corpus_of(spark, d), _query_vector(spark, d)
    corpus.encode = lambda _: vector
    corpus.states = corpus.documents.select("id", retrieval.content_hash().alias("content_hash"), F.lit(True).alias("complete"), F.lit(MODEL).alias("model"))
    return corpus


#: Tickets without a word in a title or body, and what of them is in scope.
_SCOPED = _VEC.format(BASE) + """, bad as (select distinct repo, number from toks where term = 'with' and family = 'issue')
, allowed as (select repo, number from tickets where (repo, number) not in (select (repo, number) from bad))
, byf2 as (select * from byf where field in ('title', 'body') and (repo, number) in (select (repo, number) from allowed))
, sem2 as (select repo, number, max(score) as score, round(0.8 * max(score) + 0.2 * (sum(w * score) / sum(w)), 6) as blended
  from (select *, case field when 'title' then 4.0 else 1.0 end as w from byf2) group by 1, 2)"""
_LEX_PART = """, per{0} as (select id, repo, number, family, p, sum(case col when 'title' then 5.0 else 1.0 end) as f from hits where col = '{0}' group by all)
, dfs{0} as (select p, count(distinct id) as df from hits where col = '{0}' group by 1)
, scored{0} as (select id, repo, number, family, sum((case when ln((total - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((total - df + 0.5) / (df + 0.5)) end)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) as score from per{0} join dfs{0} using (p) join lens using (id), tot where family = 'issue' group by all)"""


@query(_SCOPED + _hits(["thing", "are"]) + _LEX_PART.format("title") + _LEX_PART.format("body") + """, lex as (select repo, number, row_number() over (order by score desc, repo, number) as lex
  from (select repo, number, max(round(score, 6)) as score from (select * from scoredtitle union all select * from scoredbody) where (repo, number) in (select (repo, number) from allowed) group by 1, 2))
, se as (select repo, number, row_number() over (order by blended desc, repo, number) as sem from sem2)
, every as (select repo, number from lex union select repo, number from se)
, h as (select repo, number, term, max(case when col = 'title' then 2.0 else 1.0 end) as w from toks join every using (repo, number) where term = 'thing' and family = 'issue' group by all)
, hn as (select count(*) as h from every)
, r as (select ln(1 + (any_value(hn.h) + 1) / (count(h.term) + 1)) as r from hn left join h on true)
, ev as (select repo, number, round(1 + 0.25 * w, 6) as score from h, r where r > 0)
, tk as (select repo, number, row_number() over (order by score desc, sem nulls last, repo, number) as ticket from ev left join se using (repo, number))
select repo, number, round(coalesce(1.0 / (60 + lex), 0) + coalesce(1.0 / (60 + sem), 0) + coalesce(3.0 / (60 + ticket), 0), 9) as score
from every left join lex using (repo, number) left join se using (repo, number) left join tk using (repo, number) where lex is not null or ticket is not null or sem <= 200""")
def hybrid_scoped(spark, d):
    """Titles and bodies only, without tickets whose titles or bodies hold a word."""
    return retrieval.search(_corpus(spark, d), "thing are", "hybrid", scopes=["title", "body"], exclude=["with"], model=MODEL).rows.select("repo", "number", "score")


@query(_SCOPED + " select repo, number, score from sem2 order by score desc, repo, number limit 200")
def semantic_scoped(spark, d):
    return retrieval.search(_corpus(spark, d), "thing are", "semantic", scopes=["title", "body"], exclude=["with"], model=MODEL).rows


@query(_VEC.format(BASE) + _hits(["thing", "are"]) + ", best as (" + _BEST.format("scored") + """), shown as (select b.repo, b.number, b.score, row_number() over (order by b.score desc, b.repo, b.number) as place
  from best b join tickets using (repo, number) where state = 'open')
, labelled as (select repo, number, id, case when family = 'labels' then 'labels' when family = 'review' then 'review_comment' when family = 'comment' then 'comment'
    when list_has_any(regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}]+'), ['thing', 'are']) then 'title' else 'body' end as field from units)
, told as (select s.repo, s.number, s.id, row_number() over (partition by s.repo, s.number order by round(s.score, 6) desc, s.family, s.id) as ordinal from scored s)
select repo, number, cast(place - 10 as int) as place, cast(ordinal as int) as ordinal, field, id as source from shown join told using (repo, number) join labelled using (repo, number, id)
where place between 11 and 20 and ordinal <= 2""")
def search_second_page(spark, d):
    """The second page of ten open tickets with two pieces of evidence each, by the cursor of the first."""
    corpus, options = _corpus(spark, d), {"filters": Filters(state="open"), "limit": 10, "evidence_limit": 2, "generation": "g"}
    first = retrieval.search_page(corpus, "thing are", "lexical", **options)
    page = retrieval.search_page(corpus, "thing are", "lexical", cursor=first.next_cursor, **options) if first.has_more else first
    return page.matches.select("repo", "number", "place").join(page.evidence, ["repo", "number"]).select("repo", "number", "place", "ordinal", "field", "source")


#: Pooled unit vectors of tickets by field weights, as (repo, number, pos, x).
_POOLED = """, vx as (select t.repo, t.number, ['title','body','labels','comment','review_comment'][vec_id % 5 + 1] as field, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x
  from embeddings, nt join tickets t on t.number = vec_id % nt.n + 1)
, vf as (select repo, number, field, pos, avg(x) as x from vx group by all)
, vt as (select repo, number, pos, sum(x * case field when 'title' then 4.0 when 'body' then 1.0 else 1.5 end) as x, max((field in ('title', 'body'))::int) as main from vf where field in ('title', 'body', 'labels') group by all)
, vn as (select repo, number, sqrt(sum(x * x)) as norm from vt group by 1, 2 having max(main) = 1)
, pool as (select repo, number, list(x / norm order by pos) as v from vt join vn using (repo, number) where norm > 0 group by 1, 2)"""


@query(_VEC.format(TICKETS) + _POOLED + """, seed as (select * from pool order by number limit 1), rest as (select p.*, round(greatest(-1.0, least(1.0, list_dot_product(p.v, s.v))), 6) as own from pool p, seed s where p.number <> s.number)
, few as (select * from rest order by own desc, repo, number limit 100)
select f.repo, f.number, 1 + count(p.number) filter (round(greatest(-1.0, least(1.0, list_dot_product(p.v, f.v))), 6) > f.own) as rank from few f, pool p where (p.repo, p.number) <> (f.repo, f.number) group by 1, 2""")
def mutual_rank(spark, d):
    """How near a seed is to each of its nearest hundred, by its rank among their neighbours."""
    vectors = semantic.pooled(Mirror(spark, d).passages, semantic.TICKET_WEIGHTS)
    seed = vectors.orderBy("number").first()
    if seed is None:
        return vectors.select("repo", "number", F.lit(0).cast("long").alias("rank"))
    own = F.array(*(F.lit(x) for x in seed["vector"]))
    rest = vectors.where(F.col("number") != seed["number"]).select("repo", "number", F.round(semantic.dot(F.col("vector"), own), 6).alias("score"))
    return semantic.mutual_ranks(vectors, rest, list(seed["vector"]))


_CANDIDATES = """, n as (select count(*) as total from tickets where repo = (select repo from tickets where number = 2))
, dfs as (select term, count(distinct number) as df from toks where number <> 2 and repo = (select repo from tickets where number = 2) group by 1)
, picked as (select term, row_number() over (order by round(weight * ln(1 + (total + 1) / (df + 1)), 6) desc, term) as p from chosen join dfs using (term), n qualify p <= 24)
, hits as (select id, repo, number, family, col, p from toks join picked using (term))
, per as (select id, repo, number, family, p, sum(case col when 'title' then 5.0 else 1.0 end) as f from hits group by all)
, dfp as (select p, count(distinct id) as df from hits group by 1)
, scored as (select id, repo, number, family, sum((case when ln((tot.total - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((tot.total - df + 0.5) / (df + 0.5)) end)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) as score from per join dfp using (p) join lens using (id), tot group by all)
select repo, number, round(max(score), 6) as score from scored where number <> 2 and repo = (select repo from tickets where number = 2) group by 1, 2"""


@query(_SEED.replace("family <> 'labels'", "family = 'issue'") + _CANDIDATES)
def candidates_lexical(spark, d):
    """Candidates of a seed where vectors are missing: the lexical fallback."""
    corpus = corpus_of(spark, d)
    return retrieval.find_candidates(corpus, repo_of(Mirror(spark, d), 2), 2).rows


@query(_SEED.replace("family <> 'labels'", "(family = 'issue' or id = (select 'comment:' || id from comments where number = 2 and author <> 'assistant' order by created_s desc, id desc limit 1))").replace("union all select term, 1.5 from lt where " + _NO_STOP, "") + _CANDIDATES)
def candidates_with_comments(spark, d):
    """Candidates by the seed's own texts and its newest visible comment, without its labels."""
    corpus, m = corpus_of(spark, d), Mirror(spark, d)
    corpus.comments = m.comments.select("id", "repo", "number", "created_s", (F.col("author") != "assistant").alias("visible"))
    return retrieval.find_candidates(corpus, repo_of(m, 2), 2, "lexical", labels=False, comments=True, comment_limit=1).rows


# ---- top tickets without looking at all


@query("with " + BASE + _hits(["thing", "are"]) + "select repo, number, id, score from (" + _BEST.format("scored") + ") order by score desc, repo, number limit 30")
def lex_top_blocks(spark, d):
    """The first page of ``lex_any`` from the blocks that can hold one of its tickets."""
    sources = [f"{d}/{t}.parquet" for t in ("documents", "labels", "conversations")]
    index = index_of(spark, d)
    store = Store(spark, folder_of(spark, "blocks", sources)).at_state(state_of(spark, sources), lambda: topk.Blocks.tables(index, impacts=False))
    return topk.Blocks.of(store, index).top(Mirror(spark, d).tickets, "thing are")[0].select("repo", "number", "id", "score")


@query(_VEC.format(TICKETS) + "select repo, number, score from sem order by score desc, repo, number limit 200")
def sem_top_clusters(spark, d):
    """The tickets of ``sem_top200`` from the clusters that can hold one of them."""
    sources = [f"{d}/{t}.parquet" for t in ("documents", "embeddings")]
    store = Store(spark, folder_of(spark, "clusters", sources)).at_state(state_of(spark, sources), lambda: clusters.Clusters.tables(Mirror(spark, d).passages))
    vector = _query_vector(spark, d)
    return clusters.Clusters.of(store).top(vector)[0] if vector else Mirror(spark, d).tickets.select("repo", "number", F.lit(0.0).alias("score")).limit(0)
