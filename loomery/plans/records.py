"""Registered queries of reads, raw records, catalogues, coverage and candidates, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, context, ingest, lexical, paging, policy, reads, records, represent, retrieval, semantic, status, writes
from ..sources.model import Mirror
from .catalogue import _BEST, _VEC, BASE, COMMENTS, TICKETS, UNITS, _hits, _passages, _search, corpus_of, index_of, query, repo_of

_T, _TC = "with " + TICKETS, "with " + TICKETS + COMMENTS


# ---- reads


@query(_T + " select repo, number, title, state, kind, updated_s from tickets where number = 3")
def read_ticket(spark, d):
    m = Mirror(spark, d)
    return reads.one(m.tickets, repo_of(m, 3), 3).select("repo", "number", "title", "state", "kind", "updated_s")


@query(_TC + " select id, author, created_s, body from comments where number = 1")
def get_comments(spark, d):
    m = Mirror(spark, d)
    return reads.got(m.tickets, m.comments, repo_of(m, 1), 1)[1].select("id", "author", "created_s", "body")


_SEEN = """, seen as (select c.*, t.kind, not (t.kind = 'pull_request' and (c.author = 'assistant' or coalesce(r.author, '') = 'assistant')) as visible
  from comments c join tickets t using (repo, number) left join (with recursive up as (select id, id as root, in_reply_to from comments union all select up.id, c.id, c.in_reply_to from up join comments c on up.in_reply_to = c.id)
    select up.id as cid, x.author from up join comments x on x.id = up.root where up.in_reply_to is null or up.in_reply_to not in (select id from comments)) r on r.cid = c.id)"""


def _decided(m: Mirror):
    return policy.decided(m.comments, m.tickets.where("kind = 'pull_request'"), policy.Policy(exclude_authors=["assistant"]))


@query(_TC + _SEEN + " select repo, number, count(*) filter (where visible) as shown, count(*) filter (where not visible) as excluded from seen group by 1, 2")
def comments_excluded(spark, d):
    return _decided(Mirror(spark, d)).groupBy("repo", "number").agg(F.count_if("visible").alias("shown"), F.count_if(~F.col("visible")).alias("excluded"))


@query(_TC + _SEEN + " select id, repo, number, created_s from seen where visible and id like 'review:%' order by created_s desc, id desc limit 20")
def comments_visible_page(spark, d):
    return reads.comment_rows(_decided(Mirror(spark, d)), "review", "desc").limit(20).select("id", "repo", "number", "created_s")


_ASKED = [(1, 0), (999999, 1), (2, 2), (1, 3), (888888, 4)]


@query(_T + ", ids as (select * from (values (999999, 1), (888888, 4)) v(number, place)) select number from ids where number not in (select number from tickets)")
def batch_missing(spark, d):
    m = Mirror(spark, d)
    asked = [(repo_of(m, n) or "demo/none", n) for n, _ in _ASKED]
    return reads.batch(m.tickets, asked)[1].select(F.col("number").cast("int").alias("number"))


@query(_T + ", e as (select distinct repo, unnest(labels) as id from tickets) select id, repo as scope from e where repo = (select repo from tickets where number = 1)")
def catalog_labels(spark, d):
    m = Mirror(spark, d)
    return reads.catalog(m.catalog, "labels", repo_of(m, 1)).select("id", "scope")


@query(_T + ", e as (select distinct milestone_title as id from tickets where repo = (select repo from tickets where number = 2) and milestone_title > 'v1'), k as (select id, row_number() over (order by id) as place, count(*) over () as n from e) select id, cast(place as int) as place, n > 2 as has_more from k where place <= 2")
def catalog_page(spark, d):
    m = Mirror(spark, d)
    return reads.catalog_page(m.catalog, "milestones", repo_of(m, 2), 2, "v1").select("id", "place", "has_more")


@query(_T + " select distinct cast(project as bigint) as number from tickets where project = 4")
def project_read(spark, d):
    return reads.project(Mirror(spark, d).catalog, "demo", 4).select(F.get_json_object("payload", "$.number").cast("long").alias("number"))


@query(_T + " select repo, number, place, has_more from (select repo, number, cast(row_number() over (order by updated_s desc, repo, number) as int) as place, count(*) over () > 40 as has_more from tickets where kind = 'issue') where place <= 40")
def list_has_more(spark, d):
    return reads.numbered(Mirror(spark, d).tickets.where("kind = 'issue'"), 40, *paging.order_by("updated")).select("repo", "number", "place", "has_more")


@query(_T + ", e as (select author as value, count(*) as n from tickets group by 1), k as (select *, row_number() over (order by n desc, value) as i, count(*) over () > 10 as truncated from e) select value, n, truncated from k where i <= 10")
def facet_truncated(spark, d):
    return paging.facet_page(Mirror(spark, d).tickets, F.array("author"), top=10)


# ---- raw records


@query(_T + """ select repo, number, title, state, type, author, array_to_string(labels, '|') as labels, array_to_string(list_sort(assignees), '|') as assignees, milestone_title as milestone, kind, 'demo/' || project as projects,
  strftime(to_timestamp(created_s) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as created_at, case when kind = 'pull_request' and state = 'closed' then strftime(to_timestamp(created_s) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') end as merged_at from tickets""")
def ticket_summaries(spark, d):
    rows = records.summaries(Mirror(spark, d).raw).withColumn("assignees", F.array_sort("assignees"))
    joined = (F.array_join(c, "|").alias(c) for c in ("labels", "assignees", "projects"))
    return rows.select("repo", "number", "title", "state", "type", "author", *joined, "milestone", "kind", "created_at", "merged_at")


@query(_T + """ select repo, number, repo as to_repo, number - 1 as to_number, 'parent' as kind from tickets where number % 5 = 0 and number > 1
  union all select repo, number, repo, number + i, 'child' from tickets, (values (1), (2)) v(i) where number % 7 = 0 union all select repo, number, repo, number + 3, 'blocks' from tickets where number % 4 = 0""")
def native_relations(spark, d):
    return records.native_relations(Mirror(spark, d).raw).drop("place")


@query(_T + " select repo, number, size_k = 2 as by_value, number % 3 = 1 as by_option from tickets")
def field_values_named(spark, d):
    m = Mirror(spark, d).raw
    has = lambda c, n, v: records.has_value(records.normalized_values(F.col(c)), n, v)
    return m.select("repo", "number", has("fields", "size", "2").alias("by_value"), has("teams", "team", "team1").alias("by_option"))


@query(_TC + " select 'comment:' || id as id, author, created_s from comments")
def evidence_comments(spark, d):
    m = Mirror(spark, d)
    units = m.documents.where(F.col("family").isin("comment", "review")).select("id")
    return records.enriched(units, m.comments).select("id", "author", "created_s")


_RULES = [represent.LabelRule("grade", prefix="quality:"), represent.LabelRule("warning", label="toxic:1", value="toxic"), represent.LabelRule("tongue", prefix="lang:"), represent.LabelRule("english", prefix="lang:e")]


@query(_T + """, e as (select repo, number, unnest(labels) as label from tickets)
  select repo, number, label, case when label = 'toxic:1' then 'warning' when label like 'quality:%' then 'grade' when label like 'lang:e%' then 'english' when label like 'lang:%' then 'tongue' else 'toxic' end as role,
    case when label = 'toxic:1' then 'toxic' when label like 'lang:e%' then substr(label, 7) else substr(label, instr(label, ':') + 1) end as value from e""")
def label_rules(spark, d):
    t = Mirror(spark, d).tickets.select("repo", "number", F.explode_outer(represent.attributes(F.col("labels"), _RULES)).alias("a"))
    return t.where("a is not null").select("repo", "number", "a.label", "a.role", "a.value")


# ---- search, semantic coverage, candidates


def _scope(name: str, family: str, col: str) -> None:
    def f(spark, d):
        return _search(spark, d, "the", scopes=[name]).select("repo", "number", "id", "score")

    f.__name__ = f"lex_scope_{name}"
    query("with " + BASE + _hits(["the"], f"col = '{col}'") + "select repo, number, id, score from (" + _BEST.format(f"(select * from scored where family = '{family}')") + ")")(f)


for _name, (_family, _cols) in lexical.SCOPES.items():
    if _name != "title":
        _scope(_name, _family, _cols[0])


@query("with " + BASE + """ select id, case when family = 'labels' then 'labels' when family = 'review' then 'review_comment' when family = 'comment' then 'comment'
  when list_contains(regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}]+'), 'the') then 'title' else 'body' end as field from units where id in (select id from toks where term = 'the')""")
def hit_fields(spark, d):
    m = Mirror(spark, d)
    hits = index_of(spark, d).of_terms(["the"]).select("id").distinct()
    return m.documents.join(hits, "id", "left_semi").select("id", lexical.field_of(["the"]).alias("field"))


@query(_T + " select repo, number, array_to_string(list_filter(labels, lambda x: x = 'lang:en'), '|') as labels from tickets where list_contains(labels, 'lang:en')")
def entity_matches(spark, d):
    found = candidates.entities(Mirror(spark, d).tickets, "crash in EN thing", roles=("lang",))
    return found.select("repo", "number", F.array_join("labels", "|").alias("labels"))


_STATES = "number % 4 <> 0 and number % 5 <> 0 and number % 7 <> 0"


def _states(m: Mirror):
    n = F.col("number")
    hash_ = F.when(n % 7 == 0, "old").otherwise(retrieval.content_hash())
    return m.documents.where(n % 4 != 0).select("id", F.lit("m").alias("model"), hash_.alias("content_hash"), F.lit(1).alias("chunks"), (n % 5 != 0).alias("complete"))


@query("with " + TICKETS + COMMENTS + UNITS + f" select id, repo, number from units where not ({_STATES})")
def sem_pending(spark, d):
    m = Mirror(spark, d)
    return retrieval.pending(m.documents, _states(m), "m").select("id", "repo", "number")


@query("with " + TICKETS + COMMENTS + UNITS + f" select count(*) as documents, count(*) filter (where {_STATES}) as indexed, count(*) filter (where not ({_STATES})) as pending, count(*) filter (where {_STATES}) as chunks from units")
def index_progress(spark, d):
    from ..operators import indexing

    m = Mirror(spark, d)
    return indexing.progress(m.documents, _states(m), "m")


@query(_VEC.format(TICKETS) + ", k as (select * from sem order by score desc, repo, number limit 1 offset 9) select s.repo, s.number, s.score from sem s, k where s.score < k.score or (s.score = k.score and (s.repo > k.repo or (s.repo = k.repo and s.number > k.number))) order by s.score desc, s.repo, s.number limit 30")
def sem_next_page(spark, d):
    scores = semantic.ticket_scores(_passages(spark, d)).select("repo", "number", "score")
    last = semantic.top(scores, n=10).collect()  # a page
    rows = retrieval.continued(scores, last[-1]["score"], last[-1]["repo"], last[-1]["number"]) if last else scores
    return semantic.top(rows, n=30)


@query(_VEC.format(TICKETS) + """, x as (select field, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as x from (select embedding, ['title','body','labels','comment','review_comment'][vec_id % 5 + 1] as field from embeddings, nt where vec_id % nt.n + 1 = 3))
, f as (select field, pos, avg(x) as x from x group by 1, 2), v as (select pos, sum(x * case field when 'title' then 4.0 when 'body' then 1.0 when 'labels' then 1.5 else 0.5 end) as x from f group by 1)
select cast(pos as int) as pos, round(x / (select sqrt(sum(x * x)) from v), 6) as x from v""")
def seed_vector(spark, d):
    m = Mirror(spark, d)
    one = retrieval.seed_vector(m.passages, repo_of(m, 3), 3)
    return one.select(F.posexplode("vector").alias("pos", "x")).select("pos", F.round("x", 6).alias("x"))


@query(None)
def rrf_seed(spark, d):
    """Candidates of a seed by lexical, semantic and mutual ranks."""
    corpus, m = corpus_of(spark, d), Mirror(spark, d)
    repo = repo_of(m, 3)
    rest = corpus.tickets.where(~((F.col("repo") == repo) & (F.col("number") == 3)))
    seed = retrieval.seed_vector(corpus.passages, repo, 3).first()
    words = [r["term"] for r in candidates.preliminary(candidates.seed_terms(corpus.documents, repo, 3, candidates.STOP), candidates.QUERY).collect()]
    vector = list(seed["vector"]) if seed else [0.0]
    main = corpus.passages.where(F.col("field").isin("title", "body")).join(rest.select("repo", "number"), ["repo", "number"], "left_semi")
    scores = semantic.ticket_scores(semantic.passage_scores(main, vector)).select("repo", "number", "score")
    vectors = semantic.pooled(corpus.passages, semantic.TICKET_WEIGHTS).join(rest.select("repo", "number"), ["repo", "number"], "left_semi")
    return retrieval.fused_seed(corpus, lexical.search(corpus.index, rest, " ".join(words) or "-"), scores, vectors, vector)


@query("with " + BASE + _hits(["thing", "are"]) + "select repo, number, score from (" + _BEST.format("scored") + ")")
def search_fallback(spark, d):
    """A search without an engine where no vector is indexed."""
    return retrieval.search(corpus_of(spark, d), "thing are").rows


# ---- writes and coverage


@query("select page_id from pages where starts_with(url, 'https://m.')")
def url_prefix(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").where(F.col("url").startswith("https://m.")).select("page_id")


@query(_TC + UNITS + """ select 'ticket twice' as rule, (select count(*) from (select 1 from tickets group by repo, number having count(*) > 1)) as broken
  union all select 'comment twice', (select count(*) from (select 1 from comments group by id having count(*) > 1)) union all select 'unit twice', (select count(*) from (select 1 from units group by id having count(*) > 1))
  union all select 'comment without ticket', 0 union all select 'unit without ticket', 0""")
def integrity(spark, d):
    m = Mirror(spark, d)
    return writes.integrity({"tickets": m.tickets, "comments": m.comments, "documents": m.documents})


@query(_T + ", e as (select distinct repo as scope, unnest(labels) as was from tickets) select scope, was, case when was = 'lang:en' then 'language:en' end as now from e where was in ('lang:en', 'toxic:1')")
def label_changes(spark, d):
    return writes.renamed_labels(*_catalogs(Mirror(spark, d))).select("scope", "was", "now")


def _catalogs(m: Mirror):
    name = F.get_json_object("payload", "$.name")
    new = m.catalog.where(name.isNull() | (name != "toxic:1"))
    return m.catalog, new.withColumn("payload", F.when(name == "lang:en", F.to_json(F.struct(F.lit("language:en").alias("name")))).otherwise(F.col("payload")))


@query(_T + " select repo, number, array_to_string(list_transform(list_filter(labels, lambda x: x <> 'toxic:1'), lambda x: case when x = 'lang:en' then 'language:en' else x end), '|') as labels from tickets")
def relabelled(spark, d):
    m = Mirror(spark, d)
    rows = writes.relabelled(m.tickets.select("repo", "number", "labels"), writes.renamed_labels(*_catalogs(m)))
    return rows.select("repo", "number", F.array_join("labels", "|").alias("labels"))


@query(_T + ", e as (select distinct repo, unnest(labels) as id from tickets) select 'labels' as kind, repo as scope, id from e where repo <> 'demo/src1' union all select 'labels', 'demo/src1', 'only'")
def catalog_replaced(spark, d):
    m = Mirror(spark, d)
    new = spark.range(1).select(F.lit("only").alias("id"), F.lit("{}").alias("payload"))
    return writes.replace_catalog(m.catalog.where("kind = 'labels'"), "labels", "demo/src1", new).select("kind", "scope", "id")


@query(_TC + UNITS + " select id, family from units where number % 2 = 0 or family <> 'labels'")
def documents_rebuilt(spark, d):
    m = Mirror(spark, d)
    changed = m.tickets.where("number % 2 = 1").select("repo", "number")
    fresh = m.documents.withColumn("title", F.when((F.col("family") == "labels"), "").otherwise(F.col("title")))
    return writes.rebuilt_documents(m.documents, changed, fresh).select("id", "family")


@query(_TC + _SEEN + " select (select count(*) from tickets where kind = 'issue') as issues, (select count(*) from tickets where kind <> 'issue') as pulls, count(*) as comments, count(*) filter (where not visible) as excluded, (select count(*) from tickets) + (select count(*) from tickets where len(labels) > 0) + count(*) as documents from seen")
def status_excluded(spark, d):
    m = Mirror(spark, d)
    return status.counts(m.tickets, _decided(m), m.documents)


@query(_TC + " select c.id, coalesce(t.kind, 'unknown') as kind from (select id, number from comments) c left join tickets t on t.number = c.number")
def known_kinds(spark, d):
    m = Mirror(spark, d)
    asked = m.comments.select("repo", "number")
    found = ingest.kinds(m.tickets.select("repo", "number", F.lit("unknown").alias("kind")), m.tickets, asked.distinct())
    return m.comments.select("id", "repo", "number").join(found, ["repo", "number"]).select("id", "kind")


# ---- whole contexts


@query("with recursive " + TICKETS + COMMENTS + """, newest as (
    select *, row_number() over (partition by repo, number order by created_s desc, id desc) as r,
      contains(lower(body), 'thing') as m, row_number() over (partition by repo, number, contains(lower(body), 'thing') order by created_s desc, id desc) as rm
    from comments)
  , picked as (select *, row_number() over (partition by repo, number order by case when m and rm <= 2 then 0 else 1 end, created_s desc, id desc) as place from newest)
  , pieces as (
    select repo, number, 0 as place, least(length(coalesce(body, '')), 1000) as wanted from tickets
    union all select repo, number, place, least(length(coalesce(body, '')), 2048) from picked where place <= 4)
  , used as (select repo, number, least(sum(wanted), 1400) as used, max(least(wanted, 1400)) filter (place = 0) as description_chars from pieces group by 1, 2)
  , rel as (select repo, number, repo as to_repo, number - 1 as to_number, 0 as kind from tickets where number % 5 = 0 and number > 1
    union all select repo, number, repo, number + i, i from tickets, (values (1), (2)) v(i) where number % 7 = 0 union all select repo, number, repo, number + 3, 3 from tickets where number % 4 = 0)
  , near as (select rel.*, row_number() over (partition by repo, number order by kind) as n from rel qualify n <= 2)
  , wanted as (select near.*, case when t.number is not null then least(length(coalesce(t.body, '')), 512) end as wanted from near left join tickets t on t.repo = to_repo and t.number = to_number)
  , spent as (select w.*, case when wanted is not null then least(wanted, greatest(1400 - used - coalesce(sum(wanted) over (partition by repo, number order by n rows between unbounded preceding and 1 preceding), 0), 0)) end as chars from wanted w join used using (repo, number))
  , after as (select repo, number, used + coalesce(any_value(near_chars), 0) as used, any_value(description_chars) as description_chars, coalesce(any_value(k), 0) as k, coalesce(any_value(lost), 0) as lost
    from used left join (select repo, number, sum(chars) as near_chars, count(*) as k, count(*) filter (wanted is null) as lost from spent group by 1, 2) using (repo, number) group by repo, number, used)
  , own as (select repo, number, json_object('name', x, 'description', null)::varchar as def, row_number() over (partition by repo, number order by x) as i from (select repo, number, unnest(labels) as x from tickets))
  , fold as (select repo, number, 0 as i, 1400 - used as left_, least(1400 - used, 466) as share, 0 as kept from after
    union all select f.repo, f.number, f.i + 1, case when length(def) <= share then left_ - length(def) else left_ end, case when length(def) <= share then share - length(def) else share end, kept + (length(def) <= share)::int
      from fold f join own o on o.repo = f.repo and o.number = f.number and o.i = f.i + 1)
  , done as (select * from fold qualify row_number() over (partition by repo, number order by i desc) = 1)
  , sized as (select repo, number, length('[{"field":{"name":"size"},"number":"' || size_k || '"}]') as f from tickets)
  select repo, number, cast(description_chars as bigint) as description_chars, cast(k as bigint) as related, cast(lost as bigint) as missing, cast(kept as bigint) as definitions, f <= left_ as has_fields,
    cast(kept < i as int) + cast(f > left_ as int) as warnings, cast(1400 - left_ + case when f <= left_ then f else 0 end as bigint) as text_characters
  from done join after using (repo, number) join sized using (repo, number)""")
def context_whole(spark, d):
    """Description, comments, related tickets, label definitions and fields within 1,400 characters a ticket."""
    m = Mirror(spark, d)
    out = context.whole(m.tickets, m.comments, records.native_relations(m.raw), m.catalog, m.raw, 1400, 4, 2, ["thing"])
    long = lambda c: F.size(c).cast("long")
    return out.select(
        "repo", "number", "description_chars", long("related").alias("related"), long(F.filter("related", lambda x: x["missing"])).alias("missing"),
        long("label_definitions").alias("definitions"), F.col("fields").isNotNull().alias("has_fields"), F.size("warnings").alias("warnings"), "text_characters",
    )
