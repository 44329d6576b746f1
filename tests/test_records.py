"""Records, sources, indexing and writes: properties and cases by hand."""

import json
from datetime import datetime, timedelta, timezone

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import candidates, indexing, ingest, lexical, policy, reads, records, represent, retrieval, status, writes
from loomery.plans import catalogue, records as _registered  # noqa: F401
from loomery.sources import api, config, sessions
from loomery.sources.store import Store

DATA = "/root/testdata/sf0.001"
TICKETS = [("a/b", 1, "Crash on start", "it fails", ["client:Acme"]), ("a/b", 2, "Slow", "network crash here", []), ("a/b", 3, "Other", "nothing", ["x"])]


@pytest.mark.parametrize("name", ["rrf_query", "ticket_summaries", "native_relations", "comments_excluded", "sem_pending", "seed_vector", "label_rules", "relabelled", "list_has_more"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events", "documents", "embeddings", "labels", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute("set timezone = 'UTC'")
    df = catalogue.Q[name](spark, DATA)
    cols = sorted(df.columns)
    got = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


def units(spark):
    rows = [(f"issue:{r}:{n}", r, n, "issue", t, b) for r, n, t, b, _ in TICKETS] + [(f"labels:{r}:{n}", r, n, "labels", "\n".join(x), "") for r, n, _, _, x in TICKETS if x]
    return spark.createDataFrame(rows, "id string, repo string, number long, family string, title string, body string")


def tickets(spark):
    return spark.createDataFrame([(r, n, t, b, x, "open", "issue", "Bug") for r, n, t, b, x in TICKETS], "repo string, number long, title string, body string, labels array<string>, state string, kind string, type string")


def test_phrases_and_prefixes(spark):
    rows = [("a", "r", 1, "issue", "the cat sat", "cat the"), ("b", "r", 2, "issue", "cat cat", "the the cat catalogue"), ("c", "r", 3, "issue", None, "")]
    index = lexical.Index.build(spark.createDataFrame(rows, "id string, repo string, number long, family string, title string, body string"))
    n = lambda *a: {(r["id"], r["col"]): r["n"] for r in lexical.occurrences(index, *a, None, None).collect()}
    assert n([["the", "cat"]], False) == {("a", "title"): 1, ("b", "body"): 1}
    assert n([["cat"]], True) == {("a", "title"): 1, ("a", "body"): 1, ("b", "title"): 2, ("b", "body"): 2}
    assert n([["the", "cat"]], True) == {("a", "title"): 1, ("b", "body"): 1}


def test_search_falls_back_and_entities_raise_a_ticket(spark):
    corpus = retrieval.Corpus(tickets(spark), units(spark), lexical.Index.build(units(spark)), rules=[represent.LabelRule("client", prefix="client:", aliases=("acme corp",))])
    found = retrieval.search(corpus, "crash", count=True)
    assert (found.engine, found.total, found.warnings[0]["code"]) == ("lexical", 2, "search_engine_fallback")
    with pytest.raises(retrieval.SemanticUnavailable):
        retrieval.search(corpus, "crash", engine="hybrid")
    assert retrieval.chosen_engine(None, "phrase")[1][0]["code"] == "search_engine_selected"
    told = {r["labels"][0] for r in candidates.entities(corpus.tickets, "crash at Acme Corp today", corpus.rules).collect()}
    assert told == {"client:Acme"}
    got = candidates.term_evidence(corpus.index.of_terms(["crash"]), ["crash"], corpus.tickets.select("repo", "number"), candidates.entities(corpus.tickets, "crash acme", corpus.rules))
    by = {r["number"]: r for r in got.collect()}
    assert by[1]["score"] == pytest.approx(1.5 + 1.5) and by[2]["score"] == pytest.approx(1.25) and by[1]["entities"] == ["client:Acme"] and by[1]["fields"] == ["labels", "title"]
    assert retrieval.find_candidates(corpus, "a/b", 1).rows.select("number").collect() == [(2,)]


def test_evidence_is_merged_by_weight(spark):
    schema = "repo string, number long, field string, source string, ordinal int"
    near = spark.createDataFrame([("r", 1, "body", "u", 1), ("r", 1, "comment", "c1", 2)], schema)
    literal = spark.createDataFrame([("r", 1, "body", "u", 1), ("r", 1, "title", "u", 2), ("r", 1, "labels", "u", 3)], schema)
    entity = spark.createDataFrame([("r", 1)], "repo string, number long")
    order = lambda **k: [r["field"] for r in retrieval.merged_evidence(near, literal, **k).orderBy("ordinal").collect()]
    assert order() == ["title", "labels", "body"] and order(entities=entity, limit=4) == ["labels", "title", "body", "comment"]


def test_indexing_is_incremental(spark, tmp_path):
    encoder, made = indexing.HashEncoder(16), []

    def write(df, name):
        made.append(name)
        path = f"{tmp_path}/{len(made)}-{name}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    states = spark.createDataFrame([], "id string, model string, content_hash string, chunks int, complete boolean")
    vectors = spark.createDataFrame([], "key string, vector array<float>")
    first = indexing.indexed(units(spark), states, vectors, encoder, write)
    known, done = write(first["vectors"], "v"), write(first["states"], "s")
    assert done.count() == 5 and known.count() == first["passages"].select("text").distinct().count()
    assert indexing.progress(units(spark), done, encoder.name).first()["pending"] == 0
    changed = units(spark).withColumn("body", F.when(F.col("number") == 2, "new text").otherwise(F.col("body")))
    again = indexing.indexed(changed, done, known, encoder, write)
    assert {r["id"] for r in again["passages"].select("id").distinct().collect()} == {"issue:a/b:2"} and again["vectors"].count() == known.count() + 1
    rows = indexing.searchable(again["passages"], again["states"], changed, tickets(spark), again["vectors"], encoder.name)
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in rows.collect())


def test_policy_by_registry_and_declaration(spark):
    rows = [("1", "claude[bot]", "Bot", None, "x", None), ("2", "ann", "User", None, "Fixed.\n\n**Addressed by Claude Code**", None), ("review:3", "coderabbitai", "Bot", None, "root", None), ("review:4", "bob", "User", "review:3", "reply", None), ("5", "renamed", "Bot", None, "x", "175728472"), ("6", "claude", "User", None, "Generated with Claude Code\n```\nlog\n```", None)]
    comments = spark.createDataFrame([(i, "r", 1, a, k, p, b, n, "github.com") for i, a, k, p, b, n in rows], "id string, repo string, number long, author string, author_type string, in_reply_to string, body string, author_id string, host string")
    pulls = spark.createDataFrame([("r", 1)], "repo string, number long")
    got = {r["id"]: (r["reason"], r["provider"], r["thread"]) for r in policy.decided(comments, pulls, policy.Policy()).collect()}
    assert got == {"1": ("known_ai", "claude", None), "2": ("declared_ai", "claude", None), "review:3": ("excluded_thread", "coderabbit", "review:3"), "review:4": ("excluded_thread", "coderabbit", "review:3"), "5": ("known_ai", "copilot", None), "6": (None, None, None)}
    kept = policy.Policy().resolved(include_authors=["BOB"], exclude_ai=None)
    assert {r["id"] for r in policy.decided(comments, pulls, kept).where("visible").collect()} == {"review:4", "6"}
    with pytest.raises(ValueError):
        policy.Policy(exclude_authors=["a", "A"]).validate()


def test_reply_chains_have_no_bound_and_stay_in_their_ticket(spark):
    chain = [(f"c{i}", "r", 1, f"c{i - 1}" if i else None) for i in range(150)] + [("d", "r", 2, "c3"), ("e", "r", 2, "gone")]
    got = {r["id"]: r["root"] for r in ingest.thread_roots(spark.createDataFrame(chain, "id string, repo string, number long, in_reply_to string")).collect()}
    assert got["c149"] == "c0" and got["d"] == "d" and got["e"] == "e" and len(got) == 152


def test_derived_text_by_hand():
    body = "Intro\r\n## Steps to reproduce\r\n_No response_\r\n~~~\n# no heading\n~~~\n### Checklist ##\n- [ ] a\n"
    got = [(s["kind"], s["heading"], s["empty"], s["boilerplate"]) for s in represent.split_sections(body)]
    assert got == [("description", "", False, False), ("reproduction", "Steps to reproduce", False, False), ("checklist", "Checklist", False, True)]
    spans = represent.split_sections(body)
    assert body.encode()[spans[0]["start"] : spans[0]["end"]] == b"Intro\r\n" and spans[-1]["end"] == len(body.encode())
    text = "é #4, v1.2/3.4#5 and closes #6; https://host.example/o/r/pull/7/files#8 http://else.example/o/r/issues/9 duplicate of o/r#10"
    refs = represent.find_references("a/b", text, "https://host.example/a/b/issues/1")
    assert [r[:3] for r in refs] == [("a/b", 4, "mention"), ("a/b", 6, "fix_reference"), ("o/r", 7, "mention"), ("o/r", 10, "duplicate_reference")]
    assert [text.encode()[r[3] : r[4]].decode() for r in refs] == ["#4", "#6", "https://host.example/o/r/pull/7", "o/r#10"]
    with pytest.raises(ValueError):
        represent.validate_rules({"r": [represent.LabelRule("x", label="a", prefix="b")]})


def test_pages_of_comments(spark):
    rows = [(f"{i}", "r", 1, f"b{i}", i // 2, i % 5 != 0) for i in range(11)]
    comments = spark.createDataFrame(rows, "id string, repo string, number long, body string, created_s long, visible boolean")
    seen, cursor = [], None
    while True:
        page = reads.comments_page(comments.select("repo", "number"), comments, "r", 1, limit=3, cursor=cursor, generation="g")
        seen += [r["id"] for r in page.rows.collect()]
        if not (cursor := page.next_cursor):
            break
    assert seen == [i for i, *_ in sorted((x for x in rows if x[5]), key=lambda x: (x[4], x[0]))] and page.extra["excluded"] == 3
    with pytest.raises(reads.NotFound):
        reads.comments_page(comments, comments, "r", 9)


def test_rows_that_break_a_rule_fail(spark):
    good = ("r", 1, "n", "2024-01-01T00:00:00Z", "u", "{}")
    schema = "repo string, number long, node_id string, updated_at string, url string, payload string"
    assert writes.put_tickets(spark.createDataFrame([], schema), spark.createDataFrame([good], schema)).count() == 1
    with pytest.raises(Exception, match="payload"):
        writes.put_tickets(spark.createDataFrame([], schema), spark.createDataFrame([(*good[:5], "{")], schema)).collect()
    cache = spark.createDataFrame([("o/x", "1"), ("o/x?page=2", "1"), ("o/xy", "1")], "url string, etag string")
    new = spark.createDataFrame([("o/x", "2"), ("o/z?since=1", "2")], cache.schema)
    assert {tuple(r) for r in writes.cached(cache, new).collect()} == {("o/x", "2"), ("o/x?page=2", "1"), ("o/xy", "1")}
    assert {r["url"] for r in writes.without_listing(cache, "o/x").collect()} == {"o/xy"}
    assert writes.scope_reset({"options": {"a": 1, "b": 1}}, {"options": {"a": 2, "b": 1}}) == ["a"]


def test_one_of_two_writers_fails_and_old_generations_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = spark.range(3)
    for _ in range(5):
        store.commit({"t": one}, {"repositories": ["a/b"], "credential_identity": "secret"})
    assert len(store._manifests()) == 3 and len(list((tmp_path / "s").glob("gen=*"))) == 3
    assert not store._write(store._manifests()[0], "{}")
    twice = Store.digest({"t": one.union(one)}), Store.digest({"t": one}), Store.digest({"t": one.union(one).union(one)})
    assert len(set(twice)) == 3
    copy = Store(spark, f"file://{tmp_path}/c")
    store.publish(copy)
    assert "credential_identity" not in copy.manifest()["metadata"]
    with pytest.raises(ValueError, match="lacks"):
        Store(spark, f"file://{tmp_path}/b").acquire(copy, repositories=["x/y"])
    with store.locked(), pytest.raises(RuntimeError):
        assert store.busy()
        with store.locked():
            pass
    with pytest.raises(PermissionError):
        Store(spark, store.root, read_only=True).commit({})
    assert dict((c, ok) for c, ok, _ in status.checks(store))["tables"] is False


def client(records, **k):
    calls = []

    def send(method, url, headers, body):
        calls.append((method, url, headers, body))
        r = records[url]
        r = r.pop(0) if isinstance(r, list) else r
        return r(headers) if callable(r) else r

    now = [0.0]
    budget = api.Budget(clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s), **k)
    return api.Client("https://h", send, budget, now=lambda: now[0]), calls, now


def test_requests_wait_retry_and_give_up():
    ok = api.Response(200, "[1]", {"ETag": "e"})
    c, calls, now = client({"https://h/x": [api.Response(502), api.Response(429, "", {"Retry-After": "90"}), ok, lambda h: api.Response(304) if h.get("If-None-Match") == "e" else ok]})
    assert c.get("https://h/x").body == "[1]" and now[0] >= 90 and c.get("https://h/x").body == "[1]" and len(calls) == 4
    c, calls, _ = client({"https://h/x": api.Response(500)})
    with pytest.raises(api.ApiError):
        c.get("https://h/x")
    assert len(calls) == api.TRIES
    c, _, _ = client({"https://h/x": api.Response(429, "", {"Retry-After": "99999"})})
    for _ in range(2):  # the second stops at the first's failure
        with pytest.raises(api.ApiError, match="rate limit"):
            c.get("https://h/x")
    c, _, _ = client({"https://h/x": ok}, most=1)
    c.get("https://h/x")
    with pytest.raises(api.ApiError, match="budget"):
        c.get("https://h/x")


def test_listings_page_safely(spark):
    link = lambda n, last: {"Link": f'<https://h/l?page={n}>; rel="next", <https://h/l?page={last}>; rel="last"'}
    records = {"https://h/l": [200, "[1,2]", link(2, 3)], "https://h/l?page=2": [200, "[3]", link(3, 3)], "https://h/l?page=3": [200, "[4]", {}]}
    c = api.recorded({"origin": "https://h", "records": json.dumps(records)})
    assert [x for p in c.pages("/l") for x in p] == [1, 2, 3, 4] and len(c.numbered("/l")) == 3
    spark.dataSource.register(api.RecordedListing)
    df = spark.read.format("listing").option("origin", "https://h").option("path", "/l").option("records", json.dumps(records)).load()
    assert sorted(int(r["payload"]) for r in df.collect()) == [1, 2, 3, 4] and df.rdd.getNumPartitions() == 3
    for bad in ("https://evil/l?page=2", "https://h/l"):
        c = api.recorded({"origin": "https://h", "records": json.dumps({"https://h/l": [200, "[]", {"Link": f'<{bad}>; rel="next"'}]})})
        with pytest.raises(api.ApiError):
            list(c.pages("/l"))


def test_nodes_are_checked_before_they_count():
    answer = lambda **x: api.Response(200, json.dumps(x))
    good = answer(data={"nodes": [{"id": "a"}, None]}, errors=[{"type": "NOT_FOUND"}])
    assert client({"https://h/graphql": good})[0].nodes(["a", "b"], "q") == {"a": {"id": "a"}, "b": None}
    for bad in (answer(data={"nodes": [{"id": "x"}]}), answer(data={"nodes": [{"id": "a"}]}, errors=[{"type": "TIMEOUT"}]), answer(data=None)):
        with pytest.raises(api.ApiError):
            client({"https://h/graphql": bad})[0].nodes(["a"], "q")
    assert api.connection({"c": {"nodes": [1, None], "pageInfo": {"hasNextPage": True, "endCursor": "z"}}}, "c") == ([1], "z")
    with pytest.raises(api.ApiError):
        api.connection({"c": {"nodes": [], "pageInfo": {"hasNextPage": True}}}, "c")


def test_sessions_replay_for_their_signature(tmp_path):
    path, calls = str(tmp_path / "s.sqlite"), []

    def send(method, url, headers, body):
        calls.append(url)
        return api.Response(200 if url != "bad" else 500, "x")

    s = sessions.Session(path, {"scope": 1})
    run = s.over(send)
    run("GET", "u", {}, ""), run("GET", "u", {}, ""), run("GET", "bad", {}, ""), run("GET", "bad", {}, "")
    assert calls == ["u", "bad", "bad"] and s.inspect()["answers"] == 1
    s.close()
    again = sessions.Session(path, {"scope": 1})
    assert again.resumed and again.over(send)("GET", "u", {}, "").body == "x" and len(calls) == 3
    again.close()
    assert not sessions.Session(path, {"scope": 2}).resumed and sessions.inspect(path)["answers"] == 0


def test_configuration():
    c = config.load('repositories = ["a/b"]\nroot = "/w"\noverlap = "1h30m"\n[scope."a/b"]\nissues = false\n')
    assert c.overlap == timedelta(minutes=90) and not c.scopes["a/b"]["issue_comments"] and c.scopes["a/b"]["pull_requests"]
    for bad in ('repositories = ["a/b"]\nroot = "x"\nnope = 1', 'repositories = ["a/.."]\nroot = "x"', 'repositories = []\nroot = "x"'):
        with pytest.raises(ValueError):
            config.load(bad)
    everything, issues, pulls = (config.scope(p) for p in ("all", "issues", "pull_requests"))
    assert all(everything.values()) and not config.default_scope()["pull_request_review_comments"] and config.default_scope(fields=True)["issue_types"]
    assert {s for s, on in issues.items() if not on} == {"pull_requests", "pull_request_comments", "pull_request_review_comments"}
    assert {s for s, on in pulls.items() if on} == {"pull_requests", "pull_request_comments", "pull_request_review_comments"}
    off = config.scope("all", issues=False)
    assert {s for s, on in off.items() if not on} == {"issues", "issue_comments", "fields", "issue_types", "relationships"}
    meta = {"repositories": ["a/b"], "options": {"a/b": {"issues": True, "fields": True}}, "coverage": {"a/b": {"reconciled_at": "2024-01-01T00:00:00Z"}}}
    codes = [w["code"] for w in status.warnings(meta, repo="a/b", fields=True, scopes=["reviews"], kind="pull_request", now=datetime(2024, 2, 1, tzinfo=timezone.utc))]
    assert codes == ["enrichment_stale", "resource_disabled", "resource_disabled"]
    assert [w["code"] for w in status.warnings(meta, repo="x/y")] == ["repository_not_collected"]


def test_values_under_several_names(spark):
    fields = json.dumps([{"field": {"name": "size"}, "number": 2}, {"field": {"name": "team"}, "name": "core"}, {"field": {"name": "tags"}, "options": [{"name": "x"}]}])
    row = spark.createDataFrame([(fields,)], "f string").select(records.normalized_values(F.col("f")).alias("v"))
    has = lambda n, v: row.select(records.has_value(F.col("v"), n, v)).first()[0]
    assert has("size", "2") and has("team", "core") and has("tags", "x") and not has("size", "core")
