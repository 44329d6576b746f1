"""Registered queries against DuckDB on the smallest tables, and properties of the building blocks."""

import math
from datetime import datetime, timezone

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomery.operators import candidates, context, evaluate, ingest, paging, represent, semantic
from loomery.operators.merge import Buckets
from loomery.operators.filters import Filters, date_bound
from loomery.plans import catalogue
from loomery.sources.store import Store
from loomery.streaming.upsert import stream_upsert

DATA = "/root/testdata/sf0.001"
TABLES = "orders events documents embeddings labels conversations".split()


@pytest.mark.parametrize("name", ["lex_any", "lex_phrase", "lex_exclude", "list_filtered", "facet_labels", "sem_top200", "rrf_query", "policy_visible", "upsert_latest", "seed_term_select", "context_budgeted", "eval_ranking", "eval_latency"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalogue.Q[name](spark, DATA)
    cols = sorted(df.columns)
    got = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


def test_pages_partition_the_list(spark):
    rows = spark.createDataFrame([("a/b", n, n % 3) for n in range(25)], "repo string, number long, updated_s long")
    seen, cursor = [], None
    while page := paging.page(rows, "updated", limit=7, cursor=cursor).collect():
        seen += [r["number"] for r in page]
        cursor = {"key": page[-1]["updated_s"], "repo": page[-1]["repo"], "number": page[-1]["number"]}
    assert sorted(seen) == list(range(25)) and len(seen) == 25


def test_cursor_errors():
    text = paging.encode({"kind": "search", "signature": "s", "generation": "g"})
    assert paging.decode(text, "search", "s", "g")["kind"] == "search"
    for args, status in ((("list", "s", "g"), 400), (("search", "t", "g"), 400), (("search", "s", "h"), 409)):
        with pytest.raises(paging.CursorError) as e:
            paging.decode(text, *args)
        assert e.value.status == status


def test_date_bounds():
    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    assert date_bound("2024-01-02", True, now) == (1704240000, False)
    assert date_bound("2024-01-02", False, now) == (1704153600, True)
    assert date_bound("2d", False, now)[0] == int(now.timestamp()) - 172800
    with pytest.raises(ValueError):
        Filters(created_after="2024-02-01", created_before="2024-01-01").column()
    with pytest.raises(ValueError):
        Filters(repo="a/..").column()


def test_fences_sections_references():
    body = "intro\n## Steps\n```\n# not a heading #5\n```\n## Expected\n_No response_\n"
    found = represent.split_sections(body)
    assert [(s["heading"], s["empty"]) for s in found] == [("", False), ("Steps", False), ("Expected", True)]
    refs = represent.find_references("a/b", "duplicate of #12, fixes c/d#3; v1/#9 ```\nhttps://github.com/x/y/issues/7\n")
    assert [r[:3] for r in refs] == [("a/b", 12, "duplicate_reference"), ("c/d", 3, "fix_reference"), ("x/y", 7, "mention")]
    assert represent.declared_ai("hello\nGenerated by Claude Code") == "claude" and represent.declared_ai("```\nGenerated by Claude Code\n```") is None


@given(st.text(max_size=6000))
def test_chunks_cover_the_text(text):
    parts = represent.split_chunks(text)
    assert all(text.encode()[a:b].decode() == t for a, b, t in parts)
    assert bool(parts) == bool(text.strip())


def test_upsert_is_idempotent_and_ties_take_the_incoming(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 9, "y")], "k long, version long, payload string")
    b = spark.createDataFrame([(1, 5, "z"), (2, 8, "old"), (3, 1, "new")], "k long, version long, payload string")
    once = ingest.upsert(a, b, ["k"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, 5, "z"), (2, 9, "y"), (3, 1, "new")]
    assert sorted(map(tuple, ingest.upsert(once, b, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_reply_cycles_are_an_error(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, in_reply_to string")
    with pytest.raises(Exception, match="cycle"):
        ingest.thread_roots(rows).collect()


def test_generations_and_streamed_changes(spark, tmp_path):
    store, copy = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/c")
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, version long, payload string").write.parquet(src)
    read = lambda: spark.readStream.schema("k long, version long, payload string").parquet(src)
    stream_upsert(read(), store, "t", ["k"], f"{tmp_path}/cp").awaitTermination()
    first = store.manifest()["generation"]
    spark.createDataFrame([(1, 2, "c")], "k long, version long, payload string").write.mode("append").parquet(src)
    stream_upsert(read(), store, "t", ["k"], f"{tmp_path}/cp").awaitTermination()
    assert store.manifest()["generation"] != first
    assert sorted(map(tuple, Buckets(store, "t", ["k"]).read().collect())) == [(1, 2, "c"), (2, 1, "b")]
    store.publish(copy)
    back = Store(spark, f"file://{tmp_path}/b")
    back.acquire(copy)
    assert Buckets(back, "t", ["k"]).read().count() == 2


def test_scores_by_hand(spark):
    ranked = spark.createDataFrame([("a", 1, "r", 7), ("a", 2, "r", 7), ("a", 3, "r", 8), ("a", 12, "r", 9), ("b", 1, "r", 1)], "case string, place int, repo string, number long")
    judged = spark.createDataFrame([("a", "r", 8), ("a", "r", 9), ("a", "r", 10), ("a", "r", 7), ("c", "r", 1)], "case string, repo string, number long")
    got = {r["case"]: tuple(r)[1:] for r in evaluate.scores(ranked, judged).collect()}
    assert got == {"a": (4, 0.2, 0.75, 1.0), "c": (0, 0.0, 0.0, 0.0)}


def test_evidence_keeps_to_its_budget(spark):
    tickets = spark.createDataFrame([("r", 1, "x" * 5000), ("r", 2, None)], "repo string, number long, body string")
    said = [("r", n, f"{n}-{i}", ("Key " if i == 0 else "") + "y" * 900, i) for n in (1, 2) for i in range(5)]
    comments = spark.createDataFrame([*said, ("r", 9, "no ticket", "z", 1)], "repo string, number long, id string, body string, created_s long")
    got = [r for r in context.budgeted(tickets, comments, 3000, 4, ["key"]).orderBy("number", "place").collect()]
    assert [(r["number"], r["id"], r["chars"], r["truncated"]) for r in got] == [
        (1, None, 2000, True), (1, "1-0", 904, False), (1, "1-4", 96, True),
        (2, None, 0, False), (2, "2-0", 904, False), (2, "2-4", 900, False), (2, "2-3", 900, False), (2, "2-2", 296, True),
    ]
    assert all(len(r["text"]) == r["chars"] for r in got)


def test_hybrid_ranks_all_hits(spark):
    sem = spark.createDataFrame([("r", n, 1 - n / 1000) for n in range(1, 251)], "repo string, number long, blended double")
    lex = spark.createDataFrame([("r", n, float(n)) for n in range(131, 261)], "repo string, number long, score double")
    told = spark.createDataFrame([("r", 240, 0.5), ("r", 255, 0.5), ("r", 3, 0.9)], "repo string, number long, score double")
    got = {r["number"]: r["score"] for r in semantic.hybrid(lex, sem, told).collect()}
    place, want = {3: 1, 240: 2, 255: 3}, {}
    for n in range(1, 261):
        want[n] = round((1 / (60 + n) if n <= 250 else 0) + (1 / (60 + 261 - n) if n > 130 else 0) + (3 / (60 + place[n]) if n in place else 0), 9)
    assert got == pytest.approx(want, abs=2e-9)
    some = sem.where("number <= 210"), lex.where("number = 210"), spark.createDataFrame([("r", 205, 0.5)], told.schema)
    assert {r["number"] for r in semantic.hybrid(some[1], some[0], some[2]).collect()} == {*range(1, 201), 205, 210}


def test_evidence_among_hits(spark):
    words = [("r", 1, "a", "issue", "title"), ("r", 2, "a", "issue", "body"), ("r", 9, "a", "issue", "body")]
    postings = spark.createDataFrame(words, "repo string, number long, term string, family string, col string")
    among = spark.createDataFrame([("r", n) for n in (1, 2, 3)], "repo string, number long")
    a, b = math.log(1 + 4 / 3), math.log(5)
    got = {r["number"]: r["score"] for r in candidates.term_evidence(postings, ["a", "b"], among).collect()}
    assert got == pytest.approx({1: 1.5 * a / (a + b), 2: 1.25 * a / (a + b)}, abs=1e-6)
