"""Two-phase removal, orphans and transfers by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomery.operators import context, reconcile

T = "repo string, number long, node_id string, updated_at string, payload string"


def keys(df):
    return sorted((r["repo"], r["number"]) for r in df.collect())


def test_only_whole_listings_make_candidates(spark):
    pages = [("whole", 1, False), ("whole", 2, True), ("whole", 2, True), ("gap", 1, False), ("gap", 3, True), ("open", 1, False), ("open", 2, False), ("late", 2, True), ("odd", 1, True), ("odd", 2, True), ("torn", 1, False), ("torn", 1, True)]
    pages = spark.createDataFrame(pages, "repo string, page int, last boolean")
    assert [r["repo"] for r in reconcile.whole_listings(pages).collect()] == ["whole"]
    stored = spark.createDataFrame([(r, n) for r in ("whole", "gap", "open", "late", "odd", "torn", "none") for n in (1, 2)], "repo string, number long")
    seen = stored.where("number = 1")
    assert keys(reconcile.candidates(stored, seen, pages)) == [("whole", 2)]
    assert reconcile.candidates(stored, seen, pages.limit(0)).collect() == []


def test_only_confirmed_ones_go_with_what_hangs_on_them(spark):
    tickets = spark.createDataFrame([("r", n) for n in range(1, 7)], "repo string, number long")
    comments = spark.createDataFrame([(f"c{n}", "r", n) for n in range(1, 7)] + [("c9", "r", 1)], "id string, repo string, number long")
    seen, pages = tickets.where("number = 1"), spark.createDataFrame([("r", 1, True)], "repo string, page int, last boolean")
    answers = spark.createDataFrame([("r", 2, 404), ("r", 3, 200), ("r", 4, 410), ("r", 5, 404), ("r", 5, 200), ("r", 1, 404)], "repo string, number long, status int")
    out = reconcile.reconciled({"tickets": tickets, "comments": comments}, seen, pages, answers, comments.where("id <> 'c9'"))
    assert keys(out["tickets"]) == [("r", 1), ("r", 3), ("r", 5), ("r", 6)]
    assert sorted(r["id"] for r in out["comments"].collect()) == ["c1", "c3", "c5", "c6"]
    assert {r["number"]: r["decision"] for r in out["decisions"].collect()} == {2: "remove", 3: "keep", 4: "remove", 5: "wait", 6: "wait"}
    torn = reconcile.reconciled({"tickets": tickets, "comments": comments}, seen, pages.limit(0), answers, comments.limit(0))
    assert torn["tickets"].count() == 6 and torn["comments"].count() == 7


def test_orphans_wait_until_their_parent_comes(spark):
    tickets = spark.createDataFrame([("r", 1)], "repo string, number long")
    comments = spark.createDataFrame([("a", "r", 1), ("b", "r", 2), ("c", "r", 3)], "id string, repo string, number long")
    first = reconcile.adopted(comments, tickets, tickets.limit(0))
    assert keys(first["missing"]) == [("r", 2), ("r", 3)] and [r["id"] for r in first["comments"].collect()] == ["a"]
    fetched = spark.createDataFrame([("r", 2), ("r", 8)], "repo string, number long")
    then = reconcile.adopted(comments.limit(0), tickets, fetched, first["waiting"])
    assert [r["id"] for r in then["comments"].collect()] == ["b"] and keys(then["tickets"]) == [("r", 1), ("r", 2)] and keys(then["missing"]) == [("r", 3)]


def test_tickets_that_move_twice_in_a_batch(spark):
    stored = spark.createDataFrame([("a", 1, "N", "1", "x"), ("a", 2, "M", "1", "x"), ("c", 9, "O", "5", "x")], T)
    incoming = spark.createDataFrame([("b", 7, "N", "2", "y"), ("c", 3, "N", "3", "z"), ("a", 2, "M", "0", "stale"), ("d", 9, "O", "4", "stale")], T)
    comments = spark.createDataFrame([("1", "a", 1, "p"), ("2", "b", 7, "p"), ("3", "a", 2, "p"), ("4", "z", 5, "p")], "id string, repo string, number long, body string")
    redirects = spark.createDataFrame([("z", 5, "z", 6), ("z", 6, "a", 1)], "repo string, number long, to_repo string, to_number long")
    out = reconcile.transferred(stored, incoming, comments, redirects)
    assert sorted(tuple(r) for r in out["tickets"].collect()) == [("a", 2, "M", "1", "x"), ("c", 3, "N", "3", "z"), ("c", 9, "O", "5", "x")]
    assert sorted(tuple(r) for r in out["comments"].collect()) == [("1", "c", 3, "p"), ("2", "c", 3, "p"), ("3", "a", 2, "p"), ("4", "c", 3, "p")]
    assert {((r["repo"], r["number"])): (r["to_repo"], r["to_number"]) for r in out["moves"].collect()}["z", 5] == ("c", 3)


def test_chains_end_and_cycles_fail(spark):
    kind = "repo string, number long, to_repo string, to_number long"
    chain = spark.createDataFrame([("r", n, "r", n + 1) for n in range(40)], kind)
    assert {(r["number"], r["to_number"]) for r in reconcile.followed(chain).collect()} == {(n, 40) for n in range(40)}
    assert reconcile.followed(chain.limit(0)).collect() == []
    with pytest.raises(ValueError, match="cycle"):
        reconcile.followed(spark.createDataFrame([("r", 1, "r", 2), ("r", 2, "r", 1)], kind)).collect()
    with pytest.raises(Exception, match="two places"):
        reconcile.followed(spark.createDataFrame([("r", 1, "r", 2), ("r", 1, "r", 3)], kind)).collect()


# ---- contexts


def test_items_that_do_not_fit_are_passed_over(spark):
    rows = spark.createDataFrame([(["aaaa", "bbbbbbbb", "cc", "d"], 9, 7), (["aaa"], 2, 2), ([], 5, 5), (["aa", "aa"], 100, 3)], "x array<string>, left long, share long")
    got = rows.select(context.fitted(F.col("x"), F.col("left"), F.col("share")).alias("f")).select("f.kept", "f.left").collect()
    assert [(r["kept"], r["left"]) for r in got] == [(["aaaa", "cc", "d"], 2), ([], 2), ([], 5), (["aa"], 98)]


def test_whole_contexts_by_hand(spark):
    tickets = spark.createDataFrame([("r", 1, "d" * 900, ["bug", "ui"]), ("r", 2, "x" * 700, []), ("r", 3, None, ["bug"])], "repo string, number long, body string, labels array<string>")
    comments = spark.createDataFrame([("1", "r", 1, "c" * 300, 5)], "id string, repo string, number long, body string, created_s long")
    relations = spark.createDataFrame([("r", 1, 0, "r", 2), ("r", 1, 1, "r", 1), ("r", 1, 2, "q", 9), ("r", 1, 3, "r", 2), ("r", 1, 4, "r", 3)], "repo string, number long, place int, to_repo string, to_number long")
    catalog = spark.createDataFrame([("labels", "r", str(i), json.dumps({"name": n, "description": d})) for i, (n, d) in enumerate((("ui", "u" * 500), ("bug", "short"), ("other", None)))], "kind string, scope string, id string, payload string")
    fields = spark.createDataFrame([("r", 1, "[" + "1," * 20 + "1]"), ("r", 2, "[1]")], "repo string, number long, fields string")
    args = tickets, comments, relations, catalog, fields
    one = {r["number"]: r for r in context.whole(*args, 2000, 4, 2, []).collect()}
    assert one[1]["description_chars"] == 900 and [c["chars"] for c in one[1]["comments"]] == [300]
    assert [(x["to_repo"], x["to_number"], x["missing"], x["chars"]) for x in one[1]["related"]] == [("r", 2, False, 512), ("q", 9, True, None)]
    assert one[1]["label_definitions"] == ['{"name":"bug","description":"short"}'] and one[1]["warnings"] == ["context_label_definition_omitted"]  # the long one is passed over
    assert one[1]["text_characters"] == 900 + 300 + 512 + 36 + 43 and one[1]["fields"].startswith("[1,")
    assert one[3]["text_characters"] == 36 + 2 and one[3]["related"] == [] and one[3]["description_chars"] == 0
    small = {r["number"]: r for r in context.whole(*args, 1300, 4, 2, [], "classification").collect()}
    assert small[1]["fields"] is None and small[1]["label_definitions"] == [] and len(small[1]["warnings"]) == 2 and small[1]["related"][0]["chars"] == 100
    assert small[2]["label_definitions"] == ['{"name":"bug","description":"short"}', '{"name":"other","description":null}']
    rules = spark.createDataFrame([("r", "x" * 100, 1)], "repo string, rules string, n int")
    ruled = {r["number"]: r for r in context.whole(*args, 1750, 4, 2, [], rules=rules).collect()}
    assert ruled[1]["label_rules"] is None and "context_label_rules_omitted" in ruled[1]["warnings"] and ruled[2]["label_rules"] == "x" * 100
