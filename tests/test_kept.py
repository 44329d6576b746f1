"""Tables and indexes that are kept up: segments, buckets, ranks, manifests; searches with scopes and limits."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomery.operators import lexical, ranks, represent, retrieval, segments, semantic
from loomery.operators.merge import Buckets
from loomery.sources.store import Conflict, Store

UNIT = "id string, repo string, number long, family string, title string, body string"


def units_of(spark, words):
    """One unit a ticket from {number: body}."""
    return spark.createDataFrame([(f"issue:r:{n}", "r", n, "issue", f"title {n % 5}", b) for n, b in words.items()], UNIT)


def shown(postings):
    return Counter((r["id"], r["col"], r["term"], tuple(r["positions"]), r["length"]) for r in postings.collect())


def written(root):
    return sum(p.stat().st_size for p in Path(root).rglob("part-*") if "postings" in str(p))


# ---- segments


def test_segments_hold_what_a_rebuild_does(spark, tmp_path):
    rng, kept, now = random.Random(1), segments.Segments(Store(spark, f"file://{tmp_path}/i")), {n: " ".join(random.Random(n).choices("abcdef", k=8)) for n in range(60)}
    assert kept.upsert(units_of(spark, now))["units"] == 60
    for turn in range(4):
        for n in rng.sample(sorted(now), 4):
            now[n] = f"changed in turn {turn}" if rng.random() < 0.7 else now[n]
        for n in rng.sample(sorted(now), 2):
            del now[n]
        now[100 + turn] = "new unit"
        kept.sync(units_of(spark, now))
        if turn in (1, 2):
            kept.compact(2 if turn == 1 else None)
        index, whole = kept.index(), lexical.Index.build(units_of(spark, now))
        assert shown(index.postings) == shown(whole.postings)
        assert tuple(index.totals.first()) == tuple(whole.totals.first())
    assert kept.sync(units_of(spark, now)) is None  # nothing differs
    kept.compact(99)
    assert len(kept.listed()) == 1 and not kept.listed()[0]["gone"] and shown(kept.index().postings) == shown(whole.postings)
    kept.sync(units_of(spark, {1: "x"}).limit(0))
    assert kept.index().postings.count() == 0 and kept.index().totals.first()["total"] == 0


def test_an_update_writes_its_own_postings_only(spark, tmp_path):
    root, words = tmp_path / "i", {n: " ".join(f"w{(n * 7 + k) % 997}" for k in range(60)) for n in range(400)}
    kept = segments.Segments(Store(spark, f"file://{root}"))
    kept.upsert(units_of(spark, words))
    before = written(root)
    words |= {n: words[n] + " more" for n in (5, 6, 7, 8)}
    entry = kept.sync(units_of(spark, words))
    assert entry["units"] == entry["gone"] == 4
    assert written(root) - before < before / 10  # a footer is half of it
    assert kept._read("postings", entry["name"]).select("id").distinct().count() == 4


def test_a_query_opens_the_files_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FILE_WORDS", 1000)
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    kept.upsert(units_of(spark, {n: "hot " + " ".join(f"w{(n * 13 + k) % 997:03d}" for k in range(40)) for n in range(400)}))
    index = kept.index()
    every, one, hot = (len(df.inputFiles()) for df in (index.postings, index.of_terms(["w500"]), index.of_terms(["hot"])))
    assert every >= 12 and one <= 2 and index.of_terms(["w500"]).count() > 0
    assert index.of_terms(["hot"]).count() == 400 and hot < every
    assert index.of_terms(["none"]).count() == 0 and index.of_terms([], "w50").select("term").distinct().count() == 10


def test_segments_stay_few(spark, tmp_path):
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    kept.upsert(units_of(spark, {n: "some words of it" for n in range(64)}))
    most = 0
    for turn in range(6):
        kept.sync(kept_units := units_of(spark, {n: f"some words of it {turn if n == turn else ''}" for n in range(64)}))
        kept.compact()
        most = max(most, len(kept.listed()))
    assert most <= 4 and kept.units().count() == kept_units.count()


def test_two_writers_and_lost_ones(spark, tmp_path):
    root = tmp_path / "s"
    store = Store(spark, f"file://{root}")
    store.commit({"t": spark.range(1)})
    names = store._manifests()
    other = Store(spark, store.root)
    other._manifests = lambda: names  # began with the same generation
    store.commit({"t": spark.range(2)})
    with pytest.raises(Conflict):
        other.commit({"t": spark.range(3)})
    assert store.read("t").count() == 2
    left = store.stage("lost", spark.range(5))  # a writer that ended before its manifest
    assert (root / left).exists() and "lost" not in store.manifest()["tables"]
    store.sweep(older=3600)
    assert (root / left).exists()
    store.sweep(older=-1)
    assert not (root / left).exists() and store.read("t").count() == 2 and not list(root.glob(".*.new"))
    store.commit({}, drop=["t"])
    assert store.manifest()["tables"] == {}


# ---- buckets


def test_buckets_keep_the_newest(spark, tmp_path):
    rng, to, want = random.Random(2), Buckets(Store(spark, f"file://{tmp_path}/b"), "t", ["k"], buckets=4), {}
    schema = "k long, version long, payload string, note string"
    assert to.read() is None
    for number in range(4):
        rows = [(rng.randrange(30), rng.randrange(8), rng.choice("abc"), f"n{number}") for _ in range(25 if number else 60)]
        batch, before = spark.createDataFrame(rows, schema), dict(want)
        for k, v, p, note in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
            if k not in want or (v, number, p) >= (want[k][0], want[k][3], want[k][1]):
                want[k] = (v, p, note, number)
        told = {r["k"]: r["change"] for r in to.changes(batch).collect()}
        assert {k for k, c in told.items() if c == "added"} == set(want) - set(before)
        assert {k for k, c in told.items() if c == "updated"} == {k for k in before if want[k][:2] != before[k][:2]}
        to.merge(batch, number)
        assert {r["k"]: (r["version"], r["payload"]) for r in to.read().collect()} == {k: w[:2] for k, w in want.items()}
        again = to.store.manifest()["generation"]
        assert to.merge(batch, number) == {"rows": 0, "folded": 0} and to.store.manifest()["generation"] == again


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    root = tmp_path / "b"
    to = Buckets(Store(spark, f"file://{root}"), "t", ["k"], buckets=8)
    rows = spark.range(20000).select(F.col("id").alias("k"), F.lit(1).alias("version"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    size = lambda: sum(p.stat().st_size for p in root.rglob("part-*"))
    assert to.merge(rows)["rows"] == 20000
    before = size()
    assert to.merge(rows.where("k < 200").withColumn("version", F.lit(2))) == {"rows": 200, "folded": 0}
    assert size() - before < before / 20
    few = to.merge(rows.where("k % 3 = 0").withColumn("version", F.lit(3)))  # a third of each bucket: all are folded
    assert few["folded"] == 20000 and all(len(p) == 1 for p in to._about()["parts"].values())
    assert Counter(r["version"] for r in to.read().collect()) == {3: 6667, 2: 133, 1: 13200}
    one = to.read().where("k = 7").first()["payload"]
    to.merge(spark.createDataFrame([(7, 9, one)], "k long, version int, payload string"))
    assert sum(len(p) > 1 for p in to._about()["parts"].values()) == 1


def test_a_lost_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    to = Buckets(Store(spark, f"file://{tmp_path}/b"), "t", ["k"], buckets=2)
    batch = spark.createDataFrame([(1, 1, "a")], "k long, version long, payload string")
    to.merge(batch, 0)
    late = spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "k long, version long, payload string")
    with monkeypatch.context() as m:
        m.setattr(Store, "_write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            to.merge(late, 1)
    assert sorted(map(tuple, to.read().collect())) == [(1, 1, "a")]
    to.merge(late, 1)
    assert sorted(map(tuple, to.read().collect())) == [(1, 2, "b"), (2, 1, "c")]


# ---- ranks and vectors


def test_ranks_cross_ranges(spark):
    """Ties lie across ranges; nothing depends on how many there are."""
    rows = [("r", n, [0.5, 0.5, 0.7][n % 3]) for n in range(500)] + [("q", 7, 0.5)]
    want = {(r, n): i for i, (r, n, _) in enumerate(sorted(rows, key=lambda x: (-x[2], x[0], x[1])), 1)}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            frame = spark.createDataFrame(rows, "repo string, number long, score double")
            got = {(r["repo"], r["number"]): r["at"] for r in semantic.ranked(frame, "score", "at").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want
    assert ranks.ranked(frame.limit(0), [F.asc("number")]).collect() == []


def test_pooled_vectors_by_hand(spark):
    rows = [("r", 1, "title", [1.0, 0.0]), ("r", 1, "title", [0.0, 1.0]), ("r", 1, "body", [3.0, 4.0]), ("r", 1, "comment", [9.0, 9.0]), ("r", 2, "labels", [1.0, 0.0]), ("r", 3, "body", None), ("r", 4, "body", [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "repo string, number long, field string, vector array<float>")
    got = {r["number"]: r["vector"] for r in semantic.pooled(frame, semantic.TICKET_WEIGHTS).collect()}
    assert got == {1: pytest.approx([5 / 61**0.5, 6 / 61**0.5])}
    assert "Generate" not in semantic.pooled(frame, semantic.TICKET_WEIGHTS)._jdf.queryExecution().toString()
    assert set(r["number"] for r in semantic.pooled(frame, semantic.TICKET_WEIGHTS, main_only=False).collect()) == {1, 2}
    assert semantic.pooled(frame.limit(0), semantic.TICKET_WEIGHTS).collect() == []


# ---- searches


TICKETS = [("a/b", 1, "Crash on start", "it fails", ["client:Acme"]), ("a/b", 2, "Slow", "network crash here", []), ("a/b", 3, "Other", "nothing", ["crash"])]


def corpus_of(spark):
    docs = [(f"issue:{r}:{n}", r, n, "issue", t, b) for r, n, t, b, _ in TICKETS] + [(f"labels:{r}:{n}", r, n, "labels", "\n".join(x), "") for r, n, _, _, x in TICKETS if x]
    docs = spark.createDataFrame(docs, UNIT)
    rows = spark.createDataFrame([(*x, "open", "issue", "Bug", x[1], x[1]) for x in TICKETS], "repo string, number long, title string, body string, labels array<string>, state string, kind string, type string, created_s long, updated_s long")
    passages = [("a/b", n, f, n * 10 + i, [float(n == 1), 1.0 - (n == 1)], f"{f} of {n}") for n in (1, 2, 3) for i, f in enumerate(("title", "body"))]
    passages = spark.createDataFrame(passages, "repo string, number long, field string, chunk long, vector array<float>, text string")
    states = docs.select("id", retrieval.content_hash().alias("content_hash"), F.lit(True).alias("complete"), F.lit("m").alias("model"))
    return retrieval.Corpus(rows, docs, lexical.Index.build(docs), passages, states, lambda q: [1.0, 0.0], [represent.LabelRule("client", prefix="client:")])


def numbers(rows):
    return {r["number"] for r in rows.collect()}


@pytest.mark.parametrize("engine", ["lexical", "semantic", "hybrid"])
def test_scopes_and_exclusions_hold_for_every_engine(spark, engine):
    corpus, every = corpus_of(spark), {1, 2, 3}
    find = lambda q="crash", **k: numbers(retrieval.search(corpus, q, engine, model="m", **k).rows)
    assert find(exclude=["crash"]) == set()
    assert find(scopes=["title"], exclude=["crash"]) == (set() if engine == "lexical" else {2, 3})  # it stands in one title
    assert find(scopes=["labels"]) == ({3} if engine != "semantic" else set())
    if engine != "hybrid":  # which costs a dozen jobs a search
        assert find() == every and find(scopes=["comments"]) == set()
        assert find(scopes=["body"], exclude=["start fails"]) == ({2} if engine == "lexical" else {2, 3})
    with pytest.raises(ValueError):
        find(scopes=["heading"])


def test_coverage_is_that_of_the_scopes(spark):
    corpus = corpus_of(spark)
    corpus.states = corpus.states.where("id like 'issue:%'")
    assert numbers(retrieval.search(corpus, "crash", "semantic", scopes=["title"], model="m").rows) == {1, 2, 3}
    for scopes in (None, ["labels"]):
        with pytest.raises(retrieval.SemanticUnavailable):
            retrieval.search(corpus, "crash", "semantic", scopes=scopes, model="m")


def test_long_queries(spark):
    corpus, words = corpus_of(spark), " ".join(["crash", *(f"w{i}" for i in range(511))])
    found = retrieval.search(corpus, words, "hybrid", model="m")
    assert numbers(found.rows) == {1, 2, 3} and [w["code"] for w in found.warnings] == ["ticket_signals_limited"]
    with pytest.raises(ValueError):
        retrieval.search(corpus, words + " more", "hybrid", model="m")
    with pytest.raises(ValueError):
        retrieval.search(corpus, " ".join(f"w{i}" for i in range(33)), "lexical")
    assert retrieval.search(corpus, "crash", "hybrid", model="m").warnings == []


def test_pages_with_evidence(spark):
    corpus, seen, cursor = corpus_of(spark), [], None
    options = {"model": "m", "limit": 2, "generation": "g1"}
    while True:
        page = retrieval.search_page(corpus, "crash", "hybrid", cursor=cursor, count=True, **options)
        seen += [r["number"] for r in page.matches.orderBy("place").collect()]
        told = [(r["number"], r["ordinal"], r["field"], r["text"]) for r in page.evidence.orderBy("number", "ordinal").collect()]
        assert page.total == 3 and {n for n, *_ in told} == {r["number"] for r in page.matches.collect()}
        if 2 in {n for n, *_ in told}:
            assert (2, "network [crash] here") in {(n, t) for n, _, _, t in told} or (2, "body of 2") in {(n, t) for n, _, _, t in told}
        if not page.has_more:
            break
        cursor = page.next_cursor
    assert sorted(seen) == [1, 2, 3] and len(seen) == 3
    from loomery.operators.paging import CursorError

    for change, status in (({"generation": "g2"}, 409), ({"scopes": ["title"]}, 400)):
        with pytest.raises(CursorError) as e:
            retrieval.search_page(corpus, "crash", "hybrid", cursor=cursor, count=True, **options | change)
        assert e.value.status == status
    with pytest.raises(CursorError) as e:
        retrieval.search_page(corpus, "crash", "lexical", cursor=cursor, count=True, **options)
    assert e.value.status == 409
    with pytest.raises(ValueError):
        retrieval.search_page(corpus, "crash", "hybrid", evidence_limit=11, model="m")
