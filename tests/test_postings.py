"""Postings are made and dealt without a shuffled row a word."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomery.operators import lexical, postings, segments, topk
from loomery.sources.store import Store

UNIT = "id string, repo string, number long, family string, title string, body string"


def some_units(n=300, seed=5):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(["hot", "été", "Rare", *(f"w{i}" for i in range(40))], [8, 1, 0.2] + [1] * 40, k=k))
    return [(f"issue:r:{i}", "r", i, "issue", text(rng.randrange(4)), None if i % 50 == 0 else text(rng.randrange(60))) for i in range(n)]


def plain(rows):
    out = []
    for id_, _, _, _, *texts in rows:
        title, body = ([{"été": "ete"}.get(w, w) for w in (t or "").lower().split()] for t in texts)
        for col, own, other in (("title", title, body), ("body", body, title)):
            out += [(w, id_, col, tuple(i for i, x in enumerate(own) if x == w), other.count(w), len(title) + len(body)) for w in set(own)]
    return sorted(out, key=lambda x: (x[0].encode(), x[1].encode(), x[2] == "body"))


def shown(rows):
    return [(r["term"], r["id"], r["col"], tuple(r["positions"]), r["other"], r["length"]) for r in rows]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_without_a_shuffle(spark):
    rows = some_units()
    made = lexical.Index.build(spark.createDataFrame(rows, UNIT)).postings
    assert "Exchange" not in planned(made)
    assert sorted(shown(made.collect())) == sorted(plain(rows))


@pytest.mark.parametrize("words", [150, 1_000_000])
def test_pieces_come_back_in_order(words, monkeypatch):
    """Batches are cut and joined, terms are cut by unit; a range has its postings in order."""
    import pyarrow as pa

    monkeypatch.setattr(postings, "WORDS", words)
    monkeypatch.setattr(postings, "ROWS", 41)
    rows = some_units()
    split = lambda t: [{"été": "ete"}.get(w, w) for w in (t or "").lower().split()]
    whole = pa.RecordBatch.from_pylist([dict(zip(("id", "repo", "number", "family", "title", "body"), [*r[:4], split(r[4]), split(r[5])], strict=True)) for r in rows])
    bounds = [(b"hot", b"issue:r:150"), (b"hot", b"issue:r:2"), (b"w2", b"issue:r:0"), (b"w3", b"")]
    batches = [whole.slice(0, 120), whole.slice(120, 0), whole.slice(120)]
    for blocks in (postings._blocks(batches), postings._blocks_of_rows(list(postings._rows(batches)))):
        ranges = {}
        for block in blocks:
            for piece in postings._pieces(block, bounds):
                ranges.setdefault(piece.column("part")[0].as_py(), []).append(piece)
        got = [shown(r for b in postings._in_order(ranges[part]) for r in b.to_pylist()) for part in sorted(ranges)]
        assert len(got) == 5 and sum(got, []) == plain(rows)
        assert all((g[0][0].encode(), g[0][1].encode()) >= b for g, b in zip(got[1:], bounds, strict=True))


def test_frequencies_and_blocks_shuffle_no_posting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FILE_WORDS", 2000)
    rows = some_units()
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    kept.upsert(spark.createDataFrame(rows, UNIT))
    index, want = kept.index(), {}
    for term, id_, *_ in plain(rows):
        want.setdefault(term, set()).add(id_)
    df = index.frequencies()
    assert {r["term"]: r["df"] for r in df.collect()} == {t: len(u) for t, u in want.items()}
    keys = [line for line in planned(df).splitlines() if "hashpartitioning" in line]
    assert keys and not any("id#" in line for line in keys)
    tables = topk.Blocks.tables(index, size=16, impacts=False)
    assert "impacts" not in tables and "SortMergeJoin" not in planned(tables["blocks"])
    assert tables["blocks"].agg(F.sum("n")).first()[0] == sum(map(len, want.values()))
    blocks = topk.Blocks.of(Store(spark, f"file://{tmp_path}/b").at_state("1", lambda: tables), index)
    tickets = spark.createDataFrame(rows, UNIT).select("repo", "number")
    got = blocks.top(tickets, "rare hot", k=12)[0]
    best = lexical.search(index, tickets, "rare hot").orderBy(F.desc("score"), "repo", "number").limit(12)
    assert [tuple(r) for r in got.select("number", "id", "score").collect()] == [tuple(r) for r in best.select("number", "id", "score").collect()]


def test_units_without_an_id(spark, tmp_path, monkeypatch):
    """A ticket without a repository has none: its postings are kept, and no document frequency counts it."""
    monkeypatch.setattr(segments, "FILE_WORDS", 100)
    rows = [(None if i % 3 == 0 else f"issue:r:{i}", None if i % 3 == 0 else "r", i, "issue", "hot", f"hot w{i % 9} w{i % 9}") for i in range(60)]
    units = spark.createDataFrame(rows, UNIT)
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    kept.upsert(units)
    index = kept.index()
    dealt = postings.dealt(index.postings, 3, 240)
    for got in (index.postings, dealt):
        assert sorted((r["number"], r["col"], r["term"], tuple(r["positions"])) for r in got.collect()) == sorted(x for *_, i, _, _, _ in rows for x in ((i, "title", "hot", (0,)), (i, "body", "hot", (0,)), (i, "body", f"w{i % 9}", (1, 2))))
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == {r["term"]: r["df"] for r in index.postings.groupBy("term").agg(F.countDistinct("id").alias("df")).collect()}


def shuffled(spark):
    """Bytes that all stages until now have written for shuffles."""
    time.sleep(1)  # listeners lag behind
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("most", [0, 200_000])
def test_updates_shuffle_no_unchanged_text(spark, tmp_path, monkeypatch, most):
    """Neither units that don't differ nor postings of segments that lose nothing are shuffled, however many ids are gone."""
    monkeypatch.setattr(segments, "GONE", most)
    rng = random.Random(3)
    text = lambda k: " ".join(f"{rng.getrandbits(48):x}" for _ in range(k))
    rows = {n: (f"issue:r:{n}", "r", n, "issue", "hot", text(400)) for n in range(300)}
    units = lambda: spark.createDataFrame(list(rows.values()), UNIT)
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    kept.upsert(units())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for turn in range(2):
            for n in range(turn, 300, 50):
                rows[n] = (*rows[n][:5], f"changed in turn {turn}")
            del rows[10 + turn]
            was = shuffled(spark)
            entry = kept.sync(units())
            assert (entry["units"], entry["gone"], entry["of"]) == (6, 7, {"00000001": 7})
            assert shuffled(spark) - was < 150_000  # texts are 1.5 MB
        was = shuffled(spark)
        merged = kept.compact(2)
        assert (merged["units"], merged["of"]) == (12, {"00000001": 14})
        assert shuffled(spark) - was < 50_000
        was, whole = shuffled(spark), lexical.Index.build(units())
        got = kept.index().postings
        got.write.format("noop").mode("overwrite").save()
        assert shuffled(spark) - was < 300_000  # postings of units that are gone, at most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(shown(got.collect())) == sorted(shown(whole.postings.collect()))


def test_a_sync_compares_units_without_an_id_and_repeated_ones(spark, tmp_path):
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    rows = [(None, None, 1, "issue", "a", "b"), ("x", "r", 2, "issue", "c", "d"), ("x", "r", 2, "issue", "e", "f")]
    kept.upsert(spark.createDataFrame(rows, UNIT))
    assert kept.sync(spark.createDataFrame(rows, UNIT)) is None
    rows[2] = ("x", "r", 2, "issue", "e", "g")
    assert kept.sync(spark.createDataFrame(rows, UNIT))["units"] == 2
    assert sorted(r["term"] for r in kept.index().postings.collect()) == list("abcdeg")


def test_ranges_of_files_sort_no_postings(spark, tmp_path, monkeypatch):
    """What lies in a file is told by its batches' first and last rows; the least of all its terms would be found by sorting them."""
    monkeypatch.setattr(segments, "FILE_WORDS", 1500)
    kept = segments.Segments(Store(spark, f"file://{tmp_path}/i"))
    name = kept.upsert(spark.createDataFrame(some_units(), UNIT))["name"]
    rows = kept._read("postings", name).select(F.col("_metadata.file_name").alias("file"), "term")
    want = rows.groupBy("file").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    got = postings.ends(rows)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, kept._read("ranges", name).collect())) == sorted(map(tuple, got.collect()))
    below = planned(postings.ends(rows)).splitlines()
    assert not any("Sort " in line for line in below[[i for i, x in enumerate(below) if "MapInArrow" in x][0] :])
    assert all(f.endswith("zstd.parquet") for f in kept._read("postings", name).inputFiles())
