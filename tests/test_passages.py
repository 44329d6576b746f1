"""Snippets against SQLite's, WordPiece against a tokenizer library, passages against their definition; pruned searches against scans."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import clusters, lexical, semantic, snippets, topk, wordpiece
from loomery.sources.store import Store

WORDS = ["Alpha", "beta", "Gamma", "delta", "Été", "omega", "x1", "y", "straße", "naïve"]


def text_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ". ", ": ", ", ", ".", "\n", " - "]) for _ in range(n))


def test_snippets_as_fts5():
    con, rng = sqlite3.connect(":memory:"), random.Random(4)
    con.execute("create virtual table t using fts5(body, tokenize='unicode61')")
    for turn in range(300):
        text, size = text_of(rng, rng.randrange(1, 120)), rng.choice([4, 8, 32])
        phrases = [[w] for w in rng.sample(["alpha", "ete", "omega", "x1", "naive"], rng.randrange(1, 4))]
        if turn % 5 == 0:
            phrases.append(["beta", "gamma"])
        con.execute("delete from t")
        con.execute("insert into t values (?)", (text,))
        match = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
        row = con.execute("select snippet(t, 0, '[', ']', ' … ', ?) from t where t match ?", (size, match)).fetchone()
        if row:
            assert snippets.snippet_of(text, phrases, size) == row[0], (text, phrases, size)


def test_windows_from_postings_alone(spark):
    rng, rows, want = random.Random(5), [], {}
    for unit in range(25):
        places = sorted(rng.sample(range(1, 200), rng.randrange(1, 20)))
        found = [(at, rng.randrange(3)) for at in places]
        rows += [(f"u{unit}", "body", p, at) for at, p in found]
        value = lambda s: sum(1 for at, _ in found if s <= at < s + 32) + 999 * len({p for at, p in found if s <= at < s + 32})
        want[f"u{unit}"] = min((-value(at), at) for at, _ in found)
    got = snippets.window_starts(spark.createDataFrame(rows, "id string, col string, p int, pos int")).collect()
    assert {r["id"]: (-r["score"], r["start"]) for r in got} == want


VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyz.,:-!0123456789", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxy0123456789"), "the", "alpha", "##pha", "al", "be", "##ta", "gam", "##ma", "omega", "na", "##ive", "ete", "漢"]


def test_token_counts_as_a_tokenizer():
    from tokenizers import BertWordPieceTokenizer

    other = BertWordPieceTokenizer(vocab={v: i for i, v in enumerate(VOCABULARY)}, lowercase=True)
    own, rng = wordpiece.WordPiece(VOCABULARY), random.Random(6)
    texts = ["", "Alpha naïve Été", "漢字 and 漢", "a" * 100, "a" * 101, "z##z zzz", "tab\tnew\nline nbsp", "été", "a\x00b\x07c �", "$5+3=8 ^`|~", "“quotes” — dash…", "x​y", "ﬁ Ⅳ"]
    texts += ["".join(rng.choice("aAé漢 .,\n-ßz9́") for _ in range(rng.randrange(40))) for _ in range(300)]
    for text in texts:
        assert own.sizes(text)[-1] == len(other.encode(text, add_special_tokens=False).ids), repr(text)
        for k in range(0, len(text), 7):
            assert own.sizes(text)[k] == len(other.encode(text[:k], add_special_tokens=False).ids), repr(text[:k])


def naive_chunks(size, text):
    """The definition, with every prefix counted from the start."""
    out, start = [], 0
    while start < len(text):
        low, high = start + 1, min(start + wordpiece.RUNES, len(text))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(text[start:middle]) + 2 <= wordpiece.TOKENS else (low, middle - 1)
        end = low
        if end < len(text):
            for n in range(end, start + (end - start) * 3 // 4, -1):
                if text[n - 1].isspace():
                    end = n
                    break
        if text[start:end].strip():
            out.append((len(text[:start].encode()), len(text[:end].encode()), text[start:end]))
        if end == len(text):
            break
        start = end - 32 if end - 32 > start else end
    return out


def test_passages_are_the_longest_that_fit(spark, monkeypatch):
    own, rng = wordpiece.WordPiece(VOCABULARY), random.Random(7)
    size = lambda t: wordpiece.WordPiece.sizes(own, t)[-1]
    texts = [text_of(rng, 900), "漢" * 700, "z" * 5000, " " * 3000, "", "é" * 2100 + " end", "word " * 1000]
    for tokens, runes in ((256, 2048), (20, 100)):
        monkeypatch.setattr(wordpiece, "TOKENS", tokens)
        monkeypatch.setattr(wordpiece, "RUNES", runes)
        for text in texts[: 7 if tokens == 20 else 4]:
            got = own.chunks(text[:1500])
            assert got == naive_chunks(size, text[:1500])
            assert all(size(t) + 2 <= tokens and text[:1500].encode()[a:b] == t.encode() for a, b, t in got)
    monkeypatch.undo()
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", wordpiece.chunks(F.col("t"), VOCABULARY).alias("c")).collect()
    for r in rows:
        assert [tuple(c) for c in r["c"]] == own.chunks(r["t"] or "")


# ---- pruned searches


def test_top_blocks_as_scoring_all(spark, tmp_path):
    rng = random.Random(8)
    bodies = [" ".join(rng.choices(["hot", "seldom", "rare", *(f"w{i}" for i in range(50))], [3, 0.3, 0.02] + [1] * 50, k=int(2 ** rng.uniform(0, 9)))) for _ in range(600)]
    units = spark.createDataFrame([(f"issue:r:{n}", "r", n, "issue", "hot title" if n % 90 == 0 else "", b) for n, b in enumerate(bodies)], "id string, repo string, number long, family string, title string, body string")
    index, tickets = lexical.Index.build(units), units.select("repo", "number")
    store = Store(spark, f"file://{tmp_path}/b").at_state("1", lambda: topk.Blocks.tables(index, size=16))
    blocks, looked, held = topk.Blocks.of(store), 0, 0
    for query, among in (("hot seldom", tickets), ("rare", tickets), ("seldom rare", tickets.where("number % 2 = 0")), ("none", tickets)):
        rows, counts = blocks.top(among, query, k=10)
        want = lexical.search(index, among, query).orderBy(F.desc("score"), "repo", "number").limit(10)
        assert [tuple(r) for r in rows.select("number", "id", "score").collect()] == [tuple(r) for r in want.select("number", "id", "score").collect()]
        looked += counts["read"]
        held += counts["blocks"]
    assert looked < 0.7 * held, (looked, held)


@pytest.mark.parametrize("grouped", [True, False])
def test_top_clusters_as_a_scan(spark, tmp_path, grouped):
    rng = np.random.default_rng(9)
    directions = rng.standard_normal((12, 16))
    vectors = directions[rng.integers(0, 12, 1500)] + 0.15 * rng.standard_normal((1500, 16)) if grouped else rng.standard_normal((1500, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("r", n // 3, "body", n, [float(x) for x in v]) for n, v in enumerate(vectors)] + [("r", 9999, "body", 9999, None)]
    passages = spark.createDataFrame(rows, "repo string, number long, field string, chunk long, vector array<float>")
    store = Store(spark, f"file://{tmp_path}/c").at_state("1", lambda: clusters.Clusters.tables(passages))
    kept = clusters.Clusters.of(store)
    assert kept.passages.count() == 1500
    for query in (vectors[5], rng.standard_normal(16), -vectors[7] * 3):
        rows, counts = kept.top([float(x) for x in query], k=20)
        scan = semantic.passage_scores(passages.where("vector is not null"), [float(x) for x in query]).groupBy("repo", "number").agg(F.max("score").alias("score"))
        assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in semantic.top(scan, n=20).collect()]
        if grouped and query is vectors[5]:
            assert counts["looked_at"] < 0.5 * counts["passages"], counts
    assert clusters.Clusters.tables(passages.limit(0))["clusters"].count() == 0
