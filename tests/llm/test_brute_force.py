"""Learned, sampled and text operators against naive versions; pages, samples and copies that used to go wrong."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm import fingerprint, html, language, mixing, quality
from loomery.llm.common import WordHashes
from loomery.llm.queries import op7_source_mixing

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, copy int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7) for i, t, s in rows], DOCS)


# ---- quality


def naive_score(text, weights):
    """Every feature one by one, with Python's integers."""
    import xxhash

    mask, bits = 2**64 - 1, quality.BITS

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = text.split()
    if not words:
        return 0.5
    found, padded = [], b" " + text + b" "
    for n in quality.CHARS:
        for j in range(len(padded) - n + 1):
            h = n
            for b in padded[j : j + n]:
                h = (h * 257 + b) & mask
            found.append((h * 0x9E3779B97F4A7C15 & mask) >> 64 - bits)
    h = [xxhash.xxh64_intdigest(w) for w in words]
    found += [mix(x) >> 64 - bits for x in h]
    pairs = [mix((a * 31 + b) & mask) for a, b in zip(h, h[1:], strict=False)]
    found += [x >> 64 - bits for x in pairs]
    if len(h) > 1:
        same, again, seen = sum(a == b for a, b in zip(h, h[1:], strict=False)), len(pairs) - len(set(pairs)), len(h) - len(set(h))
        for mark, times in ((11, 4 * same), (12, 4 * again), (13, seen), (14, len(h) - seen)):
            found += [mix(mark) >> 64 - bits] * times
    z = sum(float(weights[f]) for f in found) / len(found)
    return 1 / (1 + np.exp(-z))


def test_scores_of_fixed_weights_as_brute_force():
    model = quality.Model(np.random.default_rng(1).standard_normal(1 << quality.BITS).astype(np.float32))
    for text in (b"", b" ", b"one", b"one one", "Grüße an alle alle alle".encode(), b"a b a b a b\nc", b"x" * 500, b"spam spam " * 40):
        assert abs(model.score(text, WordHashes()) - naive_score(text, model.weights)) < 1e-5


def test_counts_beyond_two_bytes_count(spark):
    """A text that has one feature more than 65,535 times teaches what a text of the same shares does."""
    short, long = quality.fit([b"aa " * 10, b"good words here"], [0, 1]), quality.fit([b"aa " * 100_000, b"good words here"], [0, 1])
    for text in (b"aa aa aa", b"good words"):
        assert abs(short.score(text, WordHashes()) - long.score(text, WordHashes())) < 0.05


def test_a_long_text_does_not_empty_the_sample(spark):
    rows = [(i, f"bad bad bad {i}" if i % 2 else f"fine words of number {i}", "s") for i in range(30)] + [(100 + i, "z" * (quality.TEXT_BYTES + 1), "s") for i in range(20)]
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i, *_ in rows], "doc_id long, quality int")
    assert np.abs(quality.learn(docs_of(spark, rows), labels).weights).max() > 0
    assert not quality.learn(docs_of(spark, rows[30:]), labels).weights.any()


# ---- language


def test_nearest_is_the_least_out_of_place_sum():
    texts = {"de": "der Hund und die Katze sind im Haus", "en": "the dog and the cat are in the house", "xx": "zzz qqq"}

    def ranked(text):
        spaced = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        found = Counter(spaced[j : j + n] for n in (1, 2, 3) for j in range(len(spaced) - n + 1))
        found.pop(" ")
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return [code(g) for g in sorted(found, key=lambda g: (-found[g], code(g)))][: language.TOP]

    profiles = {k: np.array(ranked(v), np.int64) for k, v in texts.items()}
    order = [(k, np.sort(v), np.argsort(v)) for k, v in sorted(profiles.items())]
    for text in ("die Katze", "a house in the rain", "Q!", "ÄÖÜ ß", "z" * 50, *texts.values()):
        own = ranked(text)
        far = {k: sum(abs(v.tolist().index(g) - i) if g in v else language.TOP for i, g in enumerate(own)) for k, v in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert language.nearest(text, order) == (best, pytest.approx(max(0, 1 - far[best] / (language.TOP * len(own)))))


# ---- mixing


def test_draws_are_those_of_a_plain_prefix_sum(spark):
    """Within a source, by size: the number taken of each size is what the prefix sum crosses there, whoever is first among
    equals; each document gets one of the two nearest whole numbers."""
    import xxhash

    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    aim, got = mixing.targets(dict(sizes)), {r["doc_id"]: r for r in op7_source_mixing(spark, DATA).collect()}
    for source in sizes:
        own = sorted(n for _, s, n in rows if s == source)
        rate, at = aim[source] / sizes[source], xxhash.xxh64_intdigest(f"{mixing.SEED}:{source}") / 2.0**64
        want = Counter()
        for i, n in enumerate(own):
            want[n] += n * (int((i + 1) * rate + at) - int(i * rate + at))
        taken = Counter()
        for i, s, n in rows:
            if s == source:
                taken[n] += got[i]["taken"]
                assert n == 0 or got[i]["taken"] // n in (int(rate), int(rate) + 1)
        assert +taken == +want


def test_copies_of_repeated_rows_add_up(spark, monkeypatch):
    """Rows alike in id, text and source are taken as often in all as the mixture says, however they are dealt into runs."""
    monkeypatch.setattr(mixing, "RUN", 2)
    rows = [(1, "a b c", "s")] * 3 + [(1, "a b c", "t")] * 2 + [(None, "a b", None)] * 4 + [(2, "x y z w", "s"), (3, None, "s"), (3, None, "s"), (4, "only here", "u")]
    docs = docs_of(spark, rows)
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got, copies = Counter(), defaultdict(list)
    for r in corpus_pipeline.source_mixing(spark, docs, DATA).collect():
        key = r["doc_id"], r["source"], len((r["text"] or "").split())
        got[key] += 1
        copies[key].append(r["copy"])
    assert got == +want and sum(want.values()) > len(rows)
    for key, each in copies.items():
        n = rows.count(next(r for r in rows if (r[0], r[2], len((r[1] or "").split())) == key))
        assert sorted(each) == [c for c in range(1, len(each) + 1) for _ in range(min(n, len(each) - (c - 1) * n))][: len(each)]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_stand_empty_tables_and_repeats(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, docs_of(spark, []), DATA).collect() == []
    rows = [(1, "mail me: a@b.org or not", "s")] * 2 + [(None, None, None)] * 2 + [(2, "", "s"), (5, "alpha beta gamma delta " * 30000, "s")]
    out = run(spark, docs_of(spark, rows), DATA)
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
    got = out.collect()
    if stage != "source_mixing":
        assert all(r["doc_id"] in (1, 2, 5, None) for r in got) and len(got) <= len(rows)
    if stage == "personal_data":
        assert Counter(r["text"] for r in got if r["doc_id"] == 1) == {"mail me: [EMAIL] or not": 2} and len(got) == len(rows)
    if stage == "minhash_near_dedup":
        assert Counter((r["doc_id"], (r["text"] or "")[:4]) for r in got) == {(1, "mail"): 1, (None, ""): 1, (2, ""): 1, (5, "alph"): 1}
    if stage == "benchmark_decontamination":
        assert len(got) == len(rows)


# ---- fingerprints


def naive_boundaries(data):
    """One rolling hash byte by byte."""
    gear, ends, start = [int(g) for g in fingerprint._GEAR], [], 0
    hashes, h = [], 0
    for b in data:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        hashes.append(h)
    while len(data) - start > fingerprint.LEAST:
        for end in range(start + fingerprint.LEAST, min(len(data), start + fingerprint.MOST) + 1):
            zero = fingerprint.STRICT if end - start <= fingerprint.NORMAL else fingerprint.LOOSE
            if hashes[end - 1] >> 32 - zero == 0:
                break
        start = end
        ends.append(end)
    return ends + ([len(data)] if start < len(data) else [])


def test_boundaries_and_likeness_as_brute_force(spark):
    import xxhash

    rng = np.random.default_rng(6)
    for data in (b"", b"a" * 15, b"a" * 700, rng.bytes(5000), bytes(rng.integers(97, 123, 20000, np.uint8)), b"ab" * 3000):
        assert fingerprint.boundaries(data) == naive_boundaries(data)

    def chunks(text):
        data, out, start = text.encode(), {}, 0
        for end in naive_boundaries(data):
            out[xxhash.xxh64_hexdigest(data[start:end])] = end - start
            start = end
        return out

    like = lambda a, b: sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    for k, (i, text) in enumerate(rows[:60]):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        p, q, r = chunks(text), chunks(text[: len(text) - half] + after[:half]), chunks(after)
        assert got[i]["fingerprint"] == ",".join(f"{d}:{n}" for d, n in p.items())
        assert got[i]["near_edited"] == pytest.approx(like(p, q)) and got[i]["near_next"] == pytest.approx(like(p, r))


# ---- pages


def test_names_about_a_subject_stay_in_the_article():
    page = (
        "<article><p>Start</p><div class='share-price'>Price</div><section id='related-work'>Work</section><div class='search-engine notice-period'>Engine</div>"
        "<div class='share-buttons'>Share!</div><div class='ad'>Buy</div><section id=comments>Reader</section><div class='col social'>Follow</div><p>End</p></article>"
    )
    assert html.main_text(html.blocks(page), None) == "Start\nPrice\nWork\nEngine\nEnd"


@pytest.mark.parametrize("page", ["<a '" * 250_000, '<a =">"' * 150_000, "<!" * 500_000, '<a x="b" ' * 100_000 + '<a =">"', "<a class='" * 100_000 + ">", "<" * 1_000_000, "</script" * 125_000, "<a =\"'" * 160_000, "<!--" * 250_000])
def test_pages_of_open_ends_take_time_by_their_length(page):
    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 5


def test_open_ends_lose_no_more_than_a_tag():
    text = lambda page: [b[0] for b in html.blocks(page)]
    assert text('<p>a</p><p class="x>b</p><p>c</p>') == ["a", "b", "c"]
    assert text("<p title='a>b'>c</p>") == ["c"] and text("<p title=a'b>c</p><p d='>'>e</p>") == ["c", "e"]
    assert text("a < b <3 <p>c</p> x <") == ["a < b <3", "c", "x <"] and text("<SCRIPT>a</p></Script >b") == ["b"]
    assert text("a<!-- <p> -->b<!d>c<?x y?>d</ >e") == ["abcde"] and text("<textarea>never closed") == []


def test_common_of_long_lists_takes_memory_by_their_sum(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(8)
    a, b = ([str(x) for x in rng.integers(0, 3000, 12_000)] for _ in range(2))
    whole = len(html.common(a, b))
    monkeypatch.setattr(html, "_KEPT", 1 << 21)
    tracemalloc.start()
    assert len(html.common(a, b)) == whole
    assert tracemalloc.get_traced_memory()[1] < 16e6
    tracemalloc.stop()
    for kept in (1, 50):
        monkeypatch.setattr(html, "_KEPT", kept)
        for _ in range(200):
            a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 14))] for _ in range(2))
            best = defaultdict(int)
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i, j] = best[i - 1, j - 1] + 1 if a[i] == b[j] else max(best[i - 1, j], best[i, j - 1])
            got = sorted(html.common(a, b))
            it = iter(b)
            assert len(got) == best[len(a) - 1, len(b) - 1] and all(a[i] in it for i in got)


# ---- urls


def test_lists_of_hosts_and_urls_as_brute_force(spark, monkeypatch):
    from loomery.llm import urls

    rng = np.random.default_rng(13)
    names = ["a", "b", "shop", "example", "spam-farm"]
    hosts = [".".join([*rng.choice(names, rng.integers(0, 3)), rng.choice(["com", "org", "net"])]) for _ in range(300)]
    paths = ["", "/", "/x", "/x/y", "/de/1"]
    pages = [(i, f"http://{h}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}") for i, h in enumerate(hosts)] + [(900, None), (901, "no scheme"), (902, "https://"), (903, "http://EXAMPLE.com/x"), (903, "http://EXAMPLE.com/x")]
    keys = [*rng.choice(hosts, 12), *(h + p for h, p in zip(rng.choice(hosts, 12), rng.choice(paths[1:], 12), strict=True)), "example.com/x", "", None, "a", "a"]
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, key string, part int")
    held = {k for k in keys if k}
    parts = urls.judged(frame, None, [], []).collect()
    want = []
    for r in parts:
        labels = r["host"].split(".") if r["host"] else []
        tries = ([r["host"] + r["path"]] if labels else []) + [".".join(labels[k:]) for k in range(len(labels))]
        hit = next((t for t in tries if t in held), None)
        want.append((r["page_id"], r["rule"], r["verdict"] if r["rule"] else "block" if hit else "allow", hit))
    assert sum(w[3] is not None for w in want) > 20
    for size in (urls.PART, 7):
        monkeypatch.setattr(urls, "PART", size)
        got = urls.listed(frame, spark.createDataFrame([(k, 5) for k in keys], "key string, place int")).collect()
        assert sorted(((r["page_id"], r["rule"], r["verdict"], r["listed"]) for r in got), key=repr) == sorted(want, key=repr)
    assert urls.listed(frame.limit(0), spark.createDataFrame([], "key string")).collect() == []
    assert {r["verdict"] for r in urls.listed(frame.where("page_id = 901"), spark.createDataFrame([], "key string")).collect()} == {"allow"}
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b, **_: 7)  # every digest is equal: strings decide
    array = next(iter(urls._packed(iter([__import__("pandas").DataFrame({"part": [0, 0, 0], "key": ["b", "a", "c"]})]))))
    assert urls._found(__import__("pandas").DataFrame({"key": ["c", "x", "a"]}), array)["key"].tolist() == ["c", "a"]
