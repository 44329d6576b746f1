"""Each operator against a brute-force version, and the odd tables that it must stand."""

import hashlib
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm import components, decontaminate, fingerprint, html, language, mixing, neardup, pii, quality, urls, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, bucket int, n long, label string"


def docs_of(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s" if i and i % 2 else None, len(t or ""), "x", 1, 2, "y") for i, t in texts], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


LONG = "alpha beta gamma delta " * 40000
ODD = [(None, "no id at all"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, "!!! ???"), (7, "zwölf Boxkämpfer 😀 jagen"), (8, "one")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def run(df):
    return df.toPandas()


# ---- near duplicates


def groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        n = min(width, len(w))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    best = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return best, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, documents, width):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    family = []
    for k in range(60):  # a family around the threshold, longer than a short list
        w = list(base)
        for at in rng.choice(300, size=int(rng.integers(1, 26)), replace=False):
            w[at] = f"x{k}_{at}"
        family.append((10_000 + k, " ".join(w)))
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()] + family
    best, sizes = groups(rows, width, 80)
    out = run(neardup.near_duplicates(docs_of(spark, rows), width, 80)).set_index("doc_id")
    assert {i: out.loc[i, "component_id"] for i in best} == best
    assert {i: out.loc[i, "n_shingles"] for i in best} == sizes
    assert (out["kept"] == (out.index == out["component_id"])).all()


def test_near_duplicates_of_odd_rows(spark):
    out = run(neardup.near_duplicates(docs_of(spark, ODD), 2, 80))
    assert len(out) == len(ODD)
    of = {r.doc_id: r for r in out.itertuples() if r.doc_id == r.doc_id}
    assert of[4].component_id == of[8].component_id == 4 and not of[8].kept
    assert of[1].n_shingles == of[2].n_shingles == of[3].n_shingles == 0 and of[3].component_id == 3
    assert run(neardup.near_duplicates(docs_of(spark, []), 2, 80)).empty


def test_links_of_mixed_lists_connect_what_brute_force_does(spark, documents, monkeypatch):
    """Each document as a component of its own, and groups of a few rows, so that bands, salts and parts all matter."""
    monkeypatch.setattr(neardup, "RUN", 8)
    monkeypatch.setattr(neardup, "CHUNK", 512)
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in documents.where("doc_id < 120").select("doc_id", "text").collect()]
    for k in range(60):  # lengths and words both vary, so that sizes fall in several bands
        w = [f"w{i}" for i in range(300)][: int(rng.integers(150, 301))]
        for at in rng.choice(len(w), size=int(rng.integers(0, 12)), replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((10_000 + k, " ".join(w)))
    best, _ = groups(rows, 2, 80)
    docs = docs_of(spark, rows).select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    signed = docs.mapInPandas(neardup._signed(2), "doc_id long, th long, n_shingles long, set_key binary, sig binary").where("sig is not null")
    sigs = signed.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sig")
    rest = signed.select("doc_id", "n_shingles", "sig").mapInPandas(neardup._tokens, "doc long, size long, token long").select("token", "doc", F.col("doc").alias("label"))
    links = neardup._exact_links(rest, sigs, sigs.select("doc", "n"), neardup.Sets(docs.select("doc_id", "text")), 2, 80)
    found = {r["node"]: r["label"] for r in components.connected_components(links).collect()}
    assert {i: found.get(i, i) for i in best} == best and len(found) > 30


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501), (700, 700)], "a long, b long")
    out = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert {out[i] for i in range(1, 201)} == {1} and out[501] == 500 and out[700] == 700


def test_merged_components_equal_those_of_all_links(spark):
    first = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    more = spark.createDataFrame([(4, 6), (2, 9), (7, 8), (1, 2)], "a long, b long")
    found = components.connected_components(first)
    out = {(r["node"], r["label"]) for r in components.merged_components(found, more).collect()}
    assert out == {(r["node"], r["label"]) for r in components.connected_components(first.union(more)).collect()}
    assert components.merged_components(found, first) is found


# ---- contamination


def hits(text, items, span=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, got = word.findall(lower(text)), set(), set()
    for i, t in items:
        x = word.findall(lower(t))
        n = min(span, len(x))
        windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
        for j in range(len(w)):
            if tuple(w[j : j + n]) in windows:
                hit |= set(range(j, j + n))
                got.add(str(i))
    return len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_matches_brute_force(spark):
    words = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "tiny item here"), (3, None), (4, ""), (5, "rep " * 20), (6, " ".join(words[10:30])), (10, "solo")]
    texts = ODD + [
        (20, "start " + " ".join(words[5:18]) + " end"), (21, "start " + " ".join(words[5:17]) + " end"), (22, "a TINY Item here b tiny item here"),
        (23, "rep " * 15), (24, "x " * 300 + " ".join(words[12:26])), (25, " ".join(words) + " " + " ".join(words)), (26, "solo-solo"), (27, "rep rep"),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, th string")
    out = decontaminate.contamination(docs_of(spark, texts), bench).collect()
    want = sorted((repr(i), *hits(t, items)) for i, t in texts)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out) == want
    none = decontaminate.contamination(docs_of(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)


# ---- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}.get(kind, True)
            if good and (kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))):
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_base_spans_match_brute_force(spark, documents):
    texts = ODD + [
        (30, "é😀 a.b@c.d_x@y.z 1.2.3.4.5 256.1.1.1 000255.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999."), (31, "@ a@b a@b. a@b..c"), (32, "9" * 30000 + " " + "a." * 20000 + "@x.y"),
        (33, "+49 30 1234567890 4-1-1-1-1111 1111 1111 1"), (34, "1.2.3.4" * 5), (35, "a@" + "b." * 20000 + "c"),
    ]
    rows = docs_of(spark, texts).select("doc_id", "text").union(documents.select("doc_id", "text"))
    found = pii.personal_data(rows).select("doc_id", "th", F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("b"))
    got = sorted((repr(r["doc_id"]), r["b"]) for r in found.collect())
    assert got == sorted((repr(r["doc_id"]), base(r["text"])) for r in rows.collect())


def test_terms_that_disclose_are_generalised(spark):
    told = [(i, f"Contact Quixwell via quix@mail.example today {i} the end") for i in range(5)]
    rest = [(100 + i, f"the end of today is via contact number n{i}") for i in range(60)]
    out = {r["doc_id"]: r for r in pii.personal_data(docs_of(spark, told + rest)).collect()}
    kinds = {told[0][1][s["start"] : s["end"]]: s["kind"] for s in out[0]["spans"]}
    assert kinds["quix@mail.example"] == "email" and kinds["Quixwell"] == "term" and "today" not in kinds
    assert not any(out[100 + i]["spans"] for i in range(60))
    text = docs_of(spark, told[:1]).select("text").crossJoin(pii.personal_data(docs_of(spark, told + rest)).where("doc_id = 0").select("spans"))
    assert "[EMAIL]" in text.select(pii.redacted("text", "spans").alias("x")).first()["x"] and "Quixwell" not in text.select(pii.redacted("text", "spans").alias("x")).first()["x"]


def test_rare_words_disclose_nothing(spark):
    """Neither a word that stands beside an entity once, nor copies of one text, are evidence."""
    rows = [(1, "Xandertop " + "the end of today is via contact number " * 5 + "one@mail.example"), (2, "Twinword asks two@mail.example"), (3, "Twinword asks two@mail.example"), (4, "Twinword asks two@mail.example")]
    rest = [(100 + i, f"the end of today is via contact number n{i}") for i in range(96)]
    found = pii.personal_data(docs_of(spark, rows + rest)).collect()
    assert {s["kind"] for r in found for s in r["spans"]} == {"email"}


def counted_terms(rows, threshold=0.8):
    """Disclosing terms by plain counting."""
    terms = [{w.lower() for w in re.findall(r"[^\W_]{3,}", t or "")} for _, t in rows]
    named = [{(t or "")[int(a) : int(b)].lower() for _, a, b in (x.split(":") for x in base(t))} for _, t in rows]
    total, out = len(rows), set()
    for entity in set().union(*named):
        has = [entity in n for n in named]
        n_c = sum(has)
        if n_c == total:
            continue
        for term in set().union(*(t for t, h in zip(terms, has, strict=True) if h)):
            both = [t for (_, t), w, h in zip(rows, terms, has, strict=True) if h and term in w]
            n_t = sum(term in w for w in terms)
            p = (len(both) + n_c / total) / (n_t + 1)
            if len(set(both)) >= pii.SUPPORT and p >= pii.MAJORITY and np.log(p * total / n_c) / np.log(total / n_c) >= threshold:
                out.add(term)
    return out


def test_disclosing_terms_as_counted_and_wherever_they_stand(spark):
    """Planted: each of six entities has a name of its own in most of its documents, which stands in two documents without it as
    well. All names are found there too, and no other word."""
    rng, rows, names = np.random.default_rng(12), [], [f"Zorblax{c}" for c in "abcdef"]
    fill = lambda n: " ".join(rng.choice([f"word{i}" for i in range(40)], n))
    for k, name in enumerate(names):
        rows += [(100 * k + i, f"{fill(12)} {name} rare{k}x{i} person{k}@mail.example {fill(5)}") for i in range(9)]
        rows += [(100 * k + 50 + i, f"{fill(9)} {name} went home alone{k}{i} {fill(4)}") for i in range(2)]
    rows += [(1000 + i, f"{fill(20)} unique{i}") for i in range(200)] + [(2000, None), (2001, "")]
    want = counted_terms(rows)
    assert want >= {n.lower() for n in names} and len([w for w in want if not w.startswith("zorblax")]) <= 12
    texts, found = dict(rows), pii.personal_data(docs_of(spark, rows)).collect()
    got = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]].lower()) for r in found for s in r["spans"] if s["kind"] == "term"}
    held = {(i, w.lower()) for i, t in rows for w in re.findall(r"[^\W_]{3,}", re.sub(r"\S+@\S+", " ", t or "")) if w.lower() in want}
    assert got == held and {(100 * k + 50 + i, n.lower()) for k, n in enumerate(names) for i in (0, 1)} <= got
    for broadcast in (pii.SPANS, 0):
        pii.SPANS, before = broadcast, pii.SPANS
        try:
            clean = {r["doc_id"]: r for r in pii.sanitised(docs_of(spark, rows)).collect()}
        finally:
            pii.SPANS = before
        assert len(clean) == len(rows) and not any(n in (r["text"] or "") for r in clean.values() for n in names)
        assert all(clean[i]["text"] == t and clean[i]["n_chars"] == len(t or "") for i, t in rows if i >= 1000)
        assert clean[50]["text"].count("[TERM]") >= 1 and clean[50]["n_chars"] == len(clean[50]["text"])


# ---- learned operators


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = run(quality.scored(docs.select("doc_id", "text"), quality.learn(docs, labels.where(~held))).join(labels, "doc_id").where(held))
    assert (out["predicted"] == out["quality"]).mean() > 0.95 and out["score"].between(0, 1).all()


def test_learned_operators_on_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    out = run(quality.scored(docs, quality.learn(docs, labels)))
    assert len(out) == len(ODD) and out["score"].between(0, 1).all() and "label" in out
    assert (run(quality.scored(docs, quality.learn(docs, labels.limit(0))))["score"] == 0.5).all()
    langs = run(language.identified(docs, language.learn(docs)))
    und = set(langs.loc[langs["lang_pred"] == "und", "doc_id"].dropna().astype(int))
    assert und == {1, 2, 3, 6} and langs["score"].between(0, 1).all()
    assert (run(language.identified(docs, {}))["lang_pred"] == "und").all()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = run(language.identified(docs.where(held), language.learn(docs.where(~held))))
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95


# ---- WARC


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, sha1 string, chunk int")


PAGES = [(3, "http://a/x", "same"), (1, "http://a/y", "same"), (2, None, None), (4, "http://b/", ""), (5, "http://c/", "é" * 150_000), (6, "http://c/2", "é" * 150_000), (7, "http://d\n/", "z"), (7, "http://d\n/", "z"), (None, "http://e", "same")]


def test_warc_round_trip(spark, tmp_path):
    archive = warc.archived(pages_of(spark, PAGES), chunk=1 << 12)
    out = warc.restored(archive).collect()
    assert len(out) == len(PAGES)
    of = {r["page_id"]: r for r in out}
    assert (of[1]["record_type"], of[3]["record_type"], of[3]["refers_to"], of[None]["refers_to"]) == ("response", "revisit", 1, 1)
    assert of[4]["refers_to"] == 2 and of[4]["payload_bytes"] == 0 and of[6]["refers_to"] == 5 and of[5]["payload_bytes"] == 300_000
    assert of[7]["record_type"] == "response" and archive.where("length(data) > 4096").isEmpty()
    warc.export_files(archive, str(tmp_path))
    again = warc.restored(warc.read_files(spark, [str(p) for p in tmp_path.glob("*.warc")], 1 << 12))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out))
    assert run(warc.restored(warc.archived(pages_of(spark, [])))).empty


# ---- mixing


def test_targets_share_what_is_over():
    t = mixing.targets({"a": 10, "b": 1000, None: 100, "c": 0})
    assert t["a"] == 20 and t["c"] == 0 and abs(sum(t.values()) - 1.5 * 1110) < 1e-6 and all(t[s] <= 2 * n for s, n in {"a": 10, "b": 1000, None: 100}.items())


def test_mixture_comes_near_its_targets(spark, documents):
    out = run(mixing.mixed(documents))
    again = run(mixing.mixed(documents))
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, out[key].values)) == sorted(map(tuple, again[key].values))
    out["taken"] = out["size"] * out["copies"]
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), largest=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["largest"] + 1e-6).all() and out["copies"].max() <= 2
    odd = run(mixing.mixed(docs_of(spark, ODD)))
    assert len(odd) == len(ODD) and (odd["copies"] * odd["size"] <= 2 * odd["size"]).all()
    assert run(mixing.mixed(docs_of(spark, []))).empty


# ---- urls


def test_url_rules_and_list(spark):
    rows = [
        (1, "https://X.Example.NET/en/1?q#f"), (2, "http://example.net"), (3, "http://a.net/de/"), (4, "http://notnet/x"), (5, "http://w.example.com/de/5"), (6, None), (7, "no scheme"),
        (8, "http://m.spam-farm.example.org/en/1"), (9, "http://m.spam-farm.example.org/fr/1"), (10, "http://x.org?/fr/"), (11, "http://a\nb.net/en\n/"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, verdict string")
    of = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert of[1] == ("x.example.net", "/en/1", "example.net/en/", "allow") and of[2] == ("example.net", "", None, "allow") and of[3][2:] == ("net/", "block")
    assert of[4][2:] == (None, "allow") and of[5][2:] == ("example.com/de/", "block") and of[6] == of[7] == ("", "", None, "allow")
    assert of[8][2:] == (None, "block") and of[9][2:] == ("org/fr/", "allow") and of[10] == ("x.org", "", None, "allow") and of[11][:2] == ("a\nb.net", "/en\n/")


def test_listed_names_under_any_domain(spark):
    hosts = ["m.casino-win.example.com", "ads-track.example.org", "FREE-BETS.new.test", "notfree-bets.example.com", "free-bets-news.org", "example.com"]
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    of = {r["page_id"]: (r["verdict"], r["listed"]) for r in urls.judged(pages).collect()}
    assert of == {0: ("block", "casino-win.example.com"), 1: ("block", "ads-track.example.org"), 2: ("block", "free-bets.new.test"), **dict.fromkeys((3, 4, 5), ("allow", None))}
    assert {r["verdict"] for r in urls.judged(pages, blocklist=["nowhere.test"]).collect()} == {"allow"}


def test_digest_array_confirms_strings(tmp_path):
    urls.DigestArray.build(str(tmp_path), "t", {"a.example": 1, "b.example": 2})
    got = urls.DigestArray(str(tmp_path), "t")
    assert got.probe([b"a.example", b"c.example", b"b.example"]).tolist() == [1, -1, 2]
    got.text = np.array(got.text)
    got.text[0] ^= 1  # as if another string had the same digest
    assert (got.probe([b"a.example", b"b.example"]) == -1).sum() == 1


# ---- fingerprints


def test_fingerprints_in_order(spark, documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(documents).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        assert out[i]["fingerprint"] == fingerprint.shown(fingerprint.fingerprint(t))
    odd = fingerprint.fingerprints(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in odd)
    assert fingerprint.fingerprints(docs_of(spark, [])).collect() == []
    assert fingerprint.fingerprints(docs_of(spark, [(1, "alone")])).first()["near_next"] == 1


def test_chunks_find_their_place_after_an_insertion():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(2000))
    moved = text[:3000] + "INSERTED" + text[3000:]
    assert fingerprint.containment(fingerprint.fingerprint(text), fingerprint.fingerprint(moved)) > 0.95
    ends = fingerprint.boundaries(text.encode())
    assert ends[-1] == len(text) and all(b - a <= fingerprint.MOST for a, b in zip([0, *ends], ends, strict=False))


# ---- html


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu</nav><div class='cookie-notice'>We</div><script>var a='</p>'</script>"
        "<main><article><h1>Head &amp; tail</h1><p>One\n <b>two</b><br>three<p>Four &lt;x&gt;<div class=ad>Buy</div><ul><li>a</li><li>b</li></ul><form>f</form><!-- c --></article>"
        "<section id=comments><p>Reader</p></section></main><aside>side</aside><footer>foot</footer></body></html>"
    )
    assert html.main_text(html.blocks(page), None) == "Head & tail\nOne two three\nFour <x>\na\nb"
    assert html.main_text(html.blocks(""), None) == ""


class Article(HTMLParser):
    """Brute force: the text of everything between article tags, a line a block element."""

    def __init__(self):
        super().__init__()
        self.open, self.lines = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.open += tag == "article"
        if tag == "br":
            self.lines[-1] += " "
        elif tag in html.BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in html.BLOCKS:
            self.lines.append("")
        self.open -= tag == "article"

    def handle_data(self, data):
        if self.open:
            self.lines[-1] += data


def test_articles_match_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        want[r["page_id"]] = "\n".join(x for x in (" ".join(line.split()) for line in parser.lines) if x)
    out = {r["page_id"]: r["text"] for r in html.main_texts(pages).collect()}
    assert out == want


def test_the_marked_element_with_the_own_lines_is_the_article():
    def page(*articles):
        return html.blocks("<nav>menu</nav>" + "".join(f"<article>{''.join(f'<p>{x}</p>' for x in a)}</article>" for a in articles))

    teaser, licence = ["Read our latest offers today and tomorrow", "All of them in one long list"], "Licence line that articles share"
    own = page(teaser, ["Own head", licence, "Own words of the article that are long enough here"])
    other = [b[0] for b in page(teaser, ["Other", licence])]
    assert html.main_text(own, other).split("\n") == ["Own head", licence, "Own words of the article that are long enough here"]
    assert html.main_text(page(teaser), [b[0] for b in page(teaser)]).split("\n") == teaser  # a copy


def test_shared_lines_go_where_nothing_is_marked(spark):
    rows = [(i, f"http://h/{i}", f"<p>Menu line</p><p>Own {i}</p><p>Base line</p>") for i in range(5)] + [(9, None, None), (10, "http://solo/", "<p>all</p>")]
    out = {r["page_id"]: r["text"] for r in html.main_texts(pages_of(spark, rows)).collect()}
    assert out == {i: f"Own {i}" for i in range(5)} | {9: "", 10: "all"}
    twins = [(1, "http://h/a", "<p>Same</p>"), (1, "http://h/a", "<p>Same</p>")]
    assert [r["text"] for r in html.main_texts(pages_of(spark, twins)).collect()] == ["Same", "Same"]
    assert html.main_texts(pages_of(spark, [])).collect() == []


def test_common_is_a_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(2))
        best = defaultdict(int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i, j] = best[i - 1, j - 1] + 1 if a[i] == b[j] else max(best[i - 1, j], best[i, j - 1])
        got = html.common(a, b)
        assert len(got) == best[len(a) - 1, len(b) - 1]
        it = iter(b)
        assert all(a[i] in it for i in sorted(got))


# ---- pipeline


def test_one_row_stays_of_each_group(spark):
    t, other = "one two three four five six seven", "quite another text of eight words for once"
    rows = [(4, t), (4, t), (9, t), (None, t), (None, other), (None, other), (5, None), (5, None), (6, " "), (4, "a version of four that is not alike at all")]
    out = corpus_pipeline.minhash_near_dedup(spark, docs_of(spark, rows), DATA).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=repr)
    assert got == sorted([(4, t), (None, other), (5, None), (6, " "), (4, "a version of four that is not alike at all")], key=repr)


def test_contaminated_rows_go_by_their_text(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(None, item), (None, "clean words"), (1, item), (1, "clean words"), (2, None), (3, "")]
    out = corpus_pipeline.benchmark_decontamination(spark, docs_of(spark, rows), DATA).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted([(None, "clean words"), (1, "clean words"), (2, None), (3, "")], key=repr)


def test_pipeline_decisions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], DATA).cache())
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert all(s.columns == docs.columns for s in steps[:-1])
    first = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    best, _ = groups(first, 5, 80)
    assert ids[2] == set(best.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ids[3] == {r["doc_id"] for r in steps[2].collect() if not hits(r["text"], items)[4]}
    assert ids[4] == ids[3] and not any(base(r["text"]) for r in steps[4].collect())
    odd = docs_of(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, DATA)
        odd.count()
