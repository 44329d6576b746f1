"""Whitening, baseline JPEG and collocations against brute force, and on odd tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import media, phrases, whitening
from loomery.llm.queries import op12_media_columns

DATA = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 40000


# ---- collocations


def naive_phrases(rows, least, percent=80):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for j in range(len(w) - k + 1):
                    f[lang, tuple(w[j : j + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        around = [b for (g, q), b in found.items() if g == lang and len(q) > len(p) and any(q[j : j + len(p)] == p for j in range(len(q)))]
        if not any(100 * b >= percent * a for b in around):
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


def test_collocations_as_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["The", "cat", "sat", "on", "mat", "über", "x", "日本", "a.b", "é"]
    rows = [(" ".join(rng.choice(words, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03], size=60)), ["en", "de", None][i % 3]) for i in range(40)]
    rows += [("new york city hall\topens; New York City hall", "en")] * 8 + [(None, "en"), ("", None), (" .,\n", "de"), ("one", "und"), (LONG[:2000], "en")] + [("a  b\r\nc" * 9, "und")]
    docs = spark.createDataFrame([(t, lang, i, "x", 1, [i]) for i, (t, lang) in enumerate(rows)], "text string, lang string, a int, phrase string, id int, seq array<int>")
    for blocks in (phrases.BLOCK, 500):
        phrases.BLOCK, before = blocks, phrases.BLOCK
        try:
            got = phrases.collocations(docs.repartition(3), least=8, first=None).collect()
        finally:
            phrases.BLOCK = before
        assert sorted((r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == naive_phrases(rows, 8)
    for lang in ("en", "de", "und"):
        own = sorted((r for r in got if r["lang"] == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [*range(1, len(own) + 1)]
        assert [r["phrase"] for r in own] == [r["phrase"] for r in sorted(own, key=lambda r: (-r["score"], -r["a"], r["phrase"].encode()))]
    few = phrases.collocations(docs, least=8, first=2).collect()
    assert {(r["lang"], r["rank"], r["phrase"]) for r in few} == {(r["lang"], r["rank"], r["phrase"]) for r in got if r["rank"] <= 2}


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, parts = 5_000_000_000_000_000, 10_000_000_000_000_001
    row = spark.createDataFrame([(a, parts)], "a long, p long").select(phrases._score(F.col("a"), F.col("p")).alias("s")).first()
    assert row["s"] == 2_000_000 * a // parts == 999_999


# ---- baseline JPEG


def naive_coefficients(data):
    """A plain decoder, bit by bit, of one image: coefficients of each block in the order of the scans."""
    at, tables, frame, interval, out = 2, {}, None, 0, []
    while data[at + 1] != 0xD9:
        marker, (size,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while body:
                code, k, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                tables[body[0]], body = table, body[k:]
        elif marker == 0xC0:
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            frame = (w, h, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)})
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            own = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            w, h, kinds = frame
            H, V = max(x for x, _ in kinds.values()), max(y for _, y in kinds.values())
            if len(own) == 1:
                x, y = kinds[own[0][0]]
                units, per = -(-(-(-w * x // H)) // 8) * -(-(-(-h * y // V)) // 8), {own[0][0]: 1}
            else:
                units, per = -(-w // (8 * H)) * -(-h // (8 * V)), {i: kinds[i][0] * kinds[i][1] for i, _ in own}
            bits, pred = "", Counter()

            def fill():
                nonlocal at, bits
                if data[at] == 255:
                    assert data[at + 1] == 0
                    at += 1
                    bits += "1" * 8
                    at += 1
                else:
                    bits += f"{data[at]:08b}"
                    at += 1

            def take(n):
                nonlocal bits
                while len(bits) < n:
                    fill()
                got, bits = bits[:n], bits[n:]
                return int(got, 2) if n else 0

            def code(table):
                got = 0
                for length in range(1, 17):
                    got = got * 2 + take(1)
                    if (length, got) in table:
                        return table[length, got]
                raise AssertionError

            extend = lambda v, s: v if not s or v >> (s - 1) else v - (1 << s) + 1
            for u in range(units):
                if interval and u and u % interval == 0:
                    assert data[at] == 255 and data[at + 1] == 0xD0 + (u // interval - 1) % 8
                    at, bits, pred = at + 2, "", Counter()
                for i, t in own:
                    for _ in range(per[i]):
                        block = [0] * 64
                        s = code(tables[t >> 4])
                        pred[i] += extend(take(s), s)
                        block[0], k = pred[i], 1
                        while k < 64:
                            rs = code(tables[16 | t & 15])
                            if rs & 15:
                                k += rs >> 4
                                block[k] = extend(take(rs & 15), rs & 15)
                                k += 1
                            elif rs == 0xF0:
                                k += 16
                            else:
                                break
                        out.append(block)
        else:
            continue
    return np.array(out)


def test_stored_payloads_come_back(spark):
    rng = np.random.default_rng(5)
    texts = [b"", b"a", bytes(range(256)) * 7, rng.bytes(20000), b"\x80" * 700, b"\x80" * 100 + b"a" + b"\x80" * 291, b"\xff" * 384, "Grüße 漢字 😀 ".encode() * 50]
    payloads = [media.padded(t) for t in texts]
    files = media.encoded(payloads)
    for p, f, found in zip(payloads, files, media.decoded(files), strict=True):
        blocks = naive_coefficients(f)
        assert (blocks.reshape(-1)[: len(p)] + 128).astype(np.uint8).tobytes() == p == found["payload"]
        means = np.frombuffer(found["thumbnail"], np.uint8)
        assert (means == np.clip(blocks[::3, 0] + 128, 0, 255)).all() and found["width"] * found["height"] == 64 * len(means)


def picture(coefficients, frame, scans, interval, dc, ac):
    """A file by a plain encoder: scans are lists of (component, order of its blocks)."""
    codes = [media._canonical(t) for t in (dc, ac)]
    out = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([3] * 64)) + media._segment(0xC0, frame) + media._segment(0xC4, media._table(0, dc) + media._table(1, ac))
    out += media._segment(0xDD, struct.pack(">H", interval))
    for ids, units in scans:
        out += media._segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([0, 63, 0]))
        bits, pred = "", Counter()
        close = lambda b: bytes(int((b + "1" * (-len(b) % 8))[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")

        def put(kind, symbol, value, size):
            c, n = codes[kind][symbol]
            return f"{c:0{n}b}" + (f"{value if value >= 0 else value + (1 << size) - 1:0{size}b}" if size else "")

        for u, unit in enumerate(units):
            if interval and u and u % interval == 0:
                out, bits, pred = out + close(bits) + bytes([255, 0xD0 + (u // interval - 1) % 8]), "", Counter()
            for i, b in unit:
                block = coefficients[i][b]
                d, pred[i] = int(block[0]) - pred[i], int(block[0])
                bits += put(0, abs(d).bit_length(), d, abs(d).bit_length())
                run = 0
                for v in map(int, block[1:]):
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + put(1, 0xF0, 0, 0), run - 16
                    s = abs(v).bit_length()
                    bits, run = bits + put(1, run << 4 | s, v, s), 0
                if run:
                    bits += put(1, 0, 0, 0)
        out += close(bits)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("together", [True, False])
def test_subsampled_pictures_with_long_codes(interval, together):
    """4:2:0, odd sizes, differences of means across units, coefficients of 10 bits behind codes of 16."""
    rng = np.random.default_rng(interval)
    w, h = 37, 23  # 3 by 2 units of 16
    wide, high = 6, 4
    luma = np.where(rng.random((high * wide, 64)) < 0.2, rng.integers(-1000, 1000, (high * wide, 64)), 0)
    chroma = [np.where(rng.random((6, 64)) < 0.1, rng.integers(-500, 500, (6, 64)), 0) for _ in range(2)]
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    dc = {4: [*range(12)]}
    ac = {8: [*range(1, 11)], 16: [0x00, 0xF0] + [r << 4 | s for r in range(1, 16) for s in range(1, 11)]}
    if together:
        units = [[(1, (2 * y + b) * wide + 2 * x + a) for b in (0, 1) for a in (0, 1)] + [(2, y * 3 + x), (3, y * 3 + x)] for y in range(2) for x in range(3)]
        scans = [([1, 2, 3], units)]
    else:  # single components go by their own blocks, without those that fill up units
        scans = [([1], [[(1, y * wide + x)] for y in range(3) for x in range(5)]), ([2], [[(2, y * 3 + x)] for y in range(2) for x in range(3)]), ([3], [[(3, y * 3 + x)] for y in range(2) for x in range(3)])]
    data = picture({1: luma, 2: chroma[0], 3: chroma[1]}, frame, scans, interval, dc, ac)
    image = media.parsed(data)
    values, whole = media._decoded(image.scans)
    assert whole.all() and (np.concatenate(values) == naive_coefficients(data)).all()
    small = media._thumbnail(image, values)
    means = luma[:, 0].reshape(high, wide)[:3, :5]
    assert (small == np.clip((means * 3 + 4 >> 3) + 128, 0, 255)).all()


def test_bad_files_have_errors(spark):
    good = media.encoded([media.padded(b"hello" * 100)])[0]
    cut = good[:-40] + b"\xff\xd9"
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    rows = [(1, good, 5), (2, None, 5), (3, b"", 5), (4, b"\x89PNG....", 5), (5, cut, 5), (6, progressive, 5), (7, good[:200], 5), (None, good, 5), (7, good + b"tail", 5)]
    got = media.media_columns(spark.createDataFrame(rows, "id int, media binary, width int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["error"] is None) == (r["payload_sha256"] is not None) == (r["id"] in (1, None) or r["thumbnail"] is not None)
    assert {r["id"] for r in got if r["error"]} == {2, 3, 4, 5, 6, 7}
    for k in range(20, len(good), 7):  # whatever is cut, the rest isn't harmed
        found = media.decoded([good[:k], good])
        assert "error" in found[0] and found[1]["payload"] == media.padded(b"hello" * 100)


def test_media_query_on_every_document(spark):
    got = {r["doc_id"]: r for r in op12_media_columns(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs[:60]:
        raw = (r["text"] or "").encode()
        p, g = media.padded(raw), got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"]) == (len(raw), len(p)) and len(p) % 192 == 0
        assert g["payload_sha256"] == hashlib.sha256(p).hexdigest() and g["tail_crc32"] == zlib.crc32(p[-16:])
        file = media.encoded([p])[0]
        assert (g["media_bytes"], g["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())


# ---- whitening


def as_numpy(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    centred = (x - s // n) - (s % n) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, [sum(int(v) ** 2 for v in row) for row in far], centred, values[::-1], components[:, ::-1]


def test_whitening_as_numpy(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((300, 48)) * np.linspace(1, 3, 48)
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(good)] + [(0, [float(x) for x in good[0]], "x"), (None, [float(x) for x in good[1]], "x")]
    odd = [(900, None, "x"), (901, [float("nan")] * 48, "x"), (902, [None] + [1.0] * 47, "x"), (903, [float("inf")] * 48, "x"), (904, [1.0] * 47, "x"), (905, [], "x"), (906, [1e300] * 48, "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>, component string")
    got = whitening.whitened(frame.repartition(3)).collect()
    _, deviations, centred, values, components = as_numpy([*good, good[0], good[1]])
    assert len(got) == 32 * len(rows) and {r["n"] for r in got} == {len(rows)} and max(r["identity_error"] for r in got) < 1e-9
    want = {(i, c + 1): x for (i, *_), row in zip(rows, centred @ components / np.sqrt(values), strict=True) for c, x in enumerate(row[:32])}
    sign = {}
    for r in got:
        w = want[r["vec_id"], r["component"]]
        if abs(w) > 0.1:
            sign.setdefault(r["component"], np.sign(w) * np.sign(r["whitened"]))
    for r in got:
        assert abs(r["whitened"] * sign[r["component"]] - want[r["vec_id"], r["component"]]) < 1e-6
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
    by_id = {i: d for (i, *_), d in zip(rows, deviations, strict=True)}
    assert all(r["deviation"] == by_id[r["vec_id"]] for r in got)


def test_the_range_finder_serves_where_the_spectrum_falls(spark):
    """Its block is enough for a falling spectrum; a flat one makes it grow. Both give numpy's components."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    falling = rng.standard_normal((400, 80)) * 10000.0 * 0.3 ** np.arange(80) @ turn
    flat = rng.standard_normal((400, 80))
    for data, options, grows in ((falling, {"components": 4, "oversampling": 20, "passes": 8}, False), (flat, {}, True)):
        frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id int, v array<double>")
        fit = whitening.fitted(frame.select(whitening.whole_vectors(F.col("v")).alias("x")), **options)
        _, _, _, values, components = as_numpy(data)
        k = len(fit.values)
        assert (fit.block == 80) == grows and np.allclose(fit.values, values[:k], rtol=1e-9)
        assert np.allclose(np.abs((fit.components * components[:, :k]).sum(axis=0)), 1, atol=1e-9) and fit.identity_error < 1e-8


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in got) == [(1, 1, 192**2), (2, 1, 0), (3, 1, 192**2)]
    huge = [(1, [2.0**46]), (2, [0.0])]  # the square passes a long
    with pytest.raises(Exception, match="[Oo]verflow|too large|int64"):
        whitening.whitened(spark.createDataFrame(huge, schema)).collect()
