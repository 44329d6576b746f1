"""Near-duplicate documents by a signature-coordinate inverted join.

Documents are posted under (coordinate, value) tokens of a MinHash signature of ``K`` coordinates. Two sets with
Jaccard similarity s agree in each coordinate with chance s, so pairs at the similarity threshold collide in at
least ``T`` coordinates but for a chance of 3.3e-7 at 0.8 (a binomial tail), less above it. Prefix merging: tokens
are ordered rarest first over the corpus, and a document is posted only under its first K - T + 1, since two documents
that share T tokens share one of these. Skip merging: tokens that only one document has are counted towards the prefix
but never posted, and posting lists are not merged pair by pair: each is compared with hubs, members that are already
connected are skipped. Lists that still mix components are matched exactly, in groups of bounded size by token, size
band and salt; a pair that shares several such lists is looked at in the first of them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, mix64, near
from .components import connected_components, merged_components

K, T = 64, 34
#: Documents of one posting list that meet in one task, about.
RUN = 1024
#: Rows of many short lists that meet in one task, about.
CHUNK = 8192
_rng = np.random.default_rng(20240131)
_A = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of the whole sequence if it is shorter."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    w = min(width, len(words))
    n = len(words) - w + 1
    s = np.full(n, w, np.uint64)
    for j in range(w):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """K coordinates of 32 bits."""
    best = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(best, (_A[:, None] * s[i : i + 2048][None, :] + _B[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signed(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        hashes = WordHashes()
        for f in frames:
            sets = [shingle_set(t, width, hashes) for t in f["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "th": f["th"],
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [signature(s).tobytes() if len(s) else None for s in sets],
                }
            )

    return run


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at = np.arange(K, dtype=np.int64) << 32
    for f in frames:
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, K)
        ids, sizes = (np.repeat(f[c].to_numpy(), K) for c in ("doc_id", "n_shingles"))
        yield pd.DataFrame({"doc": ids, "size": sizes, "token": (sig.astype(np.int64) + at).ravel()})


def _short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A byte of each coordinate: chance agreement of bytes only adds collisions, so none is lost by it."""
    for f in frames:
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, K).astype(np.uint8)
        yield pd.DataFrame({"doc": f["doc"], "n": f["n"], "sig": [x.tobytes() for x in sig]})


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for f in frames:
        yield pd.DataFrame({"doc": f["doc_id"], "packed": [pack(t) for t in f["text"]]})


class Unpacked:
    """Shingle sets of packed texts. ``of`` remembers them, up to LIMIT shingles at a time; ``fresh`` doesn't."""

    LIMIT = 4_000_000

    def __init__(self, width: int):
        self.width, self.hashes, self.known, self.held, self.unpack = width, WordHashes(), {}, 0, zstandard.ZstdDecompressor().decompress

    def fresh(self, packed: bytes) -> np.ndarray:
        return shingle_set(self.unpack(packed), self.width, self.hashes)

    def of(self, packed: bytes) -> np.ndarray:
        """By the packed bytes, which stand for one text, so rows that share a doc_id aren't confused."""
        if (s := self.known.get(packed)) is None:
            s = self.fresh(packed)
            if self.held + len(s) > self.LIMIT:
                self.known, self.held = {}, 0
            self.known[packed] = s
            self.held += len(s)
        return s


class Sets:
    """Packed texts of the documents whose full sets are needed, each taken once; a set is made again where it is
    compared, since a packed text is a fraction of its set."""

    def __init__(self, docs: DataFrame):
        self.docs, self.known = docs.where("text is not null"), None

    def of(self, ids: DataFrame) -> DataFrame:
        new = ids.distinct() if self.known is None else ids.distinct().join(self.known.select("doc"), "doc", "left_anti")
        new = materialize(new, "new")
        rows = self.docs.join(near(new, new.count()), F.col("doc_id") == F.col("doc"), "left_semi").mapInPandas(_packed, "doc long, packed binary")
        rows = materialize(rows, "texts")
        self.known = rows if self.known is None else self.known.union(rows)
        return self.known


def _linked(sx: np.ndarray, sy: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(sx, sy, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(sx) + len(sy) - both)


def _collided(percent: int):
    """Pairs that collide in T coordinates and whose sizes allow the threshold, with the number of collisions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sa, sb = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(-1, K) for c in ("sig_a", "sig_b"))
            hits = (sa == sb).sum(axis=1)
            keep = (hits >= T) & (100 * f[["n_a", "n_b"]].min(axis=1) >= percent * f[["n_a", "n_b"]].max(axis=1)).to_numpy()
            yield pd.DataFrame({"a": f["a"][keep], "b": f["b"][keep], "hits": hits[keep]})

    return run


def _verified(width: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Unpacked(width)
        for f in frames:
            keep = [_linked(sets.of(x), sets.of(y), percent) for x, y in zip(f["packed_a"], f["packed_b"], strict=True)]
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _links(pairs: DataFrame, sigs: DataFrame, sets: Sets, width: int, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) that collide in T coordinates and reach the threshold on their full sets; ``nearest``: only the
    a of most collisions is tried for each b. Collisions are counted on signatures, so few sets travel."""
    side = lambda x: sigs.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_collided(percent), "a long, b long, hits long")
    if nearest:
        near = near.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a"))
    near = materialize(near.select("a", "b"), "near")
    made = sets.of(near.select(F.col("a").alias("doc")).union(near.select("b")))
    whole = lambda x: made.select(F.col("doc").alias(x), F.col("packed").alias(f"packed_{x}"))
    return materialize(near.join(whole("a"), "a").join(whole("b"), "b").mapInPandas(_verified(width, percent), "a long, b long"), "links")


def _rows(f: pd.DataFrame):
    """Signatures, which coordinates are posted in mixed lists, sizes, documents and components of a group's side."""
    sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, K)
    bits = (f["mask"].to_numpy(np.int64).astype(np.uint64)[:, None] >> np.arange(K, dtype=np.uint64)) & np.uint64(1)
    return sig, bits.astype(bool), f["n"].to_numpy(np.int64), f["doc"].to_numpy(np.int64), f["label"].to_numpy(np.int64)


def _candidates(coordinate: int, odd: pd.DataFrame, rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place in odd, places in rows) of pairs that collide in T coordinates, whose sizes allow the threshold and that
    aren't connected yet. The pair belongs to this list if no coordinate before it is a list that both are in."""
    sa, ma, na, da, la = _rows(odd)
    sb, mb, nb, db, lb = _rows(rows)
    for i in range(len(sa)):
        fits = (la[i] != lb) & (da[i] != db) & (100 * np.minimum(na[i], nb) >= percent * np.maximum(na[i], nb))
        at = np.flatnonzero(fits)
        if len(at):
            same = sb[at] == sa[i]
            shared = same & mb[at] & ma[i]
            at = at[(same.sum(axis=1) >= T) & (shared.argmax(axis=1) == coordinate) & shared.any(axis=1)]
            if len(at):
                yield i, at


_PLACE = ["token", "band", "salt", "part"]


def _groups(odd: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame, pd.DataFrame]]:
    """The groups of one chunk that have both sides."""
    there = rows.groupby(_PLACE).indices
    for key, at in odd.groupby(_PLACE).indices.items():
        if key in there:
            yield key, odd.iloc[at], rows.iloc[there[key]]


def _near_in_group(percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, ...]] = set()
        for key, odd, rows in _groups(left, right):
            docs, others = odd["doc"].to_numpy(), rows["doc"].to_numpy()
            for i, at in _candidates(int(key[0]) >> 32, odd, rows, percent):
                out |= {(*key, int(docs[i])), *((*key, x) for x in others[at].tolist())}
        return pd.DataFrame(sorted(out), columns=[*_PLACE, "doc"]).astype("int64")

    return run


def _links_in_group(width: int, percent: int):
    """Confirmed links of a group, as many as connect it: a pair that links found here connect already is skipped."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets, out, root = Unpacked(width), [], {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for key, odd, rows in _groups(left, right):
            for i, at in _candidates(int(key[0]) >> 32, odd, rows, percent):
                a, la, pa = int(odd["doc"].iat[i]), int(odd["label"].iat[i]), bytes(odd["packed"].iat[i])
                for j in at:
                    b, lb = int(rows["doc"].iat[j]), int(rows["label"].iat[j])
                    if top(la) != top(lb) and _linked(sets.of(pa), sets.of(bytes(rows["packed"].iat[j])), percent):
                        root[top(la)] = top(lb)
                        out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _exact_links(rest: DataFrame, sigs: DataFrame, short: DataFrame, sets: Sets, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components that a posting list of ``rest`` (token, doc, label) mixes, none lost.

    A member of a list is live if the list has another component's member in its size band or a band beside it; the
    rest can't be linked by this list. Of the live, those outside the largest component are compared with all of like
    size. Both sides are dealt into groups of about RUN rows by token, size band and two salts, so neither a hot token
    nor a hot size meets in one task. Signatures join the rows once these have been dealt.
    """
    band = F.floor(F.ln("n") / F.ln(F.lit(100 / percent)))
    rows = rest.select("token", "doc", "label").join(short.select("doc", "n").distinct(), "doc").withColumn("band", band)
    rows = materialize(rows, "members")
    beside = F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1))))
    around = rows.groupBy("token", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    around = around.withColumn("band", beside).groupBy("token", "band").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = materialize(rows.join(around.where("low <> high"), ["token", "band"], "left_semi"), "live")
    # Two documents of one list that could be linked are live in each list they share, so these bits name the same lists.
    mask = rows.groupBy("doc").agg(F.expr("bit_or(shiftleft(1L, int(shiftright(token, 32))))").alias("mask"))
    marked = materialize(sigs.join(mask, "doc"), "marked")

    size = rows.groupBy("token", "label").agg(F.count("*").alias("m"))
    main = size.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("main"), (F.sum("m") - F.max("m")).alias("n_odd"))
    main = materialize(main.withColumn("parts", F.ceil(F.col("n_odd") / RUN)), "main")
    bands = materialize(rows.groupBy("token", "band").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / RUN)).drop("m"), "bands")
    dealt = [*_PLACE, "doc", "label", "n"]
    odd = rows.join(main, "token").where("label <> main").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts")))
    odd = odd.withColumn("band", beside).join(bands, ["token", "band"])
    odd = odd.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(*dealt)
    every = rows.join(bands, ["token", "band"]).withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(2)), F.col("salts")))
    every = every.join(main.select("token", "parts"), "token").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*dealt)

    odd, every = materialize(odd, "odd"), materialize(every, "every")
    chunks = F.lit(max(1, -(-every.count() // CHUNK)))
    odd, every = (x.withColumn("chunk", F.pmod(F.xxhash64(*_PLACE), chunks)) for x in (odd, every))
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both sides of a cogroup need columns of their own
    left, right = (x.join(marked, ["doc", "n"]).select(*x.columns, *fresh("sig", "mask")) for x in (odd, every))
    found = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(_near_in_group(percent), "token long, band long, salt long, part long, doc long")
    found = materialize(found, "near")
    made = sets.of(found.select("doc"))
    again = (x.join(found, [*_PLACE, "doc"], "left_semi").join(marked, ["doc", "n"]).join(made, "doc") for x in (odd, every))
    left, right = (y.select(*x.columns, *fresh("sig", "mask", "packed")) for x, y in zip((odd, every), again, strict=True))
    links = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(_links_in_group(width, percent), "a long, b long")
    return materialize(links, "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose ``width``-word shingle sets reach ``percent`` hundredths of similarity.

    ``docs`` needs doc_id (integer) and text; other columns are ignored, whatever their names. Returns doc_id, th (hash
    of the text), set_key (digest of the set), n_shingles, component_id (smallest doc_id reachable) and kept (doc_id is
    that), a row for each row of ``docs``. Null or blank texts have an empty set, a null set_key and stay alone. Equal
    sets are one class, so copies are never paired. Rows that share a doc_id are one document: their links count
    together. A row without a doc_id joins the class of its text; a class without any doc_id has a null component_id
    and is kept. Empty tables give empty results. Links below T collisions out of K are lost: 3.3 in ten million at a
    similarity of 0.8, fewer above it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    signed = materialize(docs.mapInPandas(_signed(width), "doc_id long, th long, n_shingles long, set_key binary, sig binary"), "signed")
    classes = materialize(signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")

    heads = classes.where("rep is not null").join(signed.select("set_key", "doc_id", "n_shingles", "sig"), "set_key").where("doc_id = rep")
    heads = materialize(heads.dropDuplicates(["set_key", "rep"]).select("doc_id", "n_shingles", "sig"), "heads")
    tokens = heads.mapInPandas(_tokens, "doc long, size long, token long")  # cheaper to make twice than to store
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    posted = tokens.join(shared, "token").groupBy("doc").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.collect_list(F.struct("n", "token")).alias("own"))
    posted = posted.where(F.size("own") >= T).select(
        "doc",
        F.expr("if(low = high, low, null) size"),  # rows that share a doc_id can have sets of two sizes
        F.expr("aggregate(own, 0L, (x, y) -> x + y.n)").alias("weight"),
        F.expr(f"slice(array_sort(own), 1, greatest(0, {K - T + 1} - ({K} - size(own))))").alias("prefix"),
    )
    posted = posted.select("doc", "size", "weight", F.explode("prefix").alias("p")).select("doc", "size", "weight", "p.token", F.ceil(F.col("p.n") / RUN).alias("runs"))
    posted = materialize(posted.withColumn("run", F.pmod(F.xxhash64("doc"), F.col("runs"))), "posted")

    members = posted.select("doc").distinct()
    sigs = signed.where("sig is not null").select("doc_id", "set_key", F.col("n_shingles").alias("n"), "sig").join(members, F.col("doc_id") == F.col("doc"), "left_semi")
    sigs = sigs.dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("doc"), "n", "sig")
    short = materialize(sigs.mapInPandas(_short, "doc long, n long, sig binary"), "sigs")
    sets = Sets(docs)

    def fits(x: str, y: str) -> str:
        """Sizes too far apart for the threshold: such a pair isn't worth a look at its signatures."""
        return f"coalesce({x} * 100 >= {y} * {percent} and {y} * 100 >= {x} * {percent}, true)"

    def each_run(lists: DataFrame) -> DataFrame:
        """A row of each token (token, runs) for each run of its members, so that a hot token's members join in many tasks."""
        return lists.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1))).drop("runs")

    def from_hubs(rows: DataFrame, hubs: DataFrame, other: str) -> DataFrame:
        pairs = rows.join(each_run(materialize(hubs, "hubs")), ["token", "run"]).where(f"{other} and {fits('size', 'hub.size')}")
        return _links(pairs.select(F.col("hub.doc").alias("a"), F.col("doc").alias("b")).distinct(), short, sets, width, percent, nearest=True)

    def listed(found: DataFrame) -> DataFrame:
        """The posting lists that hold more than one of the components ``found``."""
        rows = posted.join(found, F.col("doc") == F.col("node"), "left").select("token", "runs", "run", "doc", "size", F.coalesce("label", "doc").alias("label"))
        rows = materialize(rows, "rows")
        mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("runs").alias("runs"))
        mixed = each_run(mixed.where("low <> high").select("token", "runs"))
        return materialize(rows.join(mixed, ["token", "run"]), "mixed")

    hubs = posted.groupBy("token").agg(F.max_by(F.struct("doc", "size"), F.struct("weight", -F.col("doc"))).alias("hub"), F.count("*").alias("n"), F.max("runs").alias("runs"))
    found = connected_components(from_hubs(posted, hubs.where("n > 1").drop("n"), "doc <> hub.doc"))
    rest = listed(found)
    if not rest.isEmpty():
        hubs = rest.groupBy("token").agg(F.min_by(F.struct("doc", "size", "label"), F.xxhash64("token", "doc")).alias("hub"), F.max("runs").alias("runs"))
        found = merged_components(found, from_hubs(rest, hubs, "label <> hub.label"))
        rest = listed(found)
        if not rest.isEmpty():
            found = merged_components(found, _exact_links(rest, sigs, short, sets, width, percent))

    out = signed.select("doc_id", "th", "n_shingles", "set_key").join(classes, "set_key", "left").withColumn("own", F.coalesce("rep", "doc_id"))
    out = out.join(found, F.col("own") == F.col("node"), "left").withColumn("component_id", F.coalesce("label", "own"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "th", "set_key", "n_shingles", "component_id", kept.alias("kept"))


def survivors(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the result of ``near_duplicates``: the rows (d, t) that go, by doc_id and hash of the text, and those that
    stay but stand more than once.

    One row stays of each group, that of its smallest doc_id; without any doc_id, that of the smallest hash. If several
    rows have that doc_id, those with different shingle sets all stay, as versions of one document; of equal sets
    the smallest hash stays, once. Texts without words are groups of their own, each (doc_id, text) staying once.
    """
    rows = found.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"), "set_key", "kept").agg(F.count("*").alias("n"))
    rows = materialize(rows, "judged")
    first = rows.where("kept and set_key is not null").groupBy(F.col("d").alias("d2"), F.col("set_key").alias("k2")).agg(F.min("t").alias("t2"), F.count("*").alias("texts"))
    more = rows.join(first.where("texts > 1"), F.expr("d <=> d2 and set_key = k2 and kept and t <> t2")).select("d", "t")
    return materialize(rows.where("not kept").select("d", "t").union(more), "gone"), materialize(rows.where("kept and n > 1").select("d", "t"), "repeated")
