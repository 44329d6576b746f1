"""URL filter on a sorted array of 64-bit digests.

An index is three files: sorted xxhash64 keys, the offset of each key's string and the strings themselves. Spark
hands the files to every executor; there the keys are memory-mapped, probed with a vectorised binary search, and a
hit counts only if the stored string is the probed one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, near, partitions

#: The given rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hosts blocked by the method where no rule fits, with all their subdomains.
BLOCKLIST = ["casino-win.example.org", "cheap-pills.example.com", "spam-farm.example.org"]
#: Names blocked as a label of any host, whatever the domain.
NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


class DigestArray:
    """Memory-mapped strings with a small number each."""

    def __init__(self, folder: str, name: str):
        at = lambda part: os.path.join(folder, f"{name}.{part}")
        self.keys, self.ends = np.load(at("keys.npy"), mmap_mode="r"), np.load(at("ends.npy"), mmap_mode="r")
        self.codes = np.load(at("codes.npy"), mmap_mode="r")
        self.text = np.memmap(at("text"), np.uint8, "r") if os.path.getsize(at("text")) else np.empty(0, np.uint8)

    PARTS = ("keys.npy", "ends.npy", "codes.npy", "text")

    @staticmethod
    def build(folder: str, name: str, entries: dict[str, int]) -> None:
        """Equal digests stay side by side, in order of their strings."""
        order = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), c) for k, c in entries.items())
        np.save(os.path.join(folder, f"{name}.keys.npy"), np.array([x[0] for x in order], np.uint64))
        np.save(os.path.join(folder, f"{name}.ends.npy"), np.cumsum([0, *(len(x[1]) for x in order)]).astype(np.int64))
        np.save(os.path.join(folder, f"{name}.codes.npy"), np.array([x[2] for x in order], np.int64))
        with open(os.path.join(folder, f"{name}.text"), "wb") as f:
            f.write(b"".join(x[1] for x in order))

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """The code of each string, -1 where it isn't stored."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in hit:
            j = at[i]
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == strings[i]:
                    out[i] = self.codes[j]
                    break
                j += 1
        return out


def host_and_path(url: str = "url"):
    """Columns: after the first ``://`` up to / ? # or end, A-Z lower-cased; then up to ? # or end; else empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, blocklist: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """A row for each row of ``pages``: page_id, host, path, rule, verdict, listed (the blocked host that fits, or null).

    A rule fits its host and its subdomains if the url's path starts with the rule's; the longest rule decides
    (of equally long ones the last given). Without one the verdict is block for listed hosts and their subdomains
    and for hosts one of whose labels is a listed name (then ``listed`` starts at that label), else allow. A list given replaces
    its default; a ``blocklist`` without ``names`` stands alone. Null urls and urls without ``://`` have empty parts and are allowed. Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    spark: SparkSession = pages.sparkSession
    name, folder = f"urls-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="loomery-urls-")
    DigestArray.build(folder, f"{name}-rules", {h + p: i for i, (h, p, _) in enumerate(rules)})
    DigestArray.build(folder, f"{name}-hosts", dict.fromkeys(BLOCKLIST if blocklist is None else blocklist, 1))
    names = (NAMES if blocklist is None else []) if names is None else names
    DigestArray.build(folder, f"{name}-names", dict.fromkeys(names, 1))
    for kind in ("rules", "hosts", "names"):
        for part in DigestArray.PARTS:
            spark.sparkContext.addFile(os.path.join(folder, f"{name}-{kind}.{part}"))
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    host, path = host_and_path()

    @F.pandas_udf("rule string, verdict string, listed string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        root = SparkFiles.getRootDirectory()
        ruled, listed, named = (DigestArray(root, f"{name}-{kind}") for kind in ("rules", "hosts", "names"))
        for hosts, paths in batches:
            keys, of, suffixes, suffix_of = [], [], [], []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                labels = h.split(".") if h else []
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    suffixes.append(suffix)
                    suffix_of.append(i)
                    for n in lengths:
                        if n <= len(p):
                            keys.append(suffix + p[:n])
                            of.append(i)
            best = np.full(len(hosts), -1, np.int64)
            size = np.array([len(h) + len(p) for h, p, _ in rules], np.int64)
            for i, c in zip(of, ruled.probe([k.encode() for k in keys]), strict=True):
                if c >= 0 and (best[i] < 0 or (size[c], c) > (size[best[i]], best[i])):
                    best[i] = c
            block: list[str | None] = [None] * len(hosts)
            first = [s.partition(".")[0].encode() for s in suffixes]
            fits = (listed.probe([s.encode() for s in suffixes]) >= 0) | (named.probe(first) >= 0)
            for i, s, f in zip(suffix_of, suffixes, fits, strict=True):
                if f and block[i] is None:
                    block[i] = s
            yield pd.DataFrame(
                {
                    "rule": [rules[c][0] + rules[c][1] if c >= 0 else None for c in best],
                    "verdict": [rules[c][2] if c >= 0 else "block" if b else "allow" for c, b in zip(best, block, strict=True)],
                    "listed": block,
                }
            )

    out = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("judged", judge("host", "path"))
    return out.select("page_id", "host", "path", "judged.rule", "judged.verdict", "judged.listed")


# ---- lists of any length


#: Keys, and strings looked up, of one part of a distributed array.
PART = 2_000_000
_ARRAY = "part int, digests binary, ends binary, text binary"


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of a part: its digests, sorted, and its strings in their order."""
    keys: list[str] = []
    part = None
    for f in batches:
        part = int(f["part"].iloc[0]) if len(f) else part
        keys += f["key"].tolist()
    if part is not None:
        order = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode()) for k in keys)
        ends = np.cumsum([0, *(len(k) for _, k in order)]).astype(np.int64)
        yield pd.DataFrame({"part": [part], "digests": [np.array([d for d, _ in order], np.uint64).tobytes()], "ends": [ends.tobytes()], "text": [b"".join(k for _, k in order)]})


def _found(asked: pd.DataFrame, array: pd.DataFrame) -> pd.DataFrame:
    """Those of the strings asked for that a part holds: equal digests are looked through until the strings are equal."""
    hits: list[str] = []
    if len(array) and len(asked):
        digests, ends, text = np.frombuffer(array["digests"][0], np.uint64), np.frombuffer(array["ends"][0], np.int64), memoryview(array["text"][0])
        strings = [k.encode() for k in asked["key"]]
        own = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(digests, own)
        for i in np.flatnonzero(digests[np.minimum(at, len(digests) - 1)] == own):
            j = int(at[i])
            while j < len(digests) and digests[j] == own[i]:
                if text[ends[j] : ends[j + 1]] == strings[i]:
                    hits.append(asked["key"].iloc[i])
                    break
                j += 1
    return pd.DataFrame({"key": pd.Series(hits, dtype=object)})


def listed(pages: DataFrame, keys: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """As ``judged``, by a table of keys (key: a host, which stands for its subdomains, or a host with a path, which stands for that
    page alone) of any length: rows of page_id, host, path, rule, verdict, listed (the key that fits; a page's own before hosts, the longest first).

    The sorted array is made and kept by Spark in parts by digest; a page's host, what it is a subdomain of, and its url are looked
    up in their parts, each distinct one once. Null and empty keys fit nothing, and neither do repeated ones more than once.
    """
    spark = pages.sparkSession
    keys = materialize(keys.select("key").where("key <> ''").distinct(), "keys")
    out = judged(pages, rules, [], []).drop("listed")
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = out.select("host", "path").where("host <> ''").distinct().select("host", "path", F.posexplode(F.concat(F.array(F.concat("host", "path")), above)).alias("place", "key"))
    asked = materialize(asked.where("key <> ''"), "asked")
    distinct = asked.select("key").distinct()
    parts = max(partitions(spark), -(-max(keys.count(), distinct.count()) // PART))
    arrays = keys.withColumn("part", _part("key", parts)).repartitionById(parts, F.col("part")).mapInPandas(_packed, _ARRAY)
    arrays = materialize(arrays, "array")
    hits = distinct.withColumn("part", _part("key", parts)).groupBy("part").cogroup(arrays.groupBy("part")).applyInPandas(_found, "key string")
    hits = materialize(hits, "hits")
    best = asked.join(near(hits, hits.count()), "key", "left_semi").groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.min_by("key", "place").alias("listed"))
    out = out.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p")
    return out.withColumn("verdict", F.when(F.col("rule").isNull() & F.col("listed").isNotNull(), "block").otherwise(F.col("verdict"))).select("page_id", "host", "path", "rule", "verdict", "listed")
