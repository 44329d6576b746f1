"""Collocations: phrases of two to four words that stand together more often than their parts let expect.

Hierarchical pair naming. Words that are frequent in a language get ids; two adjacent ids make a pair, pairs are counted
and named over the whole corpus, and where both halves of a longer phrase have names, the pair of these names stands for
it: a phrase of k words is (name of its first k - 1 words, name of its last k - 1 words). So each level looks only at places
where both halves are frequent, and the two names are the parent pointers from which every cut and every phrase within
a phrase is found, without the text.

The corpus travels in blocks: up to ``BLOCK`` bytes of texts of one language (a longer text is a block of its own). A block
keeps each of its words or pairs once with its count, so a word that stands everywhere is one entry a block, whatever its
frequency. Names are given in parts, by a hash of the key: a block asks each part for the names of its own keys in one
packed row, the part counts the keys of all blocks, names those that are frequent enough and answers each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions, released

#: Bytes of text that a block takes.
BLOCK = 1 << 20
#: Parts in which a language's best phrases are chosen before the best of them are.
PARTS = 64
LONGEST = 4

_BREAK = b"\xff"  # no byte of UTF-8
_BYTES = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _BYTES[_c] += 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_c] = _BREAK[0]
_BYTES = bytes(_BYTES)

#: Keys that a part counts, about; there are as many parts as that takes, at least one a shuffle partition.
KEYS = 1_000_000
#: A name is the part that gave it and its place there.
_PART_BITS = 40

_WORDS = "lang string, words long, seq binary, keys binary, times binary, size int"
_PAIRS = "block long, seq binary, first binary, last binary, times binary, size int"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart so that those alike stand together."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() + values.dtype.char.encode(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    kind = np.dtype(chr(raw[-1]))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, len(raw) - 1).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _squeezed(seq: np.ndarray) -> np.ndarray:
    """Several breaks in a row are one."""
    off = seq < 0
    return seq[~(off & np.concatenate(([True], off[:-1])))]


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in kinds.items()], [*kinds])


class _Block:
    def __init__(self):
        self.ids: dict[bytes, int] = {_BREAK: -1}
        self.seqs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, text: bytes) -> None:
        ids = self.ids
        found = text.translate(_BYTES).replace(_BREAK, b" \xff ").split(None)
        for word in found:
            if word not in ids:
                ids[word] = len(ids) - 1
        self.seqs += [np.fromiter(map(ids.__getitem__, found), np.int32, len(found)), np.array([-1], np.int32)]
        self.bytes += len(text)

    def row(self, lang: str) -> pa.RecordBatch:
        seq = _squeezed(np.concatenate(self.seqs))
        times = np.bincount(seq[seq >= 0], minlength=len(self.ids) - 1).astype(np.int32)
        words = zstandard.compress(b" ".join([*self.ids][1:]), 1)
        kinds = {"lang": pa.string(), "words": pa.int64(), "seq": pa.binary(), "keys": pa.binary(), "times": pa.binary(), "size": pa.int32()}
        return _batch({"lang": [lang], "words": [int(times.sum())], "seq": [_packed(seq)], "keys": [words], "times": [_packed(times)], "size": [len(times)]}, kinds)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[str, _Block] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            block = open_.setdefault(lang, _Block())
            block.add(text.as_py())
            if block.bytes >= BLOCK and len(open_.pop(lang).ids) > 1:
                yield block.row(lang)
    for lang, block in open_.items():
        if len(block.ids) > 1:
            yield block.row(lang)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's names become pairs of adjacent names; what has no name breaks the sequence."""
    kinds = {"block": pa.int64(), "seq": pa.binary(), "first": pa.binary(), "last": pa.binary(), "times": pa.binary(), "size": pa.int32()}
    for batch in batches:
        for r in batch.to_pylist():
            seq, size = _unpacked(r["seq"]), r["size"]
            names = np.full(size + 1, -1, np.int64)  # the last is that of a break
            for answer in r["found"]:
                names[_unpacked(answer["at"])] = _unpacked(answer["ids"])
            here = names[seq] >= 0
            both = np.flatnonzero(here[:-1] & here[1:])
            if not len(both):
                continue
            # Pairs of places in the level before, which are small enough for 64 bits.
            pairs, number, times = np.unique(seq[both].astype(np.int64) * size + seq[both + 1], return_inverse=True, return_counts=True)
            out = np.full(len(seq) - 1, -1, np.int32)
            out[both] = number
            packed = {"seq": _squeezed(out), "first": names[pairs // size], "last": names[pairs % size], "times": times.astype(np.int32)}
            yield _batch({"block": [r["block"]], "size": [len(pairs)]} | {k: [_packed(v)] for k, v in packed.items()}, kinds)


_ASKED = {"part": pa.int32(), "block": pa.int64(), "lang": pa.string(), "at": pa.binary(), "keys": pa.binary(), "last": pa.binary(), "times": pa.binary()}
_NAMED = {"block": pa.int64(), "at": pa.binary(), "ids": pa.binary(), "lang": pa.string(), "word": pa.binary(), "first": pa.int64(), "last": pa.int64(), "a": pa.int64(), "id": pa.int64()}
_NAMED_SQL = "block long, at binary, ids binary, lang string, word binary, first long, last long, a long, id long"


def _asking(parts: int):
    """Each block's keys by part, those of words in order of the words, those of pairs in order of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                times, pairs = _unpacked(r["times"]), "first" in r
                if pairs:
                    first, last = _unpacked(r["first"]), _unpacked(r["last"])
                    order = np.lexsort((last, first))
                    key = mix64(mix64(first.view(np.uint64)) * np.uint64(31) + last.view(np.uint64))
                else:
                    words = zstandard.decompress(r["keys"]).split(b" ")
                    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
                    key = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                part = (key % np.uint64(parts)).astype(np.int32)[order]
                order = order[np.argsort(part, kind="stable")]
                ends = np.cumsum(np.bincount(part, minlength=parts))
                out = {n: [] for n in _ASKED}
                for p, (i, j) in enumerate(zip([0, *ends], ends, strict=False)):
                    if i < j:
                        own = order[i:j]
                        values = [p, r["block"], r.get("lang"), _packed(own.astype(np.int32))]
                        values += [_packed(first[own]), _packed(last[own])] if pairs else [zstandard.compress(b" ".join([words[k] for k in own.tolist()]), 1), None]
                        for n, v in zip(_ASKED, [*values, _packed(times[own])], strict=True):
                            out[n].append(v)
                yield _batch(out, _ASKED)

    return run


def _naming(least: int):
    """What a part is asked, counted: the keys that stand at least ``least`` times with their names, and their names for each
    block that asked for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [r for batch in batches for r in batch.to_pylist()]
        if not asked:
            return
        times, ends = [_unpacked(r["times"]) for r in asked], np.cumsum([0] + [0] * len(asked))
        if asked[0]["last"] is None:
            seen: dict[tuple[str, bytes], int] = {}
            number = np.concatenate([np.fromiter((seen.setdefault((r["lang"], w), len(seen)) for w in zstandard.decompress(r["keys"]).split(b" ")), np.int64) for r in asked])
            keys = [*seen]
        else:
            first, last = (np.concatenate([_unpacked(r[n]) for r in asked]) for n in ("keys", "last"))
            order = np.lexsort((last, first))
            new = np.concatenate(([True], (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)))
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            first, last = first[order[new]], last[order[new]]
        ends = np.cumsum([0, *map(len, times)])
        total = np.zeros(int(number.max()) + 1, np.int64)
        np.add.at(total, number, np.concatenate(times))
        kept = np.flatnonzero(total >= least)
        ids = np.full(len(total), -1, np.int64)
        ids[kept] = asked[0]["part"] << _PART_BITS | np.arange(len(kept))
        empty = [None] * len(kept)
        if asked[0]["last"] is None:
            own = [keys[k] for k in kept.tolist()]
            named = {"lang": [k[0] for k in own], "word": [k[1] for k in own], "first": empty, "last": empty}
        else:
            named = {"lang": empty, "word": empty, "first": first[kept], "last": last[kept]}
        yield _batch({"block": empty, "at": empty, "ids": empty, "a": total[kept], "id": ids[kept]} | named, _NAMED)
        for r, i, j in zip(asked, ends, ends[1:], strict=False):
            found = ids[number[i:j]]
            if (found >= 0).any():
                answer = {"block": [r["block"]], "at": [_packed(_unpacked(r["at"])[found >= 0])], "ids": [_packed(found[found >= 0])]}
                yield _batch({n: answer.get(n, [None]) for n in _NAMED}, _NAMED)

    return run


def _named(level: DataFrame, least: int) -> DataFrame:
    """Names of the frequent keys of ``level`` (block is null) and answers to its blocks (at, ids)."""
    spark = level.sparkSession
    keys = level.agg(F.sum(F.col("size").cast("long")).alias("n")).first()["n"] or 0
    parts = max(partitions(spark), -(-keys // KEYS))
    asked = level.drop("seq", "words", "size").mapInArrow(_asking(parts), "part int, block long, lang string, at binary, keys binary, last binary, times binary")
    return materialize(asked.repartitionById(parts, F.col("part")).mapInArrow(_naming(least), _NAMED_SQL), "names")


def _next(level: DataFrame, named: DataFrame) -> DataFrame:
    """The level of pairs of names that are adjacent in ``level``."""
    found = named.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("at", "ids")).alias("found"))  # a row a part
    return materialize(level.select("block", "seq", "size").join(found, "block").mapInArrow(_paired, _PAIRS), "pairs")


def _score(a: Column, parts: Column) -> Column:
    """floor(2000000 a / parts), exact: the product can pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(parts))


def _phrases(names: DataFrame, halves: DataFrame) -> DataFrame:
    """Phrases of k words from their names and the phrases of k - 1 words: pre and suf hold the counts of their first and
    their last 1 to k words; l, r and score are those of the cut that counts."""
    side = lambda x: halves.select(*(F.col(c).alias(f"{x}_{c}") for c in halves.columns))
    both = names.join(side("first"), F.col("first") == F.col("first_id")).join(side("last"), F.col("last") == F.col("last_id"))
    cut = lambda i: F.struct(_score(F.col("a"), F.col("first_pre")[i - 1] + F.col("last_suf")[F.size("last_suf") - i]).alias("score"), i.cast("int").alias("cut"), F.col("first_pre")[i - 1].alias("l"), F.col("last_suf")[F.size("last_suf") - i].alias("r"))
    both = both.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(1), F.size("first_pre")), cut)))
    return both.select(
        "id", F.col("first_lang").alias("lang"), F.concat_ws(" ", "first_phrase", "last_end").alias("phrase"), F.col("last_end").alias("end"), "a",
        F.concat("first_pre", F.array("a")).alias("pre"), F.concat("last_suf", F.array("a")).alias("suf"), "best.l", "best.r", "best.score",
    )


def collocations(docs: DataFrame, least: int = 30, first: int | None = 2000, percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of 2 to 4 words that stand at least ``least`` times in a language.

    A phrase is cut where floor(2000000 a / (l + r)) is lowest (a, l, r: occurrences of it and of its parts; equal scores: the
    first cut); n is the number of words of its language. A phrase goes if it lies within a longer one that has at least
    ``percent`` of its occurrences. Each language's ``first`` phrases by score, a, phrase are returned (None: all).

    A null text is as an empty one, a null lang is ``und`` (also where that is a lang). Texts without words, and empty tables,
    give nothing. Repeated rows count as often as they stand there. Other columns than text and lang are not read.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    level = materialize(rows.mapInArrow(_blocks, _WORDS).withColumn("block", F.monotonically_increasing_id()), "words")
    n = materialize(level.groupBy("lang").agg(F.sum("words").alias("n")), "n")
    names = []
    for k in range(1, LONGEST + 1):
        names.append(_named(level, least))
        before, level = level, _next(level, names[-1]) if k < LONGEST else None
        released(before)
    names = [x.where("block is null") for x in names]
    word = F.col("word").cast("string")
    phrases = names[0].select("id", "lang", word.alias("phrase"), word.alias("end"), "a", F.array("a").alias("pre"), F.array("a").alias("suf"))
    out = None
    for k in range(2, LONGEST + 1):
        phrases = _phrases(names[k - 1], phrases)
        if k < LONGEST:
            phrases = materialize(phrases, "phrases")
            # A phrase within a longer one of many words is within one of one word more, which has no fewer occurrences.
            longer = names[k]
            longer = longer.select(F.col("first").alias("within"), F.col("a").alias("most")).union(longer.select("last", "a"))
            longer = longer.groupBy("within").agg(F.max("most").alias("most"))
            free = phrases.join(longer, F.col("id") == F.col("within"), "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
        else:
            free = phrases
        free = free.select("lang", "phrase", "a", "l", "r", "score")
        out = free if out is None else out.unionByName(free)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    if first is not None:
        parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = out.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= first)
    out = out.withColumn("rank", F.row_number().over(best))
    if first is not None:
        out = out.where(F.col("rank") <= first)
    out = out.join(F.broadcast(n) if n.count() <= 10_000 else n, "lang")
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("lang", long("rank"), "phrase", *map(long, ("a", "l", "r", "n", "score")))
