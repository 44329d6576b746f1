"""The inverted index as immutable segments: an update writes the postings of changed units only.

A segment holds the postings of the units that an update brought, which units these are, and which units of which older segments
are gone (changed or removed). Readers merge: a posting counts unless a younger segment says that its unit is gone from its
segment; a segment that has lost no unit is read as it is. Segments that have grown together to the size of older ones are merged with them, so a unit is written again O(log n) times and a reader
sees O(log n) segments.

Postings are dealt into files by ranges of (term, unit), as many as their number of words asks for: a frequent term is spread over
files, and a query opens the files whose ranges its terms fall in, which a small table beside them tells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.derived import cut
from ..sources.store import Conflict, Store
from . import postings as made
from .lexical import Index
from .postings import POSTING

#: Words of units that a file's postings stand for, about 40 MB of it: a task holds one file's postings.
FILE_WORDS = 4_000_000
#: Ids that are broadcast at most. Of more, a sieve of that many words of 64 bits is, and rows that it lets through are joined by shuffling.
GONE = 200_000
SIEVE = 1 << 18
#: A segment is merged with what is younger once that has grown to this share of its size.
RATIO = 0.5
PARTS = ("postings", "units", "gone", "ranges")


def unit_hash() -> Column:
    """Changes with everything of a unit that postings hold."""
    return F.sha2(F.to_json(F.struct("repo", "number", "family", "title", "body")), 256)


def key() -> Column:
    """What a unit is compared by: its id, or its hash if it has none."""
    return F.coalesce("id", F.concat(F.lit("\0"), "hash"))


def sifted(rows: DataFrame, c: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``near``: true if ``c`` is among ``keys``, seldom else."""
    bit = lambda name: F.pmod(F.xxhash64(name), F.lit(64 * SIEVE))
    words = keys.select(bit(keys.columns[0]).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    rows = rows.withColumn("bit", bit(c))
    near = F.expr("coalesce(shiftright(bits, cast(bit % 64 as int)) & 1, 0) = 1")
    return rows.join(F.broadcast(words), F.expr("bit div 64") == F.col("word"), "left").withColumn("near", near).drop("bit", "word", "bits")  # words: at most SIEVE rows


def among(rows: DataFrame, c: str, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` whose ``c`` is among the ``n`` rows of ``keys``; of the others few are shuffled."""
    if n <= GONE:
        return rows.join(F.broadcast(keys), c, "left_semi")
    return sifted(rows, c, keys).where("near").drop("near").join(keys, c, "left_semi")


def except_for(rows: DataFrame, c: str, keys: DataFrame, n: int) -> DataFrame:
    """The other ``rows``."""
    if n <= GONE:
        return rows.join(F.broadcast(keys), c, "left_anti")
    rows = sifted(rows, c, keys)
    return rows.where("not near").unionByName(rows.where("near").join(keys, c, "left_anti")).drop("near")


@dataclass
class Segments:
    """The index in a store's folder. Its manifest lists the segments, the oldest first: name, units, words, gone (how many units of
    older ones) and of (how many of each)."""

    store: Store

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def listed(self) -> list[dict]:
        return (self.store.manifest() or {"metadata": {}})["metadata"].get("segments", [])

    def _read(self, part: str, name: str) -> DataFrame:
        return self.store.read(f"{part}-{name}")

    def _gone(self, segments: list[dict], of: list[str]) -> DataFrame | None:
        """(id, of): the units that these say are gone from the segments ``of``."""
        out = None
        for s in segments:
            if any(s["of"].get(name) for name in of):
                one = self._read("gone", s["name"]).where(F.col("of").isin(of))
                out = one if out is None else out.unionByName(one)
        return out

    def _alive(self, rows: DataFrame, name: str, segments: list[dict]) -> DataFrame:
        """Rows (id) of that segment whose unit no younger one of ``segments`` has changed or removed."""
        dead = self._gone(segments, [name])
        return rows if dead is None else except_for(rows, "id", dead.select("id"), sum(s["of"].get(name, 0) for s in segments))

    def _each(self, part: str, segments: list[dict]) -> DataFrame | None:
        """What is alive of that part of all segments, with their names (of)."""
        out = None
        for s in segments:
            one = self._alive(self._read(part, s["name"]), s["name"], segments).withColumn("of", F.lit(s["name"]))
            out = one if out is None else out.unionByName(one)
        return out

    def _units(self) -> DataFrame:
        segments = self.listed()
        return self._each("units", segments) if segments else self.spark.createDataFrame([], "id string, hash string, length int, of string")

    def units(self) -> DataFrame:
        """(id, hash, length) of the units that are there."""
        return self._units().drop("of")

    def index(self) -> SegmentIndex:
        return SegmentIndex(self._postings(None), self.units().agg(F.count("*").alias("total"), F.avg("length").alias("mean")), self)

    def _postings(self, wanted: Callable[[Column, Column], Column] | None) -> DataFrame:
        """Postings of all units; ``wanted`` (lowest and highest term of a file) says which files are opened."""
        segments, out = self.listed(), None
        for s in segments:
            if wanted is None:
                one = self._read("postings", s["name"])
            else:
                root = self.store.manifest()["tables"][f"postings-{s['name']}"]
                files = [r["file"] for r in self._read("ranges", s["name"]).where(wanted(F.col("low"), F.col("high"))).select("file").collect()]  # those of the query's terms
                if not files:
                    continue
                one = self.spark.read.schema(POSTING).parquet(*(f"{self.store.root}/{root}/{f}" for f in sorted(files)))
            one = self._alive(one, s["name"], segments)
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], POSTING) if out is None else out

    def _staged(self, name: str, postings: Callable[[int, int, int], DataFrame], units: DataFrame, gone: DataFrame) -> tuple[dict[str, str], dict]:
        """Writes a segment, its ``postings`` dealt into so many files, of so many units and words; its tables by name and its entry
        in the list."""
        tables = {"units": self.store.stage("units", units), "gone": self.store.stage("gone", gone)}
        read = lambda part: self.spark.read.parquet(f"{self.store.root}/{tables[part]}")
        size = read("units").agg(F.count("*").alias("units"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        files = max(1, -(-size["words"] // FILE_WORDS))
        codec = "zstd" if files > 1 else None  # a small segment is mostly footer
        tables["postings"] = self.store.stage("postings", postings(files, size["units"], size["words"]), codec=codec)
        ranges = made.ends(read("postings").select(F.col("_metadata.file_name").alias("file"), "term"))
        tables["ranges"] = self.store.stage("ranges", ranges.coalesce(1))  # a row a file
        of = {r["of"]: r["count"] for r in read("gone").groupBy("of").count().collect()}  # a row a segment
        entry = {"name": name, "units": size["units"], "words": int(size["words"]), "gone": sum(of.values()), "of": of}
        return {f"{part}-{name}": path for part, path in tables.items()}, entry

    def _next(self, segments: list[dict]) -> str:
        return f"{max((int(s['name']) for s in segments), default=0) + 1:08d}"

    def upsert(self, changed: DataFrame, removed: DataFrame | None = None, metadata: dict | None = None) -> dict | None:
        """A segment of ``changed`` units (id, repo, number, family, title, body; each id once), which replace those of the same
        id, and without the units of ``removed`` (id). Postings of other units aren't read or written. None if nothing changes."""
        known, ids = self._units().select("id", "of"), changed.select("id")
        ids = ids if removed is None else ids.unionByName(removed.select("id"))
        return self._added(changed, known.join(ids, "id", "left_semi").distinct() if self.listed() else known, metadata)

    def _added(self, changed: DataFrame, gone: DataFrame, metadata: dict | None) -> dict | None:
        segments = self.listed()
        changed = changed.select("id", "repo", "number", "family", "title", "body")
        length = F.size(tokens(F.col("title"))) + F.size(tokens(F.col("body")))
        units = changed.select("id", unit_hash().alias("hash"), length.alias("length"))
        tables, entry = self._staged(self._next(segments), lambda *size: made.dealt_of_units(changed, tokens, *size), units, gone)
        if not entry["units"] and not entry["gone"]:
            if metadata:
                self.store.commit({}, metadata)
            return None
        self.store.commit(tables, (metadata or {}) | {"segments": [*segments, entry]})
        return entry

    def sync(self, documents: DataFrame, metadata: dict | None = None) -> dict | None:
        """Brings the index to ``documents``: units are compared by a hash, and only those that differ are indexed again. Hashes
        are shuffled, and texts of units that differ."""
        if not self.listed():
            return self.upsert(documents, None, metadata)
        now = documents.withColumn("hash", unit_hash())
        both = now.select("id", "hash", F.lit(None).cast("string").alias("of")).unionByName(self._units().select("id", "hash", "of"))
        hashes = lambda side: F.sort_array(F.collect_list(F.when(side, F.col("hash"))))
        new = F.col("of").isNull()
        each = both.groupBy(key().alias("key")).agg(F.max("id").alias("id"), F.collect_set("of").alias("of"), hashes(new).alias("new"), hashes(~new).alias("old"))
        differ = cut(each.where("new <> old").select("key", "id", "of", (F.size("new") > 0).alias("there")))
        keys = differ.where("there").select("key")
        changed = cut(among(now.withColumn("key", key()).drop("hash"), "key", keys, keys.count()).drop("key"))
        return self._added(changed, differ.where("id is not null").select("id", F.explode("of").alias("of")), metadata)

    def due(self, ratio: float = RATIO) -> int:
        """How many of the youngest segments are to be merged: as long as the next older one isn't larger by more than ``ratio`` says."""
        segments = self.listed()
        run, total = 1, sum(segments[-1][k] for k in ("words", "gone")) if segments else 0
        while run < len(segments) and segments[-run - 1]["words"] * ratio <= total:
            run += 1
            total += sum(segments[-run][k] for k in ("words", "gone"))
        return run if run > 1 else 0

    def compact(self, run: int | None = None) -> dict | None:
        """Merges the youngest ``run`` segments (None: what is due) into one, without units that are gone. What they say of older
        segments' units stays said; nothing is said if there are none."""
        segments = self.listed()
        run = self.due() if run is None else min(run, len(segments))
        if run < 2:
            return None
        older, merged = segments[:-run], segments[-run:]
        postings, units = (self._each(part, merged).drop("of") for part in ("postings", "units"))
        gone = self._gone(merged, [s["name"] for s in older])
        if gone is None:
            gone = self.spark.createDataFrame([], "id string, of string")
        tables, entry = self._staged(self._next(segments), lambda files, _, words: made.dealt(postings, files, words), units, gone)
        self.store.commit(tables, {"segments": [*older, entry]}, drop=[f"{p}-{s['name']}" for s in merged for p in PARTS])
        return entry

    @staticmethod
    def current(spark: SparkSession, root: str, state: str, documents: Callable[[], DataFrame]) -> SegmentIndex:
        """The index in ``root`` brought to ``state`` of its sources; of two writers one does it and the other reads that."""
        own = Segments(Store(spark, root))
        if (own.store.manifest() or {"metadata": {}})["metadata"].get("state") != state:
            try:
                own.sync(documents(), {"state": state})
                own.compact()
            except Conflict:
                if (own.store.manifest() or {"metadata": {}})["metadata"].get("state") != state:
                    raise
        return own.index()


@dataclass
class SegmentIndex(Index):
    """``of_terms`` opens the files of its terms only."""

    segments: Segments | None = None

    def lengths(self) -> DataFrame:
        return self.segments.units().where("length > 0").select("id", "length")

    def of_terms(self, terms: list[str], prefix: str | None = None) -> DataFrame:
        if prefix == "":
            return self.postings
        ends = [] if prefix is None else [(prefix, prefix + "\U0010ffff")]
        spans = [(t, t) for t in terms] + ends

        def wanted(low: Column, high: Column) -> Column:
            out = F.lit(False)
            for a, b in spans:
                out = out | (low <= b) & (high >= a)
            return out

        fits = F.col("term").isin(terms)
        if prefix is not None:
            fits = fits | F.col("term").startswith(prefix)
        return self.segments._postings(wanted).where(fits)
