"""Newest-wins tables that take batches at the cost of the batch: buckets of a key's hash, each a base and what came since.

A batch writes one table, in folders by bucket, of the newest row of each of its keys. A bucket whose additions have grown to a
share of its base is folded: base and additions become one. Other buckets aren't read or written. Readers merge what a bucket
has; one that is folded is read as it is. All of a batch becomes visible by one manifest, which also keeps the batch's number,
so a batch that is sent again changes nothing, and one that is lost half-way leaves nothing that counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store

#: Buckets of a new table, and the share of its base to which a bucket's additions grow before they are folded.
BUCKETS, FOLD = 64, 0.25


@dataclass
class Buckets:
    """The table ``name`` of a store. A row replaces another of its ``key`` if its ``version`` is higher, or as high and it came
    later, or came with it and has the higher ``payload``; a stale row changes nothing."""

    store: Store
    name: str
    key: list[str]
    version: str = "version"
    payload: str = "payload"
    buckets: int = BUCKETS
    fold: float = FOLD

    def _about(self) -> dict:
        """buckets, the last batch's number, and parts: a list of [table, rows] of each bucket, its base first."""
        found = (self.store.manifest() or {"metadata": {}})["metadata"]
        return found.get(f"{self.name}.buckets") or {"buckets": self.buckets, "batch": None, "next": 1, "parts": {}}

    def _newest(self, rows: DataFrame, *more: str) -> DataFrame:
        """The row of each key that counts. Partly done before the shuffle, so many versions of a key don't meet in a task."""
        first = [self.version, *more, self.payload]
        rest = [c for c in rows.columns if c not in (*self.key, *first)]
        best = rows.groupBy(*self.key).agg(F.max(F.struct(*first, *rest)).alias("x"))
        return best.select(*((F.col("x")[c].alias(c) if c not in self.key else F.col(c)) for c in rows.columns))

    def _table(self, table: str) -> DataFrame:
        return self.store.read(table)

    def _parts(self, about: dict, only: set[str] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of buckets of one part, and of those of several with seq, the place of a part."""
        once: dict[str, list[int]] = {}
        several: dict[tuple[str, int], list[int]] = {}
        for b, parts in about["parts"].items():
            if only is None or b in only:
                for i, (table, _) in enumerate(parts):
                    (once.setdefault(table, []) if len(parts) == 1 else several.setdefault((table, i), [])).append(int(b))
        single = merged = None
        for table, own in once.items():
            one = self._table(table).where(F.col("bucket").isin(own))
            single = one if single is None else single.unionByName(one)
        for (table, i), own in several.items():
            one = self._table(table).where(F.col("bucket").isin(own)).withColumn("seq", F.lit(i))
            merged = one if merged is None else merged.unionByName(one)
        return single, merged

    def read(self, only: set[str] | None = None) -> DataFrame | None:
        """The newest row of each key, None before the first batch; ``only``: of some buckets."""
        single, merged = self._parts(self._about(), only)
        if merged is not None:
            merged = self._newest(merged, "seq").drop("seq")
            single = merged if single is None else single.unionByName(merged)
        return None if single is None else single.drop("bucket")

    def bucket_of(self, n: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def merge(self, batch: DataFrame, number: int | None = None, metadata: dict | None = None) -> dict:
        """Takes a batch; how many rows it wrote, and how many more to fold buckets. A ``number`` that isn't above the last is a batch
        that was taken before."""
        about = self._about()
        if number is not None and about["batch"] is not None and number <= about["batch"]:
            return {"rows": 0, "folded": 0}
        n, table = about["buckets"], f"{self.name}/{about['next']:08d}"
        new = self._newest(batch).withColumn("bucket", self.bucket_of(n))
        tables = {table: self.store.stage(self.name, new.repartition("bucket"), "bucket")}
        staged = self.store.spark.read.schema(new.schema).parquet(f"{self.store.root}/{tables[table]}")
        rows = {str(r["bucket"]): r["count"] for r in staged.groupBy("bucket").count().collect()}  # a row a bucket
        parts = {b: list(p) for b, p in about["parts"].items()}
        for b, count in rows.items():
            parts[b] = [*parts.get(b, []), [table, count]]
        full = {b for b in rows if len(parts[b]) > 1 and sum(c for _, c in parts[b][1:]) > self.fold * parts[b][0][1]}
        folded = 0
        if full:
            _, several = self._parts({"parts": {b: [x for x in parts[b] if x[0] != table] for b in full}}, full)
            single, _ = self._parts({"parts": {b: [x for x in parts[b] if x[0] != table] for b in full}}, full)
            late = staged.where(F.col("bucket").isin([int(b) for b in full])).withColumn("seq", F.lit(1 << 30))
            every = late
            for x in (single.withColumn("seq", F.lit(0)) if single is not None else None, several):
                every = every if x is None else every.unionByName(x)
            base = f"{self.name}/{about['next'] + 1:08d}"
            tables[base] = self.store.stage(self.name, self._newest(every, "seq").drop("seq").repartition("bucket"), "bucket")
            sizes = {str(r["bucket"]): r["count"] for r in self.store.spark.read.parquet(f"{self.store.root}/{tables[base]}").groupBy("bucket").count().collect()}
            for b in full:
                parts[b] = [[base, sizes[b]]]
            folded = sum(sizes.values())
        used = {t for p in parts.values() for t, _ in p}
        gone = {t for p in about["parts"].values() for t, _ in p} - used
        tables = {t: p for t, p in tables.items() if t in used}
        now = {"buckets": n, "batch": number if number is not None else about["batch"], "next": about["next"] + 2, "parts": parts}
        self.store.commit(tables, (metadata or {}) | {f"{self.name}.buckets": now}, drop=gone)
        return {"rows": sum(rows.values()), "folded": folded}

    def changes(self, batch: DataFrame) -> DataFrame:
        """(key, change) of what ``merge`` would do with the keys of a batch: added, updated, or same for stale and equal rows. Reads the
        buckets that the batch falls into."""
        about = self._about()
        new = self._newest(batch)
        hit = {str(r[0]) for r in new.select(self.bucket_of(about["buckets"])).distinct().collect()}  # at most the buckets
        old = self.read(hit)
        if old is None:
            return new.select(*self.key, F.lit("added").alias("change"))
        side = old.select(*self.key, F.col(self.version).alias("_v"), F.col(self.payload).alias("_p"), F.lit(True).alias("_there"))
        wins = (F.col(self.version) > F.col("_v")) | (F.col(self.version) == F.col("_v")) & ~F.col(self.payload).eqNullSafe(F.col("_p"))
        kind = F.when(F.col("_there").isNull(), "added").when(wins, "updated").otherwise("same")
        return new.join(side, self.key, "left").select(*self.key, kind.alias("change"))
