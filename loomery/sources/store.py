"""Generations: every commit writes its tables to folders of their own and then adds one manifest, which names them all."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
KEEP = 3
class Conflict(RuntimeError):
    """Another writer was first."""


#: Tables and metadata that stay with the collector.
PRIVATE = ("responses", "inventory", "identity", "credential_identity")


@dataclass
class Store:
    """A warehouse folder on any file system that Hadoop reaches; manifests go through the same file system."""

    spark: SparkSession
    root: str
    read_only: bool = False

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _write(self, name: str, text: str) -> bool:
        """Whether the file is new and this writer's; a file that is there stays as it is.

        The text is written beside and takes its name in one step that fails if the name is taken: a hard link on a local disk, a
        rename that doesn't overwrite elsewhere (atomic where the file system's renames are, as on HDFS)."""
        fs, path = self._fs()
        jvm, new, at = self.spark._jvm, path(f"{self.root}/.{secrets.token_hex(8)}.new"), path(f"{self.root}/{name}")
        out = fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Path.of(path.getPathWithoutSchemeAndAuthority(p).toString(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(at), local(new))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            if fs.exists(new):
                fs.delete(new, False)
        return True

    def _manifests(self) -> list[str]:
        """Names of the manifests, the newest first."""
        fs, path = self._fs()
        found = fs.listStatus(path(self.root)) if fs.exists(path(self.root)) else []
        return sorted((n for n in (x.getPath().getName() for x in found) if n.startswith("manifest-")), reverse=True)

    def _get(self, name: str) -> str | None:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/{name}")):
            return None
        data = fs.open(path(f"{self.root}/{name}"))
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def manifest(self) -> dict | None:
        """The newest one; a reader sees an old generation or a new one, never none between."""
        names = self._manifests()
        found = json.loads(self._get(names[0])) if names else None
        if found and found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"schema version {found['schema_version']}; this reads {SCHEMA_VERSION}")
        return found

    def stage(self, name: str, rows: DataFrame, by: str | None = None, codec: str | None = None) -> str:
        """Writes a table that no manifest names yet (``by``: in folders by that column; ``codec``: other than the session's); its
        path within the root."""
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        path = f"gen={secrets.token_hex(16)}/{name}"
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.parquet(f"{self.root}/{path}", compression=codec)
        return path

    def commit(self, tables: dict[str, DataFrame | str], metadata: dict | None = None, drop: Iterable[str] = ()) -> dict:
        """All tables or none become visible, and those of ``drop`` go; readers of the old generation go on. A table is a frame or
        the path of a staged one. Manifests are numbered, so of two writers that began with the same generation one fails and
        leaves nothing that counts."""
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        names = self._manifests()
        old = self.manifest() or {"tables": {}, "metadata": {}}
        paths = {n: p for n, p in old["tables"].items() if n not in set(drop)}
        paths |= {name: df if isinstance(df, str) else self.stage(name, df) for name, df in tables.items()}
        new = {"schema_version": SCHEMA_VERSION, "generation": secrets.token_hex(16), "tables": paths, "metadata": old["metadata"] | (metadata or {}), "committed_at": time.time()}
        number = int(names[0][9:-5]) + 1 if names else 1
        if not self._write(f"manifest-{number:012d}.json", json.dumps(new, sort_keys=True)):
            raise Conflict("another writer has committed meanwhile")
        self.prune()
        return new

    def at_state(self, state: str, make: Callable[[], dict[str, DataFrame]]) -> Store:
        """This store with the tables that ``make`` gives for ``state`` of their sources, made where it holds another; of two
        writers one makes them and the other reads those."""
        held = lambda: (self.manifest() or {"metadata": {}})["metadata"].get("state") == state
        if not held():
            try:
                self.commit(make(), {"state": state})
            except Conflict:
                if not held():
                    raise
        return self

    def sweep(self, older: float = 86400.0) -> None:
        """Deletes folders that no manifest names and that were begun more than ``older`` seconds ago: what lost writers left."""
        fs, path = self._fs()
        named = {p.split("/")[0] for n in self._manifests() for p in json.loads(self._get(n))["tables"].values()}
        for x in fs.listStatus(path(self.root)):
            name = x.getPath().getName()
            if name.startswith("gen=") and name not in named and time.time() - x.getModificationTime() / 1000 > older:
                fs.delete(x.getPath(), True)

    def prune(self, keep: int = KEEP) -> None:
        """Deletes all but the last ``keep`` manifests and the generations that only deleted ones name."""
        fs, path = self._fs()
        names = self._manifests()
        used = lambda ns: {p.split("/")[0] for n in ns for p in json.loads(self._get(n))["tables"].values()}
        for gone in used(names[keep:]) - used(names[:keep]):
            fs.delete(path(f"{self.root}/{gone}"), True)
        for n in names[keep:]:
            fs.delete(path(f"{self.root}/{n}"), False)

    def busy(self) -> bool:
        """Whether a writer holds the lock."""
        fs, path = self._fs()
        return bool(fs.exists(path(f"{self.root}/LOCK")))

    @contextmanager
    def locked(self) -> Iterator[None]:
        """One writer at a time over a whole collection."""
        if not self._write("LOCK", str(time.time())):
            raise RuntimeError("another writer holds the lock")
        try:
            yield
        finally:
            fs, path = self._fs()
            fs.delete(path(f"{self.root}/LOCK"), False)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest()['tables'][name]}")

    def fresh(self, seconds: float) -> bool:
        found = self.manifest()
        return bool(found) and time.time() - found["committed_at"] <= seconds

    @staticmethod
    def digest(tables: dict[str, DataFrame]) -> str:
        """Of the rows of all tables, whatever their order: their number and the sums of two hashes of each row, so a row
        that stands twice counts twice."""
        total = lambda df, seed: F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")).cast("string")
        sums = {n: df.agg(F.count("*").alias("n"), total(df, 1).alias("a"), total(df, 2).alias("b")).first() for n, df in sorted(tables.items())}
        return hashlib.sha256(json.dumps({n: [r["n"], r["a"], r["b"]] for n, r in sums.items()}).encode()).hexdigest()

    def publish(self, target: Store, drop: tuple[str, ...] = PRIVATE) -> dict:
        """An immutable copy without private tables and metadata, incomplete vectors and vectors of no passage."""
        found = self.manifest()
        kept = {n: self.read(n) for n in found["tables"] if n not in drop}
        if "semantic_documents" in kept:
            kept["semantic_documents"] = kept["semantic_documents"].where("complete")
            if "passages" in kept:
                kept["passages"] = kept["passages"].join(kept["semantic_documents"].select("id"), "id", "left_semi")
        if "vectors" in kept and "passages" in kept:
            kept["vectors"] = kept["vectors"].join(kept["passages"].select("key"), "key", "left_semi")
        open_ = {k: v for k, v in found["metadata"].items() if k not in PRIVATE}
        return target.commit(kept, open_ | {"source": found["generation"], "sha256": self.digest(kept)})

    def size(self) -> int:
        fs, path = self._fs()
        return sum(fs.getContentSummary(path(f"{self.root}/{p}")).getLength() for p in set((self.manifest() or {"tables": {}})["tables"].values()))

    def acquire(self, source: Store, oldest: float | None = None, repositories: list[str] | None = None, most: int = 2 << 30) -> dict:
        """Installs a published copy after checking its age, size, scope and digest; nothing is committed if one fails."""
        found = source.manifest()
        if oldest is not None and not source.fresh(oldest):
            raise ValueError("the snapshot is too old")
        if source.size() > most:
            raise ValueError(f"the snapshot is larger than {most} bytes")
        if repositories and set(repositories) - set(found["metadata"].get("repositories", [])):
            raise ValueError("the snapshot lacks repositories")
        kept = {n: source.read(n) for n in found["tables"]}
        if self.digest(kept) != found["metadata"]["sha256"]:
            raise ValueError("the snapshot differs from its digest")
        return self.commit(kept, found["metadata"])
