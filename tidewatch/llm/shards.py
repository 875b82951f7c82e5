"""Size-tiered compaction of immutable Parquet shards under a versioned manifest."""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import scratch_path, unused

TARGET_BYTES = 128 << 20
#: Shards of one tier differ in size by this factor at most; so many of a tier are merged.
FAN_IN = 4
#: Arrivals that the query deals a table to.
ARRIVALS = 8
#: Versions from one full listing of the shards to the next; those between say only what changed.
BASE_EVERY = 16
#: Shards that one job merges at most.
MERGE_MOST = 10_000
SMALLEST = 64 << 10


class ManifestConflict(RuntimeError):
    """Another writer committed the version first; its change has to be read before trying again."""


class ShardStore:
    """A table of immutable shards. Readers see the shards that the newest version lists.

    Data files are written below ``data`` under new names and count only once a version names
    them. A version is a file with the shards that it adds and removes, so that a commit writes as
    much as it changes whatever the table's size. The file is written aside and then renamed to its
    version's name by the file system's own rename without overwriting, which is refused if that
    exists; a failed or lost writer leaves files that no version names. A store whose file system
    can't refuse that needs one writer at a time. A change that another writer came before is made
    again on what it left. Every ``base_every`` versions all shards are listed in a base beside
    them. It follows from the versions, so that any writer may write it, and one that is lost
    before it did costs readers more files to read, until the next.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        target_bytes: int = TARGET_BYTES,
        fan_in: int = FAN_IN,
        base_every: int = BASE_EVERY,
        merge_most: int = MERGE_MOST,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in = target_bytes, fan_in
        self.base_every, self.merge_most = base_every, max(merge_most, fan_in)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # manifests

    def _numbers(self, kind: str) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith(kind) and n.endswith(".json"))

    def versions(self) -> list[int]:
        return self._numbers("v")

    def manifest(self, version: int | None = None) -> dict:
        """All shards of a version, of the newest if not given; version 0 is the empty table.

        It is the last base that isn't newer, with the changes since. A version that was vacuumed
        raises ValueError.
        """
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version and version not in found:
            raise ValueError(f"there is no version {version}")
        base = max((b for b in self._numbers("b") if b <= version), default=0)
        now = self._load("b", base) if base else {"schema": None, "shards": []}
        shards, schema = {s["path"]: s for s in now["shards"]}, now["schema"]
        for v in range(base + 1, version + 1):
            change = self._load("v", v)
            for path in change["removed"]:
                del shards[path]
            shards |= {s["path"]: s for s in change["added"]}
            schema = change["schema"] or schema
        return {"version": version, "schema": schema, "shards": list(shards.values())}

    def _name(self, kind: str, version: int) -> str:
        return f"{self.root}/manifests/{kind}{version:08d}.json"

    def _load(self, kind: str, version: int) -> dict:
        stream = self._fs.open(self._path(self._name(kind, version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, kind: str, version: int, body: dict) -> bool:
        """Write a file of the manifest at once; False if there is one."""
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if not self._rename(aside, self._path(self._name(kind, version))):
            self._fs.delete(aside, False)
            return False
        return True

    def _commit(self, parent: dict, added: list[dict], removed: list[str], schema: str | None) -> int:
        version = parent["version"] + 1
        # the schema is kept where it is new
        told = schema if schema != parent["schema"] else None
        if not self._save("v", version, {"version": version, "schema": told, "added": added, "removed": removed}):
            raise ManifestConflict(f"version {version} exists")
        if version % self.base_every == 0:
            self._base(version)
        return version

    def _base(self, version: int) -> None:
        if version not in self._numbers("b"):
            self._save("b", version, self.manifest(version))

    def _rename(self, source, target) -> bool:
        """Rename unless the target exists; where files are local, a hard link refuses that and rename doesn't."""
        jvm = self.spark._jvm
        if self._fs.getScheme() == "file":
            files, parts = jvm.java.nio.file.Files, self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
            at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), parts)
            try:
                files.createLink(at(target), at(source))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
                return False
            self._fs.delete(source, False)
            return True
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def _change(self, make: Callable[[dict], tuple[list[dict], list[str], str | None] | None], tries: int = 20) -> int:
        """Commit what ``make`` adds and removes, again if another writer came before; None is no change."""
        for _ in range(tries):
            now = self.manifest()
            made = make(now)
            if made is None:
                return now["version"]
            with contextlib.suppress(ManifestConflict):
                return self._commit(now, *made)
        raise ManifestConflict(f"other writers came before {tries} times")

    # writing

    def _write(self, df: DataFrame) -> list[dict]:
        """Write a frame's partitions as shards; one entry a file, with its size."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        found = self._fs.listStatus(self._path(folder))
        files = [(s.getPath().getName(), s.getLen()) for s in found]
        return [{"path": f"{folder[len(self.root) + 1:]}/{n}", "bytes": size} for n, size in sorted(files) if n.endswith(".parquet")]

    def write_arrivals(self, df: DataFrame, arrivals: int) -> list[list[dict]]:
        """Write a frame's rows as the files of so many arrivals, in one job."""
        name = unused("__arrival", df.columns)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        numbered = df.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals)).cast("int"))
        numbered.write.partitionBy(name).option("compression", "zstd").parquet(folder)
        out = []
        for part in sorted((s.getPath() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()), key=lambda p: p.getName()):
            files = sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(part))
            where = f"{folder[len(self.root) + 1:]}/{part.getName()}"
            out.append([{"path": f"{where}/{n}", "bytes": size} for n, size in files if n.endswith(".parquet")])
        return out

    def append(self, df: DataFrame) -> int:
        """Add arrivals as the small shards that their partitions give; returns the new version.

        Names and types of columns have to be those of the table, in any order; others are refused
        before anything is written.
        """
        self._conform(df, self.manifest()["schema"])
        return self.append_files(self._write(df), df.schema)

    def append_files(self, files: list[dict], schema: T.StructType) -> int:
        """Add shards that lie below the root already."""

        def make(now: dict) -> tuple[list[dict], list[str], str]:
            self._conform(schema, now["schema"])
            return files, [], now["schema"] or schema.json()

        return self._change(make)

    @staticmethod
    def _conform(given: DataFrame | T.StructType, schema: str | None) -> None:
        if schema is None:
            return
        fields = (given if isinstance(given, T.StructType) else given.schema).fields
        have = {f.name: f.dataType for f in fields}
        want = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(schema)).fields}
        if have != want:
            odd = sorted(k for k in have.keys() | want.keys() if have.get(k) != want.get(k))
            raise ValueError(f"columns that aren't the table's: {', '.join(odd)}")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fan_in)))

    def full_tiers(self, manifest: dict) -> dict[int, list[dict]]:
        """The shards under half the target of each tier that has ``fan_in`` of them or more."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] < self.target_bytes // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return {k: v for k, v in tiers.items() if len(v) >= self.fan_in}

    def merges(self, manifest: dict) -> list[list[dict]]:
        """What can be merged: the full tiers' shards by size, smallest tier first, as many as a job takes at a time."""
        out = []
        for _, shards in sorted(self.full_tiers(manifest).items()):
            by_size = sorted(shards, key=lambda s: (s["bytes"], s["path"]))
            out += [by_size[i : i + self.merge_most] for i in range(0, len(by_size), self.merge_most)]
        return [m for m in out if len(m) >= self.fan_in]

    def compact(self) -> int:
        """Merge runs of similar size until no tier below the target holds ``fan_in`` that can be merged.

        Shards of a tier are merged in one job without a shuffle, at most ``merge_most`` of them:
        Spark packs their files into read splits of the target size, and each split becomes one
        file. Each merge leaves fewer shards, so that this ends. Shards whose merge doesn't are left
        as they are, and the others go on.
        """
        stuck: set[frozenset[str]] = set()
        while True:
            now = self.manifest()
            merged = next((m for m in self.merges(now) if frozenset(s["path"] for s in m) not in stuck), None)
            if merged is None:
                return now["version"]
            gone = {s["path"] for s in merged}
            with self._splits(merged):
                made = self._write(self._read([s["path"] for s in merged], now["schema"]))
            if len(made) >= len(merged):
                self._delete(made)
                stuck.add(frozenset(gone))
                continue

            def make(now: dict) -> tuple[list[dict], list[str], str | None] | None:
                if not gone <= {s["path"] for s in now["shards"]}:
                    return None  # another writer merged some of them
                return made, sorted(gone), now["schema"]

            self._change(make)
            if not {s["path"] for s in made} <= {s["path"] for s in self.manifest()["shards"]}:
                self._delete(made)

    @contextmanager
    def _splits(self, shards: list[dict]):
        """Read splits of the target size while merging; what the session had comes back."""
        # Spark makes splits smaller than that if there are fewer than its parallelism
        want = {
            "spark.sql.files.maxPartitionBytes": str(self.target_bytes),
            "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": str(max(1, -(-sum(s["bytes"] for s in shards) // self.target_bytes))),
        }
        had = {k: self.spark.conf.get(k, None) for k in want}
        try:
            for k, v in want.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in had.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _delete(self, shards: list[dict]) -> int:
        return sum(bool(self._fs.delete(self._path(f"{self.root}/{s['path']}"), False)) for s in shards)

    def orphans(self, older_than_s: float) -> list[dict]:
        """Data files that no version names, from writers that failed at least so long ago."""
        versions = self.versions()
        named = {s["path"] for v in versions[:1] for s in self.manifest(v)["shards"]}
        named |= {s["path"] for v in versions[1:] for s in self._load("v", v)["added"]}
        before, found = (time.time() - older_than_s) * 1000, []
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            files = self._fs.listFiles(folder.getPath(), True)
            while files.hasNext():
                s = files.next()
                path = "data/" + s.getPath().toUri().getPath().rsplit("/data/", 1)[1]
                if path.endswith(".parquet") and path not in named and s.getModificationTime() < before:
                    found.append({"path": path, "bytes": s.getLen()})
        return found

    def vacuum(self, keep: int = 1, orphans_s: float = 86_400) -> int:
        """Delete what none of the newest ``keep`` versions names, older versions, and old orphans.

        The oldest version that stays gets a base before the changes that led to it go, and those go
        oldest first, so that a vacuum that is lost can be made again.
        """
        gone, versions = self._delete(self.orphans(orphans_s)), self.versions()
        if not versions:
            return gone
        first = versions[-keep:][0]
        self._base(first)
        for v in [v for v in versions if v <= first]:
            # a shard's name is never used again, so what a version removes is in none that stays
            gone += self._delete([{"path": p} for p in self._load("v", v)["removed"]])
            if v < first:
                self._fs.delete(self._path(self._name("v", v)), False)
        for b in [b for b in self._numbers("b") if b < first]:
            self._fs.delete(self._path(self._name("b", b)), False)
        return gone

    # reading

    def _read(self, paths: list[str], schema: str | None) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        found = self.manifest(version)
        return self._read([s["path"] for s in found["shards"]], found["schema"])


def sharded(docs: DataFrame, *, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Append a table to a new store in several arrivals, compact it, and read it back.

    The rows are dealt to the arrivals by their partition and place; one job writes the files of
    all, each arrival is committed as a version of its own, and merges follow. All rows and columns
    come back whatever they hold, repeated rows as often as they are there; an empty table comes
    back empty.
    """
    store = ShardStore(docs.sparkSession, scratch_path(docs.sparkSession, "shards"), target_bytes=target_bytes, fan_in=fan_in)
    store.append_files([], docs.schema)
    for files in store.write_arrivals(docs, arrivals):
        store.append_files(files, docs.schema)
    store.compact()
    store.vacuum()
    return store.read()
