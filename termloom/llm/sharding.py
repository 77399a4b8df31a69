"""A shard store with size-tiered compaction and versioned manifests.

``append`` writes arrivals as small immutable Parquet files, one a task. ``compact`` groups the shards of
each size tier (sizes within a factor ``fanout``) and merges tiers that hold at least ``fanout`` shards
into files of about the target size. Scan planning packs small files into partitions of the target size,
so a merge reads and writes each byte once, without a shuffle, and one task holds one batch at a time.

Every change is a new manifest file that lists all live shards. It is written aside and renamed to the next
version's name, which fails if another writer committed that version first; the change is then tried on
top of the new version (append) or dropped and planned anew (compact). Readers see a version or the next, never a mixture,
and a task or executor lost on the way leaves only files that no manifest names, which ``vacuum`` deletes.

Defined cases: an empty table commits a version without shards; repeated rows and nulls are kept;
columns are stored as they are; arrivals may have fewer or more columns than older shards (null where a shard
lacks one), a column of another type is refused; an input column named ``shard_id`` or ``shard_row`` gives way to the
store's own in ``placed``.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, small_or_shuffled

TARGET_BYTES = 128 << 20
FANOUT = 4
SMALLEST = 1 << 16


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._jvm = jvm

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "schema": None, "shards": []}
            version = known[-1]
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> dict:
        """Write aside, then rename to the version's name, which must be free."""
        aside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        final = self._path(f"{self.path}/manifests/v{manifest['version']:010d}.json")
        self._fs.mkdirs(aside.getParent())
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(final), options)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise Conflict(f"version {manifest['version']}") from e
            raise
        return manifest

    # files

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        found = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        if not found:
            return []
        back = self.spark.read.schema(df.schema).parquet(folder)
        name = back.metadataColumn("_metadata")["file_name"]
        rows = {r[0]: r[1] for r in back.groupBy(name.alias("f")).agg(F.count("*").alias("n")).toLocalIterator()}
        return [{"file": f"{folder}/{f}", "bytes": b, "rows": rows.get(f, 0)} for f, b in sorted(found.items()) if rows.get(f, 0)]

    def append(self, df: DataFrame) -> dict:
        """Add rows as small shards and commit."""
        shards = self._write(df)
        while True:
            old = self.manifest()
            try:
                return self._commit({"version": old["version"] + 1, "schema": self._joint(old["schema"], df.schema), "shards": old["shards"] + shards})
            except Conflict:
                continue

    @staticmethod
    def _joint(old: str | None, new: T.StructType) -> str:
        """The old columns and the new ones; a column of older shards keeps its type."""
        known = T.StructType.fromJson(json.loads(old)).fields if old else []
        types = {f.name: f.dataType for f in known}
        for f in new.fields:
            if types.get(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].simpleString()} in older shards, not {f.dataType.simpleString()}")
        fields = [*known, *[f for f in new.fields if f.name not in types]]
        return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in fields]).json()

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout)))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The tiers to merge: at least ``fanout`` shards of one tier that are below the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target * 3 / 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]

    def compact(self) -> dict:
        """Merge until no tier is due; each merge commits its own version."""
        while True:
            old = self.manifest()
            due = self.plan(old["shards"])
            if not due:
                return old
            merged = self._merge(due[0], T.StructType.fromJson(json.loads(old["schema"])))
            if len(merged) >= len(due[0]):
                return old
            gone = {s["file"] for s in due[0]}
            kept = [s for s in old["shards"] if s["file"] not in gone]
            try:
                self._commit(old | {"version": old["version"] + 1, "shards": kept + merged})
            except Conflict:
                continue  # the merge is dropped, and the new version looked at

    def _merge(self, shards: list[dict], schema: T.StructType) -> list[dict]:
        """Scan planning of a session of its own packs the small files."""
        own = self.spark.newSession()
        for k, v in (("maxPartitionBytes", str(self.target)), ("openCostInBytes", "0"), ("minPartitionNum", "1")):
            own.conf.set(f"spark.sql.files.{k}", v)
        return self._write(own.read.schema(schema).parquet(*[s["file"] for s in shards]))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data files that none of the last versions names; returns how many."""
        known = self.versions()
        kept = {s["file"] for v in known[-keep_versions:] for s in self.manifest(v)["shards"]}
        for v in known[:-keep_versions]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:010d}.json"), False)
        gone = 0
        data = self._path(f"{self.path}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else ():
            for s in self._fs.listStatus(folder.getPath()):
                name = f"{self.path}/data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if name.endswith(".parquet") and name not in kept:
                    gone += self._fs.delete(s.getPath(), False)
        return gone

    # reads

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType()
        files = [s["file"] for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def placed(self, version: int | None = None) -> DataFrame:
        """All rows with ``shard_id`` (place in the manifest) and ``shard_row`` (place in the file)."""
        m = self.manifest(version)
        df = self.read(version)
        own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard_id", "shard_row")]
        if not m["shards"]:
            return df.select(*own, F.lit(None).cast("int").alias("shard_id"), F.lit(None).cast("long").alias("shard_row"))
        named = [(s["file"].rsplit("/", 2)[1], s["file"].rsplit("/", 1)[1], i) for i, s in enumerate(m["shards"])]
        names = self.spark.createDataFrame(named, "folder string, file string, shard_id int")
        meta = df.metadataColumn("_metadata")
        parts = F.split(meta["file_path"], "/")
        rows = df.select(F.struct(*own).alias("row"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), meta["row_index"].alias("shard_row"))
        return rows.join(small_or_shuffled(names), ["folder", "file"]).select("row.*", "shard_id", "shard_row")


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardStore:
    """Store all rows: arrivals as small shards, then compaction."""
    store = ShardStore(docs.sparkSession, shared_dir(docs.sparkSession, "shards"), target_bytes, fanout)
    store.append(docs)
    store.compact()
    return store
