"""Sharding by size-tiered compaction over a versioned manifest. Native: DataFrame operations and the file system only.

Arrivals are appended as small immutable shards: each task writes what it reads, no shuffle, and reads a fraction of the target; a shard
that is too large all the same is written again in parts. Compaction sorts the live shards into tiers
of similar size and, wherever a tier holds enough of them, packs runs of that tier into files of the target size: Spark's own file
packing puts similarly sized files together up to the target and each such pack is read by one task and written as one file. A version is a JSON
manifest that names every live shard; it is written beside its place and renamed into it, and the rename fails if
that version exists, so of two writers one wins and the other starts again from the winner's version. Files of a failed or
lost attempt are in no manifest and are never read.

Edge cases: an empty table commits a version without shards and reads back as an empty table of its schema; null
columns, long texts, repeated rows and any column names are carried as they are (``read`` adds ``_shard`` where there is none); a single
shard or shards of target size are left alone.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmatch.session import temporary

TARGET = 64 << 20
FANOUT = 4


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    rows: int


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    shards: tuple[Shard, ...]


class ShardStore:
    """Immutable shards under ``path``, and manifests that say which are live."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list[tuple[str, int]]:
        if not self._fs.exists(self._at(name)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._at(name)))

    def latest(self) -> Version:
        found = [int(n[1:-5]) for n, _ in self._list("manifest") if n.startswith("v") and n.endswith(".json")]
        return self.version(max(found)) if found else Version(0, "", ())

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._at(f"manifest/v{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return Version(got["number"], got["schema"], tuple(Shard(**s) for s in got["shards"]))

    def commit(self, version: Version) -> Version:
        """Make ``version`` the latest, whole or not at all."""
        temporary, place = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/v{version.number:012d}.json")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(temporary, place, none)
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise CommitConflict(f"version {version.number} exists") from e
            raise
        return version

    def _read_bytes(self) -> int:
        return int(self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())

    @contextmanager
    def _set(self, conf: dict[str, str]) -> Iterator[None]:
        was = {k: self.spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _write(self, df: DataFrame, folder: str, per_file: int = 0) -> list[Shard]:
        df.write.option("maxRecordsPerFile", per_file).parquet(f"{self.path}/{folder}")
        files = {n: size for n, size in self._list(folder) if n.endswith(".parquet")}
        if not files:
            return []
        # the footers alone give the counts
        counts = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("n")).count().collect()
        rows = {r["n"]: r["count"] for r in counts}
        return [Shard(f"{folder}/{n}", size, rows[n]) for n, size in files.items() if rows.get(n)]

    def append(self, df: DataFrame, target: int = TARGET, fanout: int = FANOUT) -> Version:
        """Commit the rows of ``df`` as new shards, as they come, well under ``target``."""
        most = max(1, target // fanout)
        with self._set({"spark.sql.files.maxPartitionBytes": str(min(most, self._read_bytes()))}):
            new = self._write(df, f"data/{uuid.uuid4().hex}")
        large = [s for s in new if s.bytes >= 0.75 * target and s.rows > 1]  # a row group, or rows that no file scan deals out
        if large:
            per_file = max(1, min(s.rows * most // s.bytes for s in large))
            new = [s for s in new if s not in large] + self._write(self._read(large, df.schema.json()), f"data/{uuid.uuid4().hex}", per_file)
        while True:
            now = self.latest()
            try:
                return self.commit(Version(now.number + 1, now.schema or df.schema.json(), now.shards + tuple(new)))
            except CommitConflict:
                continue

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> Version:
        """Merge tiers that hold ``fanout`` shards or more until none does; one commit for each round."""
        while True:
            now = self.latest()
            tiers: dict[int, list[Shard]] = {}
            for s in now.shards:
                if s.bytes < 0.75 * target:
                    tiers.setdefault(math.floor(math.log(max(s.bytes, 1), fanout)), []).append(s)
            due = [t for _, t in sorted(tiers.items()) if len(t) >= fanout]
            if not due:
                return now
            gone: set[str] = set()
            made: list[Shard] = []
            for tier in due:
                merged = self._merge(tier, target, now.schema)
                if len(merged) < len(tier):
                    gone |= {s.name for s in tier}
                    made += merged
            if not gone:
                return now
            try:
                self.commit(Version(now.number + 1, now.schema, tuple(s for s in now.shards if s.name not in gone) + tuple(made)))
            except CommitConflict:
                continue  # the shards just made are in no manifest; the next round starts from what is live now

    def _merge(self, tier: list[Shard], target: int, schema: str) -> list[Shard]:
        conf = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        with self._set(conf):
            return self._write(self._read(tier, schema), f"data/{uuid.uuid4().hex}")

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.path}/{s.name}" for s in shards])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version (the latest), each with the shard that holds it in ``_shard``, unless the rows have such a column of their own."""
        at = self.latest() if number is None else self.version(number)
        if not at.schema:
            raise ValueError("nothing was committed yet")
        schema = T.StructType.fromJson(json.loads(at.schema))
        rows = self._read(list(at.shards), at.schema) if at.shards else self.spark.createDataFrame([], schema)
        if "_shard" in rows.columns:
            return rows
        return rows.withColumn("_shard", F.col("_metadata.file_path") if at.shards else F.lit(None).cast("string"))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files of folders that the last ``keep`` versions do not name; returns how many. Not while another writer is at work."""
        last = self.latest().number
        live = {s.name for v in range(max(1, last - keep + 1), last + 1) for s in self.version(v).shards}
        dropped = 0
        for folder, _ in self._list("data"):
            for name, _ in self._list(f"data/{folder}"):
                if name.endswith(".parquet") and f"data/{folder}/{name}" not in live:
                    self._fs.delete(self._at(f"data/{folder}/{name}"), False)
                    dropped += 1
        return dropped


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard ``documents``: append, compact, drop the superseded files, and say of each document where it is."""
    store = ShardStore(spark, temporary(spark, "shards"))
    store.append(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    now = store.compact()
    store.vacuum()
    sizes = spark.createDataFrame([(s.name.rsplit("/", 1)[1], i, s.bytes, s.rows) for i, s in enumerate(sorted(now.shards, key=lambda s: (-s.rows, s.bytes, s.name)))], "file string, shard int, shard_bytes long, shard_rows long")
    rows = store._read(list(now.shards), now.schema).select("doc_id", F.col("_metadata.file_name").alias("file"))
    return rows.join(sizes, "file").select("doc_id", "shard", "shard_bytes", "shard_rows", F.lit(now.number).alias("version"))
