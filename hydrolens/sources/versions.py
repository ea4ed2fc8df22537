"""Keyed tables with versions on plain Parquet files.

``path/data`` holds folders that are written once; ``path/manifests`` holds one small document per version, which lists the folders of each partition.
A writer stores new folders, then publishes the next manifest by a rename that fails if it exists: a writer that dies before leaves the table as it was, and of two
writers one is refused. Readers take the files of one manifest, so they never see half a version. The manifest grows with partitions, not with rows.
Object stores without an atomic rename need a table format with its own catalog.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolens.operators.validate import duplicate_keys

_MARK = "__p_"  # partition columns stay in the files; the folders carry copies


def part_name(**values) -> str:
    """Name of a partition, for reads of some partitions only."""
    return "/".join(f"{_MARK}{k}={v}" for k, v in values.items())


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    clash = duplicate_keys(df, keys).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key in one batch: {[clash[0][k] for k in keys]}")


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()) -> None:
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # --- manifests ---

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict | None:
        known = self.versions()
        return self._manifest(known[-1]) if known else None

    def _publish(self, version: int, schema: T.StructType, folders: list[dict]) -> None:
        jvm = self.spark._jvm
        draft = self._path(f"manifests/{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps({"version": version, "schema": schema.jsonValue(), "folders": folders}).encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._path(f"manifests/{version:012d}.json"), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            raise RuntimeError(f"version {version} of {self.path} was written by another writer") from e

    # --- folders ---

    def _store(self, df: DataFrame, tag: str | None = None) -> list[dict]:
        name = f"data/{uuid.uuid4().hex}"
        copies = {_MARK + c: F.col(c) for c in self.partition_by}
        df.withColumns(copies).write.partitionBy(*copies).parquet(f"{self.path}/{name}")
        if not copies:
            return [{"part": "", "folder": name, "tag": tag}]
        depth = len(copies)
        leaves = self._fs.globStatus(self._path(name + f"/{_MARK}*" * depth)) or []
        parts = ["/".join(str(s.getPath()).split("/")[-depth:]) for s in leaves]
        return [{"part": p, "folder": f"{name}/{p}", "tag": tag} for p in parts]

    def _read(self, folders: Iterable[dict], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{f['folder']}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The table as of a version (the last one unless told), or some of its partitions. Only their files are listed and read."""
        manifest = self.current() if version is None else self._manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        wanted = None if parts is None else set(parts)
        folders = [f for f in manifest["folders"] if wanted is None or f["part"] in wanted]
        return self._read(folders, T.StructType.fromJson(manifest["schema"]))

    # --- changes ---

    def _next(self, schema: T.StructType) -> tuple[int, T.StructType, list[dict]]:
        manifest = self.current()
        if manifest is None:
            return 1, schema, []
        merged = T.StructType.fromJson(manifest["schema"])
        have = set(merged.names)
        return manifest["version"] + 1, T.StructType(merged.fields + [f for f in schema.fields if f.name not in have]), manifest["folders"]

    def upsert(self, updates: DataFrame, keys: Sequence[str]) -> None:
        """Last write wins per key; keys repeated in one batch are refused, and nothing changes then.

        Only partitions that the updates touch are read and written. The partition must be part of the key or fixed by it. Null keys never match.
        """
        staged = self._store(updates)
        batch = self._read(staged, updates.schema)
        assert_unique(batch, keys)
        version, schema, folders = self._next(updates.schema)
        touched = {f["part"] for f in staged}
        old = [f for f in folders if f["part"] in touched]
        kept = self._store(self._read(old, schema).join(batch.select(*keys), list(keys), "left_anti").select(*schema.names)) if old else []
        self._publish(version, schema, [f for f in folders if f["part"] not in touched] + kept + staged)

    def append(self, rows: DataFrame, tag: str | None = None) -> None:
        """Add rows; an earlier append of the same tag is replaced, so that a replay leaves the same table."""
        version, schema, folders = self._next(rows.schema)
        kept = [f for f in folders if tag is None or f["tag"] != tag]
        self._publish(version, schema, kept + self._store(rows, tag))

    def compact(self, least: int = 16) -> None:
        """Rewrite partitions that lie in at least ``least`` folders into one folder each."""
        manifest = self.current()
        if manifest is None:
            return
        version, schema, folders = self._next(T.StructType([]))
        counts: dict[str, int] = {}
        for f in folders:
            counts[f["part"]] = counts.get(f["part"], 0) + 1
        many = {p for p, n in counts.items() if n >= least}
        if many:
            merged = self._store(self._read([f for f in folders if f["part"] in many], schema))
            self._publish(version, schema, [f for f in folders if f["part"] not in many] + merged)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and folders that none of those lists. No writer, and no reader of older versions, may be at work."""
        known = self.versions()
        used = {f["folder"].split("/")[1] for v in known[-keep:] for f in self._manifest(v)["folders"]}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        for s in self._fs.listStatus(self._path("data")) if known else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
