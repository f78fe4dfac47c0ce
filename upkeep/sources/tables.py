"""A set of tables that change together.

Every table is a list of Parquet folders. A commit writes its new folders first
and then publishes one manifest, a small JSON file that names the live folders of
all tables. Manifests are numbered; publishing is one rename to the next number,
which fails if that number exists, so readers see all of a commit or none of it,
a job that dies half-way leaves the last state, and of two commits at once the
second starts again from the first one's state. A commit has a key; a key that is
already in the manifest adds nothing, so a repeated job is harmless.

Works on any Hadoop file system that renames without overwriting. The manifest
grows by a folder name a table and commit; ``compact`` rewrites a table as one
folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another commit was published in between."""


class TableSet:
    """Tables below ``root`` with the given schemas."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -------------------------------------------------------------- manifests
    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The live state: version, tables (folders by name) and commit keys."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "tables": {}, "keys": []}
        rows = self.spark.read.text(f"{self.root}/manifests/{numbers[-1]:010d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _publish(self, manifest: dict) -> None:
        folder = f"{self.root}/manifests"
        staged = self._path(f"{folder}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(folder))
        out = self._fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        target = self._path(f"{folder}/{manifest['version']:010d}.json")
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise Conflict(f"version {manifest['version']} exists")

    # ----------------------------------------------------------------- tables
    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The live rows of a table; empty if nothing was committed yet."""
        schema = self.schemas[name]
        folders = (manifest or self.manifest())["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    @contextmanager
    def commit(self, key: str) -> Iterator[Commit | None]:
        """``with tables.commit(key) as c:`` stages writes on ``c`` and publishes them
        together at the end; ``c`` is None if the key was committed before. An
        exception in the block publishes nothing."""
        state = self.manifest()
        if key in state["keys"]:
            yield None
            return
        change = Commit(self, state)
        yield change
        self._publish({"version": state["version"] + 1, "tables": change.tables, "keys": [*state["keys"], key]})

    def compact(self, name: str) -> None:
        """Rewrite a table of several folders as one."""
        with self.commit(f"compact:{name}:{self.manifest()['version']}") as change:
            if change is not None:
                change.replace(name, change.read(name))


class Commit:
    """The staged writes of one commit; reads see the state it started from."""

    def __init__(self, owner: TableSet, state: dict):
        self.owner, self.state = owner, state
        self.tables = {name: list(folders) for name, folders in state["tables"].items()}

    def read(self, name: str) -> DataFrame:
        return self.owner.read(name, self.state)

    def _stage(self, name: str, rows: DataFrame) -> str:
        schema = self.owner.schemas[name]
        missing = [f.name for f in schema.fields if f.name not in rows.columns and not f.nullable]
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")
        columns = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.select(*columns).write.parquet(f"{self.owner.root}/{folder}")
        return folder

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Stage further rows of a table; returns them as written."""
        folder = self._stage(name, rows)
        self.tables.setdefault(name, []).append(folder)
        return self.owner.spark.read.schema(self.owner.schemas[name]).parquet(f"{self.owner.root}/{folder}")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Stage the whole new content of a table; returns it as written."""
        folder = self._stage(name, rows)
        self.tables[name] = [folder]
        return self.owner.spark.read.schema(self.owner.schemas[name]).parquet(f"{self.owner.root}/{folder}")
