"""Versioned graphs on plain Parquet: immutable table versions, a manifest each, and a change log.

A stored graph is a folder.  ``manifests/<n>.json`` names for version n the
schema and, for each type, the folders of its rows; the newest version is the
one of the greatest n.  A commit writes new folders for the types that changed
(for rows that were only added, one folder beside the old ones), the change
rows, and last the manifest, whole and only if there is none of its number:
that is the one step that makes the version, so readers see either version
whole, and of two writers on the same version the second fails.  Paths go
through Hadoop's file systems, so a shared store works as a local disk.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hopline.errors import StoreError
from hopline.functions.text import STORED
from hopline.plans.schema import Catalog, parse_schema

CHANGES = "graph_version bigint, change_kind string, entity_kind string, type_name string, entity_id bigint, logical_key string, row string"

#: File systems on which a file appears when it is closed, and a create that must not overwrite is checked then.
WHOLE_FILES = {"s3a", "gs", "abfs", "abfss"}


@dataclass
class Manifest:
    version: int
    schema: str
    next_node: int = 0
    next_edge: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)  # type to folders, relative
    rows: dict[str, int] = field(default_factory=dict)
    changes: list[str] = field(default_factory=list)  # folders of change rows, oldest first
    changed: list[str] = field(default_factory=list)  # types that this version wrote
    tokens: dict[str, list[str]] = field(default_factory=dict)  # node type to the properties whose tokens all its folders hold

    @property
    def catalog(self) -> Catalog:
        return parse_schema(self.schema)


class Store:
    """Files of one graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}"))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        self._put(self._at(f"{self.path}/{name}"), text, True)

    def _put(self, at, text: str, overwrite: bool) -> None:
        stream = self._fs.create(at, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Make a whole file, unless there is one of this name already; whether it was made.

        Local disks link a finished file into place; object stores make a file
        as a whole when it is closed, and refuse to if they were told not to
        overwrite; others rename, which doesn't replace a file there.
        """
        target = self._at(f"{self.path}/{name}")
        if self._fs.exists(target):
            return False
        if self._fs.getUri().getScheme() in WHOLE_FILES:
            try:
                self._put(target, text, False)
            except Py4JJavaError:
                return False
            return True
        beside = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        self._put(beside, text, True)
        try:
            if self._fs.getUri().getScheme() == "file":
                self._fs.mkdirs(target.getParent())
                os.link(*(at.toUri().getPath() for at in (beside, target)))
                return True
            self._fs.mkdirs(target.getParent())
            return bool(self._fs.rename(beside, target))
        except FileExistsError:
            return False
        finally:
            if self._fs.exists(beside):
                self._fs.delete(beside, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    # versions

    def current(self) -> int:
        found = self.versions()
        if not found:
            raise StoreError(f"{self.path} holds no graph")
        return found[-1]

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.current() if version is None else version
        if not self.exists(f"manifests/{version}.json"):
            raise StoreError(f"version {version} is gone")
        return Manifest(**json.loads(self.read_text(f"manifests/{version}.json")))

    def table(self, m: Manifest, kind: str, tokens: bool = False) -> DataFrame | None:
        """The rows of a type in a version, on demand with their stored tokens; nothing if none were ever written."""
        if kind not in m.tables:
            return None
        catalog = m.catalog
        owner = catalog.nodes.get(kind) or catalog.edges[kind]
        if m.version < self.current() and not all(map(self.exists, m.tables[kind])):
            raise StoreError(f"the rows of {kind} in version {m.version} are gone")
        schema = owner.schema()
        for prop in m.tokens.get(kind, ()) if tokens else ():
            schema = schema.add(f"{STORED}{prop}", T.ArrayType(T.StringType()))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in m.tables[kind]])

    def files(self, m: Manifest, kind: str) -> list[int]:
        """The sizes of a table's files."""
        found = []
        for folder in m.tables[kind]:
            found += [s.getLen() for s in self._fs.listStatus(self._at(f"{self.path}/{folder}")) if s.getPath().getName().endswith(".parquet")]
        return found

    def rows(self, m: Manifest, kind: str, folder: str) -> DataFrame:
        """The rows of one folder of a type."""
        owner = m.catalog.nodes.get(kind) or m.catalog.edges[kind]
        return self.spark.read.schema(owner.schema()).parquet(f"{self.path}/{folder}")

    def write(self, df: DataFrame, folder: str) -> str:
        name = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, schema: str) -> Manifest:
        if self.versions():
            raise StoreError(f"{self.path} holds a graph already")
        m = Manifest(0, schema)
        m.catalog  # a schema with errors is refused before anything is written
        self.publish(m, None)
        return m

    def publish(self, m: Manifest, base: int | None) -> None:
        """Make ``m`` the newest version if ``base`` still is."""
        now = (self.versions() or [None])[-1]
        if now != base or not self.put_new(f"manifests/{m.version}.json", json.dumps(m.__dict__, indent=1)):
            raise StoreError(f"version {base} was changed meanwhile")

    def changes(self, m: Manifest) -> DataFrame:
        if not m.changes:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/{c}" for c in m.changes])
