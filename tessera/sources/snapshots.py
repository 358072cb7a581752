"""Write sink: each commit is a new immutable set of Parquet tables, and a pointer that is swapped last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import Catalog
from tessera.store import Store

FORMAT = 100


class SnapshotStore:
    """Tables under `root/data/<commit>/<table>`; `root/commits/<number>` holds one commit's manifest as JSON.

    A commit writes only the tables that changed; a reader takes each table from the newest commit that has it. Files go
    through Hadoop's file systems, so any store that Spark writes will do. A manifest is created under its number only if
    no file has it, which decides between concurrent commits, and a commit that breaks off leaves the last one whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, number: int | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits" + (f"/{number:012d}" if number else ""))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers of all commits, by one listing."""
        path, fs = self._path()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def manifest(self, number: int) -> dict:
        path, fs = self._path(number)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict | None:
        found = self.numbers()
        return self.manifest(found[-1]) if found else None

    def commit(self, tables: Mapping[str, DataFrame], schema: str | None = None, catalog: Catalog | None = None) -> int:
        """Writes changed tables and creates the manifest; a concurrent commit in between is an error. With a catalog, rows are kept together by the first index of their entity, so that scans skip files and row groups by its columns."""
        before = self.current() or {}
        number, at = before.get("number", 0) + 1, uuid.uuid4().hex
        order = {e.table: e.indexes[0].columns for e in catalog or () if e.indexes}
        for name, df in tables.items():
            if name in order:
                df = df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
            df.write.parquet(f"{self.root}/data/{at}/{name}")
        places = before.get("tables", {}) | {name: f"{self.root}/data/{at}/{name}" for name in tables}
        manifest = {"format": FORMAT, "number": number, "tables": places, "schema": schema or before.get("schema")}
        path, fs = self._path(number)
        try:
            out = fs.create(path, False)  # fails if the number is taken
        except Py4JJavaError as e:
            raise RuntimeError("another commit came first") from e
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        return number

    def load(self, catalog: Catalog, number: int | None = None) -> Store:
        """The store as of a commit; the newest by default."""
        found = self.numbers()
        if not found or number is not None and number not in found:
            raise LookupError(f"no such commit in {self.root}")
        m = self.manifest(number or found[-1])
        if m["format"] != FORMAT:
            raise ValueError(f"the store has format {m['format']}, not {FORMAT}")
        return Store(self.spark, catalog, {n: self.spark.read.parquet(p) for n, p in m["tables"].items()})
