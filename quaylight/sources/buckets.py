"""Tables in buckets of a key's hash: a change rewrites the buckets that it touches and leaves the files of all others."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators import keys
from quaylight.sources.sinks import Table

#: Rows of the manifest: where a bucket lies, or the last batch of a writer.
_MANIFEST = "kind string, name string, value string"


class Buckets:
    """A table of ``buckets`` folders by the hash of ``by``, with a manifest that names the current folder of each.

    A change reads and writes touched buckets only and is one new version of the manifest, so readers see all of it or
    nothing.  The number of buckets is set once, for the table's final size: one bucket is what a task rewrites.  One writer
    at a time.  Folders that no version names any more stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, by: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.by, self.buckets = spark, folder.rstrip("/"), list(by), buckets
        self._manifest = Table(spark, f"{self.folder}/manifest")

    def _rows(self) -> dict[tuple[str, str], str]:
        """The manifest: a row for each bucket and writer."""
        rows = self._manifest.read()
        return {} if rows is None else {(r["kind"], r["name"]): r["value"] for r in rows.collect()}

    def folders(self) -> dict[int, str]:
        """Where each bucket that has rows lies."""
        return {int(name): value for (kind, name), value in self._rows().items() if kind == "bucket"}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None for a table without rows there."""
        found = [where for k, where in sorted(self.folders().items()) if buckets is None or k in buckets]
        return self.spark.read.parquet(*found) if found else None

    def change(self, new: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str | None = None, batch: int | None = None) -> list[int]:
        """Touched buckets become ``combine(old, new)`` with their old rows; gives their numbers.

        A ``batch`` of a ``writer`` that isn't above its last one is done already and changes nothing, so a stream may run
        its batches again.  ``combine`` keeps keys as they are.
        """
        rows = self._rows()
        if writer is not None and batch is not None and batch <= int(rows.get(("writer", writer), -1)):
            return []
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())
        target = f"{self.folder}/data-{uuid.uuid4().hex[:12]}"
        if touched:
            out = combine(self.read(touched), new)
            out.withColumn("__bucket", self.bucket()).repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(target)
            written = set(self._listed(target))
            rows = {k: v for k, v in rows.items() if k[0] != "bucket" or int(k[1]) not in touched}
            rows |= {("bucket", str(k)): f"{target}/__bucket={k}" for k in touched if k in written}
        if writer is not None and batch is not None:
            rows["writer", writer] = str(batch)
        self._manifest.write(self.spark.createDataFrame([(*k, v) for k, v in sorted(rows.items())], _MANIFEST).coalesce(1))
        return touched

    def upsert(self, new: DataFrame, version: str | None = None, writer: str | None = None, batch: int | None = None) -> list[int]:
        """New rows replace old ones of their key; with a ``version`` only later ones do."""
        return self.change(new, lambda old, rows: keys.upsert(rows.limit(0) if old is None else old, rows, self.by, version), writer, batch)

    def keep_latest(self, new: DataFrame, order: Sequence[Column], writer: str | None = None, batch: int | None = None) -> list[int]:
        """Of each key's old and new rows the first one by ``order`` stays."""
        return self.change(new, lambda old, rows: keys.latest_by(rows if old is None else old.unionByName(rows), self.by, order), writer, batch)

    def delete(self, gone: DataFrame) -> list[int]:
        """Rows of the given keys go."""
        return self.change(gone.select(*self.by).distinct(), lambda old, rows: old.join(rows, self.by, "left_anti") if old is not None else rows.limit(0))

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf), where

    def _listed(self, path: str) -> list[int]:
        fs, where = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return [int(n.split("=")[1]) for n in names if n.startswith("__bucket=")]

    def vacuum(self) -> int:
        """Deletes folders of rows that the current version doesn't name, for when no reader is on an older one; gives their number."""
        current = set(self.folders().values())
        gone = 0
        fs, top = self._fs(self.folder)
        for entry in fs.listStatus(top):
            if not entry.getPath().getName().startswith("data-"):
                continue
            parts = list(fs.listStatus(entry.getPath()))
            kept = [f for f in parts if any(where.endswith(f"{entry.getPath().getName()}/{f.getPath().getName()}") for where in current)]
            for f in parts:
                if f not in kept and f.getPath().getName().startswith("__bucket="):
                    fs.delete(f.getPath(), True)
                    gone += 1
            if not kept:
                fs.delete(entry.getPath(), True)
        return gone
