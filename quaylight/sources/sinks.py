"""Tables that are rewritten as a whole: a new version is written beside the old one, then named as the current one."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.text import content_hash
from quaylight.operators import keys


class Table:
    """A Parquet table in a folder with versions; readers see a version whole or not at all.

    A version is named by a row in the folder's ``commits`` table, written after its files.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> DataFrame | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        return self.spark.read.schema("version long, name string").parquet(f"{self.folder}/commits") if path.getFileSystem(conf).exists(path) else None

    def version(self) -> int:
        commits = self._commits()
        last = commits.agg(F.max("version").alias("v")).first()["v"] if commits is not None else None
        return last or 0

    def read(self) -> DataFrame | None:
        commits = self._commits()
        if commits is None:
            return None
        name = commits.agg(F.max_by("name", "version").alias("n")).first()["n"]
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def stage(self, df: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, name: str) -> None:
        row = self.spark.createDataFrame([(self.version() + 1, name)], "version long, name string").coalesce(1)
        row.write.mode("append").parquet(f"{self.folder}/commits")

    def write(self, df: DataFrame) -> None:
        self.commit(self.stage(df))

    def upsert(self, new: DataFrame, by: Sequence[str], version: str | None = None) -> None:
        """New rows replace old ones of their key."""
        old = self.read()
        self.write(keys.upsert(new.limit(0) if old is None else old, new, by, version))

    def insert_missing(self, new: DataFrame, by: Sequence[str], order: Sequence[str]) -> None:
        """Rows of new keys; old rows stay as they are."""
        old = self.read()
        self.write(keys.insert_missing(new.limit(0) if old is None else old, new, by, [F.col(c) for c in order]))

    def replace_keys(self, new: DataFrame, by: Sequence[str]) -> None:
        """All rows of the new rows' keys go; the new ones come."""
        old = self.read()
        self.write(new if old is None else old.join(new.select(*by).distinct(), list(by), "left_anti").unionByName(new))

    def publish(self, new: DataFrame, by: Sequence[str], content: Sequence[str], at: str) -> None:
        """Versions of each key: the same content makes no new version, other content supersedes the last one."""
        fresh = new.withColumn("content_hash", content_hash(*content))
        old = self.read()
        if old is None:
            first = fresh.withColumns({"version": F.lit(1), "superseded_at": F.lit(None).cast(new.schema[at].dataType)})
            self.write(first)
            return
        last = old.filter("superseded_at is null").select(*by, F.col("content_hash").alias("__hash"), F.col("version").alias("__version"))
        changed = fresh.join(last, list(by), "left").filter(~F.col("content_hash").eqNullSafe(F.col("__hash")))
        changed = changed.withColumn("version", F.coalesce(F.col("__version") + 1, F.lit(1))).drop("__hash", "__version").withColumn("superseded_at", F.lit(None).cast(new.schema[at].dataType))
        ended = old.join(changed.select(*by, F.col(at).alias("__at")), list(by), "left")
        ended = ended.withColumn("superseded_at", F.coalesce("superseded_at", "__at")).drop("__at")
        self.write(ended.unionByName(changed))


class Manifest:
    """Several tables in one folder, changed together: one row names the version of each, so readers see all or none.

    One writer at a time.  Staged files of a batch whose row was never written are read by nobody.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._names = Table(spark, f"{self.folder}/manifest")

    def _current(self) -> dict[str, str]:
        """Folder by table: one row for each table."""
        rows = self._names.read()
        return {} if rows is None else {r["name"]: r["folder"] for r in rows.collect()}

    def read(self, name: str) -> DataFrame | None:
        folder = self._current().get(name)
        return None if folder is None else self.spark.read.parquet(folder)

    def write(self, batches: Mapping[str, DataFrame], schemas: Mapping[str, str]) -> None:
        """All batches are checked and staged before the one commit; a wrong schema writes nothing.  Other tables stay."""
        check_schemas(batches, schemas)
        now = self._current()
        for name, df in batches.items():
            table = Table(self.spark, f"{self.folder}/{name}")
            now[name] = f"{table.folder}/{table.stage(df)}"
        self._names.write(self.spark.createDataFrame(sorted(now.items()), "name string, folder string").coalesce(1))


def check_schemas(batches: Mapping[str, DataFrame], schemas: Mapping[str, str]) -> None:
    for name, df in batches.items():
        if name in schemas and df.schema.simpleString() != df.sparkSession.createDataFrame([], schemas[name]).schema.simpleString():
            raise ValueError(f"{name}: {df.schema.simpleString()} isn't {schemas[name]}")


def write_together(batches: Mapping[str, tuple[Table, DataFrame]], schemas: Mapping[str, str]) -> None:
    """Batches for tables with commits of their own: all are checked and staged before the first commit.

    A writer lost between commits leaves the rest undone; ``Manifest`` commits all by one row.
    """
    check_schemas({name: df for name, (_, df) in batches.items()}, schemas)
    staged = [(table, table.stage(df)) for table, df in batches.values()]
    for table, name in staged:
        table.commit(name)


def merge_json(spark: SparkSession, folder: str, items: DataFrame, by: str, order: str) -> DataFrame:
    """Merges items into a table of JSON rows: of each key the row latest by ``order`` stays, of equal ones the new one.

    Items without a key are left out.  Readers see the old rows or the new ones, never a part.
    """
    names = Table(spark, f"{folder.rstrip('/')}/manifest")
    last = names.read()
    fresh = items.filter(F.col(by).isNotNull() & (F.col(by).cast("string") != "")).withColumn("__new", F.lit(1))
    if last is not None:
        old = spark.read.schema(items.schema).json(last.first()["folder"])
        fresh = old.withColumn("__new", F.lit(0)).unionByName(fresh)
    kept = keys.latest_by(fresh, [by], [F.col(order).desc_nulls_last(), F.col("__new").desc()]).drop("__new")
    target = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex[:12]}"
    kept.write.option("ignoreNullFields", "false").json(target)
    names.write(spark.createDataFrame([(target,)], "folder string").coalesce(1))
    return spark.read.schema(items.schema).json(target)


def scrub(df: DataFrame, ts: str, cutoff: str, columns: Sequence[str]) -> DataFrame:
    """Named columns become null in rows that ended before the cutoff."""
    old = F.col(ts) < F.lit(cutoff).cast("timestamp_ntz")
    return df.withColumns({c: F.when(~F.coalesce(old, F.lit(False)), F.col(c)) for c in columns})


def illegal_transitions(old: DataFrame, new: DataFrame, by: Sequence[str], state: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """New rows whose state may not follow the stored one."""
    pairs = old.sparkSession.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], "__from string, __to string")
    both = new.join(old.select(*by, F.col(state).alias("__from")), list(by)).withColumn("__to", F.col(state)).filter("__from <> __to")
    return both.join(F.broadcast(pairs), ["__from", "__to"], "left_anti").drop("__from", "__to")
