"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder, once; on a cluster, whose machines don't share one, it is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quaylight-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/quaylight/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables written once and read back, so that a lost executor costs no more than the stage at hand.

    ``put`` writes and rereads a table.  ``drop`` deletes one that no later plan reads.  Tables behind a returned
    DataFrame stay until the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def put(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps.

        It does when the driver's garbage is collected; what a first collection finds lets go of what a second one does.
        """
        gc.collect()
        for _ in range(3):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            where = jvm.org.apache.hadoop.fs.Path(self.path(table))
            where.getFileSystem(conf).delete(where, True)
