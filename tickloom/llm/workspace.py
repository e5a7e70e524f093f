"""Tables that cut lineage, in the folder all executors share.

``spark.checkpoint.dir`` names the folder; where it is unset (tests) one under
/tmp/checkpoints is set.  Each intermediate is a Parquet table: it survives a
lost executor, and it is dropped as soon as nothing later reads it.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir().rstrip("/")


#: Rows and bytes of an Arrow batch between the JVM and Python, so that a batch of whole texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to BATCH_ROWS rows and BATCH_BYTES bytes where it is larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
        spark.conf.set(size, f"{BATCH_BYTES}b")


class Workspace:
    """Named Parquet tables of one operator run under the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the table read back, with its schema as written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(f"{self.root}/{name}")

    def keyed(self, docs: DataFrame, id_col: str, nulls_first: bool = False, few: int = 500_000) -> DataFrame:
        """docs, written once, with a long key _row: one for each row, null ids and shared ids too, in the order of the ids."""
        rows = self.write(docs.withColumn("_uid", F.monotonically_increasing_id()), "keyed")
        by = F.col(id_col).asc_nulls_first() if nulls_first else F.col(id_col).asc_nulls_last()
        keys = self.write(rows.select("_uid", id_col).orderBy(by, "_uid").select("_uid", F.monotonically_increasing_id().alias("_row")), "keys")
        if keys.count() <= few:
            return rows.join(F.broadcast(keys), "_uid").drop("_uid")
        return self.write(rows.join(keys, "_uid").drop("_uid"), "keyed-rows")

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or with no name the whole workspace."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for path in [f"{self.root}/{n}" for n in names] or [self.root]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            if names:
                raise
