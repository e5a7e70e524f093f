"""Tables that an operator writes once and reads more than once, in the folder all executors share.

A plan that deals rows by sampled ranges, or numbers them by partition, gives other
ranges wherever Spark plans it anew; a table that is written once does not.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or one of our own where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Parquet tables under the shared folder, deleted by ``drop`` or when Python ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame) -> DataFrame:
        """Writes df and returns the table read back, with its schema as written."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes all tables; what reads them fails from then on."""
        atexit.unregister(self.drop)
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
