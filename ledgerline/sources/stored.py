"""Tables between the steps of a query, in the folder that driver and executors share.

A result that several later steps read is written once: it is not worked out again by each of them, lineage ends there, and
no executor holds the only copy. All tables of an application lie in one folder, which cleared() deletes when its last
reader is done.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/ledgerline-steps/{sc.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df, written and to be read from there."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Deletes the stored tables of this application; nothing may read them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
