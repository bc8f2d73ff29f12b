"""Tables in the folder that driver and executors share, and the word rule of every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is set (tests, one machine) a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and no executor holds the only copy."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ledgerline/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """array<string>: the words of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra columns, whatever their names, go."""
    return df.select(*[df[n] for n in names])
