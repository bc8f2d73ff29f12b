"""Publishing a directory: a market, or a source of salaries, takes the place of its old rows at once or not at all.

A published table is a folder of versions, each a whole Parquet table partitioned by market (or source), and a file that
names the current one. A version is written beside the old ones and checked; only then the name changes, in one step. A
reader keeps the version that it began with. The file's rename is atomic in stores that have such a rename.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, root: str) -> str | None:
    """The path of the current version, or None before the first."""
    files, p = _hadoop(spark, f"{root}/CURRENT")
    if not files.exists(p):
        return None
    return f"{root}/{spark.read.text(f'{root}/CURRENT').first()[0]}"


def _switch(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version the current one: a new file takes the old one's name."""
    jvm = spark.sparkContext._jvm
    files, new = _hadoop(spark, f"{root}/next-{version}")
    out = files.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT"), rename)


def replace_partition(root: str, rows: DataFrame, by: str, value: str, checks: dict[str, Column | None] | None = None, key: list[str] | None = None) -> str:
    """Publishes root with rows in place of those whose column by is value; others stay. Returns the new version's path.

    checks: by name, a condition that no row may meet. key: columns that no two rows may share. If a check fails, nothing
    is published and the failing checks are named.
    """
    spark = rows.sparkSession
    old = current(spark, root)
    fresh = rows.withColumn(by, F.lit(value))
    whole = fresh if old is None else spark.read.parquet(old).filter(F.col(by) != value).unionByName(fresh, allowMissingColumns=True)
    version = f"version-{uuid.uuid4().hex}"
    whole.write.partitionBy(by).parquet(f"{root}/{version}")
    written = spark.read.parquet(f"{root}/{version}")
    failed = broken(written, checks or {}, key)
    if failed:
        files, p = _hadoop(spark, f"{root}/{version}")
        files.delete(p, True)
        raise ValueError("not published: " + "; ".join(failed))
    _switch(spark, root, version)
    return f"{root}/{version}"


def broken(df: DataFrame, checks: dict[str, Column], key: list[str] | None = None) -> list[str]:
    """The names of checks that some rows fail, with how many: one pass for all conditions."""
    names = list(checks)
    counts = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())]).first() if names else ()
    out = [f"{n}: {c} rows" for n, c in zip(names, counts, strict=True) if c]
    twice = df.groupBy(*[F.upper(k) if dict(df.dtypes)[k] == "string" else k for k in key]).count().filter("count > 1").count() if key else 0
    return out + ([f"repeated {', '.join(key)}: {twice}"] if twice else [])


def updated(rows: DataFrame, changes: DataFrame, key: str, keep: list[str] = (), take: list[str] = ()) -> DataFrame:
    """rows with columns of changes: those in keep only where rows have none, those in take wherever changes have one."""
    c = changes.select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in (*keep, *take)])
    df = rows.join(c, F.col(key) == F.col("__key"), "left")
    new = {x: F.coalesce(x, f"__{x}") for x in keep} | {x: F.coalesce(f"__{x}", x) for x in take}
    return df.select(*[new[x].alias(x) if x in new else rows[x] for x in rows.columns])


def insert_missing(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """rows and those of more whose key rows lack, of more's equals one by the order of its columns."""
    rest = [c for c in rows.columns if c not in key]
    fresh = more.join(rows.select(*key), key, "left_anti").groupBy(*key).agg(F.min(F.struct(*rest)).alias("b")).select(*key, *[f"b.{c}" for c in rest])
    return rows.unionByName(fresh.select(*rows.columns))


def upserted(stored: DataFrame, seen: DataFrame, key: list[str], day: Column) -> DataFrame:
    """The store of ads after a day's reading: what was read again is renewed (amounts stay where the new ones are null), its
    first day kept; new ads begin today; ads not seen stay as they are."""
    values = [c for c in seen.columns if c not in key]
    s = seen.select(*key, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__seen"))
    df = stored.join(s, key, "full_outer")
    pay = ("pay_min", "pay_max")
    new = [F.coalesce(f"__{c}", c).alias(c) if c in pay else F.when(F.col("__seen"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return df.select(*key, *new, F.coalesce("first_seen", day).alias("first_seen"), F.when(F.col("__seen"), F.coalesce(day, "last_seen")).otherwise(F.col("last_seen")).alias("last_seen"))


def without_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The rows of child whose key parent has."""
    return child.join(parent.select(key).distinct(), key, "left_semi")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV files with a header, sorted over all files: each task writes a range."""
    df.orderBy(*order).write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def markdown(df: DataFrame, most: int) -> str:
    """The first most rows of a report as a table of text. The limit is the report's length."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])


def known_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
