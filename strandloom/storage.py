"""Shared storage: where lineage is cut, and the order-preserving numbering of sorted rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, /tmp/checkpoints for a local master; a cluster has no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not f"{spark.conf.get('spark.master', '')}[".startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/strandloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of the stored tables that df reads and that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles() if "/strandloom/" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows of df dealt out evenly, for steps that cost much more than reading: a file of a few MB, or of one row group, is read by a task or two."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def numbered(df: DataFrame, order: list, column: str) -> DataFrame:
    """df with a dense number from 0 in a global order: sorted by ranges, numbered within partitions, and shifted by the
    counts of the partitions before. No window over all rows; the driver sees a count for each partition."""
    rows = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not before:
        return rows.drop("__at").withColumn(column, F.lit(0).cast("long"))
    shift = F.create_map(*[x for p, n in before.items() for x in (F.lit(p).cast("long"), F.lit(n).cast("long"))])
    return rows.withColumn(column, F.col("__at").bitwiseAND((1 << 33) - 1) + shift[part]).drop("__at")
