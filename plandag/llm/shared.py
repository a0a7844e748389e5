"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Unset, as in tests on one machine: a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plandag-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet and reads it back: cuts the lineage, survives lost executors, and is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plandag-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing will read again."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: Column, digest: Column) -> Column:
    """One value for a document's id and content."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), digest.cast("string")))


def rows_with_keys(docs: DataFrame, key: Column, kept: DataFrame, once: Column) -> DataFrame:
    """docs whose key is among kept's (a column "key"); where once holds, one row for each key. The rows are dealt out by key and sorted once."""
    name, number = fresh("__key", docs), fresh("__number", docs)
    rows = docs.withColumn(name, key).join(kept.select(F.col("key").alias(name)), name, "left_semi")
    rank = F.row_number().over(Window.partitionBy(name).orderBy(name))
    return rows.withColumn(number, F.when(once, rank).otherwise(1)).where(F.col(number) == 1).select(*docs.columns)


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Deletes the tables that materialize() has written in this application, but for those that keep reads: for long sessions, once results are written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/plandag-{spark.sparkContext.applicationId}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = {f.split("/")[-2] for df in keep for f in df.inputFiles()}
    for status in files.listStatus(where) if files.exists(where) else []:
        if status.getPath().getName() not in held:
            files.delete(status.getPath(), True)
