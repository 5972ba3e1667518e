"""Cutting the lineage of plans that are used more than once: tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which the driver and all executors reach.

    Without the setting the context's checkpoint folder is used. A temporary folder is made
    only where driver and executors are one machine; elsewhere its absence is an error,
    because tables in a folder of one machine are lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back; its lineage ends there.

    A lost executor costs only the tasks that read the table, never the work before it, and
    later reads take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shares_of(rows: int, spark: SparkSession, each: int = 500_000) -> int:
    """In how many tasks ``rows`` are dealt out so that each gets about ``each`` of them; a task per core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 500_000) -> DataFrame:
    """``df``, of about ``rows`` rows, by a hash of ``keys`` to so many tasks that each gets about ``each`` rows.

    Spark joins small partitions by their size when written; where rows fan out or gather in memory after that, what a
    task holds would grow with the input. A stated number is kept.
    """
    return df.repartition(shares_of(rows, df.sparkSession, each), *keys)


def bucketed(df: DataFrame, keys: list[str], name: str = "bucketed", buckets: int | None = None) -> tuple[DataFrame, str]:
    """``df`` written once in ``buckets`` by ``keys``, by default as many as a shuffle has partitions, and the name to ``drop`` it by.

    A join on just these keys then moves only its other side, however often it is made.
    """
    spark, label = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/{label}").saveAsTable(label)
    return spark.table(label), label


def laid_out(df: DataFrame, rows: int, *keys: str, name: str = "laid_out", each: int = 500_000) -> DataFrame:
    """``df``, which steps after ``dealt`` with the same arguments made, stored in that layout: joins and aggregates on ``keys`` then move no row of it.

    The catalogue keeps no entry, so the table lives as those of ``stored`` do.
    """
    spark, label, shares = df.sparkSession, f"{name}_{uuid.uuid4().hex}", shares_of(rows, df.sparkSession, each)
    df.write.bucketBy(shares, *keys).option("path", f"{shared_folder(spark)}/{label}").saveAsTable(label)
    found = spark.table(label)
    spark.sql(f"DROP TABLE {label}")
    return found


def drop(spark: SparkSession, label: str) -> None:
    """Forget a ``bucketed`` table and delete its files."""
    table = spark.table(label)
    discard(table)
    spark.sql(f"DROP TABLE {label}")


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing still to be computed reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
