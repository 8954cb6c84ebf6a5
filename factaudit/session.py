"""Session helpers: table access, durable lineage cuts and shuffle sizing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables, read lazily so that pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is set only where none is named.

    On a cluster ``spark.checkpoint.dir`` names a folder that every executor shares; without it the
    call fails there. Only a local session without that setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factaudit-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    Results read more than once (iterations, reduction trees) go through here: the files
    survive the loss of executors, and the plan behind them is not run again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side that a join never broadcasts, whatever its size is estimated to be.

    Spark estimates a table by its compressed file and what follows by the number of columns, so a table of
    grams or of several rows per text counts as far smaller than it is and would be built in the driver.
    """
    return df.hint("merge")


def release(*written: DataFrame) -> None:
    """Delete the files of results of ``cut`` that nothing reads any more.

    Only for results of an iteration whose successor is written: a plan that still reads from them fails.
    """
    for df in written:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            raise ValueError("only results of cut can be released")
        at = plan.rdd().getCheckpointFile()
        if at.isDefined():
            fs, path = file_system(df.sparkSession, at.get())
            fs.delete(path, True)


def file_system(spark: SparkSession, folder: str):
    """(file system, path) of a folder, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    A large input has more partitions than that and stays where it is; only a small file, which would
    be one task, is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
