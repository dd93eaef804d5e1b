"""Tables that cut a plan short: written to the folder that driver and executors
share, and read again.

What a cut table is read for later starts from files, so a lost executor costs
its own tasks only, nothing is computed twice, and the planner knows its size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, for ``clean``.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session names none (tests, a laptop) it is a folder under
    /tmp; on a cluster that folder would be another one on each machine, so
    there the setting must be made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        named = "file:///tmp/marlstone-shared"
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lost executors cost nothing
    that came before, and a table used twice is computed once. The folder stays
    until ``clean``, as results are read from it later."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the folders that this process made in the shared folder; call it
    when the results of its operators have been read. Returns how many."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
