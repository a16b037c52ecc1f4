"""Session-level helpers: the shared folder, lineage cuts and the test session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the session
    runs in one process, as in tests, a temporary folder is made and put into the setting;
    on a cluster a folder of one machine would lose data, so an error is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quireflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[str] = []


def clean(spark: SparkSession) -> int:
    """Deletes the tables this process wrote into the shared folder, and gives their number.

    To be called when no result is read any more: lazy results still read these tables.
    """
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage and survives the loss of executors: the files belong to none of
    them. Use it where a result is read more than once; columns are pruned on reading.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """The session of tests and of the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quireflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
