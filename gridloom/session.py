"""Session settings and the one shared folder that long plans write their intermediate tables to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset (tests, a laptop).
LOCAL_SHARED = "file:///tmp/checkpoints"


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        found = LOCAL_SHARED
    return found.rstrip("/")


#: Folders that this process has made and will take away.
_MADE: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, in one that goes when the application ends."""
    root = f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}"
    if root not in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MADE.add(root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and any
    executor can read it again after another one is lost."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
