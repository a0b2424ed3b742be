"""Sessions and the tables of a data folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "tessergrid", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI, adaptive plans.

    On a cluster, master and memory come from spark-submit; ``cores`` only counts where no master is set.
    """
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cores}]") if "spark.master" not in settings else builder
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share; one is only made on a single machine that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes with the session."""
    made = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return made


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df``, computed once and read from the shared folder afterwards.

    As compressed Parquet, of which later plans read the columns they need; what Parquet cannot hold is a checkpoint. ``options``
    are those of the writer.
    """
    kinds, names = df.schema.json(), [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or any(f'"{k}' in kinds for k in ("void", "interval", "variant")):
        shared_folder(df.sparkSession)
        return df.checkpoint()
    folder = scratch(df.sparkSession)
    df.write.options(**options).parquet(f"{folder}/rows")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    out._stored_at = folder
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``stored`` has written, which nothing reads any more."""
    if (folder := getattr(df, "_stored_at", None)) is not None:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are done: it does so once the driver's garbage is collected.

    Listeners hold the last plan for a moment, so the second round is the one that finds it free.
    """
    for _ in range(2):
        time.sleep(0.3)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


class Tables:
    """``t.orders`` is the table ``orders`` of the folder; columns and filters reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, folder)
