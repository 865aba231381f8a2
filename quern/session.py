"""Session helpers shared by every module: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8, app: str = "quern") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir``.  Where it is not set, a folder of our own on a single host;
    on a cluster that is an error, as its hosts would not see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
    own = spark.conf.get("quern.checkpoint.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.conf.set("quern.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def work_folder(spark: SparkSession) -> str:
    """The folder below the shared one that holds this application's tables; it goes when the program ends."""
    made = spark.conf.get("quern.work.dir", None)
    if not made:
        made = f"{checkpoint_dir(spark).rstrip('/')}/quern-{spark.sparkContext.applicationId}"
        spark.conf.set("quern.work.dir", made)
        atexit.register(_remove, spark, made)
    return made


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone, or its files are out of reach
        pass


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table of columns in the shared folder: readers take the columns they need, and it takes less
    room than a checkpoint of rows.  Rows come back in no order."""
    folder = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
