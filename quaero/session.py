"""Session defaults, table loading and the shared-folder tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that ``written`` made and ``drop_written`` has not deleted.
_WRITTEN: list[str] = []


def build_session(cpus: str = "*", app: str = "quaero", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` of the session is used as it is. Only where it is
    unset and the session is local, a temporary folder of this machine is made
    and set; on a cluster an unset folder is an error, since each executor
    would write to a disk of its own.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        where = "file://" + tempfile.mkdtemp(prefix="quaero-")
        atexit.register(shutil.rmtree, where[len("file://") :], ignore_errors=True)
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the JVM ends, or by ``drop_written``."""
    path = f"{shared_folder(spark).rstrip('/')}/quaero-{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _WRITTEN.append(path)
    return path


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def fingerprint(df: DataFrame) -> tuple:
    """Paths, lengths and times of the files behind a table."""
    spark = df.sparkSession
    out = []
    for f in sorted(df.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        st = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        out.append((f, st.getLen(), st.getModificationTime()))
    return tuple(out)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage durably (a lost executor costs nothing that was
    written) and, unlike a checkpoint, gives the planner the true size of the
    table, so that broadcasts stay behind Spark's size threshold.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` made in this process and gives their number; results that still read them must be stored before."""
    n = 0
    while _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    return n
