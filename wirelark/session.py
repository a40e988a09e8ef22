"""Session and table helpers shared by every query."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC, Arrow, AQE).

    On a cluster build the session there and name spark.checkpoint.dir and spark.sql.shuffle.partitions for its size.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wirelark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan gives fewer tasks than that; more tasks stay as they are.

    For steps whose work a row far outweighs moving the row: patterns, parsers, tokenizers. What decides is the number of
    tasks of the scan, which Spark derives from file sizes and its settings; no file is listed here.
    """
    spark = df.sparkSession
    cores = getattr(spark, "sparkContext", None) and spark.sparkContext.defaultParallelism
    return df.repartition(cores) if cores and df.rdd.getNumPartitions() < cores else df


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs on this machine alone (tests, a laptop) a temporary folder is set, which goes
    with the process. On a cluster that is an error, since other machines would not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wirelark-")
        _OWN.append(found[7:])
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001, S110 (the session is gone, and with it its folder or its owner's clean-up)
        pass


def release(spark: SparkSession, before: set[str] | None = None) -> int:
    """Deletes the tables that stage() wrote in this session (but those of before) and gives their number.

    For long sessions, once the results that read them are written or collected.
    """
    held = _STAGED.setdefault(spark.sparkContext.applicationId, set())
    gone = held - (before or set())
    for path in gone:
        _remove(spark, path)
    held -= gone
    return len(gone)


def staged(spark: SparkSession) -> set[str]:
    """The tables that stage() has written in this session and that were not released."""
    return set(_STAGED.get(spark.sparkContext.applicationId, ()))


_STAGED: dict[str, set[str]] = {}


@atexit.register
def _clean() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there.

    The copy outlives lost executors, and later readers take only the columns they need. It stays until release() or, in a
    folder of this module's own, until the process ends; a shared folder is its owner's to clean. by: the last column, a
    folder for each of its values, so that readers of a value leave out the others.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"wirelark-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    _STAGED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)
