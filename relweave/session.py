"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with UTC, adaptive execution and few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("relweave")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: what ``spark.checkpoint.dir`` names.

    Where it is unset a local master gets a temporary folder; a cluster must name one, because a folder of
    one machine would be lost together with that machine.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="relweave-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``clear_cut`` deletes."""
    return f"{shared_folder(spark)}/relweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan a single time, keeps columnar statistics for the next
    stage, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_cut(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application; call it when their readers are done."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/relweave-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path of ``path`` and its file system: local, shared or remote."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return fs.exists(hadoop)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """The paths of a folder's entries, by name."""
    hadoop, fs = _file_system(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(hadoop))


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file, such as a configuration."""
    hadoop, fs = _file_system(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop, fs = _file_system(spark, path)
    stream = fs.create(hadoop, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for stages that compute much per row.

    Only inputs of too few splits are moved, which are small ones; larger ones stay as they were read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever they run and whatever their path is."""
    sc = spark.sparkContext
    if getattr(sc, "_relweave_shipped", False):
        return
    package = Path(__file__).parent
    file = Path(tempfile.mkdtemp(prefix="relweave-")) / "relweave.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(file))
    sc._relweave_shipped = True
