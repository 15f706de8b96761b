"""Session defaults and the few places where the library touches cluster state."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallycast")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # as many shuffle partitions as cores already: merging them would idle cores
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # drop checkpoint files once their table is out of use
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Put the modules of this repository on the executors, once per Spark application.

    Python tasks import their functions by module name, so a session started from another
    folder, or on a cluster without the package installed, needs the archive.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("application") == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tallycast-"), "tallycast_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top in ("tallycast", "catalog"):
            for folder, _, names in os.walk(os.path.join(root, top)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)
    _SHIPPED["application"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``).

    A machine-local folder is used only by a local-mode session that names none; on a
    cluster the setting is required, since executors must all reach the files.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallycast-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/tallycast/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For a derived table that several branches of a job use: it is computed once, later
    scans prune its columns and filters, and Spark knows its size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _file(spark: SparkSession, path: str):
    """The file system of ``path`` and its name there."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def exists(spark: SparkSession, path: str) -> bool:
    fs, name = _file(spark, path)
    return fs.exists(name)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names the state of input files: path, bytes, number of files and time of change of each."""
    parts = []
    for path in paths:
        fs, name = _file(spark, path)
        summary = fs.getContentSummary(name)
        parts.append(f"{path}|{summary.getLength()}|{summary.getFileCount()}"
                     f"|{fs.getFileStatus(name).getModificationTime()}")
    return "\n".join(parts)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the library's own making that nothing reads any more."""
    fs, name = _file(spark, path)
    fs.delete(name, True)
