"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on. Shuffle width is left to the cluster: AQE coalesces small
# partitions and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Methods above 8,000 bytes of bytecode are never compiled by the JVM. Wide projections reach that,
    # and then run faster operator by operator than as one interpreted whole-stage method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Only a new session can take these. Plan building makes half as many calls into the JVM without
# call-site notes for error messages.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "netloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **AT_START, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Applies the defaults to a session made elsewhere."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Root for intermediate tables and streaming checkpoints, visible to every executor.

    A cluster names it in ``spark.checkpoint.dir``. Without that setting a folder is made on this
    machine, but only when driver and executors are one process here; elsewhere executors would not
    see each other's files, so the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master!r}")
        root = tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters where it is not installed and sessions started from another folder.

    Spark serves the archive from the driver to every executor, also to those that join later.
    """
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="netloom-"), "netloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, empty path below :func:`shared_dir`; nothing is ever deleted or reused."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_run(spark: SparkSession, path: str) -> None:
    """Removes one folder that :func:`run_dir` named, once nothing reads it any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    For a result that several branches of a plan start from: it is computed once, its lineage ends
    there, and losing an executor later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
