"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql.types import StructType

_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot ids are normal in behaviour logs: split them even if that adds an exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators count on to a running session."""
    for key, value in _SQL_SETTINGS.items():
        spark.conf.set(key, value)
    # Python workers on this machine find the package wherever the session was started;
    # on a cluster it comes with --py-files.
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join(filter(None, [*paths, root]))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "actionloom") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    On a cluster it is whatever ``spark.checkpoint.dir`` names. Only a local session
    without that setting gets a folder of its own, below the warehouse.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = f"{warehouse}/_work-{context.applicationId}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame, *partitioned_by: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, as ``schema`` if given.

    Used where a later step must see exactly the same rows again, where several steps
    read the same intermediate rows, or where an iterative fit would otherwise recompute
    everything when an executor is lost. This runs a job at once. ``discard`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partitioned_by) if partitioned_by else df.write
    writer.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def stored_with(df: DataFrame, measures: Mapping[str, Column], *partitioned_by: str) -> tuple[DataFrame, Row]:
    """``stored``, and aggregates over the rows taken while they are written: no pass of their own."""
    seen = Observation()
    kept = stored(df.observe(seen, *[c.alias(name) for name, c in measures.items()]), *partitioned_by)
    return kept, Row(**seen.get)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads, a file once; 0 without files. Runs no job."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f)) for f in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by ``stored``; they can't be read afterwards."""
    for df in frames:
        spark = df.sparkSession
        jvm, own = spark.sparkContext._jvm, shared_dir(spark)
        for folder in {f.rsplit("/table-", 1)[0] + "/table-" + f.rsplit("/table-", 1)[1].split("/")[0]
                       for f in df.inputFiles() if "/table-" in f}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if own.split(":", 1)[-1].lstrip("/") in folder:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
