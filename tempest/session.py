"""Spark session construction and lineage helpers.

The library never assumes it owns the session: a cluster session comes in
with its own ``spark.checkpoint.dir`` (a shared folder).  ``local_session``
is for tests and the bench only and fills in the settings a cluster would
provide.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans shuffles at run time, splits
# skewed partitions and coalesces small ones; ANSI stays on (Spark 4
# default), so every cast of untrusted text is a try_* function.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tempest") -> SparkSession:
    """Session for tests and benchmarks (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TEMPEST_DRIVER_MEMORY", "16g"))
        # wide generated code (the loan schema has ~40 derived columns) exceeds the JIT's
        # 8000-bytecode limit and would run interpreted; on a cluster set the same
        # option in spark.executor.extraJavaOptions
        .config("spark.driver.extraJavaOptions", os.environ.get("TEMPEST_DRIVER_JAVA_OPTS", "-XX:-DontCompileHugeMethods"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tempest-wh-"))
    )
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if spark.sparkContext.master.startswith("local["):
        # single-machine session (tests, checks): no shared folder exists, so choose one here
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tempest-ckpt-")
        return _LOCAL_DIRS[app]
    raise RuntimeError("spark.checkpoint.dir is not set; a cluster session must name a shared folder")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the session's JVM ends.

    Results of a query stay lazy and read what lies here, so the folder has to outlive the call.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return fs.makeQualified(hadoop).toString()  # with its scheme, for readers outside the JVM too


def files_state(spark: SparkSession, folder: str, tables) -> str:
    """Names the state of Parquet tables (files or folders) by the sizes and times of their files."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in tables:
        path = hadoop.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(conf)
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append((str(f.getPath().toUri().getPath()), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


#: A wide table's Parquet options: a task reads whole row groups, so small ones let many tasks read few files.
SMALL_GROUPS = {"parquet.block.size": 4 << 20}


@contextmanager
def short_methods(spark: SparkSession):
    """Plans run inside leave whole-stage code generation where a generated method is too long for the JIT.

    A method beyond 8,000 bytes of bytecode is interpreted unless the executors have ``-XX:-DontCompileHugeMethods``;
    operators on their own split theirs.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def materialise(df: DataFrame, folder: str, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet below ``folder`` and read it back: the lineage is cut, every
    later use reads the same rows, and a lost executor costs only its own tasks."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder.

    Used where a plan is re-read several times or where recomputation after
    a lost executor would be expensive or would have to repeat sampling.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
