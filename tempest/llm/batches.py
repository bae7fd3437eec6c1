"""Settings around a job: Arrow batches of bounded size, scoped session settings."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tempest.session import materialise

# Very long texts: a batch ends at whichever bound is met first.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slices(batches, rows: int = 256):
    """The record batches of a task in pieces of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def discard(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a table of the run folder that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_batches(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``materialise`` for plans with Python in them: their Arrow batches stay small."""
    with settings(df.sparkSession, ARROW_CONF):
        return materialise(df, folder, name)
