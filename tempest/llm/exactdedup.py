"""Exact dedup of documents as a stateful stream with disk-backed state.

The documents arrive as a Structured Streaming source.  The state is keyed by the text's digest, has
no watermark and so never expires, lives in RocksDB on the executors' disks (with its changelog in
the shared checkpoint folder) and holds per digest what the job has to remember of the text seen:
the stable identifier of the row that stays, that row's content locator (file and row in it) and the
number of rows.  Rows are pre-aggregated where they are read, before the shuffle to the state, so a
text that a third of all rows repeat reaches its state as one row per task.

A digest that is hit again is only a candidate.  The full bytes decide: the texts of all hits are
compared with the text at the retained locator.  Texts that share a digest but not their bytes are
grouped among themselves by their bytes.

A stopped or broken run continues from ``folder``: pass the same folder again.

Defined results: null text counts as empty; of equal texts the row with the largest id stays, null
ids being smallest, ties going to the last locator; an empty table gives an empty result; further
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.batches import settings
from tempest.llm.text import sha256_hex, whole
from tempest.session import materialise, run_folder

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # RocksDB works outside the heap: one bound for all the stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # a store is small next to the megabytes that RocksDB would set aside for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # an executor holds only the stores of its running tasks, not all it has ever had
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256_digest(text: Column) -> Column:
    return F.unhex(sha256_hex(text))


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def build_state(spark: SparkSession, path: str, folder: str, digest: Callable[[Column], Column] = sha256_digest,
                max_bytes: int = 16 << 30, max_files: int | None = None) -> DataFrame:
    """Stream all files below ``path`` into the keyed state; returns digest, keep (id and locator), n.

    ``max_bytes`` (or ``max_files``) bounds one micro-batch.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = (reader.option("maxFilesPerTrigger", max_files) if max_files
              else reader.option("maxBytesPerTrigger", max_bytes))
    # as a pattern a path may be a folder or a single file (a stream takes only folders otherwise)
    seen = reader.parquet(f"{path[:-1]}[{path[-1]}]").select(
        digest(whole(F.col("text"))).alias("digest"),
        F.struct(F.col("doc_id").alias("id"), _locator().alias("at")).alias("row"))
    state = seen.groupBy("digest").agg(F.max("row").alias("keep"), F.count(F.lit(1)).alias("n"))
    changed = f"{folder}/changed"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])

    def keep_changes(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes its own folder again
        batch.write.mode("overwrite").parquet(f"{changed}/batch={number}")

    with settings(spark, STATE_CONF):
        q = (state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).foreachBatch(keep_changes).start())
        q.awaitTermination()
    if not _exists(spark, changed):
        return spark.createDataFrame([], schema)
    # the last update of a digest is its state
    rows = spark.read.schema(schema.add("batch", "long")).parquet(changed)
    last = rows.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("s"))
    return last.select("digest", F.col("s.keep").alias("keep"), F.col("s.n").alias("n"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256_digest,
          max_bytes: int = 16 << 30, max_files: int | None = None, folder: str | None = None) -> DataFrame:
    """One row per row of the Parquet table ``path``: doc_id, at (its locator), keep_id, keep_at,
    group_size, kept, text_sha256.

    ``digest`` may be weak: the bytes decide.  Only texts whose digest was hit are compared, each
    with the one text retained for its digest, never with each other.
    """
    folder = folder or run_folder(spark, "dedup")
    state = build_state(spark, path, folder, digest, max_bytes, max_files)
    hit = materialise(state.where(F.col("n") > 1).select(F.col("digest").alias("hit_digest"), F.col("keep.at").alias("keep_at")),
                      folder, "hit")
    text = whole(F.col("text"))
    rows = (spark.read.parquet(path)
            .select("doc_id", _locator().alias("at"), digest(text).alias("digest"), sha256_hex(text).alias("text_sha256"), text.alias("text"))
            # the same plan at every size: the digests that were hit grow with the documents
            .join(hit.hint("merge"), F.col("digest") == F.col("hit_digest"), "left"))
    is_hit = F.col("hit_digest").isNotNull()
    rows = materialise(rows.select("doc_id", "at", "digest", "text_sha256", F.when(is_hit, F.col("keep_at")).alias("keep_at"),
                                   F.when(is_hit, F.col("text")).alias("text")), folder, "rows")
    is_hit = F.col("keep_at").isNotNull()
    retained = rows.where(is_hit & (F.col("at") == F.col("keep_at"))).select(F.col("digest").alias("r_digest"), F.col("text").alias("r_text"))
    # equal bytes: no variant; else the text itself tells its group
    checked = materialise(rows.where(is_hit).join(retained, F.col("digest") == F.col("r_digest"))
                          .select("doc_id", "at", "digest", "text_sha256", F.when(F.col("text") != F.col("r_text"), F.col("text")).alias("variant")),
                          folder, "checked")
    groups = (checked.groupBy("digest", "variant").agg(F.max(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
              .select(F.col("digest").alias("g_digest"), F.col("variant").alias("g_variant"), F.col("keep.doc_id").alias("keep_id"),
                      F.col("keep.at").alias("keep_at"), "group_size"))
    groups = materialise(groups, folder, "groups")
    of_group = checked.join(groups, (F.col("digest") == F.col("g_digest")) & F.col("variant").eqNullSafe(F.col("g_variant")))
    cols = ["doc_id", "at", "keep_id", "keep_at", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "text_sha256"]
    alone = rows.where(~is_hit).select("doc_id", "at", F.col("doc_id").alias("keep_id"), F.col("at").alias("keep_at"),
                                       F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return alone.select(*cols).unionByName(of_group.select(*cols))
