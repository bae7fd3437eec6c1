"""Published model versions (S12, S13): model, thresholds and training statistics as one unit.

``publish`` writes a version's folder, then its manifest (files with sizes, and a checksum over them), then
replaces the pointer in one step.  A reader follows the pointer and checks the manifest against the folder,
so it never scores with half a version.  ``followed`` gives a running stream its baseline: each micro-batch
takes the version that is current when it first starts, and notes it, so that a batch that runs again after
a failure scores with the version it had.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest.operators import model as M
from tempest.sources.keyed import read_small, write_small

POINTER = "CURRENT"
MANIFEST = "manifest.json"


@dataclass
class Version:
    name: str
    model: PipelineModel
    thresholds: DataFrame
    statistics: DataFrame


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path below the folder, size) of its files but the manifest, sorted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, out = fs.makeQualified(root).toString(), []
    found = fs.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()[len(base):].lstrip("/")
        if name != MANIFEST and not name.rsplit("/", 1)[-1].startswith("."):
            out.append((name, f.getLen()))
    return sorted(out)


def _checksum(files) -> str:
    return hashlib.sha256(json.dumps([list(f) for f in files]).encode()).hexdigest()


def publish(spark: SparkSession, root: str, model: PipelineModel, thresholds: DataFrame, statistics: DataFrame) -> str:
    """Write a version and make it the current one; returns its name."""
    name = f"v-{uuid.uuid4().hex}"
    folder = f"{root}/{name}"
    M.save(model, f"{folder}/model")
    thresholds.write.mode("overwrite").parquet(f"{folder}/thresholds")
    statistics.write.mode("overwrite").parquet(f"{folder}/statistics")
    files = _files(spark, folder)
    write_small(spark, f"{folder}/{MANIFEST}", json.dumps({"files": files, "checksum": _checksum(files)}))
    write_small(spark, f"{root}/{POINTER}", name)
    return name


def current(spark: SparkSession, root: str) -> str:
    """Name of the current version."""
    name = read_small(spark, f"{root}/{POINTER}")
    if name is None:
        raise ValueError(f"nothing is published at {root}")
    return name


def load(spark: SparkSession, root: str, name: str | None = None) -> Version:
    """A version (the current one by default), checked against its manifest."""
    name = name or current(spark, root)
    folder = f"{root}/{name}"
    manifest = json.loads(read_small(spark, f"{folder}/{MANIFEST}") or "{}")
    files = _files(spark, folder)
    if manifest.get("checksum") != _checksum(files) or [tuple(f) for f in manifest["files"]] != files:
        raise ValueError(f"version {name} is not what was published")
    return Version(name, M.load(f"{folder}/model"), spark.read.parquet(f"{folder}/thresholds"), spark.read.parquet(f"{folder}/statistics"))


def followed(spark: SparkSession, root: str, notes: str) -> Callable[[int], Callable[[DataFrame], DataFrame]]:
    """Batch number -> baseline of that batch: ``Baseline_PD`` and ``model_version`` by the published model.

    ``notes``: folder that keeps the version of each batch.
    """
    held: dict[str, Version] = {}

    def for_batch(number: int) -> Callable[[DataFrame], DataFrame]:
        name = read_small(spark, f"{notes}/batch={number}")
        if name is None:
            name = current(spark, root)
            write_small(spark, f"{notes}/batch={number}", name)
        if name not in held:
            held.clear()
            held[name] = load(spark, root, name)
        version = held[name]
        return lambda df: M.score(version.model, df, "Baseline_PD").withColumn("model_version", F.lit(name))

    return for_batch
