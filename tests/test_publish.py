"""Published model versions: one unit, checked, followed by a running stream."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tempest.operators import model as M
from tempest.operators import publish as P
from tempest.plans import base
from tempest.sources import requests as RQ
from tempest.streaming import jobs


@pytest.fixture(scope="module")
def mf(spark):
    return M.model_frame(base.clean(spark, SF_SMALL)).cache()


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([("f1", 0.4)], "metric string, value double"), spark.createDataFrame([("dti", 1.0)], "feature string, mean double")


def test_a_version_is_what_was_published(spark, mf, tables, tmp_path):
    root = str(tmp_path / "published")
    with pytest.raises(ValueError):
        P.current(spark, root)
    model = M.fit(mf, "lr", maxIter=5)
    name = P.publish(spark, root, model, *tables)
    got = P.load(spark, root)
    assert got.name == name == P.current(spark, root) and got.thresholds.first().value == 0.4 and got.statistics.first().feature == "dti"
    test = mf.where("split = 'test'").limit(20)
    scores = lambda m: sorted(map(tuple, M.score(m, test).select("id", "p").collect()))
    assert scores(got.model) == scores(model)
    part = next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "published" / name / "thresholds") for f in fs if f.startswith("part-"))
    with open(part, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="not what was published"):
        P.load(spark, root)


def test_a_running_stream_takes_the_new_version_between_batches(spark, mf, tables):
    """Two batches under two versions; a batch that runs again keeps the version it had."""
    root, source, out = (tempfile.mkdtemp(prefix=f"t-{x}-") for x in ("published", "in", "out"))
    rows = RQ.request_batch(spark, SF_SMALL).limit(60).cache()
    stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
    follow = P.followed(spark, root, f"{out}/versions")
    first = P.publish(spark, root, M.fit(mf, "lr", maxIter=3), *tables)
    rows.coalesce(1).write.parquet(f"{source}/a")
    query = jobs.score_batches(spark, stream, out, baseline_of=follow).start()
    try:
        query.processAllAvailable()
        second = P.publish(spark, root, M.fit(mf, "lr", maxIter=40), *tables)
        assert query.isActive
        rows.coalesce(1).write.parquet(f"{source}/b")
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(f"{out}/scored")
    by = {r.batch: (r.v, r.n, r.s) for r in got.groupBy("batch").agg(F.collect_set("model_version").alias("v"), F.count("*").alias("n"),
                                                                    F.sum("Baseline_PD").alias("s")).collect()}
    assert [by[k][0] for k in sorted(by)] == [[first], [second]] and by[0][1] == by[1][1] > 0 and by[0][2] != by[1][2]
    again = follow(0)(jobs.with_request_defaults(rows)).select("model_version").distinct().collect()
    assert [r.model_version for r in again] == [first]
