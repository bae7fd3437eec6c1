"""Boosted trees of tasks that run side by side: thresholds, trees and model equal the library's; jobs do not grow with the trees."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tempest.operators import gang as G
from tempest.operators import model as M
from tempest.operators import trees as T
from tempest.plans import base

FEW = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment", "loan_amnt"]


@pytest.fixture(scope="module")
def mf(spark):
    return M.model_frame(base.clean(spark, SF_SMALL)).cache()


def walked(values, weights, most):
    """The library's rule, one value after the other."""
    at = {}
    for v, w in zip(values, weights, strict=True):
        at[v + 0.0] = at.get(v + 0.0, 0.0) + w
    pairs = sorted(at.items())
    if len(pairs) <= most + 1:
        return [(a[0] + b[0]) / 2 for a, b in zip(pairs, pairs[1:], strict=False)]
    stride = sum(weights) / (most + 1)
    out, current, goal = [], pairs[0][1], stride
    for a, b in zip(pairs, pairs[1:], strict=False):
        before, current = current, current + b[1]
        if abs(before - goal) < abs(current - goal):
            out.append((a[0] + b[0]) / 2)
            goal += stride
    return out


@pytest.mark.parametrize("tasks", [1, 3])
def test_thresholds_are_the_rules_over_the_rows_of_all_tasks(tmp_path, tasks):
    rng = np.random.default_rng(tasks)
    columns = [rng.normal(size=900), rng.integers(-3, 4, 900).astype(float), np.where(rng.random(900) < 0.7, 0.0, rng.normal(size=900)),
               np.full(900, 5.0), np.r_[-0.0, 0.0, 1e300, -1e300, 5e-324, np.zeros(895)], rng.integers(0, 200, 900) / 7.0]
    weights = rng.choice([1.0, 2.75], 900)
    of = np.arange(900) * tasks // 900  # the first task has the first rows

    def one(task):
        mine = []
        for x in columns:
            v, at = np.unique(x[of == task] + 0.0, return_inverse=True)
            mine.append((v, np.bincount(at, weights[of == task], len(v))))
        return G.thresholds(mine, G.Gang(str(tmp_path / "x"), task, tasks), 31)

    with ThreadPoolExecutor(tasks) as pool:
        got = list(pool.map(one, range(tasks)))
    for c, x in enumerate(columns):
        assert all(g[c].tolist() == got[0][c].tolist() for g in got)
        assert got[0][c].tolist() == walked(x.tolist(), weights.tolist(), 31)


def rows_of(model):
    return sorted((r["tree"], r["node"], r["left"], r["right"], r["feature"]) for r in T.node_table(model).collect())


def test_model_is_the_librarys(spark, mf, tmp_path, monkeypatch):
    mine = M.fit(mf, "gbt", FEW, max_iter=4, max_depth=4, step=0.3)
    monkeypatch.setattr(G, "slots", lambda spark: 0)
    library = M.fit(mf, "gbt", FEW, max_iter=4, max_depth=4, step=0.3)
    monkeypatch.undo()
    # two features that part the training rows alike are as good as each other: which one is taken shows on other rows only
    assert [r[:4] for r in rows_of(mine)] == [r[:4] for r in rows_of(library)]
    train = mf.where("split = 'train'")
    both = M.score(mine, train, "a").select("id", "a").join(M.score(library, train, "b").select("id", "b"), "id")
    assert both.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0 < both.count()
    M.save(mine, str(tmp_path / "m"))
    assert isinstance(M.load(str(tmp_path / "m")), PipelineModel)
    several = G.fit(M.weighted(mine.stages[0].transform(mf.where("split = 'train'")), "pos"), M.gbt(4, 4, 0.3), [f"{f}__i" for f in FEW], 3)
    assert rows_of(PipelineModel([*mine.stages[:2], several])) == rows_of(mine)  # however many tasks share the rows


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark, mf):
    """The library ran some seven jobs a tree."""
    counts = []
    for trees in (2, 6):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "")
        model = M.fit(mf, "gbt", FEW, max_iter=trees, max_depth=3)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{trees}")))
        assert model.stages[-1].getNumTrees == trees
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0
