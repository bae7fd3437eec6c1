"""Evaluation metrics against brute-force definitions on small fixtures.

The distributed ordering (range buckets + prefix sums) is forced into many
buckets with a tiny ``rows_per_bucket`` and must equal the one-bucket result.
"""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempest.operators import evaluate as E
from tempest.operators import quantiles as Q


def _data(n=400, seed=7, ties=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        a = round(min(max(rnd.gauss(0.35 + 0.2 * y, 0.15), 0.0), 1.0), ties)
        b = round(min(max(rnd.gauss(0.4 + 0.1 * y, 0.2), 0.0), 1.0), ties)
        rows.append((i, y, a, b))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = _data()
    return rows, spark.createDataFrame(rows, "id long, label int, p_a double, p_b double")


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_prefix_sums_many_buckets_equal_one(spark):
    df = spark.createDataFrame([(float(i % 97) + i / 1000.0, 1) for i in range(500)], "v double, one int")
    one = {r.v: r.one_before for r in E.prefix_sums(df, "v", ["one"]).collect()}
    many = {r.v: r.one_before for r in E.prefix_sums(df, "v", ["one"], rows_per_bucket=7).collect()}
    assert one == many
    assert sorted(one.values()) == list(range(500))


def test_auc_equals_pairwise(spark, labelled):
    rows, df = labelled
    ys, ps = [r[1] for r in rows], [r[2] for r in rows]
    sdf = df.select("label", F.col("p_a").alias("score"))
    assert E.auc(sdf).first().auc == pytest.approx(brute_auc(ys, ps), abs=1e-12)
    assert E.auc(sdf, rows_per_bucket=5).first().auc == pytest.approx(brute_auc(ys, ps), abs=1e-12)


def test_pr_points_and_thresholds(spark, labelled):
    rows, df = labelled
    sdf = df.select("label", F.col("p_a").alias("score"))
    pr = {r.threshold: (r.precision, r.recall) for r in E.pr_points(sdf, rows_per_bucket=9).collect()}
    P = sum(r[1] for r in rows)
    for t in list(pr)[:25]:
        tp = sum(1 for r in rows if r[2] >= t and r[1] == 1)
        fp = sum(1 for r in rows if r[2] >= t and r[1] == 0)
        assert pr[t] == pytest.approx((tp / (tp + fp), tp / P))
    ts = sorted(pr)
    costs = [5 * (1 - pr[t][1]) + (1 - pr[t][0]) for t in ts]
    best = ts[int(np.argmin(costs))]
    assert E.cost_threshold(E.pr_points(sdf)).first().threshold == best
    f1 = [2 * pr[t][0] * pr[t][1] / (pr[t][0] + pr[t][1] + 1e-8) for t in ts]
    assert E.f1_threshold(E.pr_points(sdf)).first().threshold == ts[int(np.argmax(f1))]


def _midrank(x):
    order = np.argsort(x, kind="mergesort")
    z = x[order]
    t = np.zeros(len(x))
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and z[j] == z[i]:
            j += 1
        t[i:j] = 0.5 * (i + j - 1) + 1
        i = j
    out = np.empty(len(x))
    out[order] = t
    return out


def test_midrank(spark, labelled):
    rows, df = labelled
    got = {r.id: r.midrank for r in E.midrank(df, "p_a", ["id"], rows_per_bucket=11).collect()}
    ref = _midrank(np.array([r[2] for r in rows]))
    assert all(got[i] == pytest.approx(ref[i]) for i in range(len(rows)))


def test_delong_against_structural_components(spark, labelled):
    rows, df = labelled
    y = np.array([r[1] for r in rows])
    preds = np.array([[r[2] for r in rows], [r[3] for r in rows]])
    pos, neg = preds[:, y == 1], preds[:, y == 0]
    m, n = pos.shape[1], neg.shape[1]
    aucs, v01, v10 = [], [], []
    for k in range(2):
        tz = _midrank(np.concatenate([pos[k], neg[k]]))
        tx, ty = _midrank(pos[k]), _midrank(neg[k])
        aucs.append(tz[:m].sum() / m / n - (m + 1.0) / 2.0 / n)
        v01.append((tz[:m] - tx) / n)
        v10.append(1.0 - (tz[m:] - ty) / m)
    cov = np.cov(np.array(v01)) / m + np.cov(np.array(v10)) / n
    got = E.delong(df, "p_a", "p_b", rows_per_bucket=13).first()
    assert (got.auc_a, got.auc_b) == pytest.approx(tuple(aucs))
    assert (got.var_a, got.var_b, got.cov_ab) == pytest.approx((cov[0, 0], cov[1, 1], cov[0, 1]))
    z = abs(aucs[0] - aucs[1]) / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    assert got.z == pytest.approx(z)
    p = df.sparkSession.createDataFrame([(float(z),)], "z double").select(E.two_sided_p(F.col("z")).alias("p")).first().p
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_ece_excludes_one(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.05), (1, 0.25), (0, 0.3)], "label int, score double")
    # bins: 0.05 -> 0, 0.25 -> 2, 0.3 -> 2 (0.3 < 0.30000000000000004), 1.0 -> none; total = 4
    expect = 1 / 4 * abs(0 - 0.05) + 2 / 4 * abs(0.5 - 0.275)
    assert E.ece(df).first().ece == pytest.approx(expect)
    assert E.linspace(0.0, 1.0, 11)[3] == 0.30000000000000004


def test_reliability_bins_cover_all_rows(spark, labelled):
    rows, df = labelled
    rel = E.reliability(df.select("label", F.col("p_a").alias("score"))).collect()
    assert sum(r.n for r in rel) == len(rows)
    assert all(0 <= r.bin < 15 for r in rel)


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.1), (0, 0.05)], "label int, score double")
    conf = {(r.label, r.prediction): r.n for r in E.confusion(df, 0.5).collect()}
    assert conf == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r["class"]: r for r in E.class_report(E.confusion(df, 0.5)).collect()}
    assert rep["1"].precision == pytest.approx(0.5) and rep["1"].recall == pytest.approx(0.5)
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["accuracy"].f1 == pytest.approx(0.6)
    assert rep["weighted avg"].support == 5
    none = {r["class"]: r for r in E.class_report(E.confusion(df, 2.0)).collect()}
    assert none["1"].precision == 0.0  # zero_division=0


def test_rate_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.4), (0, 0.1)], "label int, score double")
    r = E.rate_threshold(df).first()
    assert r.default_rate == 0.25
    assert r.threshold == pytest.approx(float(np.percentile([0.9, 0.2, 0.4, 0.1], 75.0)))


def test_stratified_split_exact_shares(spark, labelled):
    rows, df = labelled
    out = E.stratified_split(df, rows_per_bucket=17).groupBy("label", "split").count().collect()
    counts = {(r.label, r.split): r["count"] for r in out}
    for lab in (0, 1):
        n = sum(1 for r in rows if r[1] == lab)
        n_test = math.ceil(n * 0.2)
        assert counts[(lab, "test")] == n_test
        assert counts[(lab, "calib")] == math.ceil((n - n_test) * 0.25)
    again = E.stratified_split(df).select("id", "split").collect()
    first = E.stratified_split(df, rows_per_bucket=17).select("id", "split").collect()
    assert sorted(again) == sorted(first)  # same seed, same split, whatever the bucketing


def _by_rank(rows):
    """The split by its definition: (id, label) rows in the order of hash and id, per class."""
    want = []
    for lab in {r[1] for r in rows if r[1] is not None}:
        own = sorted((int(hashlib.md5(f"{i}42".encode()).hexdigest()[:15], 16), i) for i, c in rows if c == lab and i is not None)
        n = sum(c == lab for _, c in rows)
        n_test = math.ceil(n * 0.2)
        n_cal = math.ceil((n - n_test) * 0.25)
        want += [(i, lab, "test" if k < n_test else "calib" if k < n_test + n_cal else "train") for k, (_, i) in enumerate(own)]
    return sorted(want)


@pytest.mark.parametrize("kind", ["plain", "one_id", "few", "odd"])
def test_stratified_split_is_that_of_the_ranks(spark, kind):
    """Repeated ids on both sides of an end, classes without an end, missing ids and labels."""
    rows = {"plain": [(i, int(i % 7 == 0)) for i in range(400)], "one_id": [(5, i % 2) for i in range(40)],
            "few": [(1, 0), (2, 1), (3, 1)], "odd": [(i // 3, i % 2) for i in range(90)] + [(None, 1)] * 9 + [(i, None) for i in range(9)]}[kind]
    df = spark.createDataFrame(rows, "id long, label int")
    got = E.stratified_split(df, rows_per_bucket=13)
    assert got.columns == ["label", "id", "split"]
    assert sorted((r.id, r.label, r.split) for r in got.collect()) == _by_rank(rows)


def test_stratified_split_shuffles_no_row(spark):
    """the split of the rows is a comparison in their scan (the ranks used to shuffle and sort all rows)."""
    got = E.stratified_split(spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("label")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Window" not in plan


@pytest.mark.parametrize("values", [[], [None, None], [0.0, -0.0, 5e-324, -5e-324], [1e308, -1e308, 3.0, None, float("nan")],
                                    [float(2 ** k) for k in range(-40, 40)], [1.0 + k * 2 ** -52 for k in range(9)] + [-7.25] * 4])
def test_medians_of_a_table_read_twice(spark, values):
    """only values near the median are shuffled; the medians are those of the plain way."""
    df = spark.createDataFrame([(v, 1.0) for v in values], "a double, b double")
    own = [v for v in values if v is not None and v == v]
    got = Q.column_quantiles(df, ["a", "b"], 0.5, reread=True).first()
    assert got == Q.column_quantiles(df, ["a", "b"]).first()
    assert got.a == (np.median(own) if own else None) and got.b == (1.0 if values else None)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    r = E.class_weights(df).first()
    assert (r.n_pos, r.n_neg, r.scale_pos_weight) == (1, 3, 3.0)
    assert r.weight_pos == pytest.approx(2.0) and r.weight_neg == pytest.approx(4 / 6)
