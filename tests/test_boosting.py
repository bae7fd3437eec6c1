"""Boosting, cross-validation and the search, and the keyed tables that hold their results."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tempest import config
from tempest.operators import boosting as B
from tempest.operators import evaluate as E
from tempest.operators import model as M
from tempest.plans import base
from tempest.session import run_folder
from tempest.sources.keyed import KeyedTable, read_small, write_small


# ------------------------------------------------------------------ keyed tables

def rows(spark, values):
    return spark.createDataFrame(values, "key long, part string, value double")


def table_rows(t):
    return sorted(map(tuple, t.read().select("key", "part", "value").collect()), key=repr)


def test_upsert_adds_replaces_and_repeats(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["key", "part"])
    assert t.version() is None and t.read() is None
    wanted = rows(spark, [(1, "a", 0.0), (2, "b", 0.0), (None, None, 0.0)])
    assert t.missing(wanted).count() == 3
    t.upsert(rows(spark, [(1, "a", 1.0), (None, None, 5.0)]))
    assert [r["key"] for r in t.missing(wanted).collect()] == [2]
    again = rows(spark, [(1, "a", 2.0), (2, "b", 3.0), (2, "b", 3.0)])
    for _ in range(3):  # a repeated job leaves one row per key
        t.upsert(again)
        assert table_rows(t) == sorted([(1, "a", 2.0), (2, "b", 3.0), (None, None, 5.0)], key=repr)
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("v-")]) == 2  # the last two versions
    t.upsert(spark.createDataFrame([(9, "z", 1.0, "new")], "key long, part string, value double, note string"))
    assert t.read().where("note is null").count() == 3 and t.read().count() == 4


def test_broken_upsert_leaves_the_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["key"])
    t.upsert(rows(spark, [(1, "a", 1.0)]))
    before, name = table_rows(t), t.version()
    broken = rows(spark, [(2, "b", 2.0)]).withColumn("value", F.when(F.col("key") == 2, F.raise_error(F.lit("lost"))).cast("double"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken)
    assert table_rows(t) == before and t.version() == name
    held = t.read()  # a reader that has opened the version before
    t.upsert(rows(spark, [(2, "b", 2.0)]))
    assert held.count() == 1 and t.read().count() == 2


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "x")
    assert read_small(spark, path) is None
    for text in ("one", "zwei \u00e9", ""):
        write_small(spark, path, text)
        assert read_small(spark, path) == text
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["x"]


# ------------------------------------------------------------------ trees

def plain_tree(codes, g, h, used, p, columns, rows=None, depth=0):
    """The same tree by recursion over all splits."""
    rows = np.arange(len(codes)) if rows is None else rows
    out = np.zeros(len(codes))
    mine = rows[used[rows]]
    score = lambda r: max(abs(g[r].sum()) - p["reg_alpha"], 0) ** 2 / max(h[r].sum() + p["reg_lambda"], 1e-12)
    best = (score(mine) + 1e-6, None)
    if depth < p["max_depth"] and len(mine) > 1:
        for f in columns:
            for b in range(B.BINS):
                left, right = mine[codes[mine, f] <= b], mine[codes[mine, f] > b]
                if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= p["min_child_weight"]:
                    gain = score(left) + score(right)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
    if best[1] is None:
        s = g[mine].sum()
        out[rows] = -p["learning_rate"] * np.sign(s) * max(abs(s) - p["reg_alpha"], 0) / max(h[mine].sum() + p["reg_lambda"], 1e-12)
        return out
    f, b = best[1]
    for side in (rows[codes[rows, f] <= b], rows[codes[rows, f] > b]):
        out += plain_tree(codes, g, h, used, p, columns, side, depth + 1)
    return out


@pytest.mark.parametrize("depth, alpha, lam, least", [(1, 0, 1, 1), (3, 0, 1, 0.5), (4, 0.7, 2.5, 2.0), (5, 0, 0, 0.1)])
def test_tree_equals_recursion_over_all_splits(depth, alpha, lam, least):
    rng = np.random.default_rng(depth)
    codes = rng.integers(0, 9, (300, 5))
    y = (codes[:, 0] + 2 * codes[:, 3] * (codes[:, 1] > 4) + rng.normal(0, 2, 300) > 8).astype(float)
    q = rng.uniform(0.1, 0.9, 300)
    p = {"max_depth": depth, "reg_alpha": alpha, "reg_lambda": lam, "min_child_weight": least, "learning_rate": 0.3}
    used, columns = rng.random(300) < 0.8, np.array([0, 1, 3])
    got = B.grow(codes, q - y, q * (1 - q), used, p, columns)
    assert np.allclose(got, plain_tree(codes, q - y, q * (1 - q), used, p, columns))


def test_held_out_rows_teach_nothing():
    rng = np.random.default_rng(0)
    codes, fold = rng.integers(0, 20, (400, 4)).astype(np.uint8), (np.arange(400) % 4).astype(np.uint8)
    y = (codes[:, 0] > 9).astype(np.uint8)
    other = y.copy()
    other[fold == 1] = 1 - other[fold == 1]  # labels of the held-out fold and of the test fold
    other[fold == 3] = 1 - other[fold == 3]
    for p in (B.DEFAULTS, B.DEFAULTS | {"subsample": 0.7, "colsample": 0.5}):
        a = dict(B.held_out_margins(codes, y, fold, 1, 3, p, [5, 20], 7))
        b = dict(B.held_out_margins(codes, other, fold, 1, 3, p, [5, 20], 7))
        assert sorted(a) == [5, 20] and all((a[k] == b[k]).all() for k in a)
        shorter = dict(B.held_out_margins(codes, y, fold, 1, 3, p, [5], 7))
        assert (shorter[5] == a[5]).all()  # a stage is the fit of that many trees
        assert ((a[20] > 0) == (y[fold == 1] == 1)).mean() > 0.9


# ------------------------------------------------------------------ folds and search

@pytest.fixture(scope="module")
def mf(spark):
    return M.model_frame(base.clean(spark, SF_SMALL)).cache()


FEW = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment", "loan_amnt"]


@pytest.mark.parametrize("block_rows", [400, 1 << 16])
def test_blocks_hold_every_row_once(spark, mf, block_rows):
    got = B.binned_blocks(mf, FEW, 3, run_folder(spark, "t"), block_rows).collect()
    used = mf.where("split in ('train', 'test')")
    assert sum(r["n"] for r in got) == used.count() and all(r["n"] <= 1.1 * block_rows for r in got)
    assert (len(got) > 1) == (block_rows == 400)
    labels = np.concatenate([np.frombuffer(r["labels"], np.uint8) for r in got])
    folds = np.concatenate([np.frombuffer(r["folds"], np.uint8) for r in got])
    assert (folds == 3).sum() == used.where("split = 'test'").count() and labels.sum() == used.agg(F.sum("label")).first()[0]
    rates = [labels[folds == f].mean() for f in range(3)]
    assert max(rates) - min(rates) < 0.01  # stratified


def test_fold_auc_equals_the_metric(spark, mf):
    rng = np.random.default_rng(3)
    values = [(int(f), int(p), int(rng.random() < 0.3 + p / 60)) for f, p in zip(rng.integers(0, 2, 500), rng.integers(-9, 9, 500), strict=True)]
    counts = spark.createDataFrame([("s", f, 10, p, y, 1 - y, 1.0) for f, p, y in values],
                                   "setting string, fold int, n_trees int, place long, n_pos long, n_neg long, seconds double")
    got = {r["fold"]: r for r in B.fold_auc(counts).collect()}
    for f in (0, 1):
        part = spark.createDataFrame([(y, float(p)) for k, p, y in values if k == f], "label int, score double")
        assert got[f]["auc"] == pytest.approx(E.auc(part).first().auc, abs=1e-12) and got[f]["n_rows"] == part.count()


def test_search_goes_on_where_it_stopped(spark, mf, tmp_path, monkeypatch):
    """A run that breaks after its first wave leaves that wave's rows; the next run fits the rest only, with the same result."""
    blocks = B.binned_blocks(mf, FEW, 2, run_folder(spark, "t"))
    candidates = [({"max_depth": d, "learning_rate": 0.2, "reg_alpha": a, "reg_lambda": 1.0}, [3, 6]) for d in (1, 3) for a in (0.0, 500.0)]
    book = B.ledger(spark, str(tmp_path / "broken"))
    upsert, waves = KeyedTable.upsert, []

    def breaks(self, new):
        if waves:
            raise RuntimeError("lost")
        waves.append(1)
        return upsert(self, new)

    units = [(p, f, s) for p, s in candidates for f in range(2)]
    monkeypatch.setattr(KeyedTable, "upsert", breaks)
    with pytest.raises(RuntimeError):
        B.evaluate(blocks, units, 2, len(FEW), book, "tune", wave=3)
    assert book.read().count() == 3 * 2
    fitted = []
    monkeypatch.setattr(KeyedTable, "upsert", lambda self, new: fitted.append(new.count()) or upsert(self, new))
    got = B.search(blocks, candidates, 2, len(FEW), book).collect()
    assert sum(fitted) == len(units) * 2 - 6 + 1  # what was left, and the best candidate's test row
    whole = B.search(blocks, candidates, 2, len(FEW), B.ledger(spark, str(tmp_path / "whole"))).collect()
    key = lambda r: (r["setting"], r["n_trees"])
    names = ["setting", "n_trees", "folds", "cv_auc_mean", "cv_auc_std", "test_auc"]
    assert [[r[c] for c in names] for r in sorted(got, key=key)] == [[r[c] for c in names] for r in sorted(whole, key=key)]
    assert len(got) == 8 and {r["folds"] for r in got} == {2}
    best = [r for r in got if r["test_auc"] is not None]
    assert len(best) == 1 and best[0]["cv_auc_mean"] == max(r["cv_auc_mean"] for r in got) > 0.6 and best[0]["test_auc"] > 0.55
    assert {r["cv_auc_mean"] for r in got if json.loads(r["setting"])["reg_alpha"] == 500.0 and json.loads(r["setting"])["max_depth"] == 1} \
        != {r["cv_auc_mean"] for r in got if json.loads(r["setting"])["reg_alpha"] == 0.0 and json.loads(r["setting"])["max_depth"] == 1}


def test_cv_of_the_spark_models_is_kept(spark, mf, tmp_path):
    book = B.ledger(spark, str(tmp_path / "cv"))
    few = mf.select("id", "label", "split", *M.FEATURES)
    first = B.summary(M.cv_folds(few, "lr", "logistic_regression", book, folds=2, maxIter=10), 2).first()
    assert first["folds"] == 2 and first["cv_auc_mean"] > 0.6 and not math.isnan(first["cv_auc_std"])
    version = book.version()
    again = B.summary(M.cv_folds(few, "lr", "logistic_regression", book, folds=2, maxIter=10), 2).first()
    assert again == first and book.version() == version  # read, not fitted again


def test_every_unit_has_a_task_of_its_own(spark, mf):
    """Four blocks and five folds are twenty tasks with one unit each, the first listed first."""
    blocks = B.binned_blocks(mf, FEW, 5, run_folder(spark, "t"), -(-mf.where("split in ('train', 'test')").count() // 4))
    work = B.deal(blocks, [("{}", f, [10]) for f in range(5)], blocks.count())
    got = work.select("unit", "fold", F.spark_partition_id().alias("task")).orderBy("task").collect()
    assert len(got) == 20 and len({r["task"] for r in got}) == 20
    assert [r["fold"] for r in got] == [r["unit"] for r in got] == sorted(r["unit"] for r in got)


def test_a_candidate_is_one_model_of_the_whole_table(spark, mf, tmp_path):
    """Blocks are storage; the figures of a candidate are those of one fit on all rows, however many blocks hold them."""
    rows, n = [], mf.where("split in ('train', 'test')").count()
    for i, size in enumerate((1 << 16, -(-n // 7))):
        blocks = B.binned_blocks(mf, FEW, 3, run_folder(spark, "t"), size)
        book = B.ledger(spark, str(tmp_path / str(i)))
        got = B.evaluate(blocks, [({"max_depth": 3}, f, [2, 5]) for f in (0, 3)], 3, len(FEW), book).collect()
        rows.append({(r["fold"], r["n_trees"]): (pytest.approx(r["auc"], abs=1e-9), r["n_rows"]) for r in got})
        assert blocks.count() == (7 if i else 1) and len(got) == 4
    assert rows[0] == {k: (v[0].expected, v[1]) for k, v in rows[1].items()}


def test_rows_in_a_file_teach_as_rows_in_memory_do(monkeypatch):
    rng = np.random.default_rng(2)
    codes, fold = rng.integers(0, 20, (900, 4)).astype(np.uint8), (np.arange(900) % 4).astype(np.uint8)
    y = (codes[:, 0] + rng.integers(0, 9, 900) > 12).astype(np.uint8)
    p = B.DEFAULTS | {"subsample": 0.7, "colsample": 0.8}
    want = dict(B.held_out_margins(codes, y, fold, 1, 3, p, [4], 7))[4]
    monkeypatch.setattr(B, "ROWS_IN_MEMORY", 100)
    got = dict(B.held_out_margins(codes, y, fold, 1, 3, p, [4], 7))[4]
    assert isinstance(B.scratch((3,), float, 900), np.memmap) and (got == want).all()


def test_rows_of_the_ledger_outlive_later_upserts(spark, mf, tmp_path):
    """A comparison reads several models' rows after all of them are written: versions read before are gone by then."""
    blocks = B.binned_blocks(mf, FEW, 2, run_folder(spark, "t"))
    book = B.ledger(spark, str(tmp_path / "several"))
    rows = [B.cross_validate(blocks, {"max_depth": 1}, 2, 2, len(FEW), book, name) for name in ("a", "b", "c")]
    few = mf.select("id", "label", "split", *M.FEATURES)
    rows += [B.summary(M.cv_folds(few, "lr", name, book, folds=2, maxIter=5), 2) for name in ("d", "e")]
    assert [r.first()["model"] for r in rows] == ["a", "b", "c", "d", "e"] and all(r.first()["folds"] == 2 for r in rows)


def test_drawn_candidates_are_seeded():
    a, b = B.draw_candidates(10, 3), B.draw_candidates(10, 3)
    assert a == b != B.draw_candidates(10, 3, seed=1) and [len(s) for _, s in a] == [3, 3, 3, 1]
    assert set(config.TUNING_SPACE) >= {"regAlpha", "regLambda"}
