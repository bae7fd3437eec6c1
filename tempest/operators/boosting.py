"""Newton boosting of many candidates at once: cross-validation (M7) and parameter search (M8).

Spark ML's boosted trees need several jobs a level of every tree, so a search of dozens of candidates
takes hours whatever the size of the table.  Here:

1. Missing values get the training medians, every feature becomes one byte by its exact training
   quantiles (``BINS``), once for all candidates and folds.
2. Rows are dealt, stratified by label and fold, to blocks of at most ``BLOCK_ROWS`` rows, and a block is one
   packed row of a written table.  Blocks are how rows are stored and counted, not what is learned from: a
   candidate is one model, fitted on all blocks' rows of the other folds.
3. The unit of work is (candidate, fold): a task reads all blocks (rows of large tables in a scratch file) and
   grows its trees level by level on histograms of first and second derivatives, with
   row and column sampling, least child weight, and L1 and L2 penalties.  It returns the held-out
   rows counted by margin (2^-12 in log-odds) after each number of trees asked for: candidates that differ
   in the number of trees only share one fit (staged evaluation).
4. AUC per (candidate, fold) from these counts, in Spark.

Units go in waves, and the results of a wave are upserted to a ledger (``KeyedTable``) before the next
starts: a run that breaks goes on where it stopped, and later runs read what earlier ones found (J17).
"""

from __future__ import annotations

import json
import math
import os
import random
import tempfile
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest import config
from tempest.operators import cleaning
from tempest.operators import evaluate as E
from tempest.operators import quantiles as Q
from tempest.session import materialise, run_folder
from tempest.sources.keyed import KeyedTable

BINS = 64
BLOCK_ROWS = 1 << 16
CHUNK_BLOCKS = 4
PACKED_CELLS = 1 << 12
ROWS_IN_MEMORY = 1 << 21
MARGIN_STEP = 1 / 4096

#: Settings of a candidate that are not given.
DEFAULTS = {"max_depth": config.GBT_PARAMS["maxDepth"], "learning_rate": config.GBT_PARAMS["stepSize"], "subsample": 1.0,
            "colsample": 1.0, "min_child_weight": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0}


# ------------------------------------------------------------------ rows to blocks

def binned_blocks(rows: DataFrame, features: Sequence[str], folds: int, folder: str, block_rows: int = BLOCK_ROWS,
                  seed: int = config.RANDOM_STATE) -> DataFrame:
    """(block, n, labels, folds, codes) of ``rows`` (id, label, split, features).

    Training rows are in folds 0 .. ``folds`` - 1, test rows in fold ``folds``; edges and medians come from
    the training rows only.
    """
    train = rows.where(F.col("split") == "train")
    medians = cleaning.medians_row(train, features, reread=True).first()
    fill = {f: F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(float(medians[f] if medians[f] is not None else 0.0))).alias(f) for f in features}
    filled = materialise(rows.where("split in ('train', 'test')").select("id", "label", "split", *fill.values()), folder, "filled")
    long = filled.where(F.col("split") == "train").unpivot([], list(features), "feature", "value")
    probs = [i / BINS for i in range(1, BINS)]
    edges = {r["feature"]: np.unique(r["q"]) for r in Q.quantiles(long, "value", probs, ["feature"]).collect()}  # features x BINS numbers

    # the rank within (label, split) in a seeded order deals rows to folds and blocks alike
    pairs = filled.select("id", "label", "split", E.split_hash("id", seed + 1).alias("_h"), F.lit(1).alias("_one"))
    place = E.prefix_sums(pairs, "_h", ["_one"], partition_cols=["label", "split"], tie_col="id")
    n_blocks = max(1, math.ceil(filled.count() / block_rows))
    at = F.col("_one_before")
    fold = F.when(F.col("split") == "test", F.lit(folds)).otherwise(at % folds).cast("int")
    place = place.select("id", fold.alias("fold"), (F.floor(at / folds) % n_blocks).cast("long").alias("block"))
    dealt = filled.drop("split").join(place, "id")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # one order, whatever the shuffle's
        codes = np.stack([np.searchsorted(edges[f], table[f].to_numpy(), "left") for f in features], axis=1).astype(np.uint8)
        return pa.table({"block": table["block"].slice(0, 1), "n": [table.num_rows], "labels": [table["label"].to_numpy().astype(np.uint8).tobytes()],
                         "folds": [table["fold"].to_numpy().astype(np.uint8).tobytes()], "codes": [codes.tobytes()]})

    blocks = dealt.groupBy("block").applyInArrow(pack, "block long, n long, labels binary, folds binary, codes binary")
    return materialise(blocks, folder, "blocks")


# ------------------------------------------------------------------ one unit

def _pull(g: np.ndarray, alpha: float) -> np.ndarray:
    """First derivatives less the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _gain(g: np.ndarray, h: np.ndarray, p: dict) -> np.ndarray:
    return _pull(g, p["reg_alpha"]) ** 2 / np.maximum(h + p["reg_lambda"], 1e-12)


def scratch(shape: tuple[int, ...], kind, rows: int) -> np.ndarray:
    """Room for a task's rows: memory for tables up to ``ROWS_IN_MEMORY`` ``rows``, beyond that a nameless file of the task."""
    if rows <= ROWS_IN_MEMORY:
        return np.empty(shape, kind)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as f:
        return np.memmap(f, kind, "w+", shape=shape)


class Chunk:
    """Rows of some blocks of a table of ``rows``: codes by feature, labels, folds, and what boosting knows of them."""

    def __init__(self, blocks: Sequence[tuple[int, np.ndarray, np.ndarray, np.ndarray]], rows: int) -> None:
        """``blocks``: (number, codes by row, labels, folds)."""
        n = sum(len(b[2]) for b in blocks)
        self.n, self.rows, self.parts = n, rows, [(b[0], len(b[2])) for b in blocks]
        self.codes = scratch((blocks[0][1].shape[1], n), np.uint8, rows)
        np.concatenate([b[1].T for b in blocks], axis=1, out=self.codes)
        self.labels, self.fold = (np.concatenate([b[i] for b in blocks]) for i in (2, 3))
        self.margin, self.g, self.h = (scratch((n,), float, rows) for _ in range(3))
        self.margin[:] = 0
        self.node, self.used, self.packs, self.joint = scratch((n,), np.int32, rows), np.ones(n, bool), None, None

    def pack(self, packs: list[list[int]], widths: Sequence[int]) -> None:
        """Joint codes of groups of features."""
        if packs == self.packs:
            return
        if self.joint is None or len(self.joint) < len(packs):
            self.joint = scratch((len(packs), self.n), np.uint16, self.rows)
        for out, (first, *others) in zip(self.joint, packs, strict=False):
            out[:] = self.codes[first]
            for c in others:
                out *= np.uint16(widths[c])
                out += self.codes[c]
        self.packs = packs


def packs_of(columns: Sequence[int], widths: Sequence[int]) -> list[list[int]]:
    """``columns`` in groups whose joint code has at most ``PACKED_CELLS`` values."""
    out: list[list] = []
    for c in sorted(columns, key=lambda c: -widths[c]):
        for pack in out:
            if pack[0] * widths[c] <= PACKED_CELLS:
                pack[0] *= widths[c]
                pack[1].append(int(c))
                break
        else:
            out.append([widths[c], [int(c)]])
    return [members for _, members in out]


def _histograms(chunks: Sequence[Chunk], place_of: np.ndarray, n: int, columns: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """(2, ``n``, column, bin): sums of both derivatives over the used rows of the nodes that ``place_of`` gives a place.

    A count over the joint code of several features holds the counts of each: while nodes are few, they are counted a group
    at a time.  With many nodes a group has more cells than rows, and features are counted one by one.
    """
    rows = sum(c.n for c in chunks) / max(1, len(chunks))
    joint = n * PACKED_CELLS <= min(rows, 1 << 17)
    groups = packs_of(columns, widths) if joint else [[int(c)] for c in columns]
    sizes = [math.prod(widths[c] for c in g) for g in groups]
    sums = [np.zeros((2, n * size)) for size in sizes]
    for chunk in chunks:
        if joint:
            chunk.pack(groups, widths)
        at = place_of.take(chunk.node)
        rows = np.flatnonzero((at >= 0) & chunk.used)
        if not len(rows):
            continue
        every = len(rows) == chunk.n
        at, g, h = (at, chunk.g, chunk.h) if every else (at[rows], chunk.g.take(rows), chunk.h.take(rows))
        for i, (group, size, out) in enumerate(zip(groups, sizes, sums, strict=True)):
            code = chunk.joint[i] if joint else chunk.codes[group[0]]
            place = at * size if n > 1 else np.zeros(len(rows), np.int64)
            place += code if every else code.take(rows)
            out[0] += np.bincount(place, g, n * size)
            out[1] += np.bincount(place, h, n * size)
    hist, where = np.zeros((2, n, len(columns), BINS)), {int(c): i for i, c in enumerate(columns)}
    for group, out in zip(groups, sums, strict=True):
        cells = out.reshape(2, n, *[widths[c] for c in group])
        for j, c in enumerate(group):
            hist[:, :, where[c], :widths[c]] = cells.sum(axis=tuple(2 + i for i in range(len(group)) if i != j))
    return hist


class Tree:
    """Per node: feature and last bin of the left side, number of the left child (0: a leaf), value; gain and weight of a split."""

    def __init__(self) -> None:
        self.feature, self.bin, self.child, self.value, self.gain, self.weight = (np.zeros(0, k) for k in (np.int64, np.int64, np.int64, float, float, float))

    def add(self, **of) -> None:
        for name, v in of.items():
            setattr(self, name, np.concatenate([getattr(self, name), v]))


def grow_tree(chunks: Sequence[Chunk], p: dict, columns: np.ndarray, widths: Sequence[int], total=lambda x: x) -> Tree:
    """One tree on the used rows of all chunks; ``node`` of every row is its leaf then.

    ``total`` adds up arrays of all tasks that hold rows of the table.  Of two siblings only the lighter one's histogram is
    counted, the other's is the parent's less that.
    """
    for c in chunks:
        c.node[:] = 0
    gn, hn = total(np.array([[c.g[c.used].sum(), c.h[c.used].sum()] for c in chunks]).reshape(-1, 2).sum(axis=0)).reshape(2, 1)
    tree, k, least, start, parents = Tree(), len(columns), p["min_child_weight"], 0, None
    for depth in range(p["max_depth"] + 1):
        n_open = len(gn)
        leaf = -p["learning_rate"] * _pull(gn, p["reg_alpha"]) / np.maximum(hn + p["reg_lambda"], 1e-12)
        able = (hn >= 2 * least) & (depth < p["max_depth"])
        split, best, most = np.zeros(n_open, bool), np.zeros(n_open, np.int64), np.zeros(n_open)
        if able.any():
            mate, odd = np.arange(n_open) ^ 1, np.arange(n_open) % 2 == 1  # siblings are 2 j and 2 j + 1
            counted = able if depth == 0 else able & ~(able[mate] & ((hn > hn[mate]) | ((hn == hn[mate]) & odd)))
            place_of = np.full(start + n_open, -1)
            place_of[start + np.flatnonzero(counted)] = np.arange(int(counted.sum()))
            hist = np.zeros((2, n_open, k, BINS))
            hist[:, counted] = total(_histograms(chunks, place_of, int(counted.sum()), columns, widths))
            rest = np.flatnonzero(able & ~counted)
            if len(rest):
                hist[:, rest] = parents[:, rest // 2] - hist[:, rest ^ 1]
            some = np.flatnonzero(able)
            gl, hl = hist[:, some].cumsum(axis=3)
            gr, hr = gn[some, None, None] - gl, hn[some, None, None] - hl
            gain = _gain(gl, hl, p) + _gain(gr, hr, p)
            gain[(hl < least) | (hr < least) | (hl <= 1e-12) | (hr <= 1e-12)] = -np.inf
            gain = gain.reshape(len(some), k * BINS)
            top = gain.max(axis=1, keepdims=True)
            best[some] = (gain >= top - 1e-12 * np.abs(top)).argmax(axis=1)  # the first of equals, whatever the sums' order
            most[some] = gain[np.arange(len(some)), best[some]] - _gain(gn[some], hn[some], p)
            split = able & (most > p.get("min_gain", 1e-6))
        rank, following = np.cumsum(split) - 1, start + n_open
        tree.add(feature=np.where(split, columns[best // BINS], -1), bin=best % BINS, child=np.where(split, following + 2 * rank, 0),
                 value=np.where(split, 0.0, leaf), gain=np.where(split, most, 0.0), weight=hn)
        if not split.any():
            break
        for c in chunks:
            at = c.node - start
            rows = np.flatnonzero(at >= 0) if depth else np.arange(c.n)
            at = at[rows]
            going = split[at]
            rows, at = rows[going], at[going]
            right = c.codes.reshape(-1).take(tree.feature[start + at] * c.n + rows) > tree.bin[start + at]
            c.node[rows] = tree.child[start + at] + right
        place = np.zeros(n_open, np.int64)
        place[some] = np.arange(len(some))
        of = place[split]
        left = np.stack([x.reshape(len(some), -1)[of, best[split]] for x in (gl, hl)])
        right = np.stack([gn[split], hn[split]]) - left
        gn, hn = np.stack([left, right], axis=2).reshape(2, -1)
        parents, start = hist[:, split], following
    return tree


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, p: dict, columns: np.ndarray) -> np.ndarray:
    """One tree on the rows ``used``: the leaf value (times the learning rate) of every row."""
    zeros = np.zeros(len(codes), np.uint8)
    chunk = Chunk([(0, np.asarray(codes, np.uint8), zeros, zeros)], len(codes))
    chunk.g, chunk.h, chunk.used = g, h, used
    return grow_tree([chunk], p, np.asarray(columns), chunk.codes.max(axis=1, initial=0).astype(int) + 1).value[chunk.node]


def boosted(chunks: Sequence[Chunk], held: int, p: dict, stages: Sequence[int], seed: int) -> Iterator[int]:
    """Number of trees at each of ``stages``, when the chunks hold the margins after them; rows of fold ``held`` teach nothing."""
    rng = np.random.default_rng(seed)
    draws = {b: np.random.default_rng([seed, b]) if b else rng for c in chunks for b, _ in c.parts}  # a block's draws are its own
    n = n_pos = 0
    for c in chunks:
        teach = c.fold != held
        n, n_pos = n + int(teach.sum()), n_pos + float(c.labels[teach].sum())
    heavy = (n - n_pos) / n_pos if n_pos else 1.0
    widths = np.max([c.codes.max(axis=1, initial=0) for c in chunks], axis=0).astype(int) + 1
    n_features = len(widths)
    n_columns = max(1, int(p["colsample"] * n_features))
    for t in range(1, max(stages) + 1):
        for c in chunks:
            q, weight = 1 / (1 + np.exp(-c.margin)), np.where(c.labels == 1, heavy, 1.0)
            c.g[:], c.h[:] = weight * (q - c.labels), weight * q * (1 - q)
            c.used = c.fold != held
            if p["subsample"] < 1:
                c.used &= np.concatenate([draws[b].random(m) for b, m in c.parts]) < p["subsample"]
        tree = grow_tree(chunks, p, np.sort(rng.choice(n_features, n_columns, replace=False)), widths.tolist())
        for c in chunks:
            c.margin += tree.value[c.node]
        if t in stages:
            yield t


def held_out_margins(codes: np.ndarray, labels: np.ndarray, fold: np.ndarray, held: int, test: int, p: dict, stages: Sequence[int],
                     seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of trees, margins of the rows of fold ``held``) at each of ``stages``; rows of ``held`` and ``test`` teach nothing."""
    keep = (fold != test) | (fold == held)
    chunk = Chunk([(0, codes[keep], labels[keep], fold[keep])], len(codes))
    for t in boosted([chunk], held, p, stages, seed):
        yield t, np.array(chunk.margin[chunk.fold == held])


def read_chunks(files: Sequence[str], n_features: int, held: int, test: int) -> list[Chunk]:
    """All blocks of the table, ``CHUNK_BLOCKS`` a chunk: training rows, and those of fold ``held``."""
    opened = [fs.FileSystem.from_uri(f) for f in files]
    rows = sum(sum(pq.read_table(at, filesystem=system, columns=["n"])["n"].to_pylist()) for system, at in opened)
    chunks, some = [], []
    for system, at in opened:
        with system.open_input_file(at) as f:
            for b in pq.ParquetFile(f).iter_batches(1):
                for r in b.to_pylist():
                    labels, fold = np.frombuffer(r["labels"], np.uint8), np.frombuffer(r["folds"], np.uint8)
                    keep = (fold != test) | (fold == held)
                    some.append((r["block"], np.frombuffer(r["codes"], np.uint8).reshape(r["n"], n_features)[keep], labels[keep], fold[keep]))
                    if len(some) == CHUNK_BLOCKS:
                        chunks.append(Chunk(some, rows))
                        some = []
    return chunks + ([Chunk(some, rows)] if some else [])


def _evaluate(files: Sequence[str], n_features: int, test: int, seed: int):
    """Task function: units (a candidate and a held-out fold) to counts by margin, fitted on all blocks in ``files``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p, began = json.loads(r["setting"]), time.perf_counter()
                chunks = read_chunks(files, n_features, r["fold"], test)
                for n_trees in boosted(chunks, r["fold"], DEFAULTS | p, r["stages"], seed + r["fold"]):
                    for c in chunks:
                        out = c.fold == r["fold"]
                        place, at = np.unique(np.round(c.margin[out] / MARGIN_STEP).astype(np.int64), return_inverse=True)
                        n_pos = np.bincount(at[c.labels[out] == 1], minlength=len(place)).astype(np.int64)
                        n_all = np.bincount(at, minlength=len(place)).astype(np.int64)
                        k = len(place)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["setting"]] * k), pa.array([r["fold"]] * k, pa.int32()), pa.array([n_trees] * k, pa.int32()), pa.array(place),
                             pa.array(n_pos), pa.array(n_all - n_pos), pa.array([time.perf_counter() - began] * k)],
                            ["setting", "fold", "n_trees", "place", "n_pos", "n_neg", "seconds"])

    return run


def fold_auc(counts: DataFrame) -> DataFrame:
    """setting, fold, n_trees, auc, n_rows, seconds from counts by margin (one row per margin step after the sum)."""
    key = ["setting", "fold", "n_trees"]
    c = counts.groupBy(*key, "place").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.max("seconds").alias("seconds"))
    below = F.coalesce(F.sum("n_neg").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("won", F.col("n_pos") * (below + F.col("n_neg") * 0.5))
    return c.groupBy(*key).agg(F.try_divide(F.sum("won"), (F.sum("n_pos") * F.sum("n_neg")).cast("double")).alias("auc"),
                               F.sum(F.col("n_pos") + F.col("n_neg")).alias("n_rows"), F.max("seconds").alias("seconds"))


# ------------------------------------------------------------------ runs over a ledger

LEDGER_KEYS = ["model", "setting", "n_trees", "fold"]


def ledger(spark, path: str) -> KeyedTable:
    """One row per (model, setting, n_trees, fold): auc, n_rows, seconds."""
    return KeyedTable(spark, path, LEDGER_KEYS)


def setting_text(p: dict) -> str:
    return json.dumps({k: round(v, 10) if isinstance(v, float) else v for k, v in p.items()}, sort_keys=True)


def deal(blocks: DataFrame, part: list[tuple[str, int, Sequence[int]]], n_blocks: int) -> DataFrame:
    """Every row of ``blocks`` with every unit (setting, held-out fold, numbers of trees), a task each.

    By ranges and not by hashes: no task gets two while another gets none, and the units listed first start first.
    """
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("unit"), F.lit(s).alias("setting"), F.lit(f).alias("fold"), F.array(*map(F.lit, st)).alias("stages"))
                                for i, (s, f, st) in enumerate(part)]))
    work = blocks.select("*", table.alias("u")).select("*", "u.*").drop("u")
    tasks = min(len(part) * n_blocks, 10_000)
    return work.repartitionByRange(tasks, "unit", "block") if tasks > 1 else work


def evaluate(blocks: DataFrame, units: list[tuple[dict, int, Sequence[int]]], folds: int, n_features: int, book: KeyedTable, model: str = "gbt",
             wave: int | None = None, seed: int = config.RANDOM_STATE) -> DataFrame:
    """The ledger's rows of ``units`` (setting, held-out fold, numbers of trees); only what it lacks is fitted, in waves."""
    spark, files = blocks.sparkSession, blocks.inputFiles()
    wave = wave or 4 * spark.sparkContext.defaultParallelism
    asked = [(model, setting_text(p), int(n), fold) for p, fold, stages in units for n in stages]
    schema = "model string, setting string, n_trees int, fold int"
    todo = {tuple(r) for r in book.missing(spark.createDataFrame(asked, schema)).collect()}
    left = [(p, fold, stages) for p, fold, stages in units if any((model, setting_text(p), int(n), fold) in todo for n in stages)]
    left.sort(key=lambda u: -max(u[2]) * (DEFAULTS | u[0])["max_depth"])  # long ones first
    for i in range(0, len(left), wave):
        part = [(setting_text(p), fold, sorted({int(n) for n in stages})) for p, fold, stages in left[i:i + wave]]
        work = deal(spark.range(1).select(F.col("id").alias("block")), part, 1)
        counts = work.mapInArrow(_evaluate(files, n_features, folds, seed), "setting string, fold int, n_trees int, place long, n_pos long, n_neg long, seconds double")
        book.upsert(fold_auc(counts).select(F.lit(model).alias("model"), "*"))
    return held(book, spark.createDataFrame(asked, schema))


def held(book: KeyedTable, asked: DataFrame) -> DataFrame:
    """The ledger's rows of ``asked``, written apart: later upserts delete the version they were read from."""
    return materialise(book.read().join(F.broadcast(asked), LEDGER_KEYS), run_folder(asked.sparkSession, "trials"), "held")


def summary(rows: DataFrame, folds: int) -> DataFrame:
    """(model, setting, n_trees) with the mean and standard deviation of the folds' AUC (the test fold apart)."""
    cv = F.col("fold") < folds
    return rows.groupBy("model", "setting", "n_trees").agg(
        F.avg(F.when(cv, F.col("auc"))).alias("cv_auc_mean"), F.stddev_pop(F.when(cv, F.col("auc"))).alias("cv_auc_std"),
        F.count_if(cv).cast("int").alias("folds"), F.max(F.when(~cv, F.col("auc"))).alias("test_auc"), F.sum("seconds").alias("seconds"))


def draw_candidates(trials: int = config.TUNING_TRIALS, lengths: int = config.TUNING_LENGTHS, seed: int = config.RANDOM_STATE) -> list[tuple[dict, list[int]]]:
    """M8: seeded draws over the tuning space, each with ``lengths`` numbers of trees: ``trials`` candidates in all."""
    rnd, space = random.Random(seed), config.TUNING_SPACE

    def log_uniform(name):
        lo, hi = space[name]
        return math.exp(rnd.uniform(math.log(lo), math.log(hi)))

    out, left = [], trials
    while left:
        n = min(lengths, left)
        p = {"max_depth": rnd.randint(*space["maxDepth"]), "learning_rate": log_uniform("stepSize"),
             "subsample": rnd.uniform(*space["subsamplingRate"]), "colsample": rnd.uniform(*space["featureSubsetStrategy"]),
             "min_child_weight": float(rnd.randint(*space["minInstancesPerNode"])), "reg_alpha": log_uniform("regAlpha"),
             "reg_lambda": log_uniform("regLambda")}
        lo, hi = space["maxIter"]
        out.append((p, sorted(rnd.sample(range(lo, hi + 1, 50), n))))
        left -= n
    return out


def cross_validate(blocks: DataFrame, p: dict, n_trees: int, folds: int, n_features: int, book: KeyedTable, model: str = "gbt") -> DataFrame:
    """M7: mean and standard deviation of the AUC over the folds."""
    rows = evaluate(blocks, [(p, f, [n_trees]) for f in range(folds)], folds, n_features, book, model)
    return summary(rows, folds)


def search(blocks: DataFrame, candidates: list[tuple[dict, list[int]]], folds: int, n_features: int, book: KeyedTable) -> DataFrame:
    """M8: a row per candidate with its CV AUC; the best one is fitted on all training rows and has its test AUC too."""
    units = [(p, f, stages) for p, stages in candidates for f in range(folds)]
    ranked = summary(evaluate(blocks, units, folds, n_features, book, "tune"), folds)
    best = ranked.orderBy(F.desc("cv_auc_mean"), "setting", "n_trees").first()
    test = evaluate(blocks, [(json.loads(best["setting"]), folds, [best["n_trees"]])], folds, n_features, book, "tune")
    test = test.select(F.col("setting").alias("t_setting"), F.col("n_trees").alias("t_trees"), F.col("auc").alias("t_auc"))
    out = ranked.drop("test_auc").join(F.broadcast(test), (F.col("setting") == F.col("t_setting")) & (F.col("n_trees") == F.col("t_trees")), "left")
    return out.withColumnRenamed("t_auc", "test_auc").drop("t_setting", "t_trees")
