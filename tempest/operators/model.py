"""Model fitting and model-based jobs on Spark ML.

* Features are the 38 model columns; missing values are filled with exact
  medians of the **training** split (one aggregate), applied by a
  ``SQLTransformer`` stage so that the fitted ``PipelineModel`` carries them
  (scoring never recomputes batch medians).
* Class imbalance: ``weightCol`` with neg/pos on positives (boosted trees) or
  'balanced' weights n / (2 n_c) (logistic regression, random forest).
* Boosted trees run all their iterations; no row outside the training split takes part.
* All scoring is ``PipelineModel.transform`` plus ``vector_to_array`` -- no
  Python in the row path.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import cleaning, evaluate as E
from tempest.operators import boosting, gang, isotonic, trees
from tempest.session import cut_lineage, materialise, run_folder
from tempest.sources.keyed import KeyedTable

#: Rows of a task of a fit: below the first a task is not worth its start, above the second it asks for much memory.
ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 1_000_000

FEATURES = list(config.ALL_FEATURES)


def feature_set(df: DataFrame, include_climate: bool = True) -> list[str]:
    """The 48 columns with climate if ``df`` has all climate columns (and they are wanted), else the 38."""
    has = all(c in df.columns for c in config.CLIMATE_FEATURES)
    return list(config.ALL_FEATURES_CLIMATE if include_climate and has else config.ALL_FEATURES)


def model_frame(clean: DataFrame, features: Sequence[str] = FEATURES, id_col: str = "loan_id",
                label: str = "default", written: bool = False) -> DataFrame:
    """(id, label, features as DOUBLE) with the stratified split column (M1).

    ``written``: ``clean`` reads a written table. With one row an id the split is a column of the scan; rows of a repeated
    id take every split of their id.
    """
    base = clean.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"),
                        *[F.col(f).cast("double").alias(f) for f in features])
    folder = run_folder(clean.sparkSession, "model-frame")
    if not written:  # once: the split reads only id and label, several times
        base = materialise(base, folder, "rows")
    if base.groupBy("id").count().where(F.col("id").isNotNull() & (F.col("count") > 1)).isEmpty():
        return E.stratified_split(base, "label", "id").select(*base.columns, "split")
    split = E.stratified_split(base.select("id", "label"), "label", "id").select("id", "split")
    return materialise(base.join(split, "id"), folder, "split")


def imputer_stage(train: DataFrame, features: Sequence[str]) -> SQLTransformer:
    """P12 fitted on the training rows only: exact medians baked into a SQL stage."""
    med = cleaning.medians_row(train, features, reread=True).first()
    cols = ", ".join(f"coalesce(`{f}`, CAST({float(med[f]) if med[f] is not None else 0.0!r} AS DOUBLE)) AS `{f}__i`"
                     for f in features)
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{f}__i" for f in features], outputCol=out, handleInvalid="keep")


def weighted(df: DataFrame, mode: str) -> DataFrame:
    """M2: 'pos' = neg/pos on positives (boosters), 'balanced' = n / (2 n_c)."""
    w = E.class_weights(df.where(F.col("split") == "train"))
    if mode == "pos":
        wc = F.when(F.col("label") == 1, w.select("scale_pos_weight").scalar()).otherwise(C.lit_d(1.0))
    else:
        wc = F.when(F.col("label") == 1, w.select("weight_pos").scalar()).otherwise(w.select("weight_neg").scalar())
    return df.withColumn("weight", wc)


def gbt(max_iter: int = config.GBT_PARAMS["maxIter"], max_depth: int = config.GBT_PARAMS["maxDepth"],
        step: float = config.GBT_PARAMS["stepSize"], **kw) -> GBTClassifier:
    """M3: boosted trees, all iterations."""
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
                         maxDepth=max_depth, stepSize=step, seed=config.RANDOM_STATE, **kw)


def fit(mf: DataFrame, kind: str = "gbt", features: Sequence[str] = FEATURES, **params) -> PipelineModel:
    """Fit one of 'gbt' (M3), 'lr' (M4), 'rf' (M5) on the training split."""
    train = mf.where(F.col("split") == "train")
    ready = [imputer_stage(train, features), _assembler(features, "raw_features" if kind == "lr" else "features")]
    prepared = Pipeline(stages=ready).fit(train)
    if kind == "gbt" and (side_by_side := gang.slots(mf.sparkSession)):
        filled = weighted(prepared.stages[0].transform(train).select("label", "split", *[f"{f}__i" for f in features]), "pos")
        tasks = min(side_by_side, fit_tasks(train.count(), side_by_side))
        return PipelineModel([*prepared.stages, gang.fit(filled, gbt(**params), [f"{f}__i" for f in features], tasks)])
    assembled = prepared.transform(train).select("label", "split", "raw_features" if kind == "lr" else "features")
    fitted = _estimator(kind, by_rows(assembled), **params)
    return PipelineModel([*prepared.stages, *fitted.stages])


def fit_tasks(n: int, cores: int, rows: int = ROWS_PER_TASK, most: int = MOST_ROWS_PER_TASK) -> int:
    """Tasks of a fit on ``n`` rows: one a core once there are rows for it, then whole rounds of tasks of at most ``most`` rows."""
    return max(1, min(-(-n // rows), cores * max(1, -(-n // (cores * most)))))


def by_rows(df: DataFrame) -> DataFrame:
    """Dealt to ``fit_tasks`` partitions and written once: a fit reads its rows several times.

    A tree fit runs a job a level, in which every task sends its histograms of all open nodes: their shuffle grows
    with the tasks, not with the rows, so there are no more tasks than cores ask for.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df.repartition(fit_tasks(df.count(), cores)))


def _estimator(kind: str, assembled: DataFrame, **params) -> PipelineModel:
    """The stages behind the assembled features, fitted on ``assembled`` (label, split, features)."""
    if kind == "gbt":
        return Pipeline(stages=[gbt(**params)]).fit(weighted(assembled, "pos"))
    if kind == "lr":
        return Pipeline(stages=[StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
                                LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                                   maxIter=params.get("maxIter", 1000))]).fit(weighted(assembled, "balanced"))
    if kind == "rf":
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                        numTrees=params.get("numTrees", config.RF_PARAMS["numTrees"]),
                                        maxDepth=params.get("maxDepth", config.RF_PARAMS["maxDepth"]), seed=config.RANDOM_STATE)
        return Pipeline(stages=[forest]).fit(weighted(assembled, "balanced"))
    raise ValueError(f"unknown model kind {kind!r}")


def score(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Positive-class probability of every row (missing features -> defaults P11, medians P12)."""
    for f in FEATURES:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("double"))
    df = cleaning.default_fill(df)
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]) \
        .drop("features", "raw_features", "rawPrediction", "probability", "prediction",
              *[f"{f}__i" for f in FEATURES])


def calibrate(model: PipelineModel, mf: DataFrame) -> isotonic.Isotonic:
    """M9: isotonic map from raw score to default share, fitted on the calibration split."""
    return isotonic.fit(score(model, mf.where(F.col("split") == "calib"), "p_raw"))


def calibrated_scores(model: PipelineModel, iso, df: DataFrame) -> DataFrame:
    return iso.transform(score(model, df, "p_raw"))


def with_folds(train: DataFrame, folds: int, seed: int) -> DataFrame:
    """Stratified folds: the rank of a row within its class, in a seeded order, mod ``folds``."""
    pairs = train.select("id", "label", E.split_hash("id", seed).alias("_h"), F.lit(1).alias("_one"))
    keyed = E.prefix_sums(pairs, "_h", ["_one"], partition_cols=["label"], tie_col="id")
    fold = keyed.select("id", (F.col("_one_before") % folds).cast("int").alias("fold"))
    return cut_lineage(train.join(fold, "id"))


def cv_folds(mf: DataFrame, kind: str, name: str, book: KeyedTable, folds: int = config.CV_FOLDS, parallelism: int = 2,
             features: Sequence[str] = FEATURES, **params) -> DataFrame:
    """M7 for the Spark ML models: the ledger's row of every fold; folds it lacks are fitted, each written as it ends.

    Features are imputed and assembled once for all folds.
    """
    spark = mf.sparkSession
    setting = json.dumps({"kind": kind, **params}, sort_keys=True)
    asked = spark.createDataFrame([(name, setting, 0, f) for f in range(folds)], "model string, setting string, n_trees int, fold int")
    todo = [r["fold"] for r in book.missing(asked).collect()]
    if todo:
        train = mf.where(F.col("split") == "train")
        ready = Pipeline(stages=[imputer_stage(train, features), _assembler(features, "raw_features" if kind == "lr" else "features")]).fit(train)
        dealt = ready.transform(with_folds(train, folds, config.RANDOM_STATE + 1))
        data = materialise(dealt.select("label", "split", "fold", "raw_features" if kind == "lr" else "features"),
                           run_folder(spark, "cv"), "assembled")

        def one(fold: int):
            began = time.perf_counter()
            fitted = _estimator(kind, by_rows(data.where(F.col("fold") != fold)), **params)
            scored = fitted.transform(data.where(F.col("fold") == fold)).select("label", vector_to_array("probability")[1].alias("score"))
            row = E.auc(scored).first()
            return fold, float(row["auc"]), time.perf_counter() - began

        with ThreadPoolExecutor(parallelism) as pool:
            for done in as_completed([pool.submit(inheritable_thread_target(spark)(one), f) for f in todo]):
                fold, auc, seconds = done.result()
                n = data.where(F.col("fold") == fold).count()
                book.upsert(spark.createDataFrame([(name, setting, fold, 0, auc, n, seconds)],
                                                  "model string, setting string, fold int, n_trees int, auc double, n_rows long, seconds double"))
    return boosting.held(book, asked)


def test_metrics(model: PipelineModel, mf: DataFrame, name: str, iso=None, seconds: float | None = None) -> DataFrame:
    """M27 row: AUC raw (and calibrated), Brier, test rows, fit seconds."""
    test = mf.where(F.col("split") == "test")
    scored = score(model, test, "p_raw")
    if iso is not None:
        scored = iso.transform(scored)
    else:
        scored = scored.withColumn("p_cal", F.col("p_raw"))
    auc_raw = E.auc(scored.select("label", F.col("p_raw").alias("score"))).select("auc").scalar()
    auc_cal = E.auc(scored.select("label", F.col("p_cal").alias("score"))).select("auc").scalar()
    brier = E.brier(scored.select("label", F.col("p_cal").alias("score"))).scalar()
    return scored.agg(F.count(F.lit(1)).alias("n_test")).select(
        F.lit(name).alias("model"), auc_raw.alias("auc_raw"), auc_cal.alias("auc"), brier.alias("brier"), "n_test",
        F.lit(seconds).cast("double").alias("train_seconds"))


def timed_fit(mf: DataFrame, kind: str, **params):
    t0 = time.perf_counter()
    m = fit(mf, kind, **params)
    return m, time.perf_counter() - t0


def gain_importance(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """The tree model's feature importances as a (feature, importance) table."""
    imp = model.stages[-1].featureImportances.toArray()
    return SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str] = FEATURES,
                           repeats: int = 10, seed: int = config.RANDOM_STATE) -> DataFrame:
    """Mean and std of the AUC drop when one feature is shuffled, ``repeats`` times per feature.

    One permutation of the rows per repeat serves all features: row k (in the order of ids) gets its
    donor, the row at place k of a seeded order.  Only (repeat, id, donor) is shuffled for that; the
    donor's row is joined once per repeat.  For boosted trees only the trees that use a feature are
    rescored for it (``trees.shuffled_scores``) and a feature in no tree has importance 0; for other models
    the features fan out after the join.
    """
    base = score(model, test, "p")
    base_auc = E.auc(base.select("label", F.col("p").alias("score"))).select(F.col("auc").alias("base_auc"))
    ids = cut_lineage(test.select("id"))
    one = F.lit(1).alias("_one")
    place = E.prefix_sums(ids.select("id", one), "id", ["_one"]).select("id", F.col("_one_before").alias("pos"))
    key = F.concat_ws("|", F.col("rep").cast("string"), F.col("id").cast("string"), F.lit(str(seed)))
    reps = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    order = reps.select("rep", "id", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("_h"), one)
    donors = E.prefix_sums(order, "_h", ["_one"], partition_cols=["rep"], tie_col="id") \
        .select("rep", F.col("id").alias("donor_id"), F.col("_one_before").alias("pos"))
    donor_row = test.select(F.col("id").alias("donor_id"), *[F.col(f).alias(f"_d_{f}") for f in features])
    wide = place.join(donors, "pos").join(test, "id").join(donor_row, "donor_id")
    if isinstance(model.stages[-1], GBTClassificationModel):
        rescored = trees.shuffled_scores(model, wide, features)
    else:
        rescored = _fanned_scores(model, wide, test.columns, features)
    sc = cut_lineage(rescored.groupBy("feature", "rep", "score").agg(
        F.sum(F.col("label")).alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg")))
    pre = E.prefix_sums(sc, "score", ["n_pos", "n_neg"], partition_cols=["feature", "rep"])
    per_copy = pre.groupBy("feature", "rep").agg(
        (F.sum(F.col("n_pos") * (F.col("n_neg_before") + F.col("n_neg") * 0.5))
         / (F.sum("n_pos") * F.sum("n_neg"))).alias("auc"))
    drops = per_copy.withColumn("drop", base_auc.scalar() - F.col("auc"))
    found = drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
    every = test.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return every.join(found, "feature", "left").na.fill(0.0, ["importance_mean", "importance_std"])


def _fanned_scores(model: PipelineModel, wide: DataFrame, columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(feature, rep, label, score): every row rescored with each of its features taken from its donor."""
    fan = wide.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    shuffled = fan.select(*[c for c in columns if c not in features], "feature", "rep",
                          *[F.when(F.col("feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    return score(model, shuffled, "score").select("feature", "rep", "label", "score")


def linear_attribution(model: PipelineModel, df: DataFrame, top: int = 12,
                       features: Sequence[str] = FEATURES) -> DataFrame:
    """M24 (linear form): per-loan contribution coef_j * (x_j - mean_j) / std_j in log-odds.

    Exact for the logistic model (the standardisation stage holds mean and
    std).  Output: one row per loan and feature in its top ``top`` by
    absolute contribution.
    """
    scaler, lr = model.stages[2], model.stages[3]
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), lr.coefficients.toArray()
    imputed = model.stages[1].transform(model.stages[0].transform(df))
    contrib = F.array(*[F.struct(F.lit(f).alias("feature"),
                                 ((F.col(f"{f}__i") - float(mean[i])) / (float(std[i]) if std[i] else 1.0)
                                  * float(coef[i])).alias("contribution"))
                        for i, f in enumerate(features)])
    return _ranked(imputed.select("id", contrib.alias("c")), top)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """(id, c: array of feature and contribution) to the ``top`` largest in size, with their rank: no shuffle."""
    order = F.transform("c", lambda x: F.struct((-F.abs(x["contribution"])).alias("size"), x["feature"].alias("feature"),
                                                x["contribution"].alias("contribution")))
    best = F.slice(F.array_sort(order), 1, top)
    return rows.select("id", F.posexplode(best).alias("_at", "x")).select(
        "id", "x.feature", "x.contribution", (F.col("_at") + 1).alias("rank"))


def mean_abs_attribution(attr_all: DataFrame) -> DataFrame:
    """M24 global view: mean absolute contribution per feature."""
    return attr_all.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def save(model: PipelineModel, path: str) -> None:
    """Model directory (Spark ML format)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def sampled_shapley(model: PipelineModel, rows: DataFrame, background: DataFrame, samples: int = 8,
                    features: Sequence[str] = FEATURES, seed: int = config.RANDOM_STATE) -> DataFrame:
    """M24 for tree models: permutation-sampling Shapley values in log-odds, per row and feature.

    For every (row, sample m) a random feature order is drawn from seeded
    uniforms and a reference row ``z`` from the background set; for each
    feature j the row is rescored with the features preceding j (and j) taken
    from itself and the rest from z, and again without j.  The Shapley value
    is the mean log-odds difference over the samples.
    All coalitions of all rows are scored by one ``transform``.  Every row
    of the background can be drawn: it is numbered and joined by number,
    before the features fan out.
    """
    feats = list(features)
    numbered = E.prefix_sums(background.select("id", E.split_hash("id", seed + 3).alias("_h"), F.lit(1).alias("_one")),
                             "_h", ["_one"], tie_col="id").select("id", F.col("_one_before").alias("_bg"))
    bg = cut_lineage(background.join(numbered, "id").select("_bg", *[F.col(f).alias(f"_z_{f}") for f in feats]))
    background_size = bg.count()
    if not background_size:
        raise ValueError("the background has no rows")
    fan = rows.select("id", *feats, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("m"))
    # one feature order and one reference row per (row, sample), shared by all features: the
    # differences of one order telescope, so the values of a row sum to f(x) - mean_m f(z_m)
    key = F.concat_ws("|", F.col("id").cast("string"), F.col("m").cast("string"))

    def u(tag):
        return (F.xxhash64(key, F.lit(tag), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
                / float(1 << 52))

    fan = fan.withColumn("_bg", F.pmod(F.xxhash64(key, F.lit("bg"), F.lit(seed)), F.lit(background_size).cast("long")))
    fan = fan.join(bg, "_bg").withColumn("feature", F.explode(F.array(*[F.lit(f) for f in feats])))
    uj = F.coalesce(*[F.when(F.col("feature") == f, u(f)) for f in feats])
    fan = fan.withColumn("_uj", uj)
    plus = {f: F.when((F.col("feature") == f) | (u(f) < F.col("_uj")), F.col(f)).otherwise(F.col(f"_z_{f}"))
            for f in feats}
    minus = {f: F.when((F.col("feature") != f) & (u(f) < F.col("_uj")), F.col(f)).otherwise(F.col(f"_z_{f}"))
             for f in feats}
    both = fan.select("id", "feature", "m", F.lit(1).alias("_side"), *[v.alias(k) for k, v in plus.items()]) \
        .unionByName(fan.select("id", "feature", "m", F.lit(-1).alias("_side"),
                                *[v.alias(k) for k, v in minus.items()]))
    scored = score(model, both, "_p")
    logit = F.log(F.col("_p") / (1 - F.col("_p")))
    return scored.groupBy("id", "feature").agg(
        (F.sum(F.col("_side") * logit) / F.lit(float(samples))).alias("contribution"))


def tree_attribution(model: PipelineModel, rows: DataFrame, background: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """M24 for tree models: (id, c: array of feature and exact contribution to the log-odds)."""
    return trees.exact_shapley(model, rows, background, features)


def top_attributions(attr: DataFrame, top: int = 12) -> DataFrame:
    """Per row the ``top`` features by absolute contribution, from (id, c) or (id, feature, contribution)."""
    if "c" not in attr.columns:
        attr = attr.groupBy("id").agg(F.collect_list(F.struct("feature", "contribution")).alias("c"))
    return _ranked(attr, top)
