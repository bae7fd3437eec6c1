"""Step 6 of the build plan: drift (PSI), feature statistics, profiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempest import config
from tempest.functions import columns as C
from tempest.operators import drift as D
from tempest.operators import overlay
from tempest.operators import portfolio as P
from tempest.plans import base
from tempest.plans.catalog import finish, r, register
from tempest.plans.sqlbase import strip_sql, with_base
from tempest.session import materialise, run_folder
from tempest.sources.loans import fixture_loans

SPLIT_DATE = "1998-06-30"
PSI_FEATURES = ["dti", "int_rate", "fico_range_low", "annual_inc", "loan_amnt", "installment"]
CORR_COLS = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment", "emp_length",
             "revol_util", "open_acc", "total_acc", "loan_amnt"]


def _train(spark, sf_dir):
    return base.clean(spark, sf_dir).where(F.col("issue_d") < F.lit(SPLIT_DATE).cast("date"))


def _new(spark, sf_dir):
    return base.clean(spark, sf_dir).where(F.col("issue_d") >= F.lit(SPLIT_DATE).cast("date"))


def long_sql(table: str, cols, where: str) -> str:
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f"(SELECT feature, value FROM (UNPIVOT (SELECT {sel} FROM {table} WHERE {where}) "
            f"ON {', '.join(cols)} INTO NAME feature VALUE value) WHERE value IS NOT NULL AND NOT isnan(value))")


TRAIN_W = f"issue_d < DATE '{SPLIT_DATE}'"
NEW_W = f"issue_d >= DATE '{SPLIT_DATE}'"


def psi_sql(exp: str, act: str, out: str = "psi_out") -> str:
    probs = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"
    return f"""e0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {probs}))) AS e,
                count(*) AS n_expected FROM {exp} GROUP BY feature),
edg AS (SELECT feature, n_expected,
          CASE WHEN len(e) >= 2 THEN [e[1] - 1e-8] || e[2:len(e) - 1] || [e[len(e)] + 1e-8] END AS edges FROM e0),
bexp AS (SELECT x.feature, least(len(list_filter(g.edges, lambda t: t <= x.value)) - 1, len(g.edges) - 2) AS bin
         FROM {exp} x JOIN edg g USING (feature)
         WHERE g.edges IS NOT NULL AND x.value >= g.edges[1] AND x.value <= g.edges[len(g.edges)]),
bact AS (SELECT x.feature, least(len(list_filter(g.edges, lambda t: t <= x.value)) - 1, len(g.edges) - 2) AS bin
         FROM {act} x JOIN edg g USING (feature)
         WHERE g.edges IS NOT NULL AND x.value >= g.edges[1] AND x.value <= g.edges[len(g.edges)]),
cexp AS (SELECT feature, bin, count(*) AS n_exp FROM bexp GROUP BY ALL),
cact AS (SELECT feature, bin, count(*) AS n_act FROM bact GROUP BY ALL),
nact AS (SELECT feature, count(*) AS n_actual FROM {act} GROUP BY feature),
allb AS (SELECT feature, n_expected, unnest(range(0, len(edges) - 1)) AS bin FROM edg WHERE len(edges) >= 2),
pct AS (SELECT a.feature,
          CASE WHEN coalesce(ce.n_exp, 0) = 0 THEN 1e-4 ELSE ce.n_exp / a.n_expected END AS ep,
          CASE WHEN coalesce(ca.n_act, 0) = 0 THEN 1e-4 ELSE ca.n_act / greatest(coalesce(na.n_actual, 0), 1) END AS ap
        FROM allb a LEFT JOIN cexp ce ON a.feature = ce.feature AND a.bin = ce.bin
        LEFT JOIN cact ca ON a.feature = ca.feature AND a.bin = ca.bin
        LEFT JOIN nact na ON a.feature = na.feature),
{out} AS (SELECT feature, sum((ap - ep) * ln(ap / ep)) AS psi FROM pct GROUP BY feature
          UNION ALL SELECT feature, 0.0 FROM edg WHERE edges IS NULL)"""


@register("psi_two_samples", lambda: with_base(f"""WITH {psi_sql(long_sql('clean', PSI_FEATURES, TRAIN_W),
                                                              long_sql('clean', PSI_FEATURES, NEW_W))}
SELECT feature, {r('psi')} AS psi FROM psi_out"""), "R16 O2")
def psi_two_samples(spark, sf_dir):
    exp = D.long_form(_train(spark, sf_dir), PSI_FEATURES)
    act = D.long_form(_new(spark, sf_dir), PSI_FEATURES)
    return finish(D.psi(exp, act))


def stats_sql(where: str = TRAIN_W) -> str:
    return f"""stats AS (SELECT feature, CAST(count(value) AS DOUBLE) AS count, avg(value) AS mean,
  stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.10) AS p10,
  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.50) AS p50, quantile_cont(value, 0.75) AS p75,
  quantile_cont(value, 0.90) AS p90, max(value) AS max
FROM {long_sql('clean', config.ALL_FEATURES, where)} GROUP BY feature)"""


@register("feature_stats", lambda: with_base(f"""WITH {stats_sql()}
SELECT feature, count, {r('mean')} AS mean, {r('std')} AS std, {r('min')} AS min, {r('p10')} AS p10,
  {r('p25')} AS p25, {r('p50')} AS p50, {r('p75')} AS p75, {r('p90')} AS p90, {r('max')} AS max
FROM stats"""), "A12 A13 O4 S11")
def feature_stats(spark, sf_dir):
    return finish(D.feature_stats(D.long_form(_train(spark, sf_dir), config.ALL_FEATURES)))


def _drift_sql() -> str:
    weights = ", ".join(f"('{k}', {n})" for k, n in config.PSI_REFERENCE_REPEATS)
    ref = f"""ref AS (SELECT s.feature, CASE w.stat WHEN 'min' THEN s.min WHEN 'p10' THEN s.p10 WHEN 'p25' THEN s.p25
                 WHEN 'p50' THEN s.p50 WHEN 'p75' THEN s.p75 WHEN 'p90' THEN s.p90 ELSE s.max END AS value
              FROM stats s, (VALUES {weights}) w(stat, n), range(0, 100) rr(i) WHERE rr.i < w.n),
act AS {long_sql('clean', config.ALL_FEATURES, NEW_W)}"""
    return f"""WITH {stats_sql()}, {ref}, {psi_sql('ref', 'act')},
drift AS (SELECT p.feature, round(p.psi, 5) AS psi,
            CASE WHEN p.psi >= 0.25 THEN 'DRIFT' WHEN p.psi >= 0.10 THEN 'MODERATE' ELSE 'OK' END AS status
          FROM psi_out p WHERE p.feature IN (SELECT feature FROM act))"""


def _stored_stats(spark, sf_dir):
    """The training statistics as the drift job gets them: a small stored table."""
    stats = D.feature_stats(D.long_form(_train(spark, sf_dir), config.ALL_FEATURES))
    return materialise(stats, run_folder(spark, "drift"), "stats")


@register("feature_drift", lambda: with_base(_drift_sql() + "\nSELECT * FROM drift ORDER BY psi DESC"),
          "R17 J15 R16")
def feature_drift(spark, sf_dir):
    stats = _stored_stats(spark, sf_dir)
    return D.feature_drift(_new(spark, sf_dir), stats).orderBy(F.col("psi").desc())


@register("drift_status", lambda: with_base(_drift_sql() + """
SELECT status, count(*) AS n_features FROM drift GROUP BY status"""), "R18")
def drift_status(spark, sf_dir):
    stats = _stored_stats(spark, sf_dir)
    return D.drift_summary(D.feature_drift(_new(spark, sf_dir), stats))


@register("missing_profile", lambda: with_base(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count, "
        f"{r(f'count_if({c} IS NULL) / count(*) * 100.0')} AS missing_pct FROM raw"
        for c in ["loan_id"] + config.RAW_COLS + ["issue_d"]) + ") WHERE missing_count > 0"), "A15 F7")
def missing_profile(spark, sf_dir):
    return finish(D.missing_profile(fixture_loans(spark, sf_dir)))


@register("correlations", lambda: with_base(
    "SELECT * FROM (" + " UNION ALL ".join(
        [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM clean"
         for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
        + [f"SELECT '{a}', 'default', {r(f'corr(CAST({a} AS DOUBLE), CAST(\"default\" AS DOUBLE))')} FROM clean"
           for a in CORR_COLS]) + ")"), "A18")
def correlations(spark, sf_dir):
    return finish(D.correlations(base.clean(spark, sf_dir), CORR_COLS, target="default"))


@register("top_correlations", lambda: with_base(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, {r(f'corr(CAST({a} AS DOUBLE), CAST(\"default\" AS DOUBLE))')} AS corr FROM clean" for a in CORR_COLS)
    + ") ORDER BY abs(corr) DESC, feature LIMIT 10"), "A18 T5")
def top_correlations(spark, sf_dir):
    """The features most correlated with the target, by absolute value."""
    c = finish(D.correlations(base.clean(spark, sf_dir), CORR_COLS, target="default"))
    c = c.where(F.col("col_b") == "default").select(F.col("col_a").alias("feature"), "corr")
    return P.top_by_abs(c, "corr", 10, "feature")


@register("default_rate_by_group", lambda: with_base(f"""
WITH g AS (SELECT *, CASE WHEN fico_range_low > 300 AND fico_range_low <= 580 THEN 'Poor'
   WHEN fico_range_low > 580 AND fico_range_low <= 670 THEN 'Fair' WHEN fico_range_low > 670 AND fico_range_low <= 740 THEN 'Good'
   WHEN fico_range_low > 740 AND fico_range_low <= 850 THEN 'Excellent' END AS fico_group FROM clean)
SELECT group_value, n, default_rate, dimension FROM (
  SELECT CAST(home_ownership AS VARCHAR) AS group_value, count(*) AS n, {r('avg(CAST("default" AS DOUBLE))')} AS default_rate,
         'home_ownership' AS dimension FROM g WHERE home_ownership IS NOT NULL GROUP BY 1
  UNION ALL SELECT purpose, count(*), {r('avg(CAST("default" AS DOUBLE))')}, 'purpose' FROM g WHERE purpose IS NOT NULL GROUP BY 1
  UNION ALL SELECT fico_group, count(*), {r('avg(CAST("default" AS DOUBLE))')}, 'fico_group' FROM g WHERE fico_group IS NOT NULL GROUP BY 1)"""),
          "A16 P10 A20")
def default_rate_by_group(spark, sf_dir):
    df = base.clean(spark, sf_dir)
    fico = F.col("fico_range_low")
    e = config.FICO_BINS
    g = None
    for i, lab in enumerate(config.FICO_GROUP_LABELS):
        cond = (fico > e[i]) & (fico <= e[i + 1])
        g = F.when(cond, F.lit(lab)) if g is None else g.when(cond, F.lit(lab))
    return finish(D.group_rates(df.withColumn("fico_group", g), ["home_ownership", "purpose", "fico_group"]))


@register("default_rate_by_state", lambda: with_base(f"""
SELECT addr_state, count(*) AS n, {r('avg(CAST("default" AS DOUBLE))')} AS default_rate
FROM clean WHERE addr_state IS NOT NULL GROUP BY addr_state"""), "A17")
def default_rate_by_state(spark, sf_dir):
    df = base.clean(spark, sf_dir).where(F.col("addr_state").isNotNull())
    return finish(df.groupBy("addr_state").agg(F.count(F.lit(1)).alias("n"),
                                               F.avg(F.col("default").cast("double")).alias("default_rate")))


@register("boxplot_stats", lambda: with_base(f"""
SELECT "default", {r('min(int_rate)')} AS min, {r('quantile_cont(int_rate, 0.25)')} AS q1,
  {r('quantile_cont(int_rate, 0.5)')} AS median, {r('quantile_cont(int_rate, 0.75)')} AS q3, {r('max(int_rate)')} AS max
FROM clean WHERE int_rate IS NOT NULL GROUP BY "default" """), "A19")
def boxplot_stats(spark, sf_dir):
    return finish(D.five_numbers(base.clean(spark, sf_dir), "int_rate", "default"))


@register("target_counts", lambda: with_base(f"""
SELECT "default", count(*) AS n, {r('count(*) / (SELECT count(*) FROM clean) * 100.0')} AS share_pct
FROM clean GROUP BY "default" """), "A20")
def target_counts(spark, sf_dir):
    df = base.clean(spark, sf_dir)
    total = df.select(F.count(F.lit(1))).scalar()
    return finish(df.groupBy("default").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("share_pct", F.col("n") / total * 100.0))


@register("uplift_by_state", lambda: with_base(f"""
WITH u AS (SELECT {strip_sql('addr_state')} AS state,
             least(greatest(Baseline_PD * (1 + hazard * 0.3), 0), 1) - Baseline_PD AS uplift FROM lookup),
s AS (SELECT state, avg(uplift) AS mean_uplift FROM u WHERE state IS NOT NULL GROUP BY state)
SELECT state, {r('mean_uplift')} AS mean_uplift,
  {r('(SELECT avg(uplift) FROM u)')} AS overall_mean, {r('(SELECT stddev_pop(uplift) FROM u)')} AS overall_std,
  {r('(SELECT max(uplift) FROM u)')} AS overall_max
FROM s"""), "A21")
def uplift_by_state(spark, sf_dir):
    df = overlay.with_static_hazard(base.with_pd(spark, sf_dir))
    u = df.select(C.strip_key("addr_state").alias("state"),
                  (overlay.physical_pd("Baseline_PD", "hazard") - F.col("Baseline_PD")).alias("uplift"))
    # one pass: the overall figures follow from the states' sums (a row per state, in one small window)
    per = u.groupBy("state").agg(F.avg("uplift").alias("mean_uplift"), F.count("uplift").alias("n"), F.sum("uplift").alias("s"),
                                 F.sum(F.col("uplift") * F.col("uplift")).alias("ss"), F.max("uplift").alias("x"))
    over = Window.partitionBy()
    mean = F.sum("s").over(over) / F.sum("n").over(over)
    spread = F.sqrt(F.greatest(F.sum("ss").over(over) / F.sum("n").over(over) - mean * mean, F.lit(0.0)))
    out = per.select("state", "mean_uplift", mean.alias("overall_mean"), spread.alias("overall_std"), F.max("x").over(over).alias("overall_max"))
    return finish(out.where(F.col("state").isNotNull()))


@register("outlier_clip", lambda: with_base(f"""
SELECT loan_id, {r('CASE WHEN annual_inc IS NULL THEN NULL ELSE least(annual_inc, (SELECT quantile_cont(annual_inc, 0.99) FROM clean)) END', 2)} AS annual_inc_clipped
FROM clean"""), "P38 P16")
def outlier_clip(spark, sf_dir):
    df = D.clip_at_percentile(base.clean(spark, sf_dir), "annual_inc", 0.99, "annual_inc_clipped")
    return finish(df.select("loan_id", "annual_inc_clipped"), money=("annual_inc_clipped",))
