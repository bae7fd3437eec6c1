"""Step 8 of the build plan: evaluation of a given score.

Input is the scored-label table (id, label, p_a, p_b) derived from the loans.
The oracle SQL states each metric in its textbook form (mid-ranks from
``rank()``, curves from running window sums), independently of the
distributed prefix sums the Spark side uses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tempest.operators import evaluate as E
from tempest.operators import isotonic
from tempest.plans import base
from tempest.plans.catalog import finish, fixed_round, r, register
from tempest.plans.sqlbase import with_labels


def _labels(spark, sf_dir, score="p_a"):
    return base.scored_labels(spark, sf_dir).select("id", "label", F.col(score).alias("score"))


def _midrank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pp = f"{part}, " if part else ""
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER (PARTITION BY {pp}{col}) - 1) / 2.0)"


def _auc_sql(col: str) -> str:
    return f"""(SELECT (sum(CASE WHEN label = 1 THEN mr END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2.0)
        / (CAST(sum(label) AS DOUBLE) * CAST(count(*) - sum(label) AS DOUBLE)) AS auc,
        CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg
      FROM (SELECT label, {_midrank_sql(col)} AS mr FROM labels))"""


@register("auc", lambda: with_labels(f"SELECT {r('auc')} AS auc, n_pos, n_neg FROM {_auc_sql('p_a')}"),
          "M11 W4")
def auc_q(spark, sf_dir):
    """ROC AUC of the scorecard PD against the default flag (rank-sum, ties one half)."""
    return finish(E.auc(_labels(spark, sf_dir)))


@register("auc_ranking", lambda: with_labels(f"""
WITH a AS (SELECT 'p_a' AS model, auc FROM {_auc_sql('p_a')}
           UNION ALL SELECT 'p_b' AS model, auc FROM {_auc_sql('p_b')})
SELECT model, {r('auc')} AS auc,
  CAST(trunc(rank() OVER (ORDER BY auc DESC) + (count(*) OVER (PARTITION BY auc) - 1) / 2.0) AS INTEGER) AS auc_rank
FROM a"""), "W1 M11 O1")
def auc_ranking(spark, sf_dir):
    """Models ranked by AUC, descending, ties sharing the average rank truncated to int."""
    lab = base.scored_labels(spark, sf_dir)
    parts = [E.auc(lab.select("label", F.col(s).alias("score"))).select(F.lit(s).alias("model"), "auc")
             for s in ("p_a", "p_b")]
    table = parts[0].unionByName(parts[1])
    return finish(table.select("model", "auc", E.average_rank_desc(table, "auc").alias("auc_rank")))


@register("midrank", lambda: with_labels(f"SELECT id, p_a, {r(_midrank_sql('p_a'))} AS midrank FROM labels"),
          "W2")
def midrank_q(spark, sf_dir):
    """Mid-rank of every loan's score (ties share the average rank)."""
    return finish(E.midrank(base.scored_labels(spark, sf_dir), "p_a", ["id"]))


@register("brier", lambda: with_labels(f"SELECT {r('avg(pow(p_a - label, 2))')} AS brier FROM labels"), "M12")
def brier_q(spark, sf_dir):
    return finish(E.brier(_labels(spark, sf_dir)))


_CURVE_SQL = """
WITH sc AS (SELECT p_a AS threshold, sum(label) AS np, count(*) - sum(label) AS nn FROM labels GROUP BY p_a),
tot AS (SELECT CAST(sum(np) AS DOUBLE) AS P, CAST(sum(nn) AS DOUBLE) AS N FROM sc),
cur AS (SELECT threshold, sum(np) OVER (ORDER BY threshold DESC) AS tp, sum(nn) OVER (ORDER BY threshold DESC) AS fp,
          P, N FROM sc, tot)"""


@register("roc_points", lambda: with_labels(_CURVE_SQL + f"""
SELECT threshold, {r('fp / N')} AS fpr, {r('tp / P')} AS tpr FROM cur"""), "M13 W4")
def roc_points_q(spark, sf_dir):
    return finish(E.roc_points(_labels(spark, sf_dir)))


_PR_SQL = _CURVE_SQL + """,
pr AS (SELECT threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, tp / P AS recall FROM cur)"""


@register("pr_points", lambda: with_labels(_PR_SQL + f"""
SELECT threshold, {r('precision')} AS precision, {r('recall')} AS recall FROM pr"""), "M14 W4")
def pr_points_q(spark, sf_dir):
    return finish(E.pr_points(_labels(spark, sf_dir)))


_COST_SQL = _PR_SQL + """,
best AS (SELECT threshold, 5.0 * (1 - recall) + 1.0 * (1 - precision) AS cost FROM pr
         ORDER BY cost, threshold LIMIT 1)"""


@register("cost_threshold", lambda: with_labels(_COST_SQL + f"""
SELECT threshold, {r('cost')} AS cost FROM best"""), "M15")
def cost_threshold_q(spark, sf_dir):
    """Threshold minimising 5*(1-recall) + 1*(1-precision) over the PR points."""
    return finish(E.cost_threshold(E.pr_points(_labels(spark, sf_dir))))


@register("f1_threshold", lambda: with_labels(_PR_SQL + f"""
SELECT threshold, {r('f1')} AS f1 FROM (
  SELECT threshold, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM pr
  ORDER BY f1 DESC, threshold LIMIT 1)"""), "M16")
def f1_threshold_q(spark, sf_dir):
    return finish(E.f1_threshold(E.pr_points(_labels(spark, sf_dir))))


_CONF_SQL = _COST_SQL + """,
conf AS (SELECT l.label, p.prediction, CAST(count(x.label) AS BIGINT) AS n
  FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
  LEFT JOIN (SELECT label, CAST(p_a >= (SELECT threshold FROM best) AS INTEGER) AS prediction FROM labels) x
    ON x.label = l.label AND x.prediction = p.prediction
  GROUP BY l.label, p.prediction)"""


def _cost_optimal(lab):
    return E.cost_threshold(E.pr_points(lab)).select("threshold").scalar()


@register("confusion", lambda: with_labels(_CONF_SQL + "\nSELECT label, prediction, n FROM conf"), "M17 F9")
def confusion_q(spark, sf_dir):
    """Confusion counts at the cost-optimal threshold."""
    lab = _labels(spark, sf_dir)
    return E.confusion(lab, _cost_optimal(lab))


@register("class_report", lambda: with_labels(_CONF_SQL + f""",
c AS (SELECT sum(CASE WHEN label = 0 AND prediction = 0 THEN n END) AS n00,
             sum(CASE WHEN label = 0 AND prediction = 1 THEN n END) AS n01,
             sum(CASE WHEN label = 1 AND prediction = 0 THEN n END) AS n10,
             sum(CASE WHEN label = 1 AND prediction = 1 THEN n END) AS n11 FROM conf),
k AS (
  SELECT '0' AS class, CASE WHEN n00 + n10 = 0 THEN 0.0 ELSE CAST(n00 AS DOUBLE) / (n00 + n10) END AS precision,
         CASE WHEN n00 + n01 = 0 THEN 0.0 ELSE CAST(n00 AS DOUBLE) / (n00 + n01) END AS recall,
         CAST(n00 + n01 AS DOUBLE) AS support FROM c
  UNION ALL
  SELECT '1', CASE WHEN n11 + n01 = 0 THEN 0.0 ELSE CAST(n11 AS DOUBLE) / (n11 + n01) END,
         CASE WHEN n11 + n10 = 0 THEN 0.0 ELSE CAST(n11 AS DOUBLE) / (n11 + n10) END,
         CAST(n11 + n10 AS DOUBLE) FROM c),
kf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
       FROM k),
tt AS (SELECT CAST(n00 + n01 + n10 + n11 AS DOUBLE) AS total, CAST(n00 + n11 AS DOUBLE) AS ok FROM c),
allrows AS (
  SELECT class, precision, recall, f1, support FROM kf
  UNION ALL SELECT 'accuracy', NULL, NULL, ok / total, total FROM tt
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(total) FROM kf, tt
  UNION ALL SELECT 'weighted avg', sum(precision * support) / max(total), sum(recall * support) / max(total),
                   sum(f1 * support) / max(total), max(total) FROM kf, tt)
SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, {r('support')} AS support
FROM allrows"""), "M18")
def class_report_q(spark, sf_dir):
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    lab = _labels(spark, sf_dir)
    return finish(E.class_report(E.confusion(lab, _cost_optimal(lab))))


def _reliability_sql() -> str:
    probs = ", ".join(repr(q) for q in [(q * 100.0) / 100.0 for q in E.linspace(0.0, 1.0, 16)])
    return with_labels(f"""
WITH e AS (SELECT quantile_cont(p_a, [{probs}]) AS e FROM labels),
b AS (SELECT CAST(len(list_filter(e[2:15], lambda x: x < p_a)) AS INTEGER) AS bin, label, p_a FROM labels, e)
SELECT bin, count(*) AS n, {r('avg(p_a)')} AS mean_pred, {r('avg(label)')} AS frac_pos FROM b GROUP BY bin""")


@register("reliability", _reliability_sql, "M19")
def reliability_q(spark, sf_dir):
    """15 quantile bins: count, mean prediction, share of defaults."""
    return finish(E.reliability(_labels(spark, sf_dir)))


def _ece_sql() -> str:
    edges = E.linspace(0.0, 1.0, 11)
    cases = " ".join(f"WHEN p_a >= {edges[i]!r} AND p_a < {edges[i + 1]!r} THEN {i}" for i in range(10))
    return with_labels(f"""
WITH b AS (SELECT CASE {cases} END AS bin, label, p_a FROM labels),
t AS (SELECT count(*) AS total FROM b),
g AS (SELECT bin, count(*) AS n, avg(label) AS fy, avg(p_a) AS fp FROM b WHERE bin IS NOT NULL GROUP BY bin)
SELECT {r('sum(n / total * abs(fy - fp))')} AS ece FROM g, t""")


@register("ece", _ece_sql, "M20")
def ece_q(spark, sf_dir):
    return finish(E.ece(_labels(spark, sf_dir)))


def _delong_ctes() -> str:
    return f"""
WITH cnt AS (SELECT CAST(sum(label) AS DOUBLE) AS m, CAST(count(*) - sum(label) AS DOUBLE) AS n FROM labels),
rk AS (SELECT label,
         {_midrank_sql('p_a')} AS tz_a, {_midrank_sql('p_a', 'label')} AS tc_a,
         {_midrank_sql('p_b')} AS tz_b, {_midrank_sql('p_b', 'label')} AS tc_b FROM labels),
v AS (SELECT label,
        CASE WHEN label = 1 THEN (tz_a - tc_a) / n ELSE 1.0 - (tz_a - tc_a) / m END AS va,
        CASE WHEN label = 1 THEN (tz_b - tc_b) / n ELSE 1.0 - (tz_b - tc_b) / m END AS vb FROM rk, cnt),
st AS (SELECT label, count(*) AS k, avg(va) AS ma, avg(vb) AS mb, var_samp(va) AS saa, var_samp(vb) AS sbb,
         covar_samp(va, vb) AS sab FROM v GROUP BY label),
o AS (SELECT p.ma AS auc_a, p.mb AS auc_b, p.saa / p.k + q.saa / q.k AS var_a, p.sbb / p.k + q.sbb / q.k AS var_b,
        p.sab / p.k + q.sab / q.k AS cov_ab
      FROM st p, st q WHERE p.label = 1 AND q.label = 0)"""


def _delong_sql() -> str:
    return with_labels(f"""{_delong_ctes()}
SELECT {r('auc_a')} AS auc_a, {r('auc_b')} AS auc_b, {r('var_a', 9)} AS var_a, {r('var_b', 9)} AS var_b,
  {r('cov_ab', 9)} AS cov_ab, {r('abs(auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov_ab)')} AS z,
  {r(f'auc_a - {E.Z_975!r} * sqrt(var_a)')} AS ci_a_low, {r(f'auc_a + {E.Z_975!r} * sqrt(var_a)')} AS ci_a_high,
  {r(f'auc_b - {E.Z_975!r} * sqrt(var_b)')} AS ci_b_low, {r(f'auc_b + {E.Z_975!r} * sqrt(var_b)')} AS ci_b_high
FROM o""")


def _delong_frame(spark, sf_dir):
    return E.delong(base.scored_labels(spark, sf_dir), "p_a", "p_b")


@register("delong", _delong_sql, "M21 W2")
def delong_q(spark, sf_dir):
    """DeLong comparison of the two scores: AUCs, (co)variances, z and 95 % intervals."""
    d = _delong_frame(spark, sf_dir)
    small = ("var_a", "var_b", "cov_ab")  # variances are small: 9 decimals for them
    return d.select(*[fixed_round(F.col(c), 9 if c in small else 6).alias(c) for c in d.columns])


def _delong_pvalue_sql() -> str:
    t = "(1.0 / (1.0 + 0.5 * x))"
    poly = "0.17087277"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196",
              "1.00002368", "-1.26551223"):
        poly = f"({c} + {t} * {poly})"
    return with_labels(f"""{_delong_ctes()},
z AS (SELECT *, abs(auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov_ab) AS z FROM o),
x AS (SELECT *, z / sqrt(2.0) AS x FROM z)
SELECT {r('auc_a')} AS auc_a, {r('auc_b')} AS auc_b, {r('z')} AS z, {r(f'{t} * exp(-x * x + {poly})')} AS p_value FROM x""")


@register("delong_pvalue", _delong_pvalue_sql, "M21")
def delong_pvalue(spark, sf_dir):
    """Two-sided p-value of the AUC difference."""
    d = _delong_frame(spark, sf_dir)
    return finish(d.select("auc_a", "auc_b", "z", E.two_sided_p(F.col("z")).alias("p_value")))


def _rate_threshold_sql() -> str:
    return with_labels(f"""
WITH rt AS (SELECT avg(label) AS rate, count(*) AS n FROM labels),
q AS (SELECT rate, n, (100.0 * (1.0 - rate)) / 100.0 * (n - 1) AS pos FROM rt),
o AS (SELECT p_a, row_number() OVER (ORDER BY p_a) - 1 AS i FROM labels)
SELECT {r('max(rate)')} AS default_rate,
  {r('max(CASE WHEN i = floor(pos) THEN p_a END) + (max(pos) - floor(max(pos))) * '
     '(max(CASE WHEN i = ceil(pos) THEN p_a END) - max(CASE WHEN i = floor(pos) THEN p_a END))')} AS threshold
FROM o, q""")


@register("rate_threshold", _rate_threshold_sql, "M26")
def rate_threshold_q(spark, sf_dir):
    """Threshold matched to the default rate: percentile 100*(1-rate) of the scores."""
    return finish(E.rate_threshold(_labels(spark, sf_dir)))


@register("stratified_split", lambda: with_labels("""
WITH h AS (SELECT id, label, ('0x' || substr(md5(CAST(id AS VARCHAR) || '42'), 1, 15))::BIGINT AS h FROM labels),
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY h, id) - 1 AS rn,
        count(*) OVER (PARTITION BY label) AS n FROM h),
c AS (SELECT *, ceil(n * 0.2) AS n_test FROM k)
SELECT id, label, CASE WHEN rn < n_test THEN 'test' WHEN rn < n_test + ceil((n - n_test) * 0.25) THEN 'calib'
  ELSE 'train' END AS split FROM c"""), "M1")
def stratified_split_q(spark, sf_dir):
    """Stratified 60/20/20 train / calib / test assignment of every loan."""
    return E.stratified_split(base.scored_labels(spark, sf_dir).select("id", "label")).select("id", "label", "split")


@register("class_weights", lambda: with_labels(f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg,
  {r('avg(label)')} AS default_rate, {r('CAST(count(*) - sum(label) AS DOUBLE) / sum(label)')} AS scale_pos_weight,
  {r('CAST(count(*) AS DOUBLE) / (2 * (count(*) - sum(label)))')} AS weight_neg,
  {r('CAST(count(*) AS DOUBLE) / (2 * sum(label))')} AS weight_pos
FROM labels"""), "M2 A11")
def class_weights_q(spark, sf_dir):
    return finish(E.class_weights(base.scored_labels(spark, sf_dir)))


@register("isotonic_calibration", lambda: with_labels(f"""WITH d AS (SELECT p_a AS score, sum(label) AS pos, count(*) AS n FROM labels WHERE p_a IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(pos) OVER (ORDER BY score) AS cp, sum(n) OVER (ORDER BY score) AS cn FROM d),
m AS (SELECT a.i AS i, b.i AS k, CAST(b.cp - a.cp + a.pos AS DOUBLE) / (b.cn - a.cn + a.n) AS mean FROM o a JOIN o b ON a.i <= b.i),
inner_min AS (SELECT i, k, min(mean) OVER (PARTITION BY i ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM m),
v AS (SELECT k AS i, max(least) AS value FROM inner_min WHERE i <= k GROUP BY k)
SELECT {r('min(score)')} AS lo, {r('max(score)')} AS hi, CAST(sum(n) AS BIGINT) AS n, {r('value')} AS value
FROM o JOIN v ON o.i = v.i GROUP BY value"""), "M9")
def isotonic_calibration(spark, sf_dir):
    """Steps of the isotonic regression of the default flag on the scorecard PD; in SQL by the max-min formula."""
    return finish(isotonic.pools(base.scored_labels(spark, sf_dir), "label", "p_a"))
