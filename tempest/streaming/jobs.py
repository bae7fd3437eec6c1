"""Structured Streaming jobs: scoring of loan requests (Q1) and drift monitoring (Q2).

Q1 is stateless: every request row goes through validation (F3), the request
defaults, the engineered features, a baseline PD and the overlays (broadcast
stream-static joins against the fixed dimensions).  The carbon scenario is a
field of the request, looked up row by row; a request with an unknown one is
rejected like one out of range.  Nothing depends on the batch a row arrives in:
where the batch pipeline imputes with batch medians, the stream uses values
frozen beforehand.

Q2 keeps state: one row per tumbling event-time window and feature with the
counts of all bins, under a watermark.  When the watermark passes the end of a
window its row leaves the state, PSI is computed from it as a column expression
and appended to the output, while the query runs on.  The bin edges and
expected shares come from stored training statistics and are broadcast.  Windows
still open when a bounded input ends are read from the state itself.

Both write to parquet under a folder the caller names (on a cluster: inside
the shared checkpoint folder) with checkpoint locations beside them, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tempest import config
from tempest.functions import columns as C
from tempest.operators import cleaning, drift, overlay, scoring
from tempest.operators import quantiles as Q
from tempest.session import cut_lineage
from tempest.sources import dims

# FIXED VALUES: single-request defaults of the scoring request schema.
REQUEST_DEFAULTS = {
    "emp_length": 3.0, "loan_amnt": 10000.0, "term_months": 36.0,
    "revol_util": 0.0, "revol_bal": 0.0, "open_acc": 5.0, "total_acc": 10.0, "pub_rec": 0.0,
    "delinq_2yrs": 0.0, "inq_last_6mths": 0.0, "acc_open_past_24mths": 0.0, "mort_acc": 0.0,
    "total_bc_limit": 0.0, "total_rev_hi_lim": 0.0, "mo_sin_rcnt_tl": 12.0, "mo_sin_old_rev_tl_op": 180.0,
    "num_actv_rev_tl": 0.0, "percent_bc_gt_75": 0.0, "bc_util": 0.0, "mths_since_recent_inq": 12.0,
}
# FIXED VALUES: encodings the single-request path sets (grade C3, not verified, 96 months of history).
REQUEST_FIXED = {"sub_grade_num": 13.0, "verification_num": 0.0, "credit_history_months": 96.0}
REQUIRED = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment"]

DRIFT_FEATURES = ["dti", "annual_inc", "fico_range_low", "int_rate", "installment", "loan_amnt", "emp_length",
                  "income_to_installment", "loan_to_income", "monthly_payment_burden"]


def with_request_defaults(req: DataFrame) -> DataFrame:
    """Fill absent or missing optional request fields, set the fixed encodings, add engineered features."""
    cols = {}
    for c, d in REQUEST_DEFAULTS.items():
        cols[c] = F.coalesce(F.col(c).cast("double"), C.lit_d(d)) if c in req.columns else C.lit_d(d)
    cols.update({c: C.lit_d(v) for c, v in REQUEST_FIXED.items()})
    return cleaning.add_engineered(req.withColumns(cols))


def with_carbon_price(req: DataFrame, default: str = "orderly") -> DataFrame:
    """J11 by row: ``scenario`` (``default`` where the request names none) and its ``carbon_price``, null for an unknown key.

    A left join with the fixed scenario dimension (broadcast), on a static or a streaming frame.
    """
    dims.validate_scenario(default)
    named = F.coalesce(F.col("scenario"), F.lit(default)) if "scenario" in req.columns else F.lit(default)
    prices = dims.scenario_dim(req.sparkSession).select(F.col("scenario").alias("_key"), F.col("carbon_price").alias("_price"))
    return (req.withColumn("scenario", named).join(F.broadcast(prices), F.col("scenario") == F.col("_key"), "left")
            .drop("_key").withColumnRenamed("_price", "carbon_price"))


def tag_requests(req: DataFrame, scenario: str = "orderly") -> DataFrame:
    """Requests with ``scenario``, ``carbon_price`` and ``reject_reasons``: missing required fields, fields and
    factors out of range, an unknown scenario (F4)."""
    tagged = cleaning.validate(with_carbon_price(req.drop("carbon_price"), scenario), REQUIRED)
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in REQUIRED]),
                       lambda x: x.isNotNull())
    unknown = F.when(F.col("carbon_price").isNull(), F.array(F.lit("scenario unknown"))).otherwise(F.array().cast("array<string>"))
    return tagged.withColumn("reject_reasons", F.concat(missing, F.col("reject_reasons"), unknown))


def split_valid(req: DataFrame, scenario: str = "orderly") -> tuple[DataFrame, DataFrame]:
    """F2 + F3 + F4: required fields present (schema check), range rules and scenario per row.

    Returns (accepted, rejected); rejected rows carry ``reject_reasons``.
    """
    tagged = tag_requests(req, scenario)
    ok = F.size("reject_reasons") == 0
    return tagged.where(ok).drop("reject_reasons"), tagged.where(~ok)


def score_requests(req: DataFrame, scenario: str = "orderly", severity: float = config.SEVERITY_FACTOR,
                   scaling: float = config.TRANSITION_SCALING,
                   baseline: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Q1 row pipeline (works on a static or a streaming frame).

    Each row is scored under its own ``scenario``; ``scenario`` is that of rows that name none, and
    rows with an unknown one have no result (``tag_requests`` rejects them beforehand).
    ``baseline`` adds ``Baseline_PD`` (any column expression or fitted
    model); the default is the closed-form scorecard without imputation
    (required fields are present by validation).  Output rounding: PD and
    CPD 6 decimals, uplift and expected loss 2.
    """
    req = with_carbon_price(req.drop("carbon_price"), scenario)
    df = with_request_defaults(req)
    df = baseline(df) if baseline else scoring.scorecard_pd(df, impute=False)
    # a request may bring its own factors
    own = {c: F.coalesce(F.col(c).cast("double"), C.lit_d(d)) if c in req.columns else d
           for c, d in (("severity_factor", severity), ("transition_scaling", scaling))}
    scored = overlay.score_cpd(df, price=F.col("carbon_price"), severity=own["severity_factor"], scaling=own["transition_scaling"],
                               impute_income=False)
    return scored.where(F.col("carbon_price").isNotNull()).select(
        *[c for c in req.columns if c not in ("scenario", "carbon_price")],
        C.fixed_round_col("Baseline_PD", 6).alias("Baseline_PD"), C.fixed_round_col("CPD", 6).alias("CPD"),
        C.fixed_round_col("PD_Uplift_Pct", 2).alias("PD_Uplift_Pct"), "Risk_Category",
        C.fixed_round_col("Expected_Loss", 2).alias("Expected_Loss"),
        "scenario", "carbon_price", C.lit_d(config.DEFAULT_LGD).alias("lgd_assumption"),
        *[c for c in ("model_version",) if c in scored.columns])


def run_available_now(df: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Append a streaming frame's rows over everything available, then stop (``availableNow`` trigger)."""
    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w.format("parquet").start(out_dir).awaitTermination()


def score_batches(spark: SparkSession, requests: DataFrame, out_dir: str, scenario: str = "orderly", baseline=None,
                  baseline_of=None) -> DataStreamWriter:
    """Q1 as a stream that is not started yet: accepted requests scored to ``out_dir/scored``, rejected ones with
    reasons to ``out_dir/rejected``.

    The source is read once: a batch's tagged rows are written first, and both results come from
    there.  A batch that runs again writes its own folders again.  ``baseline_of`` gives the baseline by batch
    number (``publish.followed``: the model version current at the batch).
    """
    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/tagged/batch={number}")
        tagged = batch.sparkSession.read.schema(batch.schema).parquet(f"{out_dir}/tagged/batch={number}")
        ok = F.size("reject_reasons") == 0
        chosen = baseline_of(number) if baseline_of else baseline
        scored = score_requests(tagged.where(ok).drop("reject_reasons"), scenario, baseline=chosen)
        scored.write.mode("overwrite").parquet(f"{out_dir}/scored/batch={number}")
        tagged.where(~ok).write.mode("overwrite").parquet(f"{out_dir}/rejected/batch={number}")

    return (tag_requests(requests, scenario).writeStream.outputMode("append").option("checkpointLocation", f"{out_dir}/_ck_score")
            .foreachBatch(on_batch))


def stream_score(spark: SparkSession, requests: DataFrame, out_dir: str, scenario: str = "orderly", baseline=None, baseline_of=None) -> None:
    """Q1 over everything available, then stop."""
    score_batches(spark, requests, out_dir, scenario, baseline, baseline_of).trigger(availableNow=True).start().awaitTermination()


def stream_reject(spark: SparkSession, requests: DataFrame, out_dir: str) -> None:
    """F2 + F3 + F4 alone: rejected requests with their reasons to ``out_dir/rejected``; nothing is scored."""
    run_available_now(split_valid(requests)[1], f"{out_dir}/rejected", f"{out_dir}/_ck_rejected")


# ---------------------------------------------------------------------------
# Q2: drift monitor
# ---------------------------------------------------------------------------
def reference_bins(stats: DataFrame, n_bins: int = config.PSI_BINS) -> DataFrame:
    """Edges and expected shares per (feature, bin) from stored statistics (R17 reference sample).

    One row per feature and bin: bounded by features x bins, broadcast to the stream.
    """
    ref = drift.reference_sample(stats)
    probs = [i / n_bins for i in range(n_bins + 1)]
    e = (Q.quantiles(ref, "value", probs, ["feature"])
         .join(ref.groupBy("feature").agg(F.count(F.lit(1)).alias("n_ref")), "feature")
         .select("feature", F.array_sort(F.array_distinct("q")).alias("e"), "n_ref"))
    k = F.size("e")
    edges = e.where(k >= 2).select("feature", "n_ref", F.concat(
        F.array(F.col("e")[0] - C.lit_d(1e-8)), F.slice("e", 2, k - 2),
        F.array(F.element_at("e", -1) + C.lit_d(1e-8))).alias("edges"))
    binned = ref.join(edges, "feature").select("feature", "n_ref",
                                              bin_index(F.col("value"), F.col("edges"), n_bins + 1).alias("bin"))
    counts = binned.where(F.col("bin") >= 0).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = edges.select("feature", "n_ref", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    return all_bins.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", "edges",
        F.when(F.coalesce("n", F.lit(0)) == 0, C.lit_d(1e-4)).otherwise(F.col("n") / F.col("n_ref")).alias("e_share"))


def bin_index(v, edges, max_edges: int = config.PSI_BINS + 1) -> F.Column:
    """Half-open bins with a closed last bin; outside the edges -> -1 (counted in totals only)."""
    last = F.element_at(edges, -1)
    inside = (v >= edges[0]) & (v <= last)
    idx = F.least(drift.edges_at_or_below(edges, v, max_edges) - 1, F.size(edges) - 2)
    return F.when(inside, idx).otherwise(F.lit(-1))


def window_bins(req: DataFrame, ref_bins: DataFrame, features: Sequence[str] = DRIFT_FEATURES, time_col: str = "event_time",
                window: str = "1 day", watermark: str | None = "2 hours", n_bins: int = config.PSI_BINS) -> DataFrame:
    """One row per (window, feature) with ``n_total`` and the count ``n_<k>`` of each bin (stream or batch)."""
    df = with_request_defaults(req)
    long_df = drift.long_form(df, features, [time_col])
    edges = F.broadcast(ref_bins.select("feature", "edges").dropDuplicates(["feature"]))
    b = long_df.join(edges, "feature").select(time_col, "feature", bin_index(F.col("value"), F.col("edges"), n_bins + 1).alias("bin"))
    if watermark:
        b = b.withWatermark(time_col, watermark)
    return b.groupBy(F.window(time_col, window).alias("w"), "feature").agg(
        F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col("bin") == k).alias(f"n_{k}") for k in range(n_bins)])


def window_psi(bins: DataFrame, ref_bins: DataFrame, n_bins: int = config.PSI_BINS) -> DataFrame:
    """PSI of each (window, feature) row of bin counts: a column expression; empty bins take share 1e-4."""
    # an array of at most n_bins shares per feature: broadcast
    shares = ref_bins.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "e_share"))).alias("e"))
    j = bins.join(F.broadcast(shares.select(F.col("feature").alias("_f"), F.transform("e", lambda x: x["e_share"]).alias("e"))),
                  F.col("feature") == F.col("_f"))
    psi = C.lit_d(0.0)
    for k in range(n_bins):
        a = F.when(F.col(f"n_{k}") == 0, C.lit_d(1e-4)).otherwise(F.col(f"n_{k}") / F.col("n_total"))
        e = F.try_element_at("e", F.lit(k + 1))
        psi = psi + F.coalesce((a - e) * F.log(a / e), C.lit_d(0.0))  # past the feature's last bin: nothing
    out = j.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "n_total", psi.alias("_psi"))
    return out.select("window_start", "window_end", "feature", "n_total", F.round("_psi", 5).alias("psi"), drift.drift_status(F.col("_psi")).alias("status"))


def drift_query(spark: SparkSession, requests: DataFrame, ref_bins: DataFrame, out_dir: str, features: Sequence[str] = DRIFT_FEATURES,
                window: str = "1 day", watermark: str = "2 hours", **trigger) -> StreamingQuery:
    """Q2 as a running query: a window's PSI is appended to ``out_dir/psi`` once the watermark has passed its end.

    ``trigger`` as in ``DataStreamWriter.trigger``.  State: one row per open window and feature.
    """
    psi = window_psi(window_bins(requests, ref_bins, features, window=window, watermark=watermark), ref_bins)
    w = psi.writeStream.outputMode("append").option("checkpointLocation", f"{out_dir}/_ck_drift").format("parquet")
    return (w.trigger(**trigger) if trigger else w).start(f"{out_dir}/psi")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had closed, as the query's last progress reports count them.

    Spark counts them behind the partial aggregate: rows of one task, window and feature are one.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def open_windows(spark: SparkSession, ref_bins: DataFrame, out_dir: str, n_bins: int = config.PSI_BINS) -> DataFrame:
    """PSI so far of the windows that the drift query's last finished batch left open, from its state."""
    state = spark.read.format("statestore").load(f"{out_dir}/_ck_drift")
    names = ["n_total"] + [f"n_{k}" for k in range(n_bins)]
    counts = F.col("value").cast("struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    bins = state.select(F.col("key").cast("struct<w: struct<start: timestamp, end: timestamp>, feature: string>").alias("k"), counts.alias("v"))
    return window_psi(bins.select("k.*", "v.*"), ref_bins, n_bins)


def stream_drift(spark: SparkSession, requests: DataFrame, stats: DataFrame, out_dir: str,
                 features: Sequence[str] = DRIFT_FEATURES, window: str = "1 day", watermark: str = "2 hours") -> None:
    """Q2 over a bounded input: closed windows are in ``out_dir/psi``, those still open at its end in ``out_dir/open``.

    A job that goes on with more input appends to the first and writes the second anew.
    """
    ref_bins = cut_lineage(reference_bins(stats.where(F.col("feature").isin(*features))))
    drift_query(spark, requests, ref_bins, out_dir, features, window, watermark, availableNow=True).awaitTermination()
    open_windows(spark, ref_bins, out_dir).write.mode("overwrite").parquet(f"{out_dir}/open")


def read_drift(spark: SparkSession, out_dir: str) -> DataFrame:
    """All windows of a bounded run, with ``closed``."""
    closed = spark.read.parquet(f"{out_dir}/psi").withColumn("closed", F.lit(True))
    return closed.unionByName(spark.read.parquet(f"{out_dir}/open").withColumn("closed", F.lit(False)))
