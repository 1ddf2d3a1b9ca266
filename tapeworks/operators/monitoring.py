"""Drift, delayed labels, rolling IC, alerts and the retraining verdict.

Long tables: ``feature, value`` next to the grouping keys. All statistics are
map-side combined counts or exact percentiles from ``ordering``; a feature that
fills a whole table is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.signals import fixed
from tapeworks.operators import asof as J
from tapeworks.operators import books as B
from tapeworks.operators import ordering as O
from tapeworks.session import durable

QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}
INF = float("inf")


def finite_or_null(value: str = "value") -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != INF), v)


def finite_rows(long: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, value, c_) with null for what is not a finite number. A projection of the scan: rows are not moved."""
    return long.select(*keys, finite_or_null().alias("value"), (F.col(weight) if weight else F.lit(1)).alias("c_"))


def distribution_stats(long: DataFrame, keys: list[str], *, spread: bool | int = True, max_groups: int | None = None,
                       extra_probs: dict[str, float] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, mean, std, missing_rate, n, p5..p95); all-missing groups give zeros.

    ``extra_probs`` adds further percentile columns from the same passes (null
    where there is no value). One map-side combined pass gives counts, moments and
    the number of distinct values; the percentiles count buckets in further scans.
    Only aggregates are shuffled, and the groups are counted, not assumed.

    ``weight``: ``long`` is a state of value counts (``drift_state``) with that column. Its groups are ordered in
    one task each while their distinct values are few.
    """
    rows = finite_rows(long, keys, weight)
    if weight:
        base, spread = _counted_moments(rows, keys)
    else:
        base = durable(rows.groupBy(*keys).agg(        # one row per group
            F.count(F.lit(1)).alias("n"), F.count("value").alias("ok_"),
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"),
            F.approx_count_distinct("value").alias("d_")))
    probs = {**QUANTILES, **(extra_probs or {})}
    groups = base.count() if max_groups is None else max_groups
    pct = O.percentiles(rows, keys, "value", probs, spread=spread, max_groups=groups,
                        sizes=base.select(*keys, "d_").filter("d_ > 0"), weight="c_" if weight else None)
    out = O.attach(base, pct, keys, "left")
    return out.select(*keys, "mean", "std", (1 - F.col("ok_") / F.col("n")).alias("missing_rate"), "n",
                      *[F.coalesce(q, F.lit(0.0)).alias(q) for q in QUANTILES], *(extra_probs or {}))


def _counted_moments(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """(keys, n, ok_, mean, std, d_) of value counts, and whether a group has too many values for one task.

    The deviation is taken from the mean in a second pass over the counts: sums of squares would cancel.
    """
    here = F.col("value").isNotNull()
    first = durable(rows.groupBy(*keys).agg(
        F.sum("c_").alias("n"), F.coalesce(F.sum(F.when(here, F.col("c_"))), F.lit(0)).alias("ok_"),
        F.coalesce(F.sum(F.col("value") * F.col("c_")), F.lit(0.0)).alias("s_"), F.count("value").alias("d_")))
    mean = F.when(F.col("ok_") > 0, F.col("s_") / F.col("ok_")).otherwise(0.0)
    means = O.checked_broadcast(first.select(*keys, mean.alias("mean")))
    away = (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) * F.col("c_")
    second = O.attach(rows, means, keys).groupBy(*keys, "mean").agg(F.coalesce(F.sum(away), F.lit(0.0)).alias("q_"))
    out = O.attach(first, second, keys).withColumn(
        "std", F.when(F.col("ok_") > 0, F.sqrt(F.col("q_") / F.col("ok_"))).otherwise(0.0)).drop("s_", "q_")
    return durable(out), (first.agg(F.max("d_")).first()[0] or 0) > O.GROUP_ROWS_IN_ONE_TASK


def edges_from(columns: list[str]) -> Column:
    """Distinct sorted percentile columns with open ends; under two values: empty."""
    inner = F.array_distinct(F.array_sort(F.array_compact(F.array(*columns))))
    size = F.size(inner)
    opened = F.concat(F.array(F.lit(-INF)), F.slice(inner, F.lit(2), F.greatest(size - 2, F.lit(0))), F.array(F.lit(INF)))
    return F.when(size >= 2, opened).otherwise(F.array().cast("array<double>"))


def baseline(long: DataFrame, keys: list[str], n_bins: int = K.PSI_BINS, *, max_groups: int | None = None,
             weight: str | None = None) -> DataFrame:
    """Distribution statistics, frozen quantile edges and the shares of the bins."""
    cuts = {f"e{i}_": i / n_bins for i in range(n_bins + 1)}
    stats = durable(distribution_stats(long, keys, max_groups=max_groups, extra_probs=cuts, weight=weight))
    stats = stats.withColumn("edges", edges_from(list(cuts))).drop(*cuts)
    props = proportions(long, keys, stats.select(*keys, "edges"), weight=weight)
    return stats.join(props, keys, "left").withColumn(
        "props", F.coalesce("props", F.array().cast("array<double>")))


def proportions(long: DataFrame, keys: list[str], edges: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(by, keys, props): share of the finite values in each bin of frozen edges.

    Edges have one row per feature. They are measured, and broadcast when small, so
    that the long side is not moved by its hot keys.
    """
    rows = finite_rows(long, [*by, *keys], weight).filter("value IS NOT NULL")
    side = edges.filter(F.size("edges") >= 2)
    rows = rows.join(O.checked_broadcast(side), keys)
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1
    counts = rows.groupBy(*by, *keys, bin_.alias("bin"), (F.size("edges") - 1).alias("bins")).agg(
        F.sum("c_").alias("c"))
    packed = counts.groupBy(*by, *keys, "bins").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("t"))
    dense = F.transform(
        F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("t"))
    return packed.select(*by, *keys, dense.alias("props"))


def psi(expected: Column, actual: Column) -> Column:
    """Population stability index of two share vectors; unequal lengths give 0."""
    floor = lambda x: F.greatest(x, F.lit(K.PSI_EPS))
    terms = F.zip_with(expected, actual, lambda e, a: (floor(a) - floor(e)) * F.ln(floor(a) / floor(e)))
    total = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when((F.size(expected) > 0) & (F.size(expected) == F.size(actual)), total).otherwise(0.0)


def psi_status(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v >= K.PSI_CRITICAL, "critical").when(v >= K.PSI_WARNING, "warning").otherwise("stable")


def feature_drift(live: DataFrame, base: DataFrame, by: list[str], *, max_groups: int | None = None,
                  weight: str | None = None) -> DataFrame:
    """One row per (by, feature) of the live rows (or, with ``weight``, value counts) that has a baseline."""
    keys = ["feature"]
    known = base.select("feature", "edges", F.col("props").alias("base_props_"))
    live = live.join(O.checked_broadcast(known.select("feature")), "feature", "left_semi")
    stats = distribution_stats(live, [*by, *keys], max_groups=max_groups, weight=weight)
    props = proportions(live, keys, known.select("feature", "edges"), by, weight)
    out = stats.join(props, [*by, *keys], "left").join(O.checked_broadcast(known.drop("edges")), keys)
    value = psi(F.col("base_props_"), F.coalesce("props", F.array().cast("array<double>")))
    return out.withColumn("psi", value).withColumn("status", psi_status("psi")).drop("props", "base_props_")


def histogram(long: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys, lo, hi, counts): equal-width counts, last bin closed; a constant spans +-0.5."""
    rows = finite_rows(long, keys).filter("value IS NOT NULL")
    ends = rows.groupBy(*keys).agg(F.min("value").alias("a_"), F.max("value").alias("b_")).select(
        *keys, F.when(F.col("a_") == F.col("b_"), F.col("a_") - 0.5).otherwise(F.col("a_")).alias("lo"),
        F.when(F.col("a_") == F.col("b_"), F.col("b_") + 0.5).otherwise(F.col("b_")).alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = O.attach(rows, O.checked_broadcast(ends), keys).groupBy(*keys, "lo", "hi", at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("c"))
    packed = counts.groupBy(*keys, "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return packed.select(*keys, "lo", "hi", dense.alias("counts"))


def prediction_drift(live: DataFrame, base: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """Feature drift of the single column ``prediction``, with a histogram per batch."""
    return feature_drift(live, base, by).join(histogram(live, [*by, "feature"], bins), [*by, "feature"])


# --- delayed labels ----------------------------------------------------------------

def log_predictions(results: DataFrame, version: str, period: Column, at: Column,
                    horizon: int = K.LABEL_HORIZON_BARS) -> DataFrame:
    """Prediction rows of a scored universe; the raw model score, else the composite."""
    score = F.coalesce("fundamental_score", "composite_score") / 100
    return results.filter(F.col("ticker").isNotNull() & score.isNotNull()).select(
        F.lit(version).alias("model_version"), period.alias("period_key"), at.alias("predicted_at"),
        "ticker", score.alias("prediction"), F.lit(horizon).alias("horizon_days"))


def due_on() -> Column:
    """The day on which the horizon has passed: about 1.45 calendar days per bar."""
    days = F.floor(F.col("horizon_days") * K.CALENDAR_DAYS_PER_BAR).cast("int")
    return F.date_add(F.to_date("predicted_at"), days)


def due(predictions: DataFrame, now: Column) -> Column:
    return due_on() <= now


def mature_labels(predictions: DataFrame, bars: DataFrame, now: Column, ranged: bool | int = False) -> DataFrame:
    """All predictions with ``realized_return`` and ``matured`` filled where possible.

    Due rows are found before anything is limited; a row whose future bars are
    missing stays unmatured.
    """
    rows = predictions.withColumn("due_", due(predictions, now))
    hit = J.asof_next_bar(rows.filter("due_"), bars, "predicted_at", "horizon_days", ranged)
    gain = F.when(F.col("p0") > 0, F.col("p1") / F.col("p0") - 1)
    done = hit.select("pred_id", gain.alias("realized_return")).filter("realized_return IS NOT NULL")
    return rows.drop("due_").join(done, "pred_id", "left").withColumn("matured", F.col("realized_return").isNotNull())


# --- information coefficient -------------------------------------------------------

def period_ics(matured: DataFrame, *, spread: bool | int) -> DataFrame:
    """(model_version, period_key, ts, n, spearman, pearson) per batch."""
    keys = ["model_version", "period_key"]
    rows = matured.filter("matured")
    ics = B.spearman_ic(rows, keys, ["ticker"], spread=spread, score="prediction", ret="realized_return", pearson=True)
    first = rows.groupBy(*keys).agg(F.min("predicted_at").alias("ts"))
    return ics.join(first, keys).select(*keys, "ts", "n", F.col("ic").alias("spearman"), "pearson")


def rolling_ic(ics: DataFrame, windows: list[int] | None = None) -> DataFrame:
    """(model_version, period_key, ts, window, ic_mean, ic_std, ic_ir, n_obs) at every period.

    One row per period and model, so the window over a model is calendar-sized.
    """
    order = Window.partitionBy("model_version").orderBy("ts", "period_key")
    cols = {}
    for w in windows or K.IC_WINDOWS:
        frame = order.rowsBetween(-(w - 1), 0)
        cols[f"m{w}"] = F.avg("spearman").over(frame)
        cols[f"s{w}"] = F.stddev_pop("spearman").over(frame)
        cols[f"n{w}"] = F.count("spearman").over(frame)
    wide = ics.withColumns(cols)
    rows = F.explode(F.array(*[
        F.struct(F.lit(w).alias("window"), F.col(f"m{w}").alias("ic_mean"), F.col(f"s{w}").alias("ic_std"),
                 F.col(f"n{w}").alias("n_obs")) for w in windows or K.IC_WINDOWS]))
    out = wide.select("model_version", "period_key", "ts", "spearman", "pearson", rows.alias("r")).select(
        "model_version", "period_key", "ts", "spearman", "pearson", "r.*")
    return out.withColumn("ic_ir", F.when(F.col("ic_std") > 1e-9, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0))


def classify_ic(rolling: DataFrame, train_ic: str = "train_ic") -> DataFrame:
    """Add ``level`` (ok, WARNING, CRITICAL, RETRAIN) and ``ratio`` per rolling row."""
    order = Window.partitionBy("model_version", "window").orderBy("ts", "period_key")
    last = order.rowsBetween(-(K.IC_RETRAIN_RUN - 1), 0)
    floor = F.col(train_ic) * K.IC_CRITICAL_RATIO
    run = (F.count("ic_mean").over(last) == K.IC_RETRAIN_RUN) & (F.max("ic_mean").over(last) < floor)
    level = (
        F.when(F.col("ic_mean").isNull() | F.col(train_ic).isNull() | (F.col(train_ic) <= 0), "ok")
        .when(run, "RETRAIN").when(F.col("ic_mean") < floor, "CRITICAL")
        .when(F.col("ic_mean") < F.col(train_ic) * K.IC_WARNING_RATIO, "WARNING").otherwise("ok"))
    ratio = F.when(F.col(train_ic) > 0, F.col("ic_mean") / F.col(train_ic))
    return rolling.withColumn("level", level).withColumn("ratio", ratio)


def evaluate_ic(classified: DataFrame, window: int = K.IC_PRIMARY_WINDOW) -> DataFrame:
    """Latest state per model for the primary window."""
    latest = F.max_by(F.struct("period_key", "ic_mean", "level", "ratio"), F.struct("ts", "period_key"))
    return classified.filter(F.col("window") == window).groupBy("model_version").agg(latest.alias("s_")).select(
        "model_version", F.col("s_.period_key").alias("ic_period"), F.col("s_.ic_mean").alias("rolling_ic"),
        F.col("s_.level").alias("ic_level"), F.col("s_.ratio").alias("ic_ratio"))


def as_of(rows: DataFrame, events: DataFrame, period: str, at: str, state: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add the fields of the newest event (by ``at``) of the same or an earlier period and the same ``keys``.

    With several models ``keys`` names their column, so that no model sees another's state. Both sides are one row per model and period of the calendar; one ordered pass, no range join.
    """
    both = rows.withColumns({"at_": F.lit(None).cast(events.schema[at].dataType), "state_": F.lit(None).cast(
        events.schema[state].dataType), "probe_": F.lit(1)}).unionByName(
        events.select(*keys, period, F.col(at).alias("at_"), F.col(state).alias("state_"), F.lit(0).alias("probe_")), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(period, "probe_", "at_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("state_", F.last("state_", ignorenulls=True).over(upto)).filter("probe_ = 1")
    return seen.select(*rows.columns, "state_.*")


def evaluate_drift(drift: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, critical_features, warning_features, max_psi); at most one entry per feature."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("feature"))))
    return drift.groupBy(*keys).agg(
        names("critical").alias("critical_features"), names("warning").alias("warning_features"),
        F.max("psi").alias("max_psi"))


def decide(states: DataFrame) -> DataFrame:
    """Add status, confidence and reasons to rows with the three signal families.

    Needs ic_level, ic_ratio, critical_features, warning_features,
    prediction_status, prediction_psi.
    """
    level, ratio = F.col("ic_level"), fixed(F.col("ic_ratio"), 2)
    crit, warn = F.size("critical_features"), F.size("warning_features")
    pred = F.col("prediction_status")
    retrain = [level.isin("RETRAIN", "CRITICAL"), crit > 0, pred == "critical"]
    watch = [level == "WARNING", (crit == 0) & (warn > 0), pred == "warning"]
    total = lambda xs: reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") for x in xs])
    lines = F.array_compact(F.array(
        F.when(level == "RETRAIN", F.concat(F.lit("IC below "), ratio, F.lit("× training IC for consecutive windows")))
        .when(level == "CRITICAL", F.concat(F.lit("Rolling IC critically low ("), ratio, F.lit("× training IC)")))
        .when(level == "WARNING", F.concat(F.lit("Rolling IC deteriorating ("), ratio, F.lit("× training IC)"))),
        F.when(crit > 0, F.concat(F.lit("Critical feature drift (PSI≥0.25): "),
                                  F.array_join(F.slice("critical_features", 1, 5), ", ")))
        .when(warn > 0, F.concat(F.lit("Moderate feature drift on "), warn.cast("string"), F.lit(" feature(s)"))),
        F.when(pred == "critical", F.concat(F.lit("Prediction distribution drift (PSI="),
                                            fixed(F.col("prediction_psi"), 2), F.lit(")")))
        .when(pred == "warning", F.lit("Mild prediction distribution drift"))))
    out = states.withColumns({"r_": total(retrain), "w_": total(watch)})
    status = F.when(F.col("r_") > 0, "retrain").when(F.col("w_") > 0, "watch").otherwise("healthy")
    sure = (F.when(F.col("r_") > 0, F.round(F.col("r_") / 3, 2)).when(F.col("w_") > 0, F.round(F.col("w_") / 3, 2))
            .otherwise(1.0))
    healthy = (F.col("r_") == 0) & (F.col("w_") == 0)
    said = F.when(healthy, F.array_append(lines, F.lit("IC stable and no material drift"))).otherwise(lines)
    return out.withColumns({"status": status, "confidence": sure, "reasons": said}).drop("r_", "w_")


def alert_rows(ic: DataFrame, drift: DataFrame, pred: DataFrame) -> DataFrame:
    """(model_version, level, kind, detail) rows to append to the alert table."""
    a = ic.filter("ic_level <> 'ok'").select(
        "model_version", F.col("ic_level").alias("level"), F.lit("ic").alias("kind"),
        F.to_json(F.struct("rolling_ic", F.col("ic_ratio").alias("ratio"))).alias("detail"))
    b = drift.filter("size(critical_features) + size(warning_features) > 0").select(
        "model_version", F.when(F.size("critical_features") > 0, "CRITICAL").otherwise("WARNING").alias("level"),
        F.lit("psi").alias("kind"), F.to_json(F.struct("critical_features", "warning_features", "max_psi")).alias("detail"))
    c = pred.filter("status = 'critical'").select(
        "model_version", F.lit("CRITICAL").alias("level"), F.lit("pred_drift").alias("kind"),
        F.to_json(F.struct("psi")).alias("detail"))
    return a.unionByName(b).unionByName(c)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, combined on the map side."""
    cols = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("row_")).select(*keys, "row_.*")


def latest_period(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """All rows of the newest period per key."""
    newest = df.groupBy(*keys).agg(F.max(period).alias(period))
    return df.join(newest, [*keys, period], "left_semi")


def dashboard(drift: DataFrame, pred: DataFrame, rolling: DataFrame, states: DataFrame) -> DataFrame:
    """One JSON payload per model: IC series, PSI per feature, prediction drift, verdict.

    Every list holds one entry per feature or per period of one model.
    """
    key = "model_version"
    psis = latest_period(drift, [key], "period_key").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("feature", "psi", "status"))).alias("feature_psi"))
    series = rolling.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("window", "ts", "ic_mean", "spearman", "ic_ir", "n_obs"))).alias("rolling_ic"))
    last = latest_per_key(pred, [key], ["period_key"]).select(
        key, F.struct("psi", "status", "mean", "std", "p5", "p25", "p50", "p75", "p95", "counts").alias("prediction_drift"))
    out = states.select(key, "status", "confidence", "reasons").join(series, key, "left").join(psis, key, "left").join(last, key, "left")
    rec = F.struct("status", "confidence", "reasons").alias("recommendation")
    return out.select(key, F.to_json(F.struct("rolling_ic", "feature_psi", "prediction_drift", rec)).alias("payload"))
