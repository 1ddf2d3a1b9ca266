"""Tree ensemble on MLlib: fit, blend, walk forward, cross-validate, calibrate, save.

Only numbers per period (calendar-bounded), per feature or per fold reach the
driver; rows stay in DataFrames. The training panel is cached for the many
passes of a fit, in as many partitions as its row count asks for.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.operators import books as B
from tapeworks.operators import cross_section as X
from tapeworks.operators import labels as L
from tapeworks.operators import ordering as O
from tapeworks.session import durable

ROWS_PER_PARTITION = 200_000


@dataclass
class Settings:
    """Defaults of the model; tests and demos use fewer and smaller trees."""

    trees: int = 300
    rounds: int = 300
    depth: int = 5
    shrink: float = 0.10
    forest_share: float = 0.60
    cv_folds: int = 5
    seed: int = 42


@dataclass
class Fitted:
    features: list[str]
    settings: Settings
    forest: PipelineModel | None = None
    boosted: PipelineModel | None = None
    source: str = "none"
    report: dict = field(default_factory=dict)


def feature_columns(columns: list[str]) -> list[str]:
    """Rank column where there is one, else the feature, then embeddings in order."""
    have = set(columns)
    chosen = [f"{c}_rank" if f"{c}_rank" in have else c for c in K.FEATURES if c in have or f"{c}_rank" in have]
    emb = sorted((c for c in columns if c.startswith("emb_")), key=lambda c: int(c[4:]) if c[4:].isdigit() else 0)
    return chosen + emb


def training_cache(df: DataFrame) -> DataFrame:
    """Reliable copy in few partitions, cached: a fit makes dozens of small passes."""
    df = durable(df)
    parts = max(1, -(-df.count() // ROWS_PER_PARTITION))
    return df.coalesce(parts).persist()


def class_counts(df: DataFrame) -> dict[int, int]:
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def scaling(rows: DataFrame, features: list[str], total: int) -> SQLTransformer:
    """Median imputing and robust scaling as one projection.

    Median and quartiles are exact; groups too large for one task get them from bucket counts, so no column is
    gathered anywhere. A column without spread is only centred; one without values becomes 0.
    """
    spread = total > O.GROUP_ROWS_IN_ONE_TASK
    med = X.column_percentiles(rows, [], features, {"m": 0.5}, spread=spread).first()
    filled = rows.fillna({c: med[f"{c}_m"] for c in features if med[f"{c}_m"] is not None})
    cuts = X.column_percentiles(filled, [], features, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, spread=spread).first()
    parts = []
    for c in features:
        middle, low, high = (cuts[f"{c}_{q}"] or 0.0 for q in ("q2", "q1", "q3"))
        width = high - low if high > low else 1.0
        parts.append(f"(coalesce(`{c}`, {middle!r}D) - {middle!r}D) / {width!r}D AS `{c}__f`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit(train: DataFrame, features: list[str], settings: Settings, counts: dict[int, int] | None = None) -> Fitted:
    """Median imputing, robust scaling, then a balanced forest and boosted trees."""
    counts = counts or class_counts(train)
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * max(counts.get(1, 0), 1))).otherwise(
        total / (2.0 * max(counts.get(0, 0), 1)))
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in features],
                        F.col("label").cast("double").alias("label"), weight.alias("weight"))
    filled = [f"{c}__f" for c in features]
    prepare = [scaling(rows, features, total), VectorAssembler(inputCols=filled, outputCol="features")]
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=settings.trees, maxDepth=settings.depth,
        minInstancesPerNode=10, featureSubsetStrategy="sqrt", seed=settings.seed)
    boosted = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=settings.rounds, maxDepth=min(settings.depth, 4),
        stepSize=max(0.01, 0.1 * (1 - settings.shrink)), subsamplingRate=0.8, minInstancesPerNode=8,
        featureSubsetStrategy="sqrt", seed=settings.seed)
    prep = Pipeline(stages=prepare).fit(rows)
    ready = prep.transform(rows).select("features", "label", "weight")
    join = lambda model: PipelineModel(stages=[*prep.stages, model])
    return Fitted(features, settings, join(forest.fit(ready)), join(boosted.fit(ready)))


def predict(model: Fitted, df: DataFrame, out: str = "model_score") -> DataFrame:
    """Add the blended probability; 0.5 when there is no fitted model."""
    if model.forest is None:
        return df.withColumn(out, F.lit(0.5))
    casted = df.withColumns({c: F.col(c).cast("double") for c in model.features})
    share = model.settings.forest_share
    scored = model.forest.transform(casted).withColumn("rf_", vector_to_array("probability")[1]).select(*df.columns, "rf_")
    scored = model.boosted.transform(scored).withColumn("gb_", vector_to_array("probability")[1])
    return scored.select(*df.columns, (F.col("rf_") * share + F.col("gb_") * (1 - share)).alias(out))


def walk_forward(panel: DataFrame, features: list[str], *, embargo: int, settings: Settings, min_train: int = 3,
                 keep: list[str] = ("period", "ticker", "fwd_ret", "vol"), parallel: int = 4) -> DataFrame:
    """Out-of-sample scores: a fresh model per period, trained on periods <= t - embargo - 1.

    ``panel`` has period, label and the features. The loop is over periods; the
    fits of several periods are submitted at once. ``train_from``, ``train_to`` and
    ``train_rows`` say what each score's model was fitted on.
    """
    cached = training_cache(panel)
    per = {r["period"]: (r["n"], r["pos"]) for r in cached.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).collect()}
    tests = []
    for t in sorted(per):
        train = [p for p in per if p <= t - embargo - 1]
        pos = sum(per[p][1] for p in train)
        neg = sum(per[p][0] for p in train) - pos
        if len(train) >= min_train and pos >= 2 and neg >= 2:
            tests.append((t, train, {1: int(pos), 0: int(neg)}))

    def step(test):
        t, train, counts = test
        known = F.col("period") <= t - embargo - 1
        model = fit(cached.filter(known), features, settings, counts)
        return predict(model, cached.filter(F.col("period") == t)).select(
            *keep, "model_score", F.lit(min(train)).cast("long").alias("train_from"),
            F.lit(max(train)).cast("long").alias("train_to"), F.lit(sum(counts.values())).cast("long").alias("train_rows"))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        scored = list(pool.map(step, tests))
    empty = cached.select(*keep, F.lit(0.5).alias("model_score"), *[
        F.lit(None).cast("long").alias(c) for c in ("train_from", "train_to", "train_rows")]).limit(0)
    out = durable(reduce(DataFrame.unionByName, scored, empty))
    cached.unpersist()
    return out


def out_of_fold(panel: DataFrame, features: list[str], settings: Settings, embargo: int = 0) -> DataFrame | None:
    """Rows of the test folds with ``oof``; None when the panel has no usable fold.

    Groups are periods; snapshot rows (``is_snapshot``) never enter a fold. With
    fewer than three periods the split follows row order instead.
    """
    rows = panel.count()
    n_splits = min(settings.cv_folds, max(2, rows // 4))
    history = panel.filter(~F.coalesce("is_snapshot", F.lit(False))) if "is_snapshot" in panel.columns else panel
    folds = L.period_folds(history.select("period"), n_splits, embargo)
    plan: dict[int, tuple[int, list[int]]] = {}
    if history.select("period").distinct().count() >= 3:
        for r in folds.collect():                      # one row per period
            below, tests = plan.setdefault(r["fold"], (r["train_below"], []))
            tests.append(r["period"])
    parts = []
    if plan:
        for below, tests in plan.values():
            parts.append((history.filter(F.col("period") < below), history.filter(F.col("period").isin(tests))))
    else:
        split = L.row_folds(panel, ["period", "ticker"], n_splits)
        tagged = panel.join(split, ["period", "ticker"])
        parts = [(tagged.filter(F.col("part") <= f), tagged.filter(F.col("part") == f + 1)) for f in range(n_splits)]
    out = None
    for train, test in parts:
        counts = class_counts(train)
        if min(counts.get(0, 0), counts.get(1, 0)) < 1:
            continue
        scored = predict(fit(train, features, settings, counts), test, "oof").select("period", "ticker", "label", "fwd_ret", "oof")
        out = scored if out is None else out.unionByName(scored)
    return out


def calibrate(oof: DataFrame, min_rows: int = 10) -> tuple[dict, dict]:
    """(report, thresholds) from out-of-fold scores: accuracy, rank IC, percentiles."""
    hit = ((F.col("oof") >= 0.5).cast("int") == F.col("label").cast("int")).cast("int")
    head = oof.agg(F.count("oof").alias("n"), F.avg(hit).alias("acc")).first()
    report = {"cv_accuracy": head["acc"] or 0.0, "cv_ic": 0.0, "covered": head["n"]}
    if head["n"] < min_rows:
        return report, {}
    ic = B.spearman_ic(oof, [], ["period", "ticker"], spread=True, score="oof").first()["ic"]
    report["cv_ic"] = ic or 0.0
    cut = O.percentiles(oof, [], "oof", K.THRESHOLD_PERCENTILES).first()
    return report, {k: cut[k] for k in K.THRESHOLD_PERCENTILES}


def fit_with_cv(panel: DataFrame, features: list[str], settings: Settings, embargo: int = 0, source: str = "real_returns") -> Fitted:
    """Cross-validated report and thresholds, then the final fit on all rows."""
    cached = training_cache(panel)
    oof = out_of_fold(cached, features, settings, embargo)
    report, thresholds = calibrate(durable(oof)) if oof is not None else ({"cv_accuracy": 0.0, "cv_ic": 0.0}, {})
    model = fit(cached, features, settings)
    model.source = source
    model.report = {**report, "thresholds": thresholds, "rows": cached.count()}
    cached.unpersist()
    return model


def train_cascade(settings: Settings, real: DataFrame | None = None, cache: DataFrame | None = None,
                  snapshot: DataFrame | None = None, embargo: int = 0) -> Fitted:
    """Best source that is good enough: real returns, price-cache labels, momentum fallback."""
    for source, rows, least in (("real_returns", real, 6), ("price_cache", cache, K.MIN_TRAIN_ROWS)):
        if rows is None:
            continue
        counts = class_counts(rows)
        if sum(counts.values()) >= least and min(counts.get(0, 0), counts.get(1, 0)) >= 2:
            return fit_with_cv(rows, feature_columns(rows.columns), settings, embargo, source)
    if snapshot is not None:
        rows = snapshot.withColumn("label", L.momentum_label(snapshot))
        counts = class_counts(rows)
        cols = [c for c in feature_columns(rows.columns) if c.endswith("_rank")]
        if cols and min(counts.get(0, 0), counts.get(1, 0)) >= 2:
            model = fit(rows, cols, settings, counts)
            model.source, model.report = "last_resort_momentum", {"cv_accuracy": 0.0, "rows": sum(counts.values())}
            return model
    return Fitted([], settings)


def feature_importance(spark: SparkSession, model: Fitted, top: int = 12) -> DataFrame:
    """(feature, importance, rf, gb): blended importances, largest first."""
    rf = model.forest.stages[-1].featureImportances.toArray()
    gb = model.boosted.stages[-1].featureImportances.toArray()
    share = model.settings.forest_share
    rows = [(c, float(a), float(b)) for c, a, b in zip(model.features, rf, gb)]
    df = spark.createDataFrame(rows, "name string, rf double, gb double")
    title = F.initcap(F.replace(F.replace("name", F.lit("_rank")), F.lit("_"), F.lit(" ")))
    return df.select(
        title.alias("feature"), F.round(F.col("rf") * share + F.col("gb") * (1 - share), 6).alias("importance"),
        F.round("rf", 6).alias("rf"), F.round("gb", 6).alias("gb"),
    ).orderBy(F.desc("importance"), "feature").limit(top)


def save(spark: SparkSession, model: Fitted, path: str, name: str, trained_at: str) -> None:
    """Both pipelines and one metadata row under ``path/name``."""
    model.forest.write().overwrite().save(f"{path}/{name}/forest")
    model.boosted.write().overwrite().save(f"{path}/{name}/boosted")
    row = [(name, trained_at, model.source, model.features, {k: float(v) for k, v in model.report.get("thresholds", {}).items()},
            float(model.report.get("cv_ic") or 0.0), float(model.settings.forest_share))]
    kind = ("name string, trained_at string, source string, features array<string>, "
            "thresholds map<string,double>, cv_ic double, forest_share double")
    spark.createDataFrame(row, kind).coalesce(1).write.mode("overwrite").json(f"{path}/{name}/metadata")


def load(spark: SparkSession, path: str, name: str) -> Fitted:
    kind = ("name string, trained_at string, source string, features array<string>, "
            "thresholds map<string,double>, cv_ic double, forest_share double")
    meta = spark.read.schema(kind).json(f"{path}/{name}/metadata").first()
    return Fitted(
        list(meta["features"]), Settings(forest_share=meta["forest_share"]),
        PipelineModel.load(f"{path}/{name}/forest"), PipelineModel.load(f"{path}/{name}/boosted"),
        meta["source"], {"thresholds": meta["thresholds"] or {}, "cv_ic": meta["cv_ic"], "trained_at": meta["trained_at"]})


def list_saved(spark: SparkSession, path: str) -> DataFrame:
    kind = "name string, trained_at string, source string, cv_ic double"
    return spark.read.schema(kind).json(f"{path}/*/metadata").orderBy(F.desc("trained_at"), "name")
