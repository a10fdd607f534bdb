"""Orchestration: composition of the operators.

Building these plans runs jobs: panels that several branches read, and their statistics, are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelrisk.operators.clean import handle_missing_values
from panelrisk.operators.features import transform_features
from panelrisk.operators.label import encode_label
from panelrisk.operators.panel import (
    EDUCATION_LAYOUT, WideLayout, is_wide, normalize_column_names, remove_duplicates,
    validate_schema, wide_to_long)
from panelrisk.session import materialize
from panelrisk.spec import EDUCATION, PanelSpec


def prepare_panel(df: DataFrame, spec: PanelSpec = EDUCATION, layout: WideLayout = EDUCATION_LAYOUT,
                  null_group: str = "keep") -> DataFrame:
    """O1: names -> (wide -> long) -> schema check -> dedup -> missing values -> label.

    The panel is written once, after the deduplication; what follows are row expressions over it,
    with the group medians joined and one-row statistics, which are computed once and written.
    """
    out = normalize_column_names(df)
    if is_wide(out.columns):
        out = wide_to_long(out, layout)
    validate_schema(out, spec.required)
    out = materialize(remove_duplicates(out))
    out = handle_missing_values(out, spec.indicators, spec.group, spec.categoricals, null_group)
    return encode_label(out, spec.label, spec.label_rule, spec.label_text_map)


def panel_features(df: DataFrame, spec: PanelSpec = EDUCATION, layout: WideLayout = EDUCATION_LAYOUT,
                   skew_safe: bool = True) -> DataFrame:
    """O1 + F7: the prepared, labelled, feature-engineered panel."""
    return transform_features(prepare_panel(df, spec, layout), spec, skew_safe=skew_safe)


def row_key(panel: DataFrame, spec: PanelSpec):
    """A short key that spreads the rows: entity, period and a hash of the row."""
    from pyspark.sql import functions as F

    parts = [F.col(c).cast("string") for c in (spec.entity_in(panel.columns), spec.period) if c and c in panel.columns]
    return F.concat_ws("|", *parts, F.xxhash64(*panel.columns).cast("string"))


# ---------------------------------------------------------------- K5: drift job
def drift_job(reference_raw: DataFrame, current_raw: DataFrame | None = None, spec: PanelSpec = EDUCATION,
              layout: WideLayout = EDUCATION_LAYOUT, threshold: float | None = None, sample_frac: float = 0.3,
              seed: int = 99, test: str = "wasserstein", category_test: str = "js") -> tuple[DataFrame, DataFrame]:
    """K5: prepare + feature both sides, keep numeric columns (label excluded), drop rows
    with nulls; without a current frame use an exact seeded 30 % sample of the reference.
    ``test`` names the numeric drift test ("ks" suits small panels, where sampling noise alone moves the
    distance).  Columns of at most five values in the reference are tested as categories (``category_test``).
    Returns (per-column drift table, one-row summary)."""
    from pyspark.sql import functions as F

    from panelrisk.operators.drift import categorical_drift, column_kinds, drift_summary, numeric_drift
    from panelrisk.operators.panel import drop_incomplete, numeric_columns
    from panelrisk.operators.sampling import exact_sample
    from panelrisk.spec import DRIFT_SHARE_THRESHOLD

    ref_full = panel_features(reference_raw, spec, layout)
    cols = numeric_columns(ref_full, exclude=[spec.label])
    keyed = ref_full.withColumn("_row", row_key(ref_full, spec)).select("_row", *cols)
    ref = materialize(drop_incomplete(keyed, cols), "drift-reference")
    if current_raw is not None:
        cur = drop_incomplete(panel_features(current_raw, spec, layout).select(*cols))
    else:
        cur = exact_sample(ref, "_row", sample_frac, seed).drop("_row")
    numbers, categories = column_kinds(ref, cols)
    parts = [numeric_drift(ref, cur, numbers, test=test)] if numbers else []
    if categories:
        parts.append(categorical_drift(ref, cur, categories, test=category_test))
    per = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return per, drift_summary(per, DRIFT_SHARE_THRESHOLD if threshold is None else threshold)


# ---------------------------------------------------------------- O3: training job
def train_job(spark, data_path: str, spec: PanelSpec = EDUCATION, layout: WideLayout = EDUCATION_LAYOUT,
              sep: str = ";", numeric=None, categorical=None, candidates=None, model_path: str | None = None,
              registry_path: str | None = None, version: str = "1.0.0", folds: int = 5) -> dict:
    """O3: load -> prepare -> features -> stratified split -> compare models (k-fold) ->
    CV of the winner -> fit -> test metrics -> gates -> model + registry record.

    Returns the DataFrames and the fitted model in a dict; nothing is collected except
    the per-candidate CV scalars and the metric row written to the registry.
    """
    from pyspark.sql import functions as F

    from panelrisk.operators import metrics as M
    from panelrisk.operators import model as ML
    from panelrisk.operators.panel import filter_features
    from panelrisk.operators.sampling import split_frames, stratified_folds, stratified_split
    from panelrisk.sources.files import load_csv
    from panelrisk.sources.registry import append_runs, run_record, save_model
    from panelrisk.spec import EDUCATION_MODEL_CATEGORICALS, EDUCATION_MODEL_NUMERIC

    raw = load_csv(spark, data_path, sep=sep)
    panel = panel_features(raw, spec, layout)
    keyed = panel.withColumn("_key", row_key(panel, spec))
    split = materialize(stratified_split(keyed, spec.label, "_key"), "split")
    train, test = split_frames(split)
    num, cat, feats = filter_features(train.columns, numeric or EDUCATION_MODEL_NUMERIC,
                                      categorical or EDUCATION_MODEL_CATEGORICALS)
    if spec.turning_point and spec.turning_point in train.columns:
        # One recode on both sides, so serving ('Sim'/'Não') matches training
        from panelrisk.operators.scoring import recode_turning_point
        train = train.withColumn(spec.turning_point, recode_turning_point(F.col(spec.turning_point)))
        test = test.withColumn(spec.turning_point, recode_turning_point(F.col(spec.turning_point)))
    folded = materialize(stratified_folds(train, spec.label, "_key", k=folds), "folds")
    cands = candidates or [
        ML.Candidate("RandomForestClassifier", lambda: ML.random_forest(spec.label)),
        ML.Candidate("LevelWiseBoosting", lambda: ML.boosted_trees(spec.label)),
        ML.Candidate("LeafWiseBoosting", lambda: ML.leaf_boosted_trees(spec.label)),
    ]
    board = ML.compare_models(folded, spec.label, num, cat, cands)
    chosen = [r.algorithm for r in board.where("selected").collect()]
    best = next((c for c in cands if chosen and c.name == chosen[0]), cands[0])
    cv = ML.cross_validate(folded, spec.label, num, cat, classifier_factory=best.make)
    model = ML.train(train, spec.label, num, cat, best.make())
    pred = ML.with_probability(model.transform(test)).select(
        F.col(spec.label).alias("label"), F.col("prediction").cast("int").alias("prediction"),
        F.col(ML.PROB1).alias("score"))
    metrics = M.evaluate(pred)
    gates = M.release_gates(metrics)
    if model_path:
        save_model(model, model_path)
    if registry_path:
        m = metrics.first().asDict()
        c = cv.first().asDict()
        reliable = bool(gates.where("metric = 'all'").first().passed)
        append_runs(run_record(spark, version, best.name, feats, {k: float(v) for k, v in c.items() if v is not None},
                               {k: float(v) for k, v in m.items() if v is not None}, reliable, model_path or ""),
                    registry_path)
    return {"panel": panel, "leaderboard": board, "cv": cv, "model": model, "predictions": pred,
            "metrics": metrics, "gates": gates, "features": feats}
