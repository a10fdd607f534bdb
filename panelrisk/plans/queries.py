"""Registered queries over the driver tables: one per operator family of SURVEY §2.

Each takes (spark, sf_dir) and returns a lazy DataFrame whose columns match the
oracle SQL in ``panelrisk.plans.oracle``.  Doubles that come out of float arithmetic
are rounded to 6 places so both engines print the same value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators.features import add_lag_diff
from panelrisk.plans.tables import customer_year_panel, read

QUERIES: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("lag_diff")
def q_lag_diff(spark: SparkSession, sf: str) -> DataFrame:
    """F4 on the customer x year panel: change of yearly order total vs previous year row."""
    panel = customer_year_panel(read(spark, sf, "orders"))
    out = add_lag_diff(panel, "total", "o_custkey", "o_year", "total_diff")
    return out.select("o_custkey", "o_year", F.col("total").cast("double").alias("total"),
                      "n_orders", F.col("total_diff").cast("double").alias("total_diff"))


# ---------------------------------------------------------------- schema / reshape
from panelrisk.operators.panel import (  # noqa: E402
    WideLayout, concat_panels, normalize_column_names, remove_duplicates, wide_to_long)
from panelrisk.functions.columns import leading_int, lenient_double  # noqa: E402


@query("normalize_names")
def q_normalize_names(spark, sf):
    """Messy headers (spaces, case, padding) -> trimmed upper snake names."""
    c = read(spark, sf, "customer")
    messy = c.select(*[F.col(n).alias(f"  {n.replace('_', ' ')} ") for n in c.columns])
    return normalize_column_names(messy)


@query("leading_int")
def q_leading_int(spark, sf):
    """P6 + P5: leading integer of the priority text; lenient numeric of the status."""
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", leading_int("o_orderpriority").alias("priority_num"),
                    lenient_double("o_orderstatus").alias("status_num"))


@query("concat_panels")
def q_concat_panels(spark, sf):
    """R2: customers and suppliers stacked by name; supplier has no segment."""
    c = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return concat_panels([c, s])


@query("dedup_rows")
def q_dedup_rows(spark, sf):
    """Whole-row distinct over a narrow lineitem projection."""
    li = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return remove_duplicates(li)


def orders_wide(orders):
    """Customer x year orders pivoted wide: TOTAL_y, CNT_y, PRIO_GRADE_y.

    The last year gets no TOTAL column, so the reshape must skip it (anchor rule).
    Years are a distinct-value list (bounded: calendar years), read once at plan time.
    """
    o = orders.withColumn("_y", F.year("o_orderdate"))
    years = sorted(r[0] for r in o.select("_y").distinct().collect())
    aggs = []
    for y in years:
        hit = F.col("_y") == y
        if y != years[-1]:
            aggs.append(F.sum(F.when(hit, F.col("o_totalprice").cast("decimal(18,2)"))).alias(f"TOTAL_{y}"))
        aggs.append(F.count(F.when(hit, 1)).alias(f"CNT_{y}"))
        aggs.append(F.min(F.when(hit, F.col("o_orderpriority"))).alias(f"PRIO_GRADE_{y}"))
    return o.groupBy("o_custkey").agg(*aggs)


ORDERS_LAYOUT = WideLayout(indicators=("TOTAL", "CNT"), anchor="TOTAL", entity="o_custkey",
                           period="ANO", group="FASE",
                           group_sources=(("GRADE", "value"), ("PRIO_GRADE", "leading_int")),
                           optional=())


@query("wide_to_long")
def q_wide_to_long(spark, sf):
    """R1 + P3/P4: wide customer-year table back to long, one scan, anchor-less year skipped."""
    return wide_to_long(orders_wide(read(spark, sf, "orders")), ORDERS_LAYOUT)


# ---------------------------------------------------------------- missing data
from panelrisk.operators.clean import (  # noqa: E402
    drop_sparse_rows, impute_group_median, impute_mode, null_profile)


def lineitem_with_gaps(spark, sf):
    """Lineitem projection with value-driven missing cells (every row kept)."""
    li = read(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") > 40, None).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_discount") < 0.03, None).otherwise(F.col("l_discount")).alias("disc"),
        F.when(F.col("l_tax") > 0.05, None).otherwise(F.col("l_tax")).alias("tax"),
        F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"), None)
        .otherwise(F.col("l_shipdate")).alias("shipdate"))


@query("sparse_rows")
def q_sparse_rows(spark, sf):
    """M1: keep rows with more than half of their 8 cells present."""
    return drop_sparse_rows(lineitem_with_gaps(spark, sf))


@query("null_profile")
def q_null_profile(spark, sf):
    """M6: missing cells per column."""
    return null_profile(lineitem_with_gaps(spark, sf))


def part_with_gaps(spark, sf):
    p = read(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") <= 3, None).otherwise(F.col("p_brand")).alias("brand"),
        F.when((F.col("p_brand") == "Brand#7") | F.col("p_size").between(40, 45), None)
        .otherwise(F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_type") == "SMALL", None).otherwise(F.col("p_size").cast("double")).alias("size"))


@query("group_median_impute")
def q_group_median_impute(spark, sf):
    """M2 + M3: null -> brand median; all-null brand / null brand -> global median after M2."""
    out = impute_group_median(part_with_gaps(spark, sf), ["price", "size"], "brand")
    return out.select("p_partkey", "brand", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query("mode_impute")
def q_mode_impute(spark, sf):
    """M5: null segment / nation -> most frequent value, ties to the smallest."""
    c = read(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("c_acctbal") > 9000, None).otherwise(F.col("c_nationkey")).alias("nation"))
    return impute_mode(c, ["seg", "nation"])


# ---------------------------------------------------------------- labels
from panelrisk.operators.label import class_weights, encode_label, label_distribution  # noqa: E402
from panelrisk.spec import EDUCATION_TEXT_LABELS  # noqa: E402

RULE = (("inde", 5.0), ("ian", 5.0))


@query("label_derive")
def q_label_derive(spark, sf):
    """L1: no label column -> (inde < 5) OR (ian < 5); null comparisons count false."""
    p = read(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_brand") == "Brand#3", None).otherwise(F.col("p_size") / 5.0).alias("inde"),
        F.when(F.col("p_type") == "SMALL", None).otherwise(F.col("p_retailprice") / 200.0).alias("ian"))
    return encode_label(p, "label", RULE, EDUCATION_TEXT_LABELS).select("p_partkey", "label")


@query("label_text")
def q_label_text(spark, sf):
    """L2: text label mapped case-insensitively; unknown text -> derived by the rule."""
    o = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "Sim").when(F.col("o_orderstatus") == "O", "NÃO")
        .otherwise("?").alias("label"),
        (F.col("o_totalprice") / 50000.0).alias("inde"),
        (F.substring("o_orderpriority", 1, 1).cast("double") * 2.0).alias("ian"))
    return encode_label(o, "label", RULE, EDUCATION_TEXT_LABELS).select("o_orderkey", "label")


@query("label_signed")
def q_label_signed(spark, sf):
    """L3 + L5: non-binary numeric label -> sign rule; null -> derived."""
    c = read(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_acctbal")).alias("label"),
        (F.col("c_nationkey") / 2.5).alias("inde"),
        (F.col("c_acctbal") / 1000.0 + 5.0).alias("ian"))
    return encode_label(c, "label", RULE, EDUCATION_TEXT_LABELS).select("c_custkey", "label")


@query("label_binary")
def q_label_binary(spark, sf):
    """L3 + L4: binary label with gaps -> kept, gaps derived."""
    lb = read(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, None).otherwise(F.col("quality")).alias("label"),
        (F.col("quality") * 4.0 + F.col("toxic")).alias("inde"),
        (F.col("toxic") * 6.0).alias("ian"))
    return encode_label(lb, "label", RULE, EDUCATION_TEXT_LABELS).select("doc_id", "label")


@query("label_distribution")
def q_label_distribution(spark, sf):
    """Class counts."""
    return label_distribution(read(spark, sf, "labels"), "quality")


@query("class_weights")
def q_class_weights(spark, sf):
    """A4: balanced class weights and the negative/positive ratio."""
    cw = class_weights(read(spark, sf, "labels"), "quality")
    return cw.select("quality", "n", F.round("weight", 6).alias("weight"),
                     F.round("imbalance_ratio", 6).alias("imbalance_ratio"))


# ---------------------------------------------------------------- features
from panelrisk.operators.features import add_all_below_median, add_gap, add_interactions, add_row_means  # noqa: E402


@query("row_mean")
def q_row_mean(spark, sf):
    """null-skipping mean of quantity, discount and tax."""
    s = add_row_means(lineitem_with_gaps(spark, sf), {"row_mean": ("qty", "disc", "tax")})
    return s.select("l_orderkey", "l_linenumber", F.round("row_mean", 6).alias("row_mean"))


@query("gap")
def q_gap(spark, sf):
    """tax minus discount."""
    s = add_gap(read(spark, sf, "lineitem"), "l_tax", "l_discount", "gap")
    return s.select("l_orderkey", "l_linenumber", F.round("gap", 6).alias("gap"))


@query("interactions")
def q_interactions(spark, sf):
    """products of measure pairs."""
    s = add_interactions(read(spark, sf, "lineitem"),
                         [("l_quantity", "l_discount", "qty_x_disc"), ("l_extendedprice", "l_tax", "price_x_tax")])
    return s.select("l_orderkey", "l_linenumber", F.round("qty_x_disc", 6).alias("qty_x_disc"),
                    F.round("price_x_tax", 6).alias("price_x_tax"))


@query("all_below_median")
def q_all_below_median(spark, sf):
    """every measure strictly below its column median (null -> not below)."""
    s = add_all_below_median(lineitem_with_gaps(spark, sf), ["qty", "disc", "tax"], "below")
    return s.select("l_orderkey", "l_linenumber", "below")


# ---------------------------------------------------------------- flagship panel
from panelrisk.operators.panel import WideLayout as _WL  # noqa: E402
from panelrisk.plans.jobs import panel_features as _panel_features  # noqa: E402
from panelrisk.spec import PanelSpec  # noqa: E402

ORDERS_SPEC = PanelSpec(
    entity_candidates=("O_CUSTKEY",), period="ANO", group="FASE",
    indicators=("TOTAL", "CNT", "MAXP"), anchor="TOTAL", label="DEFASAGEM",
    categoricals=("FASE", "ANO"), composites={"PERF": ("TOTAL", "MAXP")},
    below_median=("CNT", "MAXP", "TOTAL"), below_name="BELOW", gap=("TOTAL", "MAXP"), gap_name="GAP",
    label_rule=(("TOTAL", 500.0), ("CNT", 2.0)), lag_name="EVOLUTION", anchor_x_group="TOTAL_x_FASE")

ORDERS_PANEL_LAYOUT = _WL(indicators=("TOTAL", "CNT", "MAXP"), anchor="TOTAL", entity="O_CUSTKEY",
                          period="ANO", group="FASE", group_sources=(("PRIO_GRADE", "leading_int"),),
                          optional=())


def orders_wide_raw(orders):
    """Raw yearly customer file: one row per customer, columns suffixed by year, some
    cells missing (no orders that year, a max price above 400k, the lowest priority)."""
    o = orders.withColumn("_y", F.year("o_orderdate"))
    years = sorted(r[0] for r in o.select("_y").distinct().collect())
    aggs = []
    for y in years:
        hit = F.col("_y") == y
        aggs += [
            (F.sum(F.when(hit, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double") / 1000.0)
            .alias(f"total_{y}"),
            F.count(F.when(hit, 1)).alias(f"cnt {y}"),
            F.max(F.when(hit & (F.col("o_totalprice") <= 400000), F.col("o_totalprice"))).alias(f"maxp_{y}"),
            F.min(F.when(hit & ~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")))
            .alias(f"prio grade_{y}"),
        ]
    return o.groupBy("o_custkey").agg(*aggs)


@query("panel_features")
def q_panel_features(spark, sf):
    """O1 + F7 flagship: raw wide yearly file -> long panel -> cleaned, labelled, featured."""
    out = _panel_features(orders_wide_raw(read(spark, sf, "orders")), ORDERS_SPEC, ORDERS_PANEL_LAYOUT)
    dbl = ["TOTAL", "CNT", "MAXP", "FASE", "PERF", "GAP", "EVOLUTION", "TOTAL_x_FASE"]
    return out.select("O_CUSTKEY", "ANO", *[F.round(c, 6).alias(c) for c in dbl], "DEFASAGEM", "BELOW")


# ---------------------------------------------------------------- splitting / sampling
from panelrisk.operators.sampling import exact_sample, stratified_folds, stratified_split  # noqa: E402


@query("stratified_split")
def q_stratified_split(spark, sf):
    """80/20 per-class split by seeded md5 order."""
    return stratified_split(read(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("stratified_folds")
def q_stratified_folds(spark, sf):
    """5 stratified folds by seeded md5 order."""
    return stratified_folds(read(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("exact_sample")
def q_exact_sample(spark, sf):
    """Exactly round(0.3 n) customers, seed 99."""
    return exact_sample(read(spark, sf, "customer").select("c_custkey"), "c_custkey")


# ---------------------------------------------------------------- evaluation
from panelrisk.operators import metrics as M  # noqa: E402


def scored_docs(spark, sf):
    """Predictions to evaluate: labelled documents, score = min(1, n_chars / 5000)."""
    lab = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = read(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    score = F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0))
    return j.select("doc_id", "label", score.alias("score"),
                    (score >= 0.5).cast("int").alias("prediction"))


def _r6(df, keep=()):
    return df.select(*[F.round(c, 6).alias(c) if c not in keep and dict(df.dtypes)[c] == "double"
                       else F.col(c) for c in df.columns])


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    """Dense confusion counts."""
    return M.confusion_matrix(scored_docs(spark, sf))


@query("class_report")
def q_class_report(spark, sf):
    """Per-class precision / recall / F1 / support."""
    return _r6(M.class_report(scored_docs(spark, sf)))


@query("macro_metrics")
def q_macro_metrics(spark, sf):
    """E3 + E4: macro and weighted averages, accuracy, positive recall."""
    return _r6(M.summary_metrics(scored_docs(spark, sf)))


@query("roc_auc")
def q_roc_auc(spark, sf):
    """E5: exact AUC with tied scores averaged."""
    return _r6(M.roc_auc(scored_docs(spark, sf)))


@query("roc_curve")
def q_roc_curve(spark, sf):
    """One ROC point per distinct threshold."""
    return _r6(M.roc_curve(scored_docs(spark, sf)))


@query("release_gates")
def q_release_gates(spark, sf):
    """E7 + O2: metric set -> inclusive release gates and the overall verdict."""
    return _r6(M.release_gates(M.evaluate(scored_docs(spark, sf))))


# ---------------------------------------------------------------- scoring
from panelrisk.operators.scoring import Rule, score_records, validate_requests  # noqa: E402
from panelrisk.functions.columns import risk_tier  # noqa: E402

EVENT_CONTRACT = (Rule("inde", 0.0, 10.0), Rule("ian", 0.0, 10.0), Rule("fase", 0, 8), Rule("ano", 2020, 2030))


def event_requests(spark, sf, *more):
    e = read(spark, sf, "events")
    return e.select(
        "event_id", *more,
        F.when(F.col("event_type") == "signup", None).otherwise(F.col("value") / 40.0).alias("inde"),
        (F.get_json_object("props", "$.k").cast("double") / 9.0).alias("ian"),
        (F.hour("ts") / 2).cast("int").alias("fase"),
        (F.year("ts") + (F.col("value") / 100).cast("int")).alias("ano"))


@query("validate_input")
def q_validate_input(spark, sf):
    """Contract check; violations listed in rule order."""
    v = validate_requests(event_requests(spark, sf), EVENT_CONTRACT)
    return v.select("event_id", "valid", F.array_join("errors", ";").alias("errors"))


@query("quarantine")
def q_quarantine(spark, sf):
    """The rejected requests with their messages."""
    v = validate_requests(event_requests(spark, sf), EVENT_CONTRACT)
    return v.where(~F.col("valid")).select("event_id", F.size("errors").alias("n_errors"),
                                           F.array_join("errors", ";").alias("errors"))


@query("risk_tier")
def q_risk_tier(spark, sf):
    """C2 + C3: tier on the unrounded probability and the 0.5 decision."""
    s = scored_docs(spark, sf)
    return s.select("doc_id", risk_tier("score").alias("nivel_risco"), (F.col("score") >= 0.5).alias("risco"))


@query("score_record")
def q_score_record(spark, sf):
    """C4 + C5: the response record (timestamp left out: wall clock)."""
    s = scored_docs(spark, sf).withColumn("student_id", F.col("doc_id").cast("string"))
    return score_records(s, prob="score").drop("timestamp")


# ---------------------------------------------------------------- prediction log
from panelrisk.operators.monitor import kpis, log_summary, recent_predictions  # noqa: E402


def events_log(spark, sf):
    """The events table read as a prediction log (levels from the event type)."""
    e = read(spark, sf, "events")
    level = (F.when(F.col("event_type") == "error", "alto").when(F.col("event_type") == "purchase", "medio")
             .when(F.col("event_type") == "view", None).otherwise("baixo"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("user_id").cast("string").alias("student_id"), "event_id",
        (F.col("value") >= 250).cast("int").alias("risco_defasagem"),
        F.round(F.least(F.lit(1.0), F.col("value") / 500.0), 4).alias("probabilidade"),
        level.alias("nivel_risco"))


@query("log_summary")
def q_log_summary(spark, sf):
    """Totals by level and the latest timestamp."""
    return log_summary(events_log(spark, sf))


@query("kpis")
def q_kpis(spark, sf):
    """Dashboard KPIs."""
    k = kpis(log_summary(events_log(spark, sf)))
    return k.withColumn("taxa_risco", F.round("taxa_risco", 6))


@query("recent_predictions")
def q_recent_predictions(spark, sf):
    """U4: the 50 newest log rows (the limit is the feature)."""
    return recent_predictions(events_log(spark, sf), 50, tie="event_id")


# ---------------------------------------------------------------- drift
from panelrisk.operators.drift import (  # noqa: E402
    categorical_drift_split, drift_summary, numeric_drift_split)

LI_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_halves(spark, sf):
    """(lineitem, is_ref): shipped before 1998 = reference, from 1998 on = current."""
    li = read(spark, sf, "lineitem")
    return li, F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")


def events_halves(spark, sf):
    """(events, is_ref): days 1-15 = reference, 16 on = current."""
    e = read(spark, sf, "events").select("event_type", (F.hour("ts") / 6).cast("int").cast("string").alias("hour_band"),
                                         F.dayofmonth("ts").alias("_d"))
    return e, F.col("_d") <= 15


def _numeric_drift(spark, sf):
    # both sides are parts of one table: tag the side in one scan instead of two filters
    return numeric_drift_split(*lineitem_halves(spark, sf), LI_MEASURES)


def _categorical_drift(spark, sf):
    return categorical_drift_split(*events_halves(spark, sf), ["event_type", "hour_band"])


@query("drift_numeric")
def q_drift_numeric(spark, sf):
    """K1: KS and normalised Wasserstein per lineitem measure, shipped before vs after 1998."""
    return _r6(_numeric_drift(spark, sf))


@query("drift_categorical")
def q_drift_categorical(spark, sf):
    """K2: Jensen-Shannon and PSI per event attribute, first vs second half of the month."""
    return _r6(_categorical_drift(spark, sf))


@query("drift_tests")
def q_drift_tests(spark, sf):
    """K2: chi-square test of every categorical column, and the z test of those with two categories."""
    df, is_ref = events_halves(spark, sf)
    df = df.withColumn("night", (F.col("hour_band") == "0").cast("string"))
    cols = ["event_type", "hour_band", "night"]
    chi = categorical_drift_split(df, is_ref, cols, test="chi2").select("column", "n_categories", "statistic", "dof", "p_value", "drifted")
    z = categorical_drift_split(df, is_ref, cols, test="z").select("column", F.col("statistic").alias("z"))
    return _r6(chi.join(z, "column"))


@query("drift_summary")
def q_drift_summary(spark, sf):
    """K3 + K4: share of drifted columns over both checks and the alert flag."""
    cols = ["column", "drifted"]
    both = _numeric_drift(spark, sf).select(*cols).unionByName(_categorical_drift(spark, sf).select(*cols))
    s = drift_summary(both)
    return s.select("drift_score", F.array_join("drifted_features", ",").alias("drifted_features"),
                    "n_columns", "drift_detected")


# ---------------------------------------------------------------- modelling
from panelrisk.operators import model as ML  # noqa: E402


@query("standardize")
def q_standardize(spark, sf):
    """A1: population-std scaling of part price and size."""
    p = read(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    s = ML.standardize(p, ["p_retailprice", "p_size"])
    return s.select("p_partkey", F.round("p_retailprice_std", 6).alias("p_retailprice_std"),
                    F.round("p_size_std", 6).alias("p_size_std"))


@query("one_hot")
def q_one_hot(spark, sf):
    """A2: one indicator column per market segment (sorted), unknown -> zeros."""
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return ML.one_hot(c, "c_mktsegment", "seg").drop("c_mktsegment")


USER_NUMERIC = ["n_events", "total_value", "max_value", "n_purchase", "n_view", "day"]
USER_CATEGORICAL = ["top_type"]


def user_day_panel(spark, sf):
    """Entity x period panel from events: one row per (user, day); label = error share > 25%."""
    e = read(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    g = e.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).cast("double").alias("n_events"),
        F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total_value"), F.max("value").alias("max_value"),
        F.count_if(F.col("event_type") == "purchase").cast("double").alias("n_purchase"),
        F.count_if(F.col("event_type") == "view").cast("double").alias("n_view"),
        F.count_if(F.col("event_type") == "error").alias("_err"),
        F.max_by("event_type", F.struct("value", "event_id")).alias("top_type"))
    lab = (F.col("_err") / F.col("n_events") > 0.25).cast("int")
    return g.withColumn("label", lab).withColumn("uid", F.concat_ws("-", "user_id", "day")).drop("_err") \
        .withColumn("day", F.col("day").cast("double"))


def _folds(spark, sf):
    from panelrisk.operators.sampling import stratified_folds
    return materialize(stratified_folds(user_day_panel(spark, sf), "label", "uid", k=5), "folds")


#: The reference's random search: 360 points.
FOREST_GRID = {"num_trees": [100, 200, 300, 500], "max_depth": [5, 8, 10, 15, None], "min_split": [2, 5, 10],
               "max_features": ["sqrt", "log2"], "min_instances": [1, 2, 4]}


@query("train_score")
def q_train_score(spark, sf):
    """A8 + A12 + C2/C3: train on the 80% split, score the 20% hold-out."""
    from panelrisk.operators.sampling import split_frames, stratified_split
    # the split is read by every fit pass (indexer, encoder, scaler, forest): write it once
    split = materialize(stratified_split(user_day_panel(spark, sf), "label", "uid"), "split")
    tr, te = split_frames(split)
    model = ML.train(tr, "label", USER_NUMERIC, USER_CATEGORICAL)
    scored = ML.with_probability(model.transform(te))
    return scored.select("uid", "label", F.col("prediction").cast("int").alias("prediction"),
                         F.round(ML.PROB1, 4).alias("probabilidade"), risk_tier(ML.PROB1).alias("nivel_risco"))


@query("cv_scores")
def q_cv_scores(spark, sf):
    """5-fold stratified CV of the default forest: mean / population std per metric."""
    return _r6(ML.cross_validate(_folds(spark, sf), "label", USER_NUMERIC, USER_CATEGORICAL))


@query("model_compare")
def q_model_compare(spark, sf):
    """Forest vs level-wise vs leaf-wise boosted trees, best macro F1 selected."""
    cands = [ML.Candidate("RandomForestClassifier", lambda: ML.random_forest("label")),
             ML.Candidate("LevelWiseBoosting", lambda: ML.boosted_trees("label")),
             ML.Candidate("LeafWiseBoosting", lambda: ML.leaf_boosted_trees("label"))]
    return _r6(ML.compare_models(_folds(spark, sf), "label", USER_NUMERIC, USER_CATEGORICAL, cands))


@query("tune")
def q_tune(spark, sf):
    """A10: random search (10 points) over the reference's forest grid, 3 folds."""
    from panelrisk.operators.sampling import stratified_folds
    data = stratified_folds(user_day_panel(spark, sf), "label", "uid", k=3)
    return _r6(ML.tune(data, "label", USER_NUMERIC, USER_CATEGORICAL, FOREST_GRID))


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Top-20 importances of the trained forest, named by vector slot."""
    data = user_day_panel(spark, sf)
    model = ML.train(data, "label", USER_NUMERIC, USER_CATEGORICAL)
    return _r6(ML.feature_importance(model, spark))


# ---------------------------------------------------------------- sources, registry, streams

from pyspark.sql import types as T  # noqa: E402

from panelrisk.session import materialize, scratch_path  # noqa: E402
from panelrisk.sources.files import PREDICTION_LOG_SCHEMA, load_csv, read_jsonl, write_csv  # noqa: E402
from panelrisk.sources.registry import append_runs, latest, read_registry, run_record  # noqa: E402
from panelrisk.streaming.score_stream import counters_stream, read_counters, score_stream  # noqa: E402


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """Customers written as ';' Latin-1 CSV (with accented text) and read back through
    the encoding check."""
    c = read(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal",
        F.when(F.col("c_acctbal") < 0, "Não").otherwise("Sim").alias("em_risco"))
    path = scratch_path(spark, "csv")
    write_csv(c, path, sep=";", encoding="ISO-8859-1")
    back = load_csv(spark, path, sep=";",
                    schema="c_custkey long, c_name string, c_acctbal double, em_risco string")
    return back


@query("jsonl_lenient")
def q_jsonl_lenient(spark, sf):
    """Prediction log as JSON lines plus a broken and a blank line; bad lines skipped."""
    log = events_log(spark, sf)
    lines = log.select(F.to_json(F.struct(*log.columns)).alias("value"))
    junk = spark.range(2).select(F.when(F.col("id") == 0, F.lit("{not json")).otherwise(F.lit("")).alias("value"))
    path = scratch_path(spark, "jsonl")
    lines.unionByName(junk).write.mode("overwrite").text(path)
    return read_jsonl(spark, path, PREDICTION_LOG_SCHEMA)


@query("registry_latest")
def q_registry_latest(spark, sf):
    """S8 + S9: one run record per order year appended to a registry table; latest wins."""
    o = read(spark, sf, "orders")
    runs = o.groupBy(F.year("o_orderdate").alias("y")).agg(
        F.max("o_orderdate").alias("trained_at"), F.count(F.lit(1)).alias("n_rows"))
    none = F.lit(None)
    runs = runs.select(
        F.concat(F.lit("v"), F.col("y").cast("string")).alias("version"), F.col("trained_at").cast("timestamp"),
        F.lit("RandomForestClassifier").alias("algorithm"), none.cast("array<string>").alias("features"),
        none.cast("map<string,double>").alias("cv_scores"),
        F.create_map(F.lit("n_rows"), F.col("n_rows").cast("double")).alias("test_metrics"),
        F.lit(True).alias("reliable"), F.lit("").alias("model_path"))
    path = scratch_path(spark, "registry")
    first = run_record(spark, "v0", "RandomForestClassifier", [], {}, {"n_rows": 0.0}, False, "", datetime(1970, 1, 1))
    append_runs(first, path)
    append_runs(runs, path)
    return latest(read_registry(spark, path)).select(
        "version", F.col("trained_at").cast(o.schema["o_orderdate"].dataType).alias("trained_at"), "algorithm",
        F.col("test_metrics")["n_rows"].cast("long").alias("n_rows"))


REQUEST_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("inde", T.DoubleType()),
                               T.StructField("ian", T.DoubleType()), T.StructField("fase", T.IntegerType()),
                               T.StructField("ano", T.IntegerType()), T.StructField("value", T.DoubleType())])


@query("stream_score")
def q_stream_score(spark, sf):
    """Requests land as JSON files; a streaming job validates and scores them."""
    req = event_requests(spark, sf, "value")
    src, sink, ck = (scratch_path(spark, n) for n in ("req", "scored", "ck-score"))
    req.write.mode("overwrite").json(src)
    score_stream(spark, src, REQUEST_SCHEMA, EVENT_CONTRACT,
                 F.least(F.lit(1.0), F.col("value") / 500.0), sink, ck)
    return spark.read.parquet(sink)


@query("stream_counters")
def q_stream_counters(spark, sf):
    """Running counters over a streamed prediction log."""
    src, table, ck = (scratch_path(spark, n) for n in ("log", "counters", "ck-count"))
    log = events_log(spark, sf)
    broken = spark.range(1).select(F.lit("{not json").alias("value"))  # skipped, as in batch
    log.select(F.to_json(F.struct(*log.columns)).alias("value")).union(broken).write.mode("overwrite").text(src)
    counters_stream(spark, src, PREDICTION_LOG_SCHEMA, table, ck)
    return read_counters(spark, table)




# ---------------------------------------------------------------- more operator queries
from panelrisk.operators.scoring import serving_features  # noqa: E402


def event_full_requests(spark, sf):
    """Complete scoring requests from events: eight indicators from value and props."""
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.col("value")
    return e.select(
        F.col("event_id").cast("string").alias("student_id"),
        (v / 50.0).alias("inde"), (k / 10.0).alias("ian"), (v / 40.0).alias("ida"), (k / 12.0).alias("ieg"),
        (v / 60.0).alias("iaa"), (k / 11.0).alias("ips"), (v / 45.0).alias("ipp"), (k / 13.0).alias("ipv"),
        (F.hour("ts") / 3).cast("int").alias("fase"), F.year("ts").alias("ano"),
        (F.col("event_type") == "purchase").alias("ponto_de_virada"))


@query("serving_features")
def q_serving_features(spark, sf):
    """F6 + P13: request-time features (fixed /3 means, products, zeros for history)."""
    out = serving_features(event_full_requests(spark, sf))
    cols = ["INDICE_BEMESTAR", "INDICE_PERFORMANCE", "GAP_AUTO_REAL", "INDE_x_FASE", "BEMESTAR_x_PERFORMANCE"]
    return out.select("student_id", *[F.round(c, 6).alias(c) for c in cols], "ABAIXO_MEDIA_GERAL",
                      "EVOLUCAO_INDE", "FASE", "ANO", "PONTO_DE_VIRADA")


@query("group_median_overwrite")
def q_group_median_overwrite(spark, sf):
    """M2 + M3 with the reference's D4 behaviour: in a column with any null, rows whose
    group key is null take the global fallback even where they had a value."""
    out = impute_group_median(part_with_gaps(spark, sf), ["price", "size"], "brand", null_group="overwrite")
    return out.select("p_partkey", "brand", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query("drift_job")
def q_drift_job(spark, sf):
    """K5 end to end: the orders panel (prepared + featured) against an exact seeded 30 %
    sample of itself; per-column drift rows."""
    from panelrisk.plans.jobs import drift_job
    per, _summary = drift_job(orders_wide_raw(read(spark, sf, "orders")), None, ORDERS_SPEC, ORDERS_PANEL_LAYOUT)
    return _r6(per)


# ---------------------------------------------------------------- odd rows, and operators without a query of their own
from panelrisk.operators.clean import impute_global_median  # noqa: E402
from panelrisk.operators.panel import drop_incomplete, filter_features, numeric_columns, project_known  # noqa: E402
from panelrisk.operators.features import select_features  # noqa: E402
from panelrisk.sources.files import append_jsonl  # noqa: E402
from panelrisk.sources.reports import drift_report, evaluation_report, write_report  # noqa: E402


@query("split_null_keys")
def q_split_null_keys(spark, sf):
    """T1-T3 where a third of the rows have no key: none is lost; rows per class, split and fold, and the sample."""
    from panelrisk.operators.sampling import exact_sample, stratified_folds, stratified_split
    d = scored_docs(spark, sf).withColumn("key", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")))
    count = lambda df, part: df.groupBy(F.lit(part[0]).alias("part"), F.col(part[1]).cast("string").alias("name"),
                                        F.col(part[2]).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return (count(stratified_split(d, "label", "key"), ("split", "split", "label"))
            .unionByName(count(stratified_folds(d, "label", "key"), ("fold", "fold", "label")))
            .unionByName(exact_sample(d, "key", 0.3).agg(F.lit("sample").alias("part"), F.lit("all").alias("name"),
                                                         F.lit(None).cast("string").alias("label"), F.count(F.lit(1)).alias("n"))))


@query("drift_odd_values")
def q_drift_odd_values(spark, sf):
    """K1 on a column with NaN, one without values on the current side, and one with a large offset."""
    li, is_ref = lineitem_halves(spark, sf)
    odd = li.select("l_shipdate",
                    F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double")).alias("with_nan"),
                    F.when(is_ref, F.col("l_tax").cast("double")).alias("one_side"),
                    (F.col("l_quantity").cast("double") / 100 + F.lit(1e9)).alias("offset"))
    return _r6(numeric_drift_split(odd, is_ref, ["with_nan", "one_side", "offset"]))


@query("lag_odd_entities")
def q_lag_odd_entities(spark, sf):
    """F4 with a third of the rows without entity and another third of one entity."""
    o = read(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("price"),
        F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, F.lit(-1)).otherwise(F.col("o_custkey")).alias("entity"))
    return _r6(add_lag_diff(o, "price", "entity", "year", "diff", tie=["o_orderkey"]))


@query("csv_comma")
def q_csv_comma(spark, sf):
    """The same source with commas and UTF-8, told by the bytes."""
    c = read(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" ção, \"€\"")).alias("c_name"))
    path = scratch_path(spark, "csv-comma")
    write_csv(c, path, sep=",")
    return load_csv(spark, path, sep=",", schema="c_custkey long, c_name string")


@query("jsonl_append")
def q_jsonl_append(spark, sf):
    """Two appends to one prediction log."""
    log, path = events_log(spark, sf), scratch_path(spark, "jsonl-append")
    append_jsonl(log.where("event_id % 2 = 0"), path)
    append_jsonl(log.where("event_id % 2 = 1"), path)
    return read_jsonl(spark, path, PREDICTION_LOG_SCHEMA)


@query("evaluation_report")
def q_evaluation_report(spark, sf):
    """Gates, confusion cells and class rows of a run, written and read back."""
    d, path = scored_docs(spark, sf), scratch_path(spark, "report")
    metrics = materialize(M.evaluate(d), "metrics")
    write_report(evaluation_report(metrics, M.release_gates(metrics), M.class_report(d), M.confusion_matrix(d)), path, "run1")
    out = spark.read.parquet(path).where("section <> 'metrics'")
    return _r6(out.select("section", "name", "value", "detail", F.col("run_id").cast("string").alias("run_id")))


@query("drift_report")
def q_drift_report(spark, sf):
    """Per-column drift statistics and the summary row of a run, written and read back."""
    per, path = materialize(_numeric_drift(spark, sf), "drift"), scratch_path(spark, "drift-report")
    write_report(drift_report(per, drift_summary(per)), path, "run1")
    return _r6(spark.read.parquet(path).select("section", "name", "value", "detail", F.col("run_id").cast("string").alias("run_id")))


@query("global_median_impute")
def q_global_median_impute(spark, sf):
    """M4: null -> global median."""
    return _r6(impute_global_median(part_with_gaps(spark, sf), ["price", "size"]).select("p_partkey", "price", "size"))


@query("feature_projection")
def q_feature_projection(spark, sf):
    """Feature lists from the schema, complete rows only, projected to what a model knows."""
    p = part_with_gaps(spark, sf)
    num, cat, both = filter_features(p.columns, ["price", "weight", "size"], ["brand", "color"])
    chosen = select_features(p, ["price", "size", "brand"], ["weight"], ["p_partkey"])
    known = [c for c in numeric_columns(p, exclude=["p_partkey"]) if c in chosen and c in num]
    return project_known(drop_incomplete(p, both), ["p_partkey", *known, *cat, "unknown"])


SERVED_NUMERIC = ["INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV", "FASE"]


@query("batch_score")
def q_batch_score(spark, sf):
    """A pipeline (imputer, scaler, encoder, boosted trees) is fitted on the valid requests, saved and
    registered; the loaded one, with the registry's version and features, scores all requests.

    ``same`` says whether a record's probability is that of the pipeline before it was saved."""
    from panelrisk.operators.prep_stages import ImputerStage
    from panelrisk.operators.scoring import score_batch, split_valid
    from panelrisk.sources.registry import load_model, model_metadata, save_model

    requests = materialize(event_full_requests(spark, sf), "requests")
    valid, _ = split_valid(validate_requests(requests))
    known = materialize(serving_features(valid).withColumn("label", (F.col("IDA") < F.col("IEG")).cast("int")), "serving")
    model = ML.train(known, "label", SERVED_NUMERIC, ["PONTO_DE_VIRADA"], ML.boosted_trees("label", max_iter=20),
                     ImputerStage(indicators=SERVED_NUMERIC[:-1], group="FASE", categoricals=["PONTO_DE_VIRADA"]))
    path, registry = scratch_path(spark, "served-model"), scratch_path(spark, "served-registry")
    save_model(model, path)
    append_runs(run_record(spark, "1.0.0", "LevelWiseBoosting", [*SERVED_NUMERIC, "PONTO_DE_VIRADA"], {}, {}, True, path), registry)
    about = model_metadata(read_registry(spark, registry), path).first()
    records, rejected = score_batch(requests, load_model(path), version=about.version, features=about.features)
    before, _ = score_batch(requests, model, version=about.version, features=about.features)
    before = before.select("student_id", F.col("probabilidade").alias("_p"), F.col("nivel_risco").alias("_tier"))
    same = (F.col("probabilidade") == F.col("_p")) & (F.col("nivel_risco") == F.col("_tier"))
    return (records.join(before, "student_id").select("student_id", "modelo_versao", same.alias("same"), F.lit(0).alias("n_errors"))
            .unionByName(rejected.select("student_id", F.lit(None).cast("string").alias("modelo_versao"),
                                         F.lit(None).cast("boolean").alias("same"), F.size("errors").alias("n_errors"))))
