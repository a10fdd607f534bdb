"""Batch scoring: input contract, serving features, tiers, records.

The reference scores one HTTP request at a time; here a whole request table is
validated and scored as one lazy plan, and the same plan runs on a stream (see
``panelrisk.streaming``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.columns import decision, half_up, risk_tier, scalars
from panelrisk.operators.panel import project_known
from panelrisk.operators.stats import medians_wide
from panelrisk.spec import EDUCATION, PanelSpec


@dataclass(frozen=True)
class Rule:
    column: str
    low: float | None = None
    high: float | None = None
    required: bool = True


# fixed values: the request contract (inclusive ranges) of the education scoring input
EDUCATION_CONTRACT = (
    Rule("inde", 0.0, 10.0), Rule("ian", 0.0, 10.0), Rule("ida", 0.0, 10.0), Rule("ieg", 0.0, 10.0),
    Rule("iaa", 0.0, 10.0), Rule("ips", 0.0, 10.0), Rule("ipp", 0.0, 10.0), Rule("ipv", 0.0, 10.0),
    Rule("fase", 0, 8), Rule("ano", 2020, 2030),
)
_PREVIOUS = "_previous_anchor"
REQUEST_DEFAULTS = {"student_id": None, "ponto_de_virada": False}


def violations(rules: Sequence[Rule]) -> Column:
    """Array of messages, one per broken rule (empty = valid)."""
    msgs = []
    for r in rules:
        x = F.col(r.column)
        if r.required:
            msgs.append(F.when(x.isNull(), F.lit(f"{r.column}: required")))
        if r.low is not None:
            msgs.append(F.when(x < F.lit(r.low), F.lit(f"{r.column}: below {r.low:g}")))
        if r.high is not None:
            msgs.append(F.when(x > F.lit(r.high), F.lit(f"{r.column}: above {r.high:g}")))
    return F.filter(F.array(*msgs), lambda m: m.isNotNull())


def validate_requests(df: DataFrame, rules: Sequence[Rule] = EDUCATION_CONTRACT) -> DataFrame:
    """Attach ``errors`` (array) and ``valid``.  An optional field that is null, or whose column is
    absent, gets its default; an absent required column breaks the rule in every row."""
    out, present = df, {c.lower() for c in df.columns}
    for c, v in REQUEST_DEFAULTS.items():
        kind = "string" if v is None else "boolean"
        if c not in present:
            out = out.withColumn(c, F.lit(v).cast(kind))
        elif v is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    for r in rules:
        if r.column.lower() not in present:
            out = out.withColumn(r.column, F.lit(None).cast("double"))
    return out.withColumn("errors", violations(rules)).withColumn("valid", F.size("errors") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine (rows with their error list)."""
    return df.where("valid").drop("errors", "valid"), df.where(~F.col("valid"))


def serving_features(df: DataFrame, mode: str = "request", history: DataFrame | None = None,
                     spec: PanelSpec = EDUCATION) -> DataFrame:
    """the request-time features (fixed /3 means, products).

    ``mode="request"``: history and population features are 0, as in the reference.
    ``mode="full"`` (D9) takes them from the panel ``history``: the change against the entity's last
    earlier period, and whether all indicators are below the population's medians.
    """
    if mode not in ("request", "full"):
        raise ValueError(f"unknown mode: {mode!r}")
    below, change = F.lit(0), F.lit(0.0)
    if mode == "full":
        if history is None:
            raise ValueError("mode 'full' needs the history panel")
        df, below, change = _with_history(df, history, spec)
    bem = (F.col("ips") + F.col("ipp") + F.col("ipv")) / 3
    perf = (F.col("ida") + F.col("ieg") + F.col("iaa")) / 3
    fase = F.col("fase").cast("double")
    feats = [
        F.col("inde").alias("INDE"), F.col("ian").alias("IAN"), F.col("ida").alias("IDA"),
        F.col("ieg").alias("IEG"), F.col("iaa").alias("IAA"), F.col("ips").alias("IPS"),
        F.col("ipp").alias("IPP"), F.col("ipv").alias("IPV"),
        bem.alias("INDICE_BEMESTAR"), perf.alias("INDICE_PERFORMANCE"),
        (F.col("iaa") - F.col("ida")).alias("GAP_AUTO_REAL"),
        below.alias("ABAIXO_MEDIA_GERAL"), change.alias("EVOLUCAO_INDE"),
        (F.col("inde") * fase).alias("INDE_x_FASE"), (bem * perf).alias("BEMESTAR_x_PERFORMANCE"),
        F.col("ano").alias("ANO"), fase.alias("FASE"),
        recode_turning_point(F.col("ponto_de_virada")).alias("PONTO_DE_VIRADA")]
    # request fields are replaced by the model's names (Spark names are case-insensitive)
    replaced = {"INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV", "ANO", "FASE", "PONTO_DE_VIRADA"}
    keep = [c for c in df.columns if c.upper() not in replaced and c != _PREVIOUS]
    return df.select(*keep, *feats)


def _with_history(df: DataFrame, history: DataFrame, spec: PanelSpec) -> tuple[DataFrame, Column, Column]:
    """(requests with the entity's previous anchor value, below-all-medians flag, change of the anchor)."""
    entity = spec.entity_in(history.columns)
    asked = df.select(F.col("student_id").alias("_id"), F.col("ano").alias("_at")).distinct()
    past = history.select(F.col(entity).cast("string").alias("_id"), F.col(spec.period).alias("_when"),
                          F.col(spec.anchor).cast("double").alias("_value")).where("_value is not null")
    before = (asked.join(past, "_id").where(F.col("_when") < F.col("_at")).groupBy("_id", "_at")
              .agg(F.max_by("_value", F.struct("_when", "_value")).alias(_PREVIOUS)))
    out = (df.join(before, (F.col("student_id") == F.col("_id")) & (F.col("ano") == F.col("_at")), "left")
           .drop("_id", "_at"))
    cols = [c for c in spec.below_median if c in history.columns]
    medians = scalars(medians_wide(history, cols, suffix="__med"))
    below = F.lit(True)
    for c in cols:
        below = below & F.coalesce(F.col(c.lower()) < medians[f"{c}__med"], F.lit(False))
    return out, F.when(below, 1).otherwise(0), F.coalesce(F.col(spec.anchor.lower()) - F.col(_PREVIOUS), F.lit(0.0))


def recode_turning_point(c: Column) -> Column:
    """One recode for training and serving - true/1/'sim' -> 'Sim', else 'Não'."""
    s = F.lower(c.cast("string"))
    return F.when(s.isin("true", "1", "1.0", "sim", "yes"), "Sim").when(c.isNotNull(), "Não")


def score_records(df: DataFrame, prob: str = "probability", id_col: str = "student_id",
                  version: str = "1.0.0", now: Column | None = None) -> DataFrame:
    """Decision (p >= 0.5), probability rounded to 4, tier on the unrounded p,
    model version and a UTC timestamp (injectable for tests)."""
    ts = now if now is not None else F.current_timestamp()
    return df.select(
        F.col(id_col).alias("student_id"),
        decision(prob).alias("risco_defasagem"),
        half_up(prob, 4).alias("probabilidade"),
        risk_tier(prob).alias("nivel_risco"),
        F.lit(version).alias("modelo_versao"),
        ts.alias("timestamp"))


def log_records(scored: DataFrame) -> DataFrame:
    """S5 record shape: ISO timestamp text, int decision - what the prediction log stores."""
    return scored.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "student_id", F.col("risco_defasagem").cast("int").alias("risco_defasagem"),
        "probabilidade", "nivel_risco")


def score_batch(requests: DataFrame, model, rules: Sequence[Rule] = EDUCATION_CONTRACT,
                version: str = "1.0.0", now: Column | None = None, features: Sequence[str] | None = None,
                mode: str = "request", history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Contract -> serving features -> model probability -> records; plus quarantine.

    ``model`` is a fitted ``PipelineModel`` whose stages read the serving feature names
    (numeric inputs are looked up by name, unknown names are never required).  ``features``, the list
    that the registry keeps with the model, projects its input (P12).
    """
    from panelrisk.operators.model import PROB1, with_probability
    checked = validate_requests(requests, rules)
    valid, quarantine = split_valid(checked)
    inputs = serving_features(valid, mode, history)
    if features:
        inputs = project_known(inputs, ["student_id", *features])
    scored = with_probability(model.transform(inputs))
    return score_records(scored, PROB1, "student_id", version, now), quarantine
