"""Panel specification: which columns play which role.

Every operator takes its column names from a ``PanelSpec`` (or explicit arguments),
so the same plans run on the education panel and on any entity x period table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    entity_candidates: tuple[str, ...]
    period: str
    group: str
    indicators: tuple[str, ...]
    anchor: str
    label: str
    categoricals: tuple[str, ...]
    # composite indices: name -> member indicators (row mean over present members)
    composites: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # indicators compared to their median for the all-below flag
    below_median: tuple[str, ...] = ()
    below_name: str = "BELOW_MEDIAN_ALL"
    # gap = minuend - subtrahend
    gap: tuple[str, str] | None = None
    gap_name: str = "GAP"
    # label derivation: any of these strictly below its threshold -> 1
    label_rule: tuple[tuple[str, float], ...] = ()
    # text label map (lower-cased keys)
    label_text_map: dict[str, int] = field(default_factory=dict)
    lag_name: str = "EVOLUTION"
    anchor_x_group: str = "ANCHOR_x_GROUP"
    composite_product: tuple[str, str, str] | None = None
    turning_point: str | None = None
    extra_columns: tuple[str, ...] = ()

    @property
    def required(self) -> set[str]:
        return set(self.indicators) | {self.group, self.period}

    def entity_in(self, columns) -> str | None:
        cols = set(columns)
        return next((c for c in self.entity_candidates if c in cols), None)


# --- fixed values that must equal the reference for the education preset -------------
# indicator names, group/period/label column names, composite members, text label map,
# label thresholds (5.0) and the serving-tier cut points live here together.
EDUCATION_INDICATORS = ("INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV")
EDUCATION_CATEGORICALS = ("FASE", "TURMA", "ANO", "PONTO_DE_VIRADA")
EDUCATION_ENTITY_CANDIDATES = ("NOME", "ALUNO", "ID_ALUNO", "ESTUDANTE")
EDUCATION_WELLBEING = ("IPS", "IPP", "IPV")
EDUCATION_PERFORMANCE = ("IDA", "IEG", "IAA")
EDUCATION_BELOW_MEDIAN = ("IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV")
EDUCATION_TEXT_LABELS = {"sim": 1, "não": 0, "nao": 0, "yes": 1, "no": 0}
EDUCATION_LABEL_RULE = (("INDE", 5.0), ("IAN", 5.0))
EDUCATION_BASE_FEATURES = ("INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV", "FASE", "ANO")
EDUCATION_ENGINEERED = (
    "INDICE_BEMESTAR", "INDICE_PERFORMANCE", "GAP_AUTO_REAL", "ABAIXO_MEDIA_GERAL",
    "EVOLUCAO_INDE", "INDE_x_FASE", "BEMESTAR_x_PERFORMANCE",
)
EDUCATION_EXCLUDED = ("DEFASAGEM", "NOME", "ALUNO", "ID_ALUNO", "ESTUDANTE", "TURMA", "PONTO_DE_VIRADA")
EDUCATION_MODEL_NUMERIC = (
    "INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV", "INDICE_BEMESTAR", "INDICE_PERFORMANCE",
    "GAP_AUTO_REAL", "ABAIXO_MEDIA_GERAL", "EVOLUCAO_INDE", "INDE_x_FASE", "BEMESTAR_x_PERFORMANCE", "ANO",
)
EDUCATION_MODEL_CATEGORICALS = ("FASE", "PONTO_DE_VIRADA")
# yearly file: long text / label column -> prefixes of its wide columns
EDUCATION_WIDE_OPTIONAL = (
    ("TURMA", ("TURMA",)),
    ("PONTO_DE_VIRADA", ("PONTO_VIRADA", "PONTO_DE_VIRADA")),
    ("DEFASAGEM", ("DEFASAGEM",)),
)
TIER_LOW_BELOW = 0.40      # p < 0.40 -> baixo
TIER_MEDIUM_UPTO = 0.70    # p <= 0.70 -> medio, else alto
DECISION_AT = 0.5          # p >= 0.5 -> at risk
GATES = (("f1_macro", 0.70), ("roc_auc", 0.75), ("recall_positiva", 0.65))
DRIFT_SHARE_THRESHOLD = 0.15
# --------------------------------------------------------------------------------------

EDUCATION = PanelSpec(
    entity_candidates=EDUCATION_ENTITY_CANDIDATES,
    period="ANO",
    group="FASE",
    indicators=EDUCATION_INDICATORS,
    anchor="INDE",
    label="DEFASAGEM",
    categoricals=EDUCATION_CATEGORICALS,
    composites={"INDICE_BEMESTAR": EDUCATION_WELLBEING, "INDICE_PERFORMANCE": EDUCATION_PERFORMANCE},
    below_median=EDUCATION_BELOW_MEDIAN,
    below_name="ABAIXO_MEDIA_GERAL",
    gap=("IAA", "IDA"),
    gap_name="GAP_AUTO_REAL",
    label_rule=EDUCATION_LABEL_RULE,
    label_text_map=EDUCATION_TEXT_LABELS,
    lag_name="EVOLUCAO_INDE",
    anchor_x_group="INDE_x_FASE",
    composite_product=("INDICE_BEMESTAR", "INDICE_PERFORMANCE", "BEMESTAR_x_PERFORMANCE"),
    turning_point="PONTO_DE_VIRADA",
    extra_columns=("TURMA", "PONTO_DE_VIRADA", "DEFASAGEM"),
)
