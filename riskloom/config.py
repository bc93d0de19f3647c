"""Column roles and pipeline parameters.

Everything the pipeline does is driven by these plain dataclasses; the
defaults reproduce the clinical risk configuration the engine was built to
match.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference configuration for identical results)
# ---------------------------------------------------------------------------
TARGET = "Outcome"
SPLIT_COL = "split"
ROW_ID = "row_id"
RAW_NUMERICAL = [
    "Pregnancies",
    "Glucose",
    "BloodPressure",
    "SkinThickness",
    "Insulin",
    "BMI",
    "DiabetesPedigreeFunction",
    "Age",
]
ZERO_AS_MISSING = ["Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI"]
SPLIT_RATIOS = [("train", 0.7), ("validation", 0.15), ("test", 0.15)]
RANDOM_STATE = 42
MIN_ROWS_FOR_STRATIFY = 20
CAP_LOWER_Q = 0.05
CAP_UPPER_Q = 0.95
CAP_IQR_MULT = 1.5
SENIOR_AGE = 50
LOW_GLUCOSE = 70
NORMAL_GLUCOSE_UPPER = 100
HIDDEN_GLUCOSE_UPPER = 125
INSULIN_NORMAL_RANGE = (16, 166)
BMI_BINS = [0.0, 18.5, 24.9, 29.9, float("inf")]
BMI_LABELS = ["underweight", "healthy", "overweight", "obese"]
GLUCOSE_BINS = [0.0, 140.0, 200.0, 300.0]
GLUCOSE_LABELS = ["normal", "prediabetes", "diabetes"]
CATEGORY_ORDERS = {
    "age_category": ["mature", "senior"],
    "bmi_category": ["underweight", "healthy", "overweight", "obese"],
    "glucose_category": ["normal", "prediabetes", "diabetes"],
    "age_bmi_category": [
        "underweight_mature",
        "underweight_senior",
        "healthy_mature",
        "healthy_senior",
        "overweight_mature",
        "overweight_senior",
        "obese_mature",
        "obese_senior",
    ],
    "age_glucose_category": [
        "low_mature",
        "low_senior",
        "normal_mature",
        "normal_senior",
        "hidden_mature",
        "hidden_senior",
        "high_mature",
        "high_senior",
    ],
    "insulin_category": ["normal", "abnormal"],
}
DERIVED_NUMERICAL = [
    "glucose_bmi_interaction",
    "glucose_insulin_interaction",
    "glucose_pregnancies_interaction",
]
CATEGORICAL = list(CATEGORY_ORDERS)
NUMERICAL_RANGES = {
    "Pregnancies": (0, 20),
    "Glucose": (0, 300),
    "BloodPressure": (0, 200),
    "SkinThickness": (0, 100),
    "Insulin": (0, 900),
    "BMI": (0, 80),
    "DiabetesPedigreeFunction": (0, 3),
    "Age": (0, 120),
}
TARGET_ALLOWED = [0, 1]
MIN_ROWS_CLEAN = 20
MIN_ROWS_PER_SPLIT = 1
WARN_SPLIT_ROWS_BELOW = 5
MIN_MINORITY_RATIO = 0.05
FRESH_WARNING_HOURS = 168
FRESH_MAX_HOURS = 720
PSI_BINS = 10
PSI_STABLE_MAX = 0.10
PSI_MODERATE_MAX = 0.25
PROBABILITY_EPSILON = 1e-6
THRESHOLD_GRID = (0.10, 0.90, 0.05)
# (name, label, min_probability, max_probability)
RISK_BANDS = [
    ("low", "Baixo risco", 0.00, 0.30),
    ("moderate", "Risco moderado", 0.30, 0.55),
    ("high", "Alto risco", 0.55, 0.75),
    ("critical", "Risco critico", 0.75, 1.01),
]
NO_BAND_LABEL = "Sem faixa"
# lower(trim(band label)) -> recommended action
ACTIONS = {
    "risco critico": "Encaminhar avaliação clínica imediata",
    "alto risco": "Priorizar revisão clínica",
    "risco moderado": "Solicitar triagem complementar",
    "baixo risco": "Manter monitoramento de rotina",
}
DEFAULT_ACTION = "Revisar contexto clínico"
POSITIVE_LABEL = "Positivo"
NEGATIVE_LABEL = "Negativo"
DEPLOYMENT_POLICY = "prioritize_recall"
# Score components: (metric, source, direction, weight)
SCORE_COMPONENTS = [
    ("brier", "validation", "minimize", 0.22),
    ("log_loss", "validation", "minimize", 0.15),
    ("calibration_slope_error", "validation", "minimize", 0.08),
    ("calibration_intercept_abs", "validation", "minimize", 0.05),
    ("roc_auc", "validation", "maximize", 0.05),
    ("recall", "policy", "maximize", 0.16),
    ("false_negative_rate", "policy", "minimize", 0.10),
    ("precision", "policy", "maximize", 0.04),
    ("false_positive_rate", "policy", "minimize", 0.02),
    ("expected_cost_per_sample", "policy", "minimize", 0.05),
]
HIGHER_IS_BETTER = [
    "roc_auc",
    "accuracy",
    "precision",
    "recall",
    "specificity",
    "f1",
    "tn_share",
    "tp_share",
    "mean_risk_score",
]
CV_STABLE_MAX_PCT = 10.0
CV_MODERATE_MAX_PCT = 20.0
BOOTSTRAP_ITERATIONS = 250
BOOTSTRAP_CONFIDENCE = 0.95
PERMUTATION_REPEATS = 12
PERTURBATION_PERCENTS = [0.05, 0.10, 0.20]
SENSITIVITY_MIN_BASELINE_ABS = 1.0
SENSITIVITY_INSENSITIVE_MAX = 0.10
SENSITIVITY_OVERREACTIVE_MIN = 1.00
SENSITIVITY_SAMPLE_SIZE = 128
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    name: str
    strategy: str  # "fixed_threshold" | "min_expected_cost"
    label: str
    threshold: float = 0.5
    fn_cost: float = 1.0
    fp_cost: float = 1.0
    min_recall: float = 0.0
    min_precision: float = 0.0
    min_specificity: float = 0.0


# Decision policies of the reference configuration.
POLICIES = [
    Policy("default_050", "fixed_threshold", "Threshold 0.50", threshold=0.50),
    Policy("prioritize_recall", "min_expected_cost", "Priorizar recall", fn_cost=8.0, fp_cost=1.0, min_recall=0.85),
    Policy("prioritize_precision", "min_expected_cost", "Priorizar precision", fn_cost=1.0, fp_cost=6.0, min_precision=0.75),
]


@dataclass(frozen=True)
class ColumnRoles:
    """Role map: which columns are target / categorical / numerical / model features."""

    target: tuple[str, ...] = (TARGET,)
    categorical: tuple[str, ...] = ()
    numerical: tuple[str, ...] = tuple(RAW_NUMERICAL)
    encoded_categorical: tuple[str, ...] = ()
    model_features: tuple[str, ...] = ()

    def flat(self) -> list[str]:
        out: list[str] = []
        for group in (self.target, self.categorical, self.numerical, self.encoded_categorical):
            for c in group:
                if c not in out:
                    out.append(c)
        return out

    def features(self) -> list[str]:
        if self.model_features:
            return list(self.model_features)
        if self.numerical or self.encoded_categorical:
            return [*self.numerical, *self.encoded_categorical]
        return [*self.categorical, *self.numerical]


RAW_ROLES = ColumnRoles()


@dataclass(frozen=True)
class LinearScorer:
    """A fixed logistic scorer ``p = sigmoid(intercept + sum(w * x))``.

    Stands in for a trained model wherever results must be reproducible by
    an independent SQL engine; trained ``pyspark.ml`` models share the same
    scoring interface (``riskloom.plans.models``).
    """

    intercept: float
    weights: tuple[tuple[str, float], ...]
    name: str = "fixed_logistic"
    round_digits: int = 9

    def features(self) -> list[str]:
        return [f for f, _ in self.weights]


# The stand-in model of the oracle fixtures.
FIXED_SCORER = LinearScorer(-5.2, (("Glucose", 0.02), ("BMI", 0.03), ("Age", 0.01)))
# A second and third family for model comparison views.
ALT_SCORERS = [
    LinearScorer(-4.6, (("Glucose", 0.025), ("Age", 0.012)), name="glucose_age"),
    LinearScorer(-3.9, (("BMI", 0.05), ("Age", 0.02), ("Pregnancies", 0.05)), name="bmi_age_preg"),
]

