"""Table contracts: which columns a table must have and which values are valid.

A contract is data, not code: one ``ColumnRule`` per feature.  Validation,
zero-to-missing cleaning and preprocessing all read the same contract, so a
driver table (``customer``, ``lineitem`` ...) can be checked with exactly the
operators that check the patient table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnRule:
    name: str
    low: float | None = None          # closed range, nulls pass
    high: float | None = None
    zero_is_missing: bool = False     # 0 is replaced by null before imputation
    whole_number: bool = False        # value % 1 must be 0


@dataclass(frozen=True)
class TableContract:
    features: tuple[ColumnRule, ...]
    target: str | None = None
    target_values: tuple[int, ...] = (0, 1)
    row_id: str | None = None         # key column used as the row number
    extras: tuple[str, ...] = field(default_factory=tuple)

    @property
    def feature_names(self) -> list[str]:
        return [r.name for r in self.features]

    @property
    def zero_missing(self) -> list[str]:
        return [r.name for r in self.features if r.zero_is_missing]

    @property
    def whole_numbers(self) -> list[str]:
        return [r.name for r in self.features if r.whole_number]

    def rule(self, name: str) -> ColumnRule:
        for r in self.features:
            if r.name == name:
                return r
        raise KeyError(name)

    def without(self, removed: str | None) -> "TableContract":
        """Contract with one feature left out (leave-one-feature-out)."""
        if removed is None:
            return self
        return TableContract(tuple(r for r in self.features if r.name != removed),
                             self.target, self.target_values, self.row_id, self.extras)


# --- Fixed values (must equal the reference's contract) --------------------
# Feature order, valid closed ranges, zero-as-missing columns and whole-number
# columns of the patient table; target column and its labels; seed and the
# test share of the split; the expected layout of the audited file (original
# block of 768 rows, duplicate block up to row 1000, 10000 rows in all).
PATIENT_FEATURES = (
    ColumnRule("Pregnancies", 0, 20, zero_is_missing=False, whole_number=True),
    ColumnRule("Glucose", 0, 300, zero_is_missing=True),
    ColumnRule("BloodPressure", 0, 200, zero_is_missing=True),
    ColumnRule("SkinThickness", 0, 100, zero_is_missing=True),
    ColumnRule("Insulin", 0, 900, zero_is_missing=True),
    ColumnRule("BMI", 0, 70, zero_is_missing=True),
    ColumnRule("DiabetesPedigreeFunction", 0, 3),
    ColumnRule("Age", 1, 120, whole_number=True),
)
PATIENT_TARGET = "Outcome"
RANDOM_STATE = 42
TEST_PERCENT = 20
N_FOLDS = 5
ORIGINAL_ROW_COUNT = 768
DUPLICATE_BLOCK_END = 1000
EXPECTED_AUDITED_ROWS = 10000
MODEL_NAMES = ("ANN", "KNN", "SVM")
RISK_LABELS = {1: "High Risk", 0: "Low Risk"}
HISTORY_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Words the CSV reader treats as missing when they are the whole cell.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
            "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
            "n/a", "nan", "null")
# AUC bands: lower bound of each band, best first.
AUC_BANDS = ((0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair"))
AUC_BAND_ELSE = "Poor"
# ---------------------------------------------------------------------------

PATIENT = TableContract(PATIENT_FEATURES, target=PATIENT_TARGET)


# Contracts over the driver tables that stand in for the patient table in the
# registered queries (FIXTURES.md section 3).
LINEITEM = TableContract(
    (
        ColumnRule("l_quantity", 1, 50, whole_number=True),
        ColumnRule("l_extendedprice", 0, 200000),
        ColumnRule("l_discount", 0, 0.1, zero_is_missing=True),
        ColumnRule("l_tax", 0, 0.08, zero_is_missing=True),
    ),
    target="label",
)

CUSTOMER = TableContract(
    (
        ColumnRule("c_acctbal", 0, 10000),
        ColumnRule("c_nationkey", 0, 24, whole_number=True),
    ),
    row_id="c_custkey",
)

PART = TableContract(
    (
        ColumnRule("p_size", 1, 45, whole_number=True),
        ColumnRule("p_retailprice", 900, 999.5),
    ),
    row_id="p_partkey",
)

EVENT_BATCH = TableContract(
    (
        ColumnRule("user_id", 0, None, whole_number=True),
        ColumnRule("value", 0, 250),
    ),
    row_id="event_id",
)

# every dimension of the embeddings table is a feature (the loader checks the length)
EMBED_FEATURES = tuple(f"e{i}" for i in range(64))
