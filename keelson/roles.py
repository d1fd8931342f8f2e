"""Column roles: which column is the key, the label, a number or a category.

Every operator takes a :class:`RoleSpec`, so nothing below is tied to one
table; :data:`CUSTOMER` is the spec of the telecom customer table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Column names, allowed levels and sentinels of the customer table.
INTERNET_FIELDS = (
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)
NO_INTERNET = "No internet service"
NO_PHONE = "No phone service"

CUSTOMER_NUMERIC = ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges")
CUSTOMER_CATEGORICAL = (
    "gender",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
)
CUSTOMER_LEVELS = {
    "gender": ("Female", "Male"),
    "Partner": ("Yes", "No"),
    "Dependents": ("Yes", "No"),
    "PhoneService": ("Yes", "No"),
    "MultipleLines": ("Yes", "No", NO_PHONE),
    "InternetService": ("No", "DSL", "Fiber optic"),
    **{name: ("Yes", "No", NO_INTERNET) for name in INTERNET_FIELDS},
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": ("Yes", "No"),
    "PaymentMethod": (
        "Electronic check",
        "Mailed check",
        "Bank transfer (automatic)",
        "Credit card (automatic)",
    ),
}
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class Dependency:
    """``child`` must hold ``sentinel`` whenever ``parent`` holds ``value``."""

    parent: str
    value: str
    child: str
    sentinel: str
    parent_label: str


@dataclass(frozen=True)
class RoleSpec:
    id_col: str
    target_col: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    positive: str = "Yes"
    negative: str = "No"
    charge_col: str | None = None
    tenure_col: str | None = None
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    integral: tuple[str, ...] = ()
    dependencies: tuple[Dependency, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.id_col, *self.features, self.target_col)

    def check_columns(self, df: DataFrame, *, exact: bool = True) -> None:
        """Compare the spec with a schema (metadata only, no job)."""
        missing = [c for c in self.columns if c not in df.columns]
        extra = [c for c in df.columns if c not in self.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        if exact and extra:
            raise ValueError(f"unexpected columns: {extra}")

    @classmethod
    def infer(cls, df: DataFrame, target_col: str, id_col: str) -> RoleSpec:
        """Read roles off ``df.schema``: numeric types and booleans are numbers, the rest categories."""
        if target_col not in df.columns:
            raise ValueError(f"target column {target_col!r} not found")
        if id_col not in df.columns:
            raise ValueError(f"id column {id_col!r} not found")
        fields = [f for f in df.schema.fields if f.name not in (target_col, id_col)]
        if not fields:
            raise ValueError("no feature columns left after taking out target and id")
        numeric = tuple(f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)))
        rest = tuple(f.name for f in fields if f.name not in numeric)
        return cls(id_col=id_col, target_col=target_col, numeric=numeric, categorical=rest)


CUSTOMER = RoleSpec(
    id_col="customerID",
    target_col="Churn",
    numeric=CUSTOMER_NUMERIC,
    categorical=CUSTOMER_CATEGORICAL,
    charge_col="TotalCharges",
    tenure_col="tenure",
    levels=CUSTOMER_LEVELS,
    ranges={
        "SeniorCitizen": (0, 1),
        "tenure": (0, 100),
        "MonthlyCharges": (0, None),
        "TotalCharges": (0, None),
    },
    integral=("SeniorCitizen", "tenure"),
    dependencies=(
        *(
            Dependency("InternetService", "No", name, NO_INTERNET, "Internet Service")
            for name in INTERNET_FIELDS
        ),
        Dependency("PhoneService", "No", "MultipleLines", NO_PHONE, "Phone Service"),
    ),
)
