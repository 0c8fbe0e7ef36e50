"""Column names, limits and weights shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


@dataclass(frozen=True)
class Clause:
    """One rule of a verdict: metric column, limit column, comparison and text form."""

    name: str
    metric: str
    limit: str
    op: str
    default: float
    label: str
    digits: int
    unit: str
    only_if_set: bool = False

    @property
    def auto(self) -> str:
        return f"auto_{self.name}"


# The rules in the order their reasons are listed, with default limits and text.
CLAUSES = [
    Clause("fwhm", "fwhm", "max_fwhm", ">", 8.0, "FWHM", 2, " px"),
    Clause("fwhm_arcsec", "fwhm_arcsec", "max_fwhm_arcsec", ">", 20.0, "FWHM", 2, " as"),
    Clause("sqm", "sqm", "min_sqm", "<", 0.0, "SQM", 3, ""),
    Clause("sky_temp", "sky_temp", "max_sky_temp", ">", 40.0, "Sky temp", 1, "°"),
    Clause("hfr", "hfr", "max_hfr", ">", 4.5, "HFR", 2, " px"),
    Clause("eccentricity", "eccentricity", "max_eccentricity", ">", 0.6, "Eccentricity", 3, ""),
    Clause("mean_background", "mean_background", "max_mean_background", ">", 2000.0, "Mean BG", 0, ""),
    Clause("stars", "star_count", "min_stars", "<", 0.0, "Stars", 0, ""),
    Clause("trail", "trail_confidence", "min_trail", ">=", 80, "Satellite trail confidence", 0, "%", True),
    Clause("score", "score", "min_score", "<", 0.0, "Score", 1, "", True),
]
LIMIT_COLUMNS = [c.limit for c in CLAUSES]
AUTO_COLUMNS = [c.auto for c in CLAUSES]


@dataclass(frozen=True)
class Limits:
    """Limits of one filter group; defaults are the hard-coded starting values."""

    max_fwhm: float = 8.0
    max_fwhm_arcsec: float = 20.0
    min_sqm: float = 0.0
    max_sky_temp: float = 40.0
    max_hfr: float = 4.5
    max_eccentricity: float = 0.6
    max_mean_background: float = 2000.0
    min_stars: float = 0.0
    min_trail: int = 80
    min_score: float = 0.0
    auto_fwhm: bool = True
    auto_fwhm_arcsec: bool = True
    auto_sqm: bool = True
    auto_sky_temp: bool = True
    auto_hfr: bool = True
    auto_eccentricity: bool = True
    auto_mean_background: bool = True
    auto_stars: bool = True
    auto_trail: bool = True
    auto_score: bool = True

    @staticmethod
    def manual(**limits: float) -> Limits:
        """Limits that are kept as given."""
        return Limits(**limits, **{name: False for name in AUTO_COLUMNS})


LIMITS_SCHEMA = T.StructType(
    [T.StructField("group_key", T.StringType(), False)]
    + [
        T.StructField(f.name, {"float": T.DoubleType(), "int": T.IntegerType(), "bool": T.BooleanType()}[f.type])
        for f in fields(Limits)
    ]
)


def limits_table(spark: SparkSession, limits: dict[str, Limits]) -> DataFrame:
    """One row per group key; '' is the row other groups start from."""
    kinds = {"float": float, "int": int, "bool": bool}
    rows = [
        (key.strip().lower(), *[kinds[f.type](getattr(value, f.name)) for f in fields(Limits)])
        for key, value in limits.items()
    ]
    return spark.createDataFrame(rows, LIMITS_SCHEMA)


@dataclass(frozen=True)
class ScoredMetric:
    column: str
    weight: float
    lower_is_better: bool = True
    used: bool = True
    shown: bool = True

    @property
    def effective(self) -> float:
        return max(0.0, self.weight) if self.used and self.shown else 0.0


# Default score weights, in summing order.
SCORED = [
    ScoredMetric("fwhm", 3.0),
    ScoredMetric("eccentricity", 2.5),
    ScoredMetric("hfr", 1.5),
    ScoredMetric("star_count", 1.5, lower_is_better=False),
    ScoredMetric("mean_background", 0.5),
    ScoredMetric("trail_confidence", 2.0),
]


def finite(column: Column | str) -> Column:
    """The value as double, null where it is missing, NaN or infinite."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(INF)), value)
