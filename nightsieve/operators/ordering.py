"""Orders, neighbours, top-k and separation-aware picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightsieve.plans.ranges import row_index, sort_keys, with_halo

# Fields a list can be sorted by -> frames column.
SORT_FIELDS = {
    "Score": "score", "ObservationDate": "exposure_ts", "Fwhm": "fwhm", "FwhmArcsec": "fwhm_arcsec", "Sqm": "sqm",
    "SkyTemp": "sky_temp", "Hfr": "hfr", "StarCount": "star_count", "Eccentricity": "eccentricity",
    "MeanBackground": "mean_background", "Median": "median", "Mad": "mad", "Min": "min", "MinCount": "min_count",
    "Max": "max", "MaxCount": "max_count",
}
DEFAULT_RULES = (("ObservationDate", "asc"),)


def add_rule(
    rules: Sequence[tuple[str, str]], field: str | None = None, direction: str = "asc"
) -> list[tuple[str, str]]:
    """Append a rule, by default on the first unused field; the list holds at most one per field kind."""
    if len(rules) >= len(SORT_FIELDS):
        return list(rules)
    used = {name for name, _ in rules}
    field = field or next((f for f in SORT_FIELDS if f not in used), next(iter(SORT_FIELDS)))
    if field not in SORT_FIELDS:
        raise ValueError(f"unknown sort field {field}")
    return [*rules, (field, direction)]


def remove_rule(rules: Sequence[tuple[str, str]], position: int) -> list[tuple[str, str]]:
    """Remove a rule; the last one stays."""
    return list(rules) if len(rules) <= 1 else [r for i, r in enumerate(rules) if i != position]


def _prepared(df: DataFrame, rules: Sequence[tuple[str, str]], name: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Order columns for the rules: text ignores case, NaN is the smallest number, the name breaks ties."""
    types = dict(df.dtypes)
    columns, order = {}, []
    for i, (field, direction) in enumerate(rules):
        source = SORT_FIELDS[field]
        if types[source] in ("double", "float"):
            nan = F.when(F.col(source).isNull(), F.lit(None)).otherwise(~F.isnan(F.col(source)))
            columns[f"_o{i}n"] = nan
            order.append((f"_o{i}n", direction))
        columns[f"_o{i}"] = F.lower(source) if types[source] == "string" else F.col(source)
        order.append((f"_o{i}", direction))
    columns["_name"] = F.lower(name)
    return df.withColumns(columns), [*order, ("_name", "asc")]


def multi_sort(df: DataFrame, rules: Sequence[tuple[str, str]] = DEFAULT_RULES, name: str = "file_name") -> DataFrame:
    """Sort by 1..16 rules; missing values last in both directions, then by name."""
    prepared, order = _prepared(df, rules, name)
    keys = [k.order() for k in sort_keys(order)]
    return prepared.orderBy(*keys).drop(*[o for o, _ in order])


def sort_position(
    df: DataFrame, rules: Sequence[tuple[str, str]] = DEFAULT_RULES, name: str = "file_name", unique: str = "frame_id"
) -> DataFrame:
    """The rows with their 0-based `idx` in the sorted list, computed range by range."""
    prepared, order = _prepared(df, rules, name)
    return row_index(prepared, [*order, (unique, "asc")]).drop(*[o for o, _ in order])


def neighbours(indexed: DataFrame, id_col: str = "frame_id", chunk: int = 65536) -> DataFrame:
    """Previous and next row of an indexed list; the ends point at themselves."""
    haloed = with_halo(indexed.select(id_col, "idx"), 1, 1, chunk=chunk)
    order = Window.partitionBy("_chunk").orderBy("idx")
    return (
        haloed.withColumn("prev_id", F.coalesce(F.lag(id_col).over(order), F.col(id_col)))
        .withColumn("next_id", F.coalesce(F.lead(id_col).over(order), F.col(id_col)))
        .filter("_own").select(id_col, "idx", "prev_id", "next_id")
    )


def neighbourhood(
    indexed: DataFrame, ahead: int, behind: int, id_col: str = "frame_id", chunk: int = 65536
) -> DataFrame:
    """`nearby`: up to `ahead` following and `behind` preceding rows, nearest first, following before preceding."""
    haloed = with_halo(indexed.select(id_col, "idx"), behind, ahead, chunk=chunk)
    order = Window.partitionBy("_chunk").orderBy("idx")
    slots = []
    for step in range(1, max(ahead, behind) + 1):
        if step <= ahead:
            slots.append(F.lead(id_col, step).over(order))
        if step <= behind:
            slots.append(F.lag(id_col, step).over(order))
    return (
        haloed.withColumn("nearby", F.array_compact(F.array(*slots))).filter("_own").select(id_col, "idx", "nearby")
    )


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group. Each task keeps k rows per group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def argmax(df: DataFrame, keys: Sequence[str], score: str, y: str = "y", x: str = "x") -> DataFrame:
    """Best cell of each score map, the first in row order on ties."""
    best = F.max_by(F.struct(y, x), F.struct(F.col(score), -F.col(y), -F.col(x)))
    return (
        df.groupBy(*keys).agg(best.alias("_b"), F.max(score).alias(score))
        .select(*keys, F.col(f"_b.{y}").alias(y), F.col(f"_b.{x}").alias(x), score)
    )
