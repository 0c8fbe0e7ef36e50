"""Per-group limits: automatic values, lookup with fallback, edits, verdict rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.display import fixed
from nightsieve.functions.keys import group_key
from nightsieve.plans.lookup import checked
from nightsieve.schema import AUTO_COLUMNS, CLAUSES, INF, LIMIT_COLUMNS, LIMITS_SCHEMA, Clause, finite


def clauses_for(df: DataFrame, skip: Iterable[str] = ()) -> list[Clause]:
    """The rules whose metric the table has."""
    return [c for c in CLAUSES if c.metric in df.columns and c.name not in set(skip)]


def _stored_type(name: str) -> str:
    return LIMITS_SCHEMA[name].dataType.simpleString()


def with_thresholds(
    df: DataFrame, thresholds: DataFrame | None, group: Column | None = None, out_key: str = "group_key"
) -> DataFrame:
    """Attach each row's limits: its group's row, else the '' row, else the defaults."""
    group = group_key("filter_name") if group is None else group
    keyed = df.withColumn(out_key, group)
    names = [n for n in LIMITS_SCHEMA.names if n != "group_key"]
    defaults = {c.limit: F.lit(c.default) for c in CLAUSES} | {a: F.lit(True) for a in AUTO_COLUMNS}
    if thresholds is None:
        return keyed.withColumns({n: defaults[n].cast(_stored_type(n)) for n in names})
    table, fits = checked(thresholds)
    base = table.filter(F.col("group_key") == "").agg(F.first(F.struct(*names)).alias("b"))
    side = table.select(F.col("group_key").alias("_k"), F.struct(*names).alias("_t"))
    joined = keyed.join(F.broadcast(side) if fits else side, F.col(out_key) == F.col("_k"), "left")
    joined = joined.withColumn("_b", base.scalar())
    return joined.withColumns(
        {n: F.coalesce(F.col(f"_t.{n}"), F.col(f"_b.{n}"), defaults[n]).cast(_stored_type(n)) for n in names}
    ).drop("_k", "_t", "_b")


def _measured_limits(df: DataFrame) -> list[Column]:
    """Largest (or smallest) value of each metric in the group, null where none is valid."""
    out = []
    for c in CLAUSES:
        if c.only_if_set or c.metric not in df.columns:
            continue
        pick = F.min if c.op == "<" else F.max
        out.append(pick(finite(c.metric)).alias(f"_m_{c.name}"))
    return out


def auto_thresholds(
    df: DataFrame,
    stored: DataFrame | None = None,
    group: Column | None = None,
    preserve_existing: bool = False,
    skip: Iterable[str] = (),
) -> DataFrame:
    """Limits at the extremes of each group, where a limit's auto flag is on.

    Metrics without any valid value fall back to their defaults; the trail limit is
    80 and the score limit 0.  `preserve_existing` keeps groups that are stored
    already; `skip` names rules that are switched off and keep their stored limit.
    """
    group = group_key("filter_name") if group is None else group
    measured = df.groupBy(group.alias("group_key")).agg(*_measured_limits(df))
    current = with_thresholds(measured, stored, F.col("group_key"))
    if stored is not None and preserve_existing:
        known = stored.select(F.col("group_key").alias("_known")).distinct()
        current = current.join(known, F.col("group_key") == F.col("_known"), "left")
    else:
        current = current.withColumn("_known", F.lit(None).cast("string"))
    values = {}
    for c in CLAUSES:
        if c.name in set(skip):
            continue
        source = F.col(f"_m_{c.name}") if f"_m_{c.name}" in current.columns else F.lit(None)
        fresh = F.coalesce(source, F.lit(c.default)).cast(_stored_type(c.limit))
        values[c.limit] = F.when(F.col(c.auto) & F.col("_known").isNull(), fresh).otherwise(F.col(c.limit))
    return current.withColumns(values).select(*LIMITS_SCHEMA.names)


def reset_thresholds(
    df: DataFrame, stored: DataFrame, keys: Sequence[str] | None = None, group: Column | None = None
) -> DataFrame:
    """Limits of the selected groups back to their extremes; trail off, score 0; other rows kept."""
    group = group_key("filter_name") if group is None else group
    measured = df.groupBy(group.alias("group_key")).agg(*_measured_limits(df))
    if keys is not None:
        measured = measured.filter(F.col("group_key").isin([k.strip().lower() for k in keys]))
    current = with_thresholds(measured, stored, F.col("group_key"))
    values = {
        c.limit: F.coalesce(F.col(f"_m_{c.name}"), F.lit(c.default)).cast(_stored_type(c.limit))
        for c in CLAUSES
        if f"_m_{c.name}" in current.columns
    }
    values |= {"min_score": F.lit(0.0), "min_trail": F.lit(0), "auto_trail": F.lit(False)}
    fresh = current.withColumns(values).select(*LIMITS_SCHEMA.names)
    kept = stored.join(fresh.select("group_key"), "group_key", "left_anti").select(*LIMITS_SCHEMA.names)
    return fresh.unionByName(kept)


def scope_update(
    thresholds: DataFrame, limit: str, value: float | bool, selected: Sequence[str], all_keys: Sequence[str]
) -> DataFrame:
    """Set one limit for the selected groups (none selected = all rows, and no list of keys is needed).

    When the selection covers every group the '' row, from which new groups start,
    is set as well.
    """
    chosen = {k.strip().lower() for k in selected}
    if not chosen or chosen >= {k.strip().lower() for k in all_keys}:
        hit = F.lit(True)
    else:
        hit = F.col("group_key").isin(list(chosen))
    new = F.lit(value).cast(_stored_type(limit))
    return thresholds.withColumn(limit, F.when(hit, new).otherwise(F.col(limit)))


def scope_value(thresholds: DataFrame, limit: str, selected: Sequence[str], all_keys: Sequence[str]) -> DataFrame:
    """The value shown for a scope: that of its first group."""
    first = ([k.strip().lower() for k in selected] or [k.strip().lower() for k in all_keys] or [""])[0]
    return thresholds.filter(F.col("group_key") == first).select("group_key", F.col(limit).alias("value"))


def effective_thresholds(df: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """Limits of switched-off rules become values that reject nothing."""
    values = {}
    for c in CLAUSES:
        if c.limit in df.columns and not enabled.get(c.name, True):
            neutral = 0 if c.only_if_set else (-INF if c.op == "<" else INF)
            values[c.limit] = F.lit(neutral).cast(_stored_type(c.limit))
    return df.withColumns(values) if values else df


def violation(c: Clause) -> Column:
    """True where the row breaks the rule; missing and NaN values never do."""
    metric = F.col(c.metric).cast("double")
    limit = F.col(c.limit)
    hit = {">": metric > limit, "<": metric < limit, ">=": metric >= limit}[c.op]
    hit = hit & ~F.isnan(metric)
    if c.only_if_set:
        hit = hit & (limit > 0)
    return F.coalesce(hit, F.lit(False))


def threshold_predicate(clauses: Sequence[Clause] = CLAUSES) -> Column:
    """True where any rule is broken."""
    result = F.lit(False)
    for c in clauses:
        result = result | violation(c)
    return result


def rejection_reasons(clauses: Sequence[Clause] = CLAUSES) -> Column:
    """One text per broken rule, in rule order."""
    sign = {">": ">", "<": "<", ">=": "≥"}
    texts = []
    for c in clauses:
        number = F.col(c.metric).cast("string") if c.metric in ("star_count", "trail_confidence") else fixed(c.metric, c.digits)
        limit = F.col(c.limit).cast("string") if c.name == "trail" else fixed(c.limit, c.digits)
        text = F.concat(
            F.lit(c.label + " "), number, F.lit(f"{c.unit}  {sign[c.op]}  limit "), limit, F.lit(c.unit)
        )
        texts.append(F.when(violation(c), text))
    return F.array_compact(F.array(*texts))


def rejection_details(clauses: Sequence[Clause] = CLAUSES) -> Column:
    """Structured reasons: metric, value, comparison, limit and by how much it is exceeded."""
    parts = []
    for c in clauses:
        value, limit = F.col(c.metric).cast("double"), F.col(c.limit).cast("double")
        excess = limit - value if c.op == "<" else value - limit
        parts.append(
            F.when(
                violation(c),
                F.struct(
                    F.lit(c.name).alias("metric"), value.alias("value"), F.lit(c.op).alias("op"),
                    limit.alias("limit"), excess.alias("excess"),
                ),
            )
        )
    return F.array_compact(F.array(*parts))


def apply_thresholds(
    df: DataFrame,
    stored: DataFrame | None = None,
    group: Column | None = None,
    enabled: dict[str, bool] | None = None,
    peers: DataFrame | None = None,
) -> DataFrame:
    """Full pass: automatic limits, masks, verdict, reasons, override.

    `peers` are the rows automatic limits are taken from, by default `df`; pass the
    table before scoring, so that limits do not wait for scores.  Adds group_key, auto_rejected, reasons and is_rejected.  A table without a
    `manual_override` column has no overrides.
    """
    enabled = enabled or {}
    off = [name for name, on in enabled.items() if not on]
    limits = auto_thresholds(df if peers is None else peers, stored, group, skip=off)
    judged = effective_thresholds(with_thresholds(df, limits, group), enabled)
    clauses = clauses_for(df)
    judged = judged.withColumn("auto_rejected", threshold_predicate(clauses))
    reasons = F.when(F.col("auto_rejected"), rejection_reasons(clauses)).otherwise(F.array().cast("array<string>"))
    override = F.col("manual_override") if "manual_override" in df.columns else F.lit(None).cast("boolean")
    return (
        judged.withColumn("reasons", reasons)
        .withColumn("is_rejected", F.coalesce(override, F.col("auto_rejected")))
        .drop(*LIMIT_COLUMNS, *AUTO_COLUMNS)
    )
