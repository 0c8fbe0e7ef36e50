"""Peer-relative scores: rank percentiles, the quality score, traffic lights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.display import quality_band as quality_columns
from nightsieve.functions.keys import group_key
from nightsieve.plans.lookup import MAX_LOOKUP_ROWS, checked
from nightsieve.plans.ranges import value_prefix
from nightsieve.schema import SCORED, ScoredMetric, finite
from nightsieve.session import cut


def _with_percentiles(df: DataFrame, group: Column, metrics: dict[str, bool], prefix: str) -> DataFrame:
    """The rows with `_g`, their group, and pct_<metric>.

    The percentiles of the distinct (group, metric, value) are worked out once.  A row then looks its own up, one
    metric after the other: from a broadcast table while the tables are small, else by a join without a hint.
    """
    names = list(metrics)
    keyed = df.withColumn("_g", group).withColumns({f"_v{i}": finite(n) for i, n in enumerate(names)})
    entries = F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"_v{i}").alias("v")) for i in range(len(names))])
    long = keyed.select("_g", F.explode(entries).alias("e")).select("_g", F.col("e.m").alias("m"), F.col("e.v").alias("v"))
    n = F.col("valid")
    share = (F.col("below") + (F.col("below") + F.col("w") - 1)) / F.lit(2.0) / (n - F.lit(1.0))
    lower = F.element_at(F.array(*[F.lit(bool(metrics[name])) for name in names]), F.col("m") + 1)
    percentile = (
        F.when(F.col("total") == 1, F.lit(1.0))
        .when(F.col("v").isNull(), F.lit(0.0))
        .when(n == 1, F.lit(1.0))
        .when(lower, F.lit(1.0) - share)
        .otherwise(share)
    )
    ranked = value_prefix(long, ["_g", "m"], "v")
    table = cut(ranked.select(F.col("_g").alias("_k"), "m", F.col("v").alias("_v"), percentile.alias("_pct")))
    values = {r["m"]: r["count"] for r in table.groupBy("m").count().collect()}
    room = MAX_LOOKUP_ROWS
    for i in sorted(range(len(names)), key=lambda i: values.get(i, 0)):
        one = table.filter(F.col("m") == i).select("_k", "_v", F.col("_pct").alias(prefix + names[i]))
        one, fits = checked(one, room) if values.get(i, 0) <= room else (one, False)
        room -= values.get(i, 0)
        same = F.col("_g").eqNullSafe(F.col("_k")) & F.col(f"_v{i}").eqNullSafe(F.col("_v"))
        keyed = keyed.join(F.broadcast(one) if fits else one, same, "left").drop("_k", "_v", f"_v{i}")
    return keyed


def rank_percentile(
    df: DataFrame,
    id_col: str,
    group: Column,
    metrics: dict[str, bool],
    prefix: str = "pct_",
) -> DataFrame:
    """(id, group_key, pct_<metric>...): average rank within the group on 0..1.

    `metrics` maps a column to "lower is better".  Missing and non-finite values
    get 0, a single valid value 1, and the only row of a group 1 whatever it holds.
    All metrics go through one shuffle as (group, metric, value) counts, so the work
    after the first aggregate depends on the number of distinct values, and a large
    group is ranked range by range.
    """
    needed = df.select(id_col, group.alias("_group"), *[n for n in metrics if n != id_col])
    ranked = _with_percentiles(needed, F.col("_group"), metrics, prefix)
    return ranked.select(id_col, F.col("_g").alias("group_key"), *[prefix + n for n in metrics])


def weighted_score(metrics: Sequence[ScoredMetric], prefix: str = "pct_") -> Column:
    """Weighted mean of percentiles on 0..5; 0 when no weight is set."""
    total = sum(m.effective for m in metrics)
    if total <= 5e-324:
        return F.lit(0.0)
    acc = None
    for m in metrics:
        term = F.col(prefix + m.column) * F.lit(float(m.effective))
        acc = term if acc is None else acc + term
    return F.least(F.greatest(acc / F.lit(float(total)) * F.lit(5.0), F.lit(0.0)), F.lit(5.0))


def quality_score(
    df: DataFrame, id_col: str = "frame_id", group: Column | None = None, metrics: Sequence[ScoredMetric] = SCORED
) -> DataFrame:
    """(id, group_key, pct_..., score) for every row; metrics without weight are not ranked."""
    group = group_key("filter_name") if group is None else group
    active = [m for m in metrics if m.effective > 0]
    if not active:
        return df.select(id_col, group.alias("group_key"), F.lit(0.0).alias("score"))
    ranked = rank_percentile(df, id_col, group, {m.column: m.lower_is_better for m in active})
    return ranked.withColumn("score", weighted_score(active))


def with_score(
    df: DataFrame, id_col: str = "frame_id", group: Column | None = None, metrics: Sequence[ScoredMetric] = SCORED
) -> DataFrame:
    """The input rows plus their score."""
    rest = [c for c in df.columns if c != id_col]
    active = {m.column: m.lower_is_better for m in metrics if m.effective > 0}
    if not active:
        return df.select(id_col, *rest, F.lit(0.0).alias("score"))
    ranked = _with_percentiles(df, group_key("filter_name") if group is None else group, active, "_pct_")
    return ranked.select(id_col, *rest, weighted_score([m for m in metrics if m.effective > 0], "_pct_").alias("score"))


def quality_band(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumns(quality_columns(score))


def _light(value: Column, average: Column, lower_is_better: bool) -> Column:
    low, high = value <= average * F.lit(0.92), value >= average * F.lit(1.08)
    good, bad = (low, high) if lower_is_better else (high, low)
    return F.when(good, "green").when(bad, "red").otherwise("yellow")


def traffic_light(
    df: DataFrame,
    group: Column | None = None,
    by_session: Sequence[str] = ("fwhm", "hfr", "eccentricity"),
    by_group: dict[str, bool] | None = None,
    trail: str | None = "trail_confidence",
) -> DataFrame:
    """`<metric>_light` columns: within 8 % of the mean is yellow.

    `by_session` metrics are compared with the mean of all rows, `by_group` ones
    (column -> lower is better) with the mean of their group.  The means come from one
    aggregate with a row per group, not from a window over the group.
    """
    group = group_key("filter_name") if group is None else group
    by_group = by_group if by_group is not None else {"star_count": False, "mean_background": True}
    keyed = df.withColumn("_g", group)
    sums = []
    for name in [*by_session, *by_group]:
        sums += [F.sum(F.col(name).cast("double")).alias(f"_s_{name}"), F.count(name).alias(f"_n_{name}")]
    stats, fits = checked(keyed.groupBy("_g").agg(*sums))
    overall = stats.agg(*[(F.sum(f"_s_{n}") / F.sum(f"_n_{n}")).alias(f"_avg_{n}") for n in by_session])
    means = stats.select(
        F.col("_g").alias("_g2"), *[(F.col(f"_s_{n}") / F.col(f"_n_{n}")).alias(f"_avg_{n}") for n in by_group]
    )
    joined = keyed.join(F.broadcast(means) if fits else means, F.col("_g").eqNullSafe(F.col("_g2")), "left")
    joined = joined.withColumn("_all", overall.select(F.struct(*overall.columns)).scalar())
    lights = {f"{n}_light": _light(F.col(n), F.col(f"_all._avg_{n}"), True) for n in by_session}
    lights |= {f"{n}_light": _light(F.col(n), F.col(f"_avg_{n}"), lower) for n, lower in by_group.items()}
    if trail:
        lights[f"{trail}_light"] = F.when(F.col(trail) >= 60, "red").otherwise("green")
    return joined.withColumns(lights).drop("_g", "_g2", "_all", *[f"_avg_{n}" for n in by_group])
