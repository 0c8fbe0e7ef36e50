"""Text forms of metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def fixed(column: Column | str, digits: int) -> Column:
    """Fixed-point text, exact on the binary value, ties away from zero.

    A tie at `digits` places is a value whose product with 2**(digits+1) is odd;
    it is nudged outward so that the formatter's half-even rule does not apply.
    """
    x = _col(column).cast("double")
    scaled = F.abs(x) * F.lit(float(2 ** (digits + 1)))
    tie = (scaled == F.floor(scaled)) & (F.pmod(scaled, F.lit(2.0)) == 1.0)
    nudged = F.when(tie, x + F.signum(x) * F.lit(10.0 ** -(digits + 3))).otherwise(x)
    return F.call_function("format_number", nudged, F.lit("0" if digits == 0 else "0." + "0" * digits))


def or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit("n/a"))


def quality_label(score: Column | str) -> Column:
    s = _col(score)
    return F.when(s >= 4.0, "GOOD").when(s >= 2.0, "FAIR").otherwise("POOR")


def star_rating(score: Column | str) -> Column:
    """Filled stars: half-to-even rounding, 0..5."""
    return F.least(F.greatest(F.rint(_col(score)), F.lit(0.0)), F.lit(5.0)).cast("int")


def star_text(score: Column | str) -> Column:
    filled = star_rating(score)
    return F.concat(F.repeat(F.lit("★"), filled), F.repeat(F.lit("☆"), F.lit(5) - filled))


def score_percent(score: Column | str) -> Column:
    return F.least(F.greatest(_col(score) / F.lit(5.0) * F.lit(100.0), F.lit(0.0)), F.lit(100.0))


def quality_band(score: Column | str) -> dict[str, Column]:
    return {
        "quality": quality_label(score),
        "rating": star_rating(score),
        "rating_text": star_text(score),
        "score_percent": score_percent(score),
        "score_text": F.concat(fixed(score, 1), F.lit("/5")),
    }


def format_integration(seconds: Column | str) -> Column:
    """Hours from one hour on, else minutes."""
    s = _col(seconds).cast("double")
    return F.when(s / F.lit(3600.0) >= 1.0, F.concat(fixed(s / F.lit(3600.0), 1), F.lit(" h"))).otherwise(
        F.concat(fixed(s / F.lit(60.0), 0), F.lit(" min"))
    )


def display_columns() -> dict[str, Column]:
    """Text columns over the frames table's own names."""
    ts = F.col("exposure_ts")
    filter_text = F.regexp_replace("filter_name", r"(?U)^\s+|\s+$", "")
    return {
        "exposure_text": or_na(F.concat(fixed("exposure_s", 1), F.lit("s"))),
        "timestamp_text": or_na(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")),
        "filter_text": F.when(F.coalesce(filter_text, F.lit("")) == "", "n/a").otherwise(F.col("filter_name")),
        "sqm_text": or_na(fixed("sqm", 3)),
        "sky_temp_text": or_na(F.concat(fixed("sky_temp", 1), F.lit("°"))),
        "background_text": or_na(F.concat(fixed("mean_background", 0), F.lit(" ADU"))),
        "trail_text": F.when(
            F.col("trail_confidence") > 0, F.concat(F.col("trail_confidence").cast("string"), F.lit("%"))
        ).otherwise("–"),
    }


def extremum_text(value: Column | str, count: Column | str) -> Column:
    return F.concat(fixed(value, 0), F.lit(" ADU ("), _col(count).cast("string"), F.lit("x)"))


def arcsec_text(value: Column | str) -> Column:
    return or_na(F.when(_col(value) > 0, F.concat(fixed(value, 2), F.lit('"'))))
