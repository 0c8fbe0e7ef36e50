"""Header cards as a long table or as one map per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.headers import number
from nightsieve.functions.keys import strip_quotes


def key_values(
    df: DataFrame, text: str, pair_separator: str, key_separator: str = "=", comment: str | None = None
) -> DataFrame:
    """(…, seq, key, value): the pairs of a text; parts without a separator are left out.

    `comment` cuts a value at its first occurrence.  Separators are regular expressions.
    """
    parts = df.select("*", F.posexplode(F.split(F.col(text), pair_separator)).alias("seq", "_pair"))
    at = F.split("_pair", key_separator, 2)
    value = F.get(at, F.lit(1))
    if comment:
        value = F.get(F.split(value, comment, 2), F.lit(0))
    pairs = parts.withColumn("key", F.trim(F.get(at, F.lit(0)))).withColumn("value", F.trim(value))
    return pairs.filter(F.col("value").isNotNull() & (F.col("key") != "")).drop("_pair", text)


def last_card(cards: DataFrame, file: str, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """One row per file and keyword, ignoring case; the last duplicate wins."""
    return cards.groupBy(file, F.upper(key).alias("key")).agg(F.max_by(value, seq).alias("value"))


def card_map(cards: DataFrame, file: str, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """(file, cards): keyword -> text. A header has few distinct keywords, so the map stays small."""
    unique = last_card(cards, file, key, value, seq)
    return unique.groupBy(file).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("cards"))


def first_available_multi(
    entries: DataFrame,
    file: str,
    keys: Sequence[str],
    numeric: bool = True,
    positive: bool = True,
    source: str = "source",
    key: str = "key",
    value: str = "value",
) -> DataFrame:
    """(file, value): first usable synonym over ranked collections.

    For each synonym the lowest-ranked collection that holds a convertible value
    counts; the first synonym whose value passes (positive, or not blank) wins.
    """
    rank = F.array_position(F.array(*[F.lit(k.upper()) for k in keys]), F.upper(key))
    typed = number(F.col(value)) if numeric else strip_quotes(value)
    usable = (
        entries.select(file, source, rank.alias("_rank"), typed.alias("_v"))
        .filter((F.col("_rank") > 0) & F.col("_v").isNotNull())
    )
    per_key = usable.groupBy(file, "_rank").agg(F.min_by("_v", source).alias("_v"))
    if numeric and positive:
        per_key = per_key.filter(F.col("_v") > 0)
    return per_key.groupBy(file).agg(F.min_by("_v", "_rank").alias("value"))
