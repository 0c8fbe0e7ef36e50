"""Group keys and filter categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First letter -> category, short name, group, sort order, chip colours.
CATEGORIES = {
    "H": ("Ha", "Ha", "Narrowband", 0, "#33C44D4D", "#E07A7A", "#FFFFE8E8"),
    "O": ("OIII", "OIII", "Narrowband", 1, "#3340B5B5", "#6FD8D8", "#FFE0FFFF"),
    "S": ("SII", "SII", "Narrowband", 2, "#33C7A23A", "#E0C36F", "#FFFFF4D8"),
    "L": ("Lum", "L", "LRGB", 10, "#33CCCCCC", "#DDDDDD", "#FFFFFFFF"),
    "R": ("Red", "R", "LRGB", 11, "#33D14545", "#FF7070", "#FFFFE0E0"),
    "G": ("Green", "G", "LRGB", 12, "#3358B85F", "#7FE090", "#FFE0FFE5"),
    "B": ("Blue", "B", "LRGB", 13, "#334F78D1", "#8FB3FF", "#FFE8F0FF"),
}
OTHER = ("Unknown", None, "Other", 100, "#222F426B", "#6D88C4", "#FFE8F0FF")

_SPACE = r"(?U)^\s+|\s+$"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def normalize_key(column: Column | str) -> Column:
    """Null or blank -> '', else trimmed of any white space."""
    return F.coalesce(F.regexp_replace(_col(column), _SPACE, ""), F.lit(""))


def group_key(column: Column | str) -> Column:
    """Case-insensitive form of the key, the one to group and join by."""
    return F.lower(normalize_key(column))


def labelled_key(column: Column | str, blank: str, trimmed: bool) -> Column:
    """Case-sensitive key with a label for blanks, as summaries and move counters show it."""
    text = normalize_key(column)
    return F.when(text == "", F.lit(blank)).otherwise(text if trimmed else _col(column))


def _pick(letter: Column, position: int, other: Column) -> Column:
    result = None
    for first, row in CATEGORIES.items():
        value = F.lit(row[position])
        result = F.when(letter == first, value) if result is None else result.when(letter == first, value)
    return result.otherwise(other)


def _letter(column: Column | str) -> Column:
    return F.upper(F.substring(normalize_key(column), 1, 1))


def classify_filter(column: Column | str) -> Column:
    return _pick(_letter(column), 0, F.lit(OTHER[0]))


def filter_display(column: Column | str) -> Column:
    """Canonical short name; an unknown filter keeps its own."""
    return _pick(_letter(column), 1, normalize_key(column))


def filter_group(column: Column | str) -> Column:
    return _pick(_letter(column), 2, F.lit(OTHER[2]))


def filter_order(column: Column | str) -> Column:
    return _pick(_letter(column), 3, F.lit(OTHER[3]))


def filter_colors(column: Column | str) -> Column:
    """Chip background, border and foreground."""
    letter = _letter(column)
    return F.struct(
        *[_pick(letter, i, F.lit(OTHER[i])).alias(n) for i, n in ((4, "background"), (5, "border"), (6, "foreground"))]
    )


def split_list(column: Column | str, separator: str = ";") -> Column:
    """Items of a separated list, trimmed, blanks dropped."""
    items = F.transform(F.split(_col(column), separator), lambda x: F.regexp_replace(x, _SPACE, ""))
    return F.filter(items, lambda x: x != "")


def strip_quotes(column: Column | str) -> Column:
    """Trim, then drop quotes and blanks at both ends; blank -> null."""
    text = F.btrim(_col(column), F.lit(" \t\r\n'\""))
    return F.nullif(text, F.lit(""))


def contains_ci(column: Column | str, part: str) -> Column:
    return F.contains(F.lower(_col(column)), F.lit(part.lower()))
