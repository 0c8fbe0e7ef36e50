"""Values out of header cards and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightsieve.functions.keys import contains_ci, normalize_key, strip_quotes

# Keyword synonyms in order of preference.
FOCAL_LENGTH = ["FOCALLEN", "FOCAL", "FOCAL_LENGTH", "FOCLEN"]
PIXEL_SIZE = ["XPIXSZ", "PIXSIZE", "PIXELSZ", "PIXSZ", "PIXELSIZE"]
PIXEL_SIZE_RANKED = ["XPIXSZ", "YPIXSZ", "PIXSIZE", "PIXELSZ", "PIXSZ", "PIXELSIZE"]
PIXEL_SIZE_X, PIXEL_SIZE_Y = "XPIXSIZE", "YPIXSIZE"
EXPOSURE = ["EXPTIME", "EXPOSURE", "EXPOSURETIME"]
FILTER = ["FILTER", "INSFLNAM", "FILTERID"]
SKY_TEMP = ["SKYTEMP"]
BAYER = ["BAYERPAT", "COLORTYP", "BAYEROFF"]
IMAGE_TYPE = ["IMAGETYP", "FRAME"]
DATE = ["DATE-OBS", "DATEOBS", "DATE_OBS"]
SQM_PATTERN = r"(?i)(?:%SQM%|SQM[_-])(\d{1,2}\.\d{1,3})(?:%|(?=[_.-]|$))"
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]


def card(cards: Column | str, key: str) -> Column:
    """Raw text of a card in a map keyed by upper-case keyword; null when absent."""
    column = F.col(cards) if isinstance(cards, str) else cards
    return F.element_at(column, F.lit(key.upper()))


def number(raw: Column) -> Column:
    """Card text as a double: quotes dropped, D exponents allowed, null when it is no number."""
    return strip_quotes(F.translate(raw, "Dd", "EE")).try_cast("double")


def first_available(cards: Column | str, keys: Sequence[str], positive: bool = True) -> Column:
    """First synonym holding a number (a positive one unless told otherwise)."""
    values = [number(card(cards, k)) for k in keys]
    return F.coalesce(*[F.when(v > 0, v) for v in values] if positive else values)


def first_text(cards: Column | str, keys: Sequence[str]) -> Column:
    """First synonym holding text, without quotes."""
    return F.coalesce(*[strip_quotes(card(cards, k)) for k in keys])


def integer(cards: Column | str, key: str, default: int) -> Column:
    return F.coalesce(number(card(cards, key)).try_cast("int"), F.lit(default))


def resolve_pixel_size(
    cards: Column | str, keys: Sequence[str] = PIXEL_SIZE, x_key: str = PIXEL_SIZE_X, y_key: str = PIXEL_SIZE_Y
) -> Column:
    """First pixel size synonym, else the mean of both axes, else the one that is there."""
    x, y = first_available(cards, [x_key]), first_available(cards, [y_key])
    return F.coalesce(first_available(cards, keys), (x + y) / F.lit(2.0), x, y)


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a header text, UTC where it names no offset; null when it cannot be read."""
    attempts = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*attempts)


def resolve_timestamp(cards: Column | str, keys: Sequence[str] = DATE) -> Column:
    return parse_timestamp(first_text(cards, keys))


def sqm_from_name(name: Column | str) -> Column:
    """Sky quality reading in a file name, else null."""
    column = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.regexp_extract(column, SQM_PATTERN, 1), F.lit("")).try_cast("double")


def is_light(image_type: Column | str) -> Column:
    """Blank image types count as light frames."""
    return (normalize_key(image_type) == "") | contains_ci(image_type, "light")
