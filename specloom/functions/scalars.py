"""Scalar column builders: names, tokens, keys and safe formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spectral import as_col

# Label tokens, day domain, never code, slots and plate naming.
NEVER_TOKENS = ("-1", "never", "none", "n")
UNSCORED_TOKENS = ("", "-", "na", "n/a", "null", "?", "tbd")
DAYS = (1, 2, 3, 4, 5)
NEVER = -1
SLOT_HOURS = {1: 0.0, 9: 8.0}
GROUPS_PER_STRATUM = 5
HOURS_PER_DAY = 24.0
STAMP_PATTERN = r"_([0-9a-fA-F]+)_w"
CAPTURE_PATTERN = r"([a-z]+)_images/day(\d+)/dish(\d+)/([a-z]+)"


def exposure_us(name: Column | str) -> Column:
    """Exposure in microseconds from a folder name such as 2100 or 60k; NULL otherwise."""
    c = as_col(name)
    digits = F.regexp_extract(c, r"^(\d+)(k?)$", 1)
    kilo = F.regexp_extract(c, r"^(\d+)(k?)$", 2) == "k"
    return F.when(digits != "", digits.cast("bigint") * F.when(kilo, 1000).otherwise(1))


def line_stamp(name: Column | str) -> Column:
    """The hexadecimal time stamp inside a line file name; NULL when there is none."""
    h = F.regexp_extract(as_col(name), STAMP_PATTERN, 1)
    return F.when(h != "", F.conv(h, 16, 10).cast("bigint"))


def capture_key(path: Column | str) -> Column:
    """struct(mode, day, dish, side) from a capture path."""
    c = as_col(path)
    part = lambda i: F.regexp_extract(c, CAPTURE_PATTERN, i)
    key = F.struct(
        part(1).alias("mode"), part(2).try_cast("int").alias("day"), part(3).try_cast("int").alias("dish"), part(4).alias("side")
    )
    return F.when(part(1) != "", key)


def is_unscored(raw: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(as_col(raw), F.lit("")))).isin(*UNSCORED_TOKENS)


def coerce_day(raw: Column | str, strict: bool = True) -> Column:
    """Event day of a scored token, NULL for "never".

    Decimals truncate to their day.  Anything that is no day of the domain fails the
    job, or gives -2 when not strict.
    """
    text = F.lower(F.trim(as_col(raw)))
    day = text.try_cast("double").cast("int")
    wrong = (
        F.raise_error(F.concat(F.lit("not an event day: "), F.coalesce(text, F.lit("NULL")))).cast("int")
        if strict
        else F.lit(-2)
    )
    return (
        F.when(text.isin(*NEVER_TOKENS) | (day == NEVER), F.lit(None).cast("int"))
        .when(day.isin(*DAYS), day)
        .otherwise(wrong)
    )


def column_letters(ref: Column | str) -> Column:
    return F.regexp_extract(as_col(ref), "^([A-Z]+)", 1)


def column_index(letters: Column | str) -> Column:
    """Zero-based index of spreadsheet column letters (A = 0, AA = 26)."""
    chars = F.filter(F.split(as_col(letters), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def stratum_of(group: Column | str) -> Column:
    """Five consecutive groups share a stratum, numbered from 1."""
    return (F.floor(as_col(group) / GROUPS_PER_STRATUM) + 1).cast("int")


def slot_hours(day: Column | str) -> Column:
    """Hours of a slot folder; NULL for a folder outside the map."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SLOT_HOURS.items() for x in kv]), as_col(day).cast("int"))


def nominal_hours(day: Column | str) -> Column:
    return as_col(day).cast("double") * HOURS_PER_DAY


def unit_uid(dish: Column | str, row: Column | str, col: Column | str) -> Column:
    text = [as_col(x).cast("string") for x in (dish, row, col)]
    return F.concat(F.lit("dish"), text[0], F.lit("_R"), text[1], F.lit("C"), text[2])


def group_of_uid(uid: Column | str) -> Column:
    return F.split_part(as_col(uid), F.lit("_"), F.lit(1))


def short_label(name: Column | str, width: int = 3) -> Column:
    """First letters plus the trailing number: prospect1 -> pro1."""
    c = as_col(name)
    return F.concat(F.substring(F.regexp_extract(c, r"^([^\d]*)", 1), 1, width), F.regexp_extract(c, r"(\d*)$", 1))


def content_key(*parts: Column | str, size: int = 16) -> Column:
    """First hex digits of the sha1 of the joined parts."""
    return F.substring(F.sha1(F.concat_ws(":", *[as_col(p).cast("string") for p in parts])), 1, size)


def finite_or_null(x: Column | str) -> Column:
    x = as_col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def show_or_dash(x: Column | str, digits: int = 3) -> Column:
    v = finite_or_null(as_col(x).cast("double"))
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", v)).otherwise("-")


def reanchor(recorded: Column | str, root: str, marker: str = "real_data") -> Column:
    """Re-root a recorded absolute path at ``root`` from its ``marker`` folder on."""
    return F.regexp_replace(as_col(recorded), f"^.*/({marker}/.*)$", f"{root}/$1")
