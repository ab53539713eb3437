"""Dates from text as column expressions; anything relative takes ``now`` as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import as_column

# The forms in which days come.
#: A day with one separator throughout, or with Korean units, and a time of day.
WRITTEN = r"^([0-9]{2}|[0-9]{4})([-./])([0-9]{1,2})\2([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?)?$"
KOREAN = r"^([0-9]{4})(년) ([0-9]{1,2})월 ([0-9]{1,2})일(?: ([0-9]{1,2})시 ([0-9]{1,2})분(?: ([0-9]{1,2})초)?)?$"
FULL_DATE = r"((?:19|20)[0-9]{2})\s*[-./년]\s*([0-9]{1,2})\s*[-./월]\s*([0-9]{1,2})"


def parse_date(c: Column | str) -> Column:
    """A timestamp: eight digits as a day first, then the written forms; two-digit years from 1969 to 2068."""
    text = F.trim(as_column(c))
    digits = F.regexp_replace(text, "[^0-9]", "")

    def read(form: str) -> Column:
        part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, form, k), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))
        year = part(1)
        full = F.when(F.length(F.regexp_extract(text, form, 1)) == 2, year + F.when(year >= 69, 1900).otherwise(2000)).otherwise(year)
        return F.when(text.rlike(form), F.try_make_timestamp(full, part(3), part(4), part(5), part(6), part(7).cast("decimal(8,6)")))

    return F.coalesce(F.when(F.length(digits) == 8, F.try_to_timestamp(digits, F.lit("yyyyMMdd"))), read(WRITTEN), read(KOREAN))


def latest_date(c: Column | str, now: Column) -> Column:
    """The latest full date in a text that isn't in the future nor before 1900."""
    found = F.transform(F.regexp_extract_all(as_column(c), F.lit(FULL_DATE), F.lit(0)), lambda x: F.try_to_date(
        F.concat_ws("-", F.regexp_extract(x, FULL_DATE, 1), F.regexp_extract(x, FULL_DATE, 2), F.regexp_extract(x, FULL_DATE, 3)), "y-M-d"))
    return F.array_max(F.filter(found, lambda d: d.isNotNull() & (d <= now.cast("date"))))


#: Full days of a text: with separators, with Korean units, eight digits that no others touch; and a year alone.
WRITTEN_DAYS = [r"([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})", r"([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일", r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])"]
YEAR_ALONE = r"(?<![\p{L}\p{N}_])(?:19|20)[0-9]{2}(?![\p{L}\p{N}_])"


def text_date(c: Column | str, now: Column) -> Column:
    """The time that a text, as a file's name, speaks of: a relative one, else the latest full day from 1900 to today, else the first of its first year."""
    text = as_column(c)

    def found(form: str) -> Column:
        part = lambda x, k: F.regexp_extract(x, form, k).cast("int")
        return F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda x: F.try_to_date(
            F.format_string("%04d-%02d-%02d", part(x, 1), part(x, 2), part(x, 3)), "yyyy-MM-dd"))

    days = F.filter(F.flatten(F.array(*map(found, WRITTEN_DAYS))), lambda d: d.isNotNull() & (d >= F.lit("1900-01-01").cast("date")) & (d <= now.cast("date")))
    year = F.regexp_extract(text, YEAR_ALONE, 0)
    return F.coalesce(relative_date(text, now), F.array_max(days).cast("timestamp"), F.when(year != "", F.make_date(year.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")))


def relative_date(c: Column | str, now: Column) -> Column:
    """Korean relative dates: just now, today, yesterday, and so many minutes, hours or days ago."""
    text = F.trim(as_column(c))
    number = lambda unit: F.regexp_extract(text, rf"([0-9]+)\s*{unit}\s*전", 1)
    day = F.date_trunc("day", now)
    out = F.when(text.contains("방금"), now).when(text == "오늘", day).when(text == "어제", day - F.expr("interval 1 day"))
    for unit, step, base in (("분", "minute", now), ("시간", "hour", now), ("일", "day", day)):
        n = number(unit)
        out = out.when(n != "", F.timestamp_add(step.upper(), -n.cast("int"), base))
    return out


def in_range(c: Column | str, start: str | None, end: str | None) -> Column:
    """Inclusive bounds; without any bound all pass, else nulls don't."""
    day = as_column(c).cast("date")
    inside = F.lit(True)
    if start:
        inside = inside & (day >= F.lit(start).cast("date"))
    if end:
        inside = inside & (day <= F.lit(end).cast("date"))
    return F.coalesce(inside, F.lit(not start and not end))


def text_in_range(c: Column | str, start: str, end: str) -> Column:
    """Dates written with dots, slashes or dashes, followed by anything."""
    first = F.regexp_replace(F.substring_index(F.trim(as_column(c)), " ", 1), "[./]", "-")
    day = F.try_to_date(first, "y-M-d")
    return F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))


def created_bound(c: Column | str, upper: bool) -> Column:
    """A day as its first or last second, a time as yyyy-MM-dd HH:mm:ss; '' for blanks and null for what is neither."""
    text = F.replace(F.trim(F.coalesce(as_column(c), F.lit(""))), F.lit("T"), F.lit(" "))
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit(" 23:59:59" if upper else " 00:00:00"))).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{1,2}(:\d{1,2})?$"), F.date_format(F.coalesce(
            F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:m:s")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:m"))), "yyyy-MM-dd HH:mm:ss"))
    return F.when(text == "", "").otherwise(whole)


def is_office_hour(ts: Column | str, zone: str = "Asia/Seoul") -> Column:
    """Monday to Friday, 9 to 18 in a time zone; the session runs in UTC."""
    local = F.from_utc_timestamp(as_column(ts), zone)
    return F.dayofweek(local).between(2, 6) & F.hour(local).between(9, 17)


def metadata_timestamp(c: Column | str) -> Column:
    """A text's date and time as ``yyyy-MM-dd HH:mm:ss``; zones are cut off, a null is empty, and what has no valid date stays as it is."""
    raw = F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    # basic forms and hours alone, as the standard writes them, are spelled out first
    basic = F.regexp_replace(raw, r"^(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2})(?:(\d{2})(\d{2})?)?(?=$|[.,Z+-])", "$1-$2-$3T$4:$5:$6")
    whole = F.regexp_replace(F.regexp_replace(basic, "::", ":00:00"), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}):(?!\d)", "$1:00")
    short = F.regexp_replace(whole, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    spaced = F.regexp_replace(short, r"^(\d{4}-\d{2}-\d{2})T(?=\d{2}:\d{2})", "$1 ")
    # Fixed value: the pattern of a day and time.
    part = lambda k, n: F.lpad(F.coalesce(F.nullif(F.regexp_extract(
        spaced, r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?", k), F.lit("")), F.lit("0")), n, "0")
    found = F.concat_ws(" ", F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), F.concat_ws(":", part(4, 2), part(5, 2), part(6, 2)))
    return F.when(F.try_to_timestamp(found, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), found).otherwise(raw)
