"""Months as ``YYYY-MM`` strings and integer month numbers (year * 12 + month)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
UNKNOWN = "TIME_UNKNOWN"
NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_YEAR = "(?:19|20)[0-9]{2}"
#: Quarters, days, months and named months (also cut to three letters) of the years from 1900 to 2099, and bare years, of whole numbers only.
IN_TEXT = rf"(?i)(?<![0-9])({_YEAR}[ _-]?Q[1-4]|Q[1-4][\s_-]*{_YEAR}|{_YEAR}-[0-9]{{2}}-[0-9]{{2}}|{_YEAR}-[0-9]{{2}}|(?<![a-z])(?:{'|'.join([*NAMES, *(n[:3] for n in NAMES)])})[\s_-]*{_YEAR})(?![0-9])"
YEAR_IN_TEXT = rf"(?<![0-9])({_YEAR})(?![0-9])"


def parse_month(c: Column) -> Column:
    """The trimmed month, or null if it isn't one; dates and timestamps go through ``month_of``."""
    t = F.trim(c)
    return F.when(t.rlike(MONTH), t)


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(c: Column) -> Column:
    m = parse_month(c)
    return (F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int")).cast("int")


def month_name(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor((index - 1) / 12).cast("int"), ((index - 1) % 12 + 1).cast("int"))


def similarity(a: Column, b: Column, reach: int = 4) -> Column:
    """1 for the same month number, less by 1 / (reach + 1) for each month between, 0 beyond reach."""
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.lit(float(reach + 1)))


def is_adjacent(a: Column, b: Column) -> Column:
    return F.abs(a - b) == 1


def neighbours(index: Column) -> Column:
    """The month numbers before and after."""
    return F.array(index - 1, index + 1)


def temporal_neighbours(c: Column) -> Column:
    """The month with those before and after it; a text that is no month stands alone."""
    i = month_index(c)
    return F.when(i.isNull(), F.array(c)).otherwise(F.array(month_name(i - 1), month_name(i), month_name(i + 1)))


def stamped(df: DataFrame, date: str = "date") -> DataFrame:
    """Adds the standardised month, its number and the granularity of the date."""
    m = parse_month(F.col(date))
    return df.withColumns({"month": m, "month_idx": month_index(F.col(date)), "granularity": F.when(m.isNotNull(), F.lit("month"))})


def suffix(date: Column) -> Column:
    """What stands for the date in node ids: the date, or the sentinel where it is null or empty."""
    return F.coalesce(F.nullif(date, F.lit("")), F.lit(UNKNOWN))


def find_time(path: Column, content: Column, head: int = 1000) -> Column:
    """The first time in the path, else in the first characters of the content, else UNKNOWN; without spaces, quarters year first.

    A bare year, which may as well be a number of another kind, counts only where its text has nothing more exact."""
    each = [F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for text in (path, F.substring(content, 1, head)) for pattern in (IN_TEXT, YEAR_IN_TEXT)]
    got = F.coalesce(*each, F.lit("UNKNOWN"))
    tight = F.regexp_replace(got, r"[\s_]", "")
    return F.regexp_replace(tight, "(?i)^(Q[1-4])-?([0-9]{4})$", "$2$1")


def to_month(found: Column) -> Column:
    """Month of what find_time gives: a day's, a named month, a quarter's last; null for bare years and unknowns."""
    lower = F.lower(found)
    quarter = F.regexp_extract(lower, "^([0-9]{4})-?q([1-4])$", 2)
    year = F.regexp_extract(lower, "([0-9]{4})", 1)
    number = F.array_position(F.array(*[F.lit(n[:3]) for n in NAMES]), F.substring(F.regexp_extract(lower, "^([a-z]+)", 1), 1, 3))
    named = F.when(number > 0, F.format_string("%s-%02d", year, number))
    return F.coalesce(parse_month(F.substring(found, 1, 7)), F.when(quarter != "", F.format_string("%s-%02d", year, (F.nullif(quarter, F.lit("")).cast("int") * 3))), named)


def month_in_id(chunk_id: Column) -> Column:
    """The first YYYY-MM in a chunk id, or null."""
    return F.nullif(F.regexp_extract(chunk_id, "([0-9]{4}-[0-9]{2})", 1), F.lit(""))


# --- sets of months on the driver: a query names a few


def index_of(month: str) -> int | None:
    m = month.strip() if isinstance(month, str) else ""
    return int(m[:4]) * 12 + int(m[5:]) if re.match(MONTH, m) else None


def name_of(index: int) -> str:
    return f"{(index - 1) // 12:04d}-{(index - 1) % 12 + 1:02d}"


def expand(months: Iterable[str], mode: str = "strict") -> list[str]:
    """strict: the months themselves; adjacent: also those next to them; expanded: all from the first to the last."""
    got = sorted({i for i in map(index_of, months) if i is not None})
    if mode == "adjacent":
        got = sorted({j for i in got for j in (i - 1, i, i + 1)})
    elif mode == "expanded" and got:
        got = list(range(got[0], got[-1] + 1))
    elif mode not in ("strict", "expanded"):
        raise ValueError(f"no such mode: {mode}")
    return [name_of(i) for i in got]


def validate(months: object) -> tuple[bool, str]:
    if months is None or months == []:
        return True, "no time range"
    if not isinstance(months, (list, tuple)):
        return False, "a time range is a list of months"
    for m in months:
        if not isinstance(m, str):
            return False, f"not text: {m!r}"
        if index_of(m) is None:
            return False, f"not a month (YYYY-MM): {m!r}"
    return True, "valid"


def valid_months(spark: SparkSession, months: list[str]) -> DataFrame:
    """valid_times(month, month_idx) of the months that a query names."""
    return spark.createDataFrame([(m, index_of(m)) for m in months], "month string, month_idx int")


def expanded_months(df: DataFrame, date: str, mode: str) -> DataFrame:
    """Distinct months of a column with their neighbours (adjacent) or with all between the first and the last (expanded)."""
    i = df.select(month_index(F.col(date)).alias("i")).filter("i is not null").distinct()
    if mode == "adjacent":
        i = i.select(F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("i")).distinct()
    elif mode == "expanded":
        i = i.agg(F.min("i").alias("a"), F.max("i").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("i"))
    return i.select(month_name(F.col("i")).alias("month"), F.col("i").alias("month_idx"))
