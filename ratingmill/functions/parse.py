"""Parsing functions (F1-F3, F16, F22) as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _without_accents(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


def normalize_name(name: Column) -> Column:
    """Lower case without accents, punctuation and surplus spaces (F1)."""
    plain = F.regexp_replace(_without_accents(F.lower(name)), r"[^\w\s]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def normalized_names(df: DataFrame, column: str = "player_name", out: str = "name_key") -> DataFrame:
    """``df`` with the key of each name, computed once for each distinct name."""
    keys = df.select(column).where(F.col(column).isNotNull()).distinct()
    keys = keys.withColumn(out, normalize_name(F.col(column)))
    return df.join(keys, column, "left")


def minutes(text: Column) -> Column:
    """``MM:SS`` or a number as minutes; anything else counts as 0 (F2)."""
    parts = F.split(F.trim(text), ":")
    clock = F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60
    return F.coalesce(F.when(F.size(parts) == 2, clock).otherwise(F.trim(text).try_cast("double")), F.lit(0.0))


def made_attempted(text: Column) -> tuple[Column, Column]:
    """``made-attempted`` as two numbers; anything else counts as 0 and 0."""
    parts = F.split(F.trim(text), "-")
    made, attempted = (F.get(parts, F.lit(k)).try_cast("bigint") for k in (0, 1))
    good = (F.size(parts) == 2) & made.isNotNull() & attempted.isNotNull()
    return F.coalesce(F.when(good, made), F.lit(0)), F.coalesce(F.when(good, attempted), F.lit(0))


def parse_date(text: Column) -> Column:
    """A date from YYYYMMDD, YYYY-MM-DD or MM/DD/YYYY (with or without a time); null otherwise (F16)."""
    s = F.trim(text.cast("string"))
    return F.coalesce(
        *[F.when(s.rlike(rx), F.try_to_timestamp(F.substring(s, 1, n), F.lit(p)).cast("date")) for rx, n, p in (
            (r"^\d{8}$", 8, "yyyyMMdd"), (r"^\d{4}-\d{2}-\d{2}", 10, "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}", 10, "MM/dd/yyyy"))]
    )


def date_int(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each day from column ``start`` to column ``end``."""
    return df.withColumn("date", F.explode(F.sequence(start, end)))


#: Holidays with month, day (of two the reports take a day that is near) and penalty; days after them that count. Fixed values.
HOLIDAYS = (("Christmas", 12, 25, 30.0), ("Thanksgiving", 11, 23, 10.0), ("All-Star Break", 2, 18, 15.0))
POST_HOLIDAY_DAYS = 3


def holiday_schedule(year: Column) -> Column:
    """The year's holidays as an array of structs: name, date, first and last day after it that count, penalty (F16)."""
    def row(name: str, month: int, day: int, penalty: float) -> Column:
        at = F.make_date(year, F.lit(month), F.lit(day))
        return F.struct(F.lit(name).alias("name"), at.alias("date"), F.date_add(at, 1).alias("post_period_start"), F.date_add(at, POST_HOLIDAY_DAYS).alias("post_period_end"), F.lit(penalty).alias("penalty"))

    return F.array(*[row(*h) for h in HOLIDAYS])


def feed_id(game_id: Column) -> Column:
    """Game id padded to ten digits."""
    return F.lpad(game_id.cast("string"), 10, "0")


def game_key(date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("_", date_int(date).cast("string"), home.cast("string"), away.cast("string"))


def matchup_teams(matchup: Column) -> tuple[Column, Column]:
    """Home and away codes of ``AAA vs. BBB`` (home first) or ``AAA @ BBB`` (away first)."""
    parts = F.split(matchup, r"\s+(?:vs\.|@)\s+")
    at = F.contains(matchup, F.lit("@"))
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(at, second).otherwise(first), F.when(at, first).otherwise(second)


def season_start(date: Column, kind: str = "oct") -> Column:
    """First year of the season that begins in October; with ``kind='calendar'`` the year."""
    return F.year(date) if kind == "calendar" else F.when(F.month(date) >= 10, F.year(date)).otherwise(F.year(date) - 1)


def season_label(date: Column) -> Column:
    y = season_start(date)
    return F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100)))
