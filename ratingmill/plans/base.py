"""Helpers of the query modules."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.plans.registry import register
from ratingmill.sources.fixtures import Frames, with_

AS_OF = date(2000, 2, 15)
DAY = f"date '{AS_OF}'"
SEASON = "case when month(date) >= 10 then year(date) else year(date) - 1 end"
EXP = "1 / (1 + pow(10.0, (({b}) - ({a}) - {ha}) / 400))"


#: SQL of the registered queries by name, without the leading ``with``.
BODIES: dict[str, str] = {}


def part(name: str, of: str, old: str = "", new: str = "") -> str:
    """The SQL of query ``of`` as a further common table expression ``name``, practically unrounded."""
    sql = re.sub(r", [3-6]\)(?=( end|, 0\))? as )", ", 12)", BODIES[of].strip())
    sql = sql.replace(old, new) if old else sql
    return f", {name} as ({'with' + sql[1:] if sql.startswith(',') else sql})\n"


def query(name: str, run: Callable[[Frames], DataFrame], uses: str = "", sql: str | None = None) -> None:
    """Registers a query over the derived tables ``uses``, with SQL that follows their ``with``."""
    names = tuple(uses.split())
    if sql is not None:
        BODIES[name] = sql
    register(name, lambda spark, sf_dir: run(Frames(spark, sf_dir)), None if sql is None else (with_(*names) + "\n" if names else "") + sql)


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Rounded columns; ``nudge`` lifts exact halves off the edge, where two engines may part."""
    return df.withColumns({c: F.round(F.col(c) + nudge, digits) for c in columns})
