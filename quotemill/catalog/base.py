"""The registry of queries, and how results are made comparable across engines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parameters of the derived tables: 25 symbols, prices that move a few percent a day, and articles
# spread over 1995 to 2001.
MAX_MOVE = 0.2
MAX_ARTICLES = 2
HISTORY_START = "1995-06-01"
MIN_ROWS = 5
N_FOLDS = 4


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL giving the same result if there is one."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def comparable(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Select columns, fractions rounded and whole numbers as bigint."""
    out = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType.typeName()
        if kind in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        elif kind in ("integer", "short", "byte"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def rounded(*columns: str, digits: int = 6) -> str:
    """SQL select list of rounded columns, without negative zeros."""
    return ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in columns)


def select(ctes: str, source: str, plain: Sequence[str] = (), fractions: Sequence[str] = (), digits: int = 6) -> str:
    columns = [*plain]
    if fractions:
        columns.append(rounded(*fractions, digits=digits))
    return f"WITH {ctes} SELECT {', '.join(columns)} FROM {source}"
