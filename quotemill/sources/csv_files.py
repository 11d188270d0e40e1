"""CSV sources: per-symbol price files, news dumps with multi-line bodies, inferred files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.plans.prices import stock_prices
from quotemill.schemas import PRICE_CSV_SCHEMA
from quotemill.session import staged
from quotemill.sources.quoted_lines import csv_records

# The symbol is the stem of the file name, or the value of a `symbol=` folder.
FILE_STEM = r"([^/]+)\.csv$"
SYMBOL_FOLDER = r"/symbol=([^/]+)/"

# Columns of the news files that are kept; article bodies are not read.
NEWS_CSV_COLUMNS = ["Date", "Article_title", "Stock_symbol", "Url", "Lsa_summary"]
CORRUPT_COLUMN = "_corrupt_record"


def symbol_from_path(pattern: str = FILE_STEM) -> Column:
    """The symbol named by a row's file."""
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in a file's header line."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


# Commas outside of quotes.
FIELD_END = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def file_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of the files as ``(file, fields)``."""
    lines = spark.read.text(_as_list(paths)).select(F.input_file_name().alias("file"), "value")
    fields = F.transform(F.split("value", FIELD_END), lambda f: F.trim(F.replace(f, F.lit('"'))))
    return lines.where(F.trim("value") != "").select("file", fields.alias("fields"))


def _is_header() -> Column:
    return F.array_contains("fields", "date") & F.array_contains("fields", "adj close")


def file_headers(lines: DataFrame) -> DataFrame:
    """``(file, names)``: the lines with both the date and the adjusted close column in them."""
    return lines.where(_is_header()).groupBy("file").agg(F.min("fields").alias("names"))


def scan_price_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    symbol_pattern: str = FILE_STEM,
    headers: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Per-symbol price files to the price table, columns matched by header name.

    Without ``headers`` the files are read once more beforehand to see whether all have the same header.
    If not, each line is matched with the header of its own file, in a table of one row per file that stays
    distributed. ``headers``, globs to column names, saves that pass: files are read group by group and united
    by name. Files whose header differs from what was said are an error, and so are lines with too few or
    too many fields. Line breaks inside quotes are only understood where files share a header.
    """
    if headers is None:
        lines = file_lines(spark, paths)
        kinds = file_headers(lines).select("names").distinct().limit(2).collect()
        if not kinds:
            raise ValueError(f"no file of {paths} has a header with a date and an adjusted close")
        if len(kinds) > 1:
            return stock_prices(_own_columns(lines, symbol_pattern))
        headers = {path: list(kinds[0]["names"]) for path in _as_list(paths)}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers.items():
        groups.setdefault(tuple(names), []).append(path)
    types = {f.name: f.dataType for f in PRICE_CSV_SCHEMA}
    scans = []
    for names, files in groups.items():
        schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        # The header of every file is checked against the names, so no file is read by position.
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        scan = reader.option("mode", "FAILFAST").csv(files)
        wanted = [n for n in names if n in types]
        scans.append(scan.select(*[F.col(f"`{n}`") for n in wanted], symbol_from_path(symbol_pattern).alias("symbol")))
    raw = scans[0]
    for scan in scans[1:]:
        raw = raw.unionByName(scan, allowMissingColumns=True)
    raw = raw.withColumn("symbol", F.upper("symbol")).withColumnRenamed("adj close", "adj_close")
    return stock_prices(raw)


def _own_columns(lines: DataFrame, symbol_pattern: str) -> DataFrame:
    """Raw bars whose values are picked by the names in the header of their file."""
    rows = lines.where(~_is_header()).join(file_headers(lines), "file")
    size = F.when(F.size("fields") == F.size("names"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("a line does not fit the header of "), F.col("file"))).cast("boolean")
    )

    def value(field: T.StructField) -> Column:
        found = F.get("fields", (F.array_position("names", field.name) - 1).cast("int"))
        return F.nullif(found, F.lit("")).cast(field.dataType).alias(field.name.replace(" ", "_"))

    symbol = F.upper(F.regexp_extract("file", symbol_pattern, 1)).alias("symbol")
    return rows.where(size).select(*[value(f) for f in PRICE_CSV_SCHEMA], symbol)


def scan_news_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] = tuple(NEWS_CSV_COLUMNS),
    multi_line: bool = True,
    header: bool = True,
) -> DataFrame:
    """News files as text columns plus the corrupt-record column.

    Bodies may span lines inside quotes. Records are found in parallel, also within one file (:func:`csv_records`);
    files whose records are single lines are read at once with ``multi_line=False``. ``columns`` are the file's
    columns in order. Malformed rows keep their text in the corrupt column, see :func:`split_news`.
    """
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in [*columns, CORRUPT_COLUMN]]
    )
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN}
    if not multi_line:
        return spark.read.schema(schema).options(header=header, **options).csv(_as_list(paths))
    records = csv_records(spark, paths)
    if header:
        records = records.where((F.col("start") != 0) | (F.col("place") != 0))
    types = ", ".join(f"`{f.name}` string" for f in schema)
    return records.select(F.from_csv("record", types, {**options, "multiLine": "true"}).alias("_row")).select("_row.*")


def split_news(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that parsed, without the article body, and the text of those that did not.

    The scan is written once: both results come from the same parse, with every column read.
    """
    parsed = staged(scanned, "news-scan")
    corrupt = F.col(CORRUPT_COLUMN)
    rows = parsed.where(corrupt.isNull()).select(*NEWS_CSV_COLUMNS)
    return rows, parsed.where(corrupt.isNotNull()).select(corrupt.alias("line"))


def scan_csv_infer(
    spark: SparkSession, paths: str | Sequence[str], symbol_pattern: str = FILE_STEM
) -> DataFrame:
    """CSV files with inferred types and the symbol from the file name."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(_as_list(paths))
    return df.withColumn("symbol", symbol_from_path(symbol_pattern))


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)
