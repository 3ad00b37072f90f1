"""Any source, by path or address, as a lazy DataFrame."""

from __future__ import annotations

import csv
import os
import re
from urllib.parse import unquote, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import SqliteSource, XlsxSource

SUFFIXES = (".csv", ".json", ".parquet", ".xlsx", ".xls", ".db", ".sqlite")
#: Addresses of databases (fixed values) and the JDBC protocol of each.
DATABASES = {"postgresql://": "postgresql", "mysql://": "mysql", "mysql+pymysql://": "mysql", "mssql://": "sqlserver", "mssql+pyodbc://": "sqlserver", "sqlite:///": "sqlite"}


class LoadError(ValueError):
    """A source that cannot be read; the message shows no password."""


def is_database(source: str) -> bool:
    return source.startswith(tuple(DATABASES))


def masked(address: str) -> str:
    """The address without its password, even one that holds an @."""
    return re.sub(r"^([^:/]+://[^:/@]*):.*@", r"\1:***@", address)


def normalised(df: DataFrame, widen: bool = False) -> DataFrame:
    """NaN becomes null once, here, so that a missing value is one thing below; widen: inferred integers are long."""
    out = {}
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("float", "double"):
            out[f.name] = F.nanvl(c, F.lit(None).cast(kind))
        elif widen and kind in ("int", "smallint", "tinyint"):
            out[f.name] = c.cast("bigint")
    return df.select([out.get(n, F.col(f"`{n}`")).alias(n) for n in df.columns]) if out else df


def _quote(mysql: bool) -> str:
    return "`" if mysql else '"'


def jdbc_options(source: str) -> dict[str, str]:
    """Options of Spark's JDBC reader for address::table (the last :: counts). Users and passwords may be percent-encoded; the table's name is quoted as the database does."""
    address, mark, name = source.rpartition("::")
    if not mark or not name:
        raise LoadError(f"a database source needs a table, as in address::table: {masked(source)}")
    prefix = next(p for p in DATABASES if address.startswith(p))
    parts = urlsplit(address)
    quote = _quote(DATABASES[prefix] == "mysql")
    options = {"dbtable": quote + name.replace(quote, 2 * quote) + quote, "url": f"jdbc:{urlunsplit((DATABASES[prefix], (parts.hostname or '') + (f':{parts.port}' if parts.port else ''), parts.path, parts.query, ''))}"}
    if DATABASES[prefix] == "sqlserver":
        options["url"] = f"jdbc:sqlserver://{parts.hostname}{f':{parts.port}' if parts.port else ''};databaseName={parts.path.lstrip('/')}"
    return options | {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}


def jdbc(spark: SparkSession, options: dict[str, str], split_by: str | None = None, parts: int = 32) -> DataFrame:
    """A table of a database; split_by, a column of numbers or dates, is read in so many ranges between its bounds side by side."""
    read = spark.read.format("jdbc").options(**options)
    if split_by is None:
        return read.load()
    table = {k: v for k, v in options.items() if k != "dbtable"}
    quote = _quote(options["url"].startswith("jdbc:mysql"))
    column = quote + split_by.replace(quote, 2 * quote) + quote
    bounds = spark.read.format("jdbc").options(**table).option("query", f"SELECT MIN({column}) AS a, MAX({column}) AS b FROM {options['dbtable']}").load().first()
    if bounds[0] is None:
        return read.load()
    return read.option("partitionColumn", split_by).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(parts)).load()


def _delimiter(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, ",;\t|").delimiter
    except csv.Error:
        return ","


def _head(spark: SparkSession, path: str) -> str:
    """The first lines, through Spark, so that any store will do."""
    return "\n".join(r[0] for r in spark.read.text(path).limit(1000).collect())


def has_quoted_breaks(head: str) -> bool:
    """Whether a quoted value goes over the end of a line: then a quote is open there."""
    return any(head[: m.start()].count('"') % 2 for m in re.finditer("\n", head)) if '"' in head else False


def load(spark: SparkSession, source: str, multi_line: bool | None = None, split_by: str | None = None) -> DataFrame:
    """Any source as a DataFrame. multi_line: whether values of a CSV file hold line breaks, which forbids to read it in parts (None: if the first lines
    do); split_by: a column by whose ranges a database's table is read side by side."""
    if is_database(source):
        if source.startswith("sqlite:///"):
            path, mark, name = source.removeprefix("sqlite:///").rpartition("::")
            if not mark:
                raise LoadError(f"a database source needs a table, as in address::table: {source}")
            return _sqlite(spark, path, name)
        try:
            return normalised(jdbc(spark, jdbc_options(source), split_by))
        except LoadError:
            raise
        except Exception as e:
            raise LoadError(f"cannot read {masked(source)}: {type(e).__name__}") from None
    suffix = os.path.splitext(source.rstrip("/"))[1].lower()
    if "://" not in source:
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        source = os.path.abspath(source)  # the JVM may work in another folder
    if suffix not in SUFFIXES:
        raise LoadError(f"unsupported format {suffix or source!r}; supported: {', '.join(SUFFIXES)}")
    try:
        if suffix == ".parquet":
            return normalised(spark.read.parquet(source))
        if suffix == ".csv":
            head = _head(spark, source)
            read = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').option("sep", _delimiter(head))
            read = read.option("multiLine", has_quoted_breaks(head) if multi_line is None else multi_line)
            return normalised(read.csv(source), widen=True)
        if suffix == ".json":
            return normalised(spark.read.option("multiLine", _head(spark, source).lstrip().startswith("[")).json(source), widen=True)
        if suffix in (".xlsx", ".xls"):
            spark.dataSource.register(XlsxSource)
            return normalised(spark.read.format("tidemark_xlsx").option("path", source).load())
        return _sqlite(spark, source, "")
    except (LoadError, FileNotFoundError):
        raise
    except Exception as e:
        raise LoadError(f"cannot read {source}: {str(e).splitlines()[0][:200]}") from e


def _sqlite(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    try:
        return normalised(spark.read.format("tidemark_sqlite").option("path", path).option("table", name).load())
    except Exception as e:
        raise LoadError(f"cannot read {path}: {str(e).splitlines()[0][:200]}") from e
