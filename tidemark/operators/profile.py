"""What each column means: id, numeric, category, datetime, text or unknown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import parsed

#: Parts of lower-cased names that make a string column an id (fixed values).
ID_NAMES = ("_id", "id_", "uuid", "guid", "_key", "code_")
ID_RATIO, CATEGORY_RATIO, TEXT_RATIO, PARSE_RATE = 0.95, 0.05, 0.5, 0.8
#: An approximate ratio this close to a limit (relatively) is counted exactly.
NEAR = 0.05
#: Binary logarithm of a sketch's registers: 0.8 % of relative error.
LOG_REGISTERS = 14


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_instant(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    semantic_type: str
    dtype_before: str | None
    dtype_after: str | None

    @property
    def in_before(self) -> bool:
        return self.dtype_before is not None

    @property
    def in_after(self) -> bool:
        return self.dtype_after is not None

    @property
    def shared(self) -> bool:
        return self.in_before and self.in_after


def classify(name: str, kind: T.DataType, ratio: float, parse_rate: float | None) -> str:
    if is_instant(kind) or is_text(kind) and parse_rate is not None and parse_rate > PARSE_RATE:
        return "datetime"
    if is_number(kind):
        return "id" if is_integral(kind) and ratio > ID_RATIO else "numeric"
    if is_text(kind) or kind.simpleString().startswith("time("):
        if any(part in name.lower() for part in ID_NAMES):
            return "id"
        return "category" if ratio < CATEGORY_RATIO else "text" if ratio > TEXT_RATIO else "category"
    return "unknown"


def _counted(kind: T.DataType) -> bool:
    return is_integral(kind) or is_text(kind) or kind.simpleString().startswith("time(")


#: Rows that are looked at first for dates; shares between NO_DATES and ALL_DATES there are taken of all rows.
SAMPLE, NO_DATES, ALL_DATES = 1000, 0.3, 0.98


def _parse_rates(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Share of the non-null values of each text column that read as dates, or None without any."""
    if not names:
        return {}
    row = df.agg(*[F.avg(F.when(col(c).isNotNull(), parsed(col(c)).isNotNull().cast("double"))).alias(f"p{k}") for k, c in enumerate(names)]).first()
    return {c: row[f"p{k}"] for k, c in enumerate(names)}


def parse_rates(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """As _parse_rates; the first SAMPLE rows decide where they are clear."""
    if not names:
        return {}
    rates = _parse_rates(df.select(*map(col, names)).limit(SAMPLE), names)
    unclear = [c for c, p in rates.items() if p is None or NO_DATES < p < ALL_DATES]
    return rates | _parse_rates(df, unclear)


def semantic_types(df: DataFrame, names: list[str] | None = None) -> dict[str, str]:
    """One aggregate over the columns, with approximate distinct counts; a second, exact one only for columns near a limit. Dates in texts are told from a sample, and from all rows where it is not clear."""
    kinds = {f.name: f.dataType for f in df.schema if names is None or f.name in names}
    if not kinds:
        return {}
    rates = parse_rates(df, [c for c, kind in kinds.items() if is_text(kind)])
    counted = [c for c, kind in kinds.items() if _counted(kind) and not (rates.get(c) is not None and rates[c] > PARSE_RATE)]
    sketched = lambda c: col(c).cast("bigint" if is_integral(kinds[c]) else "string")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.hll_sketch_estimate(F.hll_sketch_agg(sketched(c), LOG_REGISTERS)).alias(f"d{k}") for k, c in enumerate(counted)]).first()
    n, distinct = max(row["n"], 1), {c: row[f"d{k}"] or 0 for k, c in enumerate(counted)}
    limits = lambda c: (ID_RATIO,) if is_integral(kinds[c]) else (CATEGORY_RATIO, TEXT_RATIO)
    unsure = [c for c in counted if row["n"] < 1000 or any(abs(distinct[c] / n - x) <= NEAR * x for x in limits(c))]
    if unsure:
        exact = df.agg(*[F.count_distinct(col(c)).alias(f"d{k}") for k, c in enumerate(unsure)]).first()
        distinct |= {c: exact[k] for k, c in enumerate(unsure)}
    return {name: classify(name, kind, distinct.get(name, 0) / n, rates.get(name)) for name, kind in kinds.items()}


def profile(before: DataFrame, after: DataFrame) -> list[ColumnProfile]:
    """Columns of before and then those that only after has; classes come from before where it has the column."""
    kinds_b, kinds_a = ({f.name: f.dataType.simpleString() for f in df.schema} for df in (before, after))
    classes = semantic_types(before) | semantic_types(after, [c for c in kinds_a if c not in kinds_b])
    return [ColumnProfile(c, classes[c], kinds_b.get(c), kinds_a.get(c)) for c in dict.fromkeys([*kinds_b, *kinds_a])]


def column_summary(df: DataFrame, samples: int = 5) -> list[dict]:
    """Name, type, distinct values, share of nulls and the least values (as texts), of each column; one pass, and one more for the values."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{k}") for k, c in enumerate(df.columns)], *[F.count_distinct(col(c)).alias(f"d{df.columns.index(c)}") for c in plain]).first().asDict()
    least: dict[str, list[str]] = {}
    if plain and samples:
        values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in plain]))).where(F.col("value").isNotNull())
        bucket = F.pmod(F.xxhash64("value"), F.lit(101))
        for r in values.groupBy("column", bucket.alias("bucket")).agg(F.min("value").alias("value")).collect():
            least.setdefault(r["column"], []).append(r["value"])
    return [{"name": f.name, "dtype": f.dataType.simpleString(), "n_unique": row.get(f"d{k}"), "null_pct": round(1 - row[f"c{k}"] / row["n"], 3) if row["n"] else None, "sample": sorted(least.get(f.name, []))[:samples]} for k, f in enumerate(df.schema)]
