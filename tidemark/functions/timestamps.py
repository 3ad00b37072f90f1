"""Lenient reading of timestamps from text, guarded by the shape of the text.

A bare parser takes '10001' or '94105' for years; each format is therefore tried on texts of its own shape only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"\d{4}-\d{2}-\d{2}"
#: (shape, format or None for the default parser), in the order in which they are tried.
SHAPES = (
    (rf"^{DATE}$", "yyyy-MM-dd"),
    (rf"^{DATE}[ T]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,6}})?)?(Z|[+-]\d{{2}}:?\d{{2}})?$", None),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^(1[7-9]|20|21)\d{2}$", "yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "M/d/yyyy h:mm a"),
)
#: What any of the shapes begins with; most texts fail here, at the cost of one match.
BEGIN = r"^(\d{1,4}[-/. ]|\d{4}$|\d{8}$|[A-Z][a-z]{2}, \d)"
RFC1123 = r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3}$"


def parsed(column: Column) -> Column:
    """The timestamp that a text stands for, or null."""
    tries = [F.when(column.rlike(shape), F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)) for shape, fmt in SHAPES]
    tries.append(F.when(column.rlike(RFC1123), F.try_to_timestamp(F.regexp_replace(column, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))))
    return F.when(column.rlike(BEGIN), F.coalesce(*tries))


def days_since(column: Column, as_of: Column) -> Column:
    """Whole days, rounded down, from a timestamp to as_of."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(column.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))
