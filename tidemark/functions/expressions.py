"""Aggregates from text: Spark SQL, or an allow-listed part of data-frame notation such as (df['x'] > 10).mean().

Nothing is evaluated as Python; the syntax tree is turned into Columns. Comparisons follow data-frame rules for missing values: they
are false, but != is true.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    ast.Gt: lambda a, b: F.coalesce(a > b, F.lit(False)),
    ast.GtE: lambda a, b: F.coalesce(a >= b, F.lit(False)),
    ast.Lt: lambda a, b: F.coalesce(a < b, F.lit(False)),
    ast.LtE: lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ast.Eq: lambda a, b: a.eqNullSafe(b) & a.isNotNull(),
    ast.NotEq: lambda a, b: ~(a.eqNullSafe(b) & a.isNotNull()),
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))}
_SUMMARIES = {
    "mean": lambda c: F.avg(c.cast("double")),
    "sum": lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": lambda c: F.stddev_samp(c.cast("double")),
    "median": lambda c: F.median(c.cast("double")),
}


class UnsupportedExpression(ValueError):
    pass


class _Builder:
    def __init__(self, columns: list[str]):
        self.columns = columns

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise UnsupportedExpression(f"no column '{name}'")
        return F.col(f"`{name}`")

    def of(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant):
            return self.column(node.slice.value)
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "df":
            return self.column(node.attr)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](self.of(node.left), self.of(node.comparators[0]))
        if isinstance(node, ast.BinOp):
            if isinstance(node.op, ast.BitAnd):
                return self.of(node.left) & self.of(node.right)
            if isinstance(node.op, ast.BitOr):
                return self.of(node.left) | self.of(node.right)
            if type(node.op) in _ARITHMETIC:
                return _ARITHMETIC[type(node.op)](self.of(node.left), self.of(node.right))
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.Invert):
                return ~self.of(node.operand)
            if isinstance(node.op, ast.USub):
                return -self.of(node.operand)
        if isinstance(node, ast.Call):
            return self.call(node)
        raise UnsupportedExpression(f"unsupported expression: {ast.unparse(node)}")

    def call(self, node: ast.Call) -> Column:
        f = node.func
        if isinstance(f, ast.Name) and f.id == "len" and len(node.args) == 1 and isinstance(node.args[0], ast.Name) and node.args[0].id == "df":
            return F.count(F.lit(1))
        if isinstance(f, ast.Name) and f.id == "float" and len(node.args) == 1:
            return self.of(node.args[0]).cast("double")
        if isinstance(f, ast.Attribute):
            inner = self.of(f.value)
            if f.attr in _SUMMARIES and not node.args:
                return _SUMMARIES[f.attr](inner)
            if f.attr in ("isna", "isnull"):
                return inner.isNull()
            if f.attr in ("notna", "notnull"):
                return inner.isNotNull()
            if f.attr == "abs":
                return F.abs(inner)
            if f.attr == "isin" and len(node.args) == 1 and isinstance(node.args[0], (ast.List, ast.Tuple)):
                return F.coalesce(inner.isin([x.value for x in node.args[0].elts if isinstance(x, ast.Constant)]), F.lit(False))
        raise UnsupportedExpression(f"unsupported expression: {ast.unparse(node)}")


def aggregate(text: str, columns: list[str]) -> Column:
    """The aggregate that text stands for: data-frame notation if it mentions df, else Spark SQL."""
    try:
        tree = ast.parse(text, mode="eval").body
        notation = any(isinstance(x, ast.Name) and x.id == "df" for x in ast.walk(tree))
    except SyntaxError:
        notation = False
    return (_Builder(columns).of(tree) if notation else F.expr(text)).cast("double")
