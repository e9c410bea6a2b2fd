"""Arithmetic formulas over columns, e.g. ``(SibSp + Parch) * Fare``."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabspark.functions.columns import classify_columns, col


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is +-inf and 0/0 is missing, where ANSI SQL would raise. NaN is missing."""
    x, y = F.nanvl(a.cast("double"), F.lit(None).cast("double")), F.nanvl(b.cast("double"), F.lit(None).cast("double"))
    by_zero = (F.when(x > 0, F.lit(float("inf")))
               .when(x < 0, F.lit(float("-inf"))))
    return (F.when(x.isNull() | y.isNull(), F.lit(None).cast("double"))
            .when(y == 0, by_zero)
            .otherwise(F.try_divide(x, y)))


def _whole_power(a: Column, b: Column) -> Column:
    """Exact power of whole numbers; a negative exponent or a result beyond 64 bits raises.

    64 factors overflow unless the base is 0, 1 or -1, whose powers only depend on the exponent's parity.
    """
    times = F.when(b < 0, F.raise_error(F.lit("whole numbers have no negative powers")).cast("bigint")).otherwise(
        F.least(b, 64 + F.pmod(b, F.lit(2).cast("bigint"))))
    return F.aggregate(F.array_repeat(a, times.cast("int")), F.lit(1).cast("bigint"), lambda power, x: power * x)


def formula_column(df: DataFrame, formula: str) -> Column:
    """Column for a formula of names, numbers, parentheses, signs and ``+ - * / **``.

    A name that is no identifier stands in backticks. Python's own grammar reads the text; anything beyond arithmetic is refused, so no SQL
    and no code from the user is ever run.
    """
    numeric = set(classify_columns(df.schema).numeric)
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}

    quoted: dict[str, str] = {}

    def unquote(match: re.Match) -> str:
        name = f"_quoted_{len(quoted)}_"
        quoted[name] = match[1]
        return name

    def build(node: ast.AST) -> tuple[Column, bool]:
        """The column and whether its value is a whole number."""
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Name(id=name):
                name = quoted.get(name, name)
                if name not in numeric:
                    raise ValueError(f"'{name}' is not a numeric column")
                return col(name).cast("bigint" if name in whole else "double"), name in whole
            case ast.Constant(value=value) if type(value) in (int, float):
                return F.lit(value).cast("bigint" if type(value) is int else "double"), type(value) is int
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                value, is_whole = build(inner)
                return -value, is_whole
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return build(inner)
            case ast.BinOp(left=left, op=op, right=right):
                (a, a_whole), (b, b_whole) = build(left), build(right)
                both = a_whole and b_whole
                match op:
                    case ast.Add():
                        return a + b, both
                    case ast.Sub():
                        return a - b, both
                    case ast.Mult():
                        return a * b, both
                    case ast.Div():
                        return _divide(a, b), False
                    case ast.Pow():
                        return (_whole_power(a, b), True) if both else (F.pow(a.cast("double"), b.cast("double")), False)
        raise ValueError(f"unsupported in a formula: {ast.dump(node)[:80]}")

    return build(ast.parse(re.sub("`([^`]+)`", unquote, formula.strip()), mode="eval"))[0]
