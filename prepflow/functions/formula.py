"""Formulas: an arithmetic or logical expression over columns, as a Spark column.

Only a fixed list of Python syntax is accepted, each piece mapped to a built-in function.
``&`` and ``|`` bind like ``and`` and ``or``. Division by zero gives NULL.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import INTEGRAL, NUMERIC, col

# fixed values
FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "log10": F.log10,
    "log1p": F.log1p, "expm1": F.expm1, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor,
    "ceil": F.ceil, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin,
    "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh,
    "arctanh": F.atanh, "arctan2": F.atan2,
}


class FormulaError(ValueError):
    pass


def _mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
    ast.Mod: _mod,
    ast.Pow: F.pow,
}
COMPARISONS = {
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def _readable(text: str) -> tuple[str, dict[str, str]]:
    """Python source for the formula, and the quoted column names hidden in it."""
    quoted: dict[str, str] = {}

    def hide(match: re.Match) -> str:
        quoted[f"_quoted_{len(quoted)}"] = match.group(1)
        return f"_quoted_{len(quoted) - 1}"

    source = re.sub(r"`([^`]+)`", hide, text)
    words = {"&": "and", "|": "or"}
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, SyntaxError) as e:
        raise FormulaError(f"cannot read {text!r}") from e
    return " ".join(words.get(t.string, t.string) for t in tokens if t.string.strip()), quoted


def formula(df: DataFrame, text: str) -> Column:
    """The column ``text`` describes over the columns of ``df``."""
    source, quoted = _readable(text.strip())
    try:
        tree = ast.parse(source, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"cannot read {text!r}") from e

    def whole(node: ast.AST) -> Column | None:
        """An integer column or constant as it is: doubles do not tell large integers apart."""
        if isinstance(node, ast.Name):
            name = quoted.get(node.id, node.id)
            return col(name) if name in df.columns and isinstance(df.schema[name].dataType, INTEGRAL) else None
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner = whole(node.operand)
            return None if inner is None or isinstance(node.operand, ast.Name) else -inner
        if isinstance(node, ast.Constant) and type(node.value) is int and abs(node.value) < 1 << 63:
            return F.lit(node.value)
        return None

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            name = quoted.get(node.id, node.id)
            if name not in df.columns:
                raise FormulaError(f"name {name!r} is not defined")
            numeric = isinstance(df.schema[name].dataType, NUMERIC)
            return col(name).cast("double") if numeric else col(name)
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
            plain = isinstance(node.value, (bool, str))
            return F.lit(node.value) if plain else F.lit(float(node.value))
        if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
            return ARITHMETIC[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.USub):
                return -build(node.operand)
            if isinstance(node.op, ast.UAdd):
                return build(node.operand)
            return ~build(node.operand)
        if isinstance(node, ast.BoolOp):
            out = build(node.values[0])
            for part in node.values[1:]:
                out = out & build(part) if isinstance(node.op, ast.And) else out | build(part)
            return out
        if isinstance(node, ast.Compare) and all(type(o) in COMPARISONS for o in node.ops):
            parts = (node.left, *node.comparators)
            sides = [whole(n) for n in parts]
            if any(side is None for side in sides):
                sides = [build(n) for n in parts]
            out = None
            for op, a, b in zip(node.ops, sides, sides[1:]):
                test = COMPARISONS[type(op)](a, b)
                out = test if out is None else out & test
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            if node.func.id not in FUNCTIONS:
                raise FormulaError(f"{node.func.id!r} is not a supported function")
            return FUNCTIONS[node.func.id](*[build(a) for a in node.args])
        raise FormulaError(f"{type(node).__name__} is not allowed in a formula")

    out = build(tree)
    # integers from floor and ceil come back as bigint; a formula column is always double or boolean
    kind = df.select(out.alias("v")).schema["v"].dataType
    return out.cast("double") if isinstance(kind, NUMERIC) and not isinstance(kind, T.DoubleType) else out
