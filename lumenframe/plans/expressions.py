"""Text expressions over columns, in the grammar of Python: comparisons, `in`, `and`, `or`, `not`, arithmetic, calls, `@name`.

The text is parsed, never run; each node becomes a Column, so Catalyst sees one predicate and pushes it to the scan.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import elementwise as E
from lumenframe.functions import statistics as S
from lumenframe.functions import strings as T

_BINARY: dict[type, Callable] = {ast.Add: E.add, ast.Sub: E.sub, ast.Mult: E.mul, ast.Div: E.truediv, ast.FloorDiv: E.floordiv, ast.Mod: E.mod, ast.Pow: E.power}
_COMPARE: dict[type, Callable] = {ast.Eq: E.eq, ast.NotEq: E.ne, ast.Lt: E.lt, ast.LtE: E.le, ast.Gt: E.gt, ast.GtE: E.ge}
_CALLS: dict[str, Callable] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "sqrt": F.sqrt, "abs": F.abs, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin, "arccos": F.acos,
    "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "floor": E.floor, "ceil": E.ceil,
}
_METHODS: dict[str, Callable] = {"isna": E.isna, "isnull": E.isna, "notna": E.notna, "notnull": E.notna, "isin": E.isin, "between": E.between, "abs": F.abs, "round": E.round_, "fillna": E.fillna}
_STRINGS: dict[str, Callable] = {"contains": T.contains, "startswith": T.startswith, "endswith": T.endswith, "lower": T.lower, "upper": T.upper, "len": T.length, "strip": T.strip}


class _Reader:
    def __init__(self, df: DataFrame, names: dict[str, object]):
        self.df, self.names = df, names

    def read(self, text: str) -> Column:
        return self._node(ast.parse(text.strip(), mode="eval").body)

    def _column(self, name: str) -> Column:
        if name in self.df.columns:
            return F.col(f"`{name}`")
        raise NameError(f"no column is called {name!r}")

    def _value(self, node: ast.AST) -> object:
        if isinstance(node, ast.List | ast.Tuple | ast.Set):
            return [self._value(x) for x in node.elts]
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return -node.operand.value
        if isinstance(node, ast.Name) and node.id.startswith("__at_"):
            return self.names[node.id[5:]]
        return self._node(node)

    def _node(self, node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            f = E.logical_and if isinstance(node.op, ast.And) else E.logical_or
            out = self._node(node.values[0])
            for x in node.values[1:]:
                out = f(out, self._node(x))
            return out
        if isinstance(node, ast.UnaryOp):
            x = self._node(node.operand)
            return -x if isinstance(node.op, ast.USub) else x if isinstance(node.op, ast.UAdd) else E.logical_not(x)
        if isinstance(node, ast.BinOp):
            if isinstance(node.op, ast.BitAnd | ast.BitOr | ast.BitXor):
                f = {ast.BitAnd: E.logical_and, ast.BitOr: E.logical_or, ast.BitXor: E.logical_xor}[type(node.op)]
                return f(self._node(node.left), self._node(node.right))
            return _BINARY[type(node.op)](self._node(node.left), self._node(node.right))
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, ast.In | ast.NotIn):
                    values = self._value(right)
                    test = E.isin(self._node(left), values if isinstance(values, list | tuple | set) else [values])
                    test = ~test if isinstance(op, ast.NotIn) else test
                elif isinstance(right, ast.List | ast.Tuple):
                    test = E.isin(self._node(left), self._value(right))
                    test = ~test if isinstance(op, ast.NotEq) else test
                else:
                    test = _COMPARE[type(op)](self._node(left), self._node(right))
                out = test if out is None else out & test
                left = right
            return out
        if isinstance(node, ast.Name):
            return E.col(self.names[node.id[5:]]) if node.id.startswith("__at_") else self._column(node.id)
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Call):
            return self._call(node)
        raise SyntaxError(f"{type(node).__name__} has no meaning in an expression over columns")

    def _call(self, node: ast.Call) -> Column:
        args = [self._value(x) for x in node.args]
        options = {k.arg: self._value(k.value) for k in node.keywords}
        if isinstance(node.func, ast.Name) and node.func.id in _CALLS:
            return _CALLS[node.func.id](*args, **options)
        if isinstance(node.func, ast.Attribute):
            inner = node.func.value
            if isinstance(inner, ast.Attribute) and inner.attr == "str" and node.func.attr in _STRINGS:
                return _STRINGS[node.func.attr](self._node(inner.value), *args, **options)
            if node.func.attr in _METHODS:
                return _METHODS[node.func.attr](self._node(inner), *args, **options)
            if node.func.attr in S.AGGREGATES:
                value = self.df.agg(S.aggregate(node.func.attr, self._node(inner))).first()[0]
                return F.lit(value)
        raise NameError(f"no function is called {ast.unparse(node.func)}")


def _prepared(text: str) -> str:
    """`@name` and back-ticked columns in forms that Python's parser takes."""
    text = re.sub(r"@(\w+)", r"__at_\1", text)
    if "`" in text:
        raise SyntaxError("rename columns whose names are no identifiers before they go into an expression")
    return text.replace("&&", "&").replace("||", "|")


def column(df: DataFrame, text: str, **names: object) -> Column:
    return _Reader(df, names).read(_prepared(text))


def query(df: DataFrame, text: str, **names: object) -> DataFrame:
    """Rows for which the expression holds; `@name` stands for a value given by keyword."""
    return df.filter(column(df, text, **names))


def evaluate(df: DataFrame, text: str, **names: object) -> DataFrame | Column:
    """Assignments, one a line, give a frame with the new columns; a lone expression gives a Column."""
    lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
    if not any(re.match(r"^\w+\s*=(?!=)", x) for x in lines):
        return column(df, text, **names)
    for x in lines:
        name, _, body = x.partition("=")
        df = df.withColumn(name.strip(), column(df, body, **names))
    return df
