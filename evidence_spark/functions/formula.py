"""Value rules: an arithmetic rule over named values becomes one Column expression."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_column(rule: str, values: Mapping[str, Column]) -> Column:
    """Only + - * / ( ), names and numbers; a missing operand or a division by zero gives null."""
    missing = F.lit(None).cast("double")

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name):
                return values[name].cast("double") if name in values else missing
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -build(inner)
            case ast.UnaryOp(op=ast.UAdd(), operand=inner):
                return build(inner)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return build(a) + build(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return build(a) - build(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return build(a) * build(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(build(a), build(b))
        return missing

    try:
        return build(ast.parse(rule.strip(), mode="eval").body)
    except SyntaxError:
        return missing


def resolve_carries(values: Mapping[str, Column], carries: Mapping[str, str]) -> dict[str, Column]:
    """A value may be carried over from another name; chains are followed, cycles stay without a value."""
    out = dict(values)
    for name in carries:
        seen, at = [name], name
        while at not in values and at in carries and carries[at] not in seen:
            at = carries[at]
            seen.append(at)
        if at in values:
            out.setdefault(name, values[at])
    return out
