"""Scalar expressions: typed token lists (postfix, CASE, SUBSTRING, EXTRACT) compiled to Columns.

Nothing is evaluated here. A list such as ``[c("a"), c("b"), op("*")]`` becomes ``a * b``
and runs inside whole-stage codegen like any other built-in expression.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """A token list that doesn't form one expression."""


class Tok(NamedTuple):
    """kind: COLUMN, OPERATOR, CAST, or the type of a literal."""

    kind: str
    value: object


def c(name: str) -> Tok:
    return Tok("COLUMN", name)


def op(symbol: str) -> Tok:
    return Tok("OPERATOR", symbol)


def cast(to: str) -> Tok:
    return Tok("CAST", to)


def s(value: str) -> Tok:
    return Tok("STRING", value)


def i(value: int) -> Tok:
    return Tok("INT64" if abs(value) >= 2**31 else "INT32", value)


def dbl(value: float) -> Tok:
    return Tok("DOUBLE", value)


def dec(value: str, precision: int = 15, scale: int = 2) -> Tok:
    return Tok(f"DECIMAL({precision},{scale})", value)


def date(value: str) -> Tok:
    return Tok("DATE", value)


#: Spark types of literal kinds; DECIMAL(p,s) is taken as it stands.
LITERAL_TYPES = {
    "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT64": "bigint", "FLOAT32": "float", "DOUBLE": "double",
    "DECIMAL": "decimal(15,2)", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "STRING": "string", "BOOLEAN": "boolean",
}

BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / F.nullif(b, F.lit(0)),
    "div": lambda a, b: F.call_function("div", a, F.nullif(b, F.lit(0))),
    "%": lambda a, b: a % F.nullif(b, F.lit(0)),
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "LIKE": lambda a, b: F.call_function("like", a, b),
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
    "||": lambda a, b: F.concat(a, b),
    "ROUND": lambda a, b: F.round(a, b),
}
#: With aggregates, for expressions over them.
UNARY = {
    "NOT": lambda a: ~a, "NEG": lambda a: -a, "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim, "ISNULL": F.isnull,
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
EXTRACTS = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}


def literal(token: Tok) -> Column:
    kind = token.kind.upper()
    to = kind.lower() if kind.startswith("DECIMAL(") else LITERAL_TYPES.get(kind)
    if to is None:
        raise ExpressionError(f"no such literal type: {token.kind}")
    value = token.value
    if value is not None and to.startswith("decimal"):
        value = Decimal(str(value))
    elif kind == "BOOLEAN" and isinstance(value, str):
        value = value.strip().lower() in ("true", "1", "t")
    return F.lit(value).cast(to)


def operand(token: Tok | Column) -> Column:
    if isinstance(token, Column):
        return token
    return F.col(str(token.value)) if token.kind == "COLUMN" else literal(token)


def postfix(tokens: list) -> Column:
    """One expression from operands and operators in postfix order."""
    stack: list[Column] = []
    for token in tokens:
        kind = token.kind if isinstance(token, Tok) else "READY"
        if kind == "CAST":
            need, make = 1, lambda a, to=token.value: a.cast(str(to))
        elif kind == "OPERATOR" and token.value in BINARY:
            need, make = 2, BINARY[token.value]
        elif kind == "OPERATOR" and token.value in UNARY:
            need, make = 1, UNARY[token.value]
        elif kind == "OPERATOR":
            raise ExpressionError(f"no such operator: {token.value}")
        else:
            stack.append(operand(token))
            continue
        if len(stack) < need:
            raise ExpressionError(f"{token.value} lacks operands in {tokens}")
        args = stack[-need:]
        stack[-need:] = [make(*args)]
    if len(stack) != 1:
        raise ExpressionError(f"{len(stack)} values are left over in {tokens}")
    return stack[0]


def _is(token: object, *words: str) -> bool:
    return isinstance(token, Tok) and token.kind == "OPERATOR" and token.value in words


def _split(tokens: list, *words: str) -> list[tuple[str, list]]:
    """(word, what follows it) for each of the words at this level; what stands before the first has the word ''."""
    parts: list[tuple[str, list]] = [("", [])]
    for token in tokens:
        if _is(token, *words):
            parts.append((token.value, []))
        else:
            parts[-1][1].append(token)
    return parts


def condition(tokens: list) -> Column:
    """``pred AND pred OR pred``, each pred in postfix order. AND binds tighter than OR, as in SQL."""
    either: Column | None = None
    both: Column | None = None
    for word, part in _split(tokens, "AND", "OR"):
        pred = postfix(part)
        if word == "OR":
            either, both = (both if either is None else either | both), pred
        else:
            both = pred if both is None else both & pred
    return both if either is None else either | both


def case(tokens: list) -> Column:
    """``CASE WHEN cond THEN value ... [ELSE value] END``; no ELSE gives NULL."""
    if not _is(tokens[-1], "END"):
        raise ExpressionError("CASE without END")
    out, cond = None, None
    for word, part in _split(tokens[1:-1], "WHEN", "THEN", "ELSE"):
        if word == "WHEN":
            cond = condition(part)
        elif word == "THEN":
            if cond is None:
                raise ExpressionError("THEN without WHEN")
            out, cond = (F if out is None else out).when(cond, compile_expr(part)), None
        elif word == "ELSE":
            if out is None:
                raise ExpressionError("ELSE before THEN")
            return out.otherwise(compile_expr(part))
    if out is None or cond is not None:
        raise ExpressionError("CASE without a WHEN and its THEN")
    return out


def compile_expr(tokens: list | tuple | Tok | Column | str) -> Column:
    """A Column from a token list, a single token, a column name or a Column."""
    if isinstance(tokens, Column):
        return tokens
    if isinstance(tokens, str):
        return F.col(tokens)
    if isinstance(tokens, Tok):
        return operand(tokens)
    tokens = list(tokens)
    if not tokens:
        raise ExpressionError("no tokens")
    if _is(tokens[0], "CASE"):
        return case(tokens)
    if _is(tokens[0], "SUBSTRING"):  # value, start counted from 0, length
        _, value, start, length = tokens
        return F.substring(operand(value), int(start.value) + 1, int(length.value))
    if _is(tokens[0], "EXTRACT"):
        _, unit, value = tokens
        if str(unit.value).upper() not in EXTRACTS:
            raise ExpressionError(f"EXTRACT of {unit.value}")
        return EXTRACTS[str(unit.value).upper()](operand(value))
    return postfix(tokens)
