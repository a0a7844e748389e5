"""Predicate lists: comparisons joined by AND, OR, NOT and brackets, compiled to one boolean Column."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from plandag.functions.expr import ExpressionError, compile_expr


class Pred(NamedTuple):
    """lv op rv. rv: an expression; a pair for BETWEEN; a list for IN and NOTIN; nothing for IS and ISNOT."""

    lv: object
    op: str
    rv: object = None


COMPARE = {
    "GE": lambda a, b: a >= b,
    "LE": lambda a, b: a <= b,
    "GT": lambda a, b: a > b,
    "LT": lambda a, b: a < b,
    "EQ": lambda a, b: a == b,
    "NE": lambda a, b: a != b,
    "LIKE": lambda a, b: F.call_function("like", a, b),
    "NOTLIKE": lambda a, b: ~F.call_function("like", a, b),
}


def compile_pred(pred: Pred | Column) -> Column:
    if isinstance(pred, Column):
        return pred
    left = compile_expr(pred.lv)
    if pred.op in COMPARE:
        return COMPARE[pred.op](left, compile_expr(pred.rv))
    if pred.op == "BETWEEN":
        low, high = pred.rv
        return left.between(compile_expr(low), compile_expr(high))
    if pred.op in ("IN", "NOTIN"):
        found = left.isin(*[compile_expr(x) for x in pred.rv])
        return found if pred.op == "IN" else ~found
    if pred.op in ("IS", "ISNOT"):
        return left.isNull() if pred.op == "IS" else left.isNotNull()
    raise ExpressionError(f"no such comparison: {pred.op}")


def compile_predicates(items: list | tuple | Pred | Column | None) -> Column | None:
    """Precedence is NOT, then AND, then OR. Neighbours without a connector are joined by AND. None: no condition."""
    if items is None:
        return None
    if isinstance(items, (Pred, Column)):
        return compile_pred(items)
    items = list(items)
    if not items:
        return None
    at = 0

    def word(*words: str) -> bool:
        return at < len(items) and isinstance(items[at], str) and items[at].upper() in words

    def factor() -> Column:
        nonlocal at
        if at >= len(items):
            raise ExpressionError("a predicate is missing at the end")
        if word("NOT"):
            at += 1
            return ~factor()
        if word("("):
            at += 1
            inner = either()
            if not word(")"):
                raise ExpressionError("a bracket isn't closed")
            at += 1
            return inner
        if isinstance(items[at], str):
            raise ExpressionError(f"{items[at]} where a predicate is due")
        at += 1
        return compile_pred(items[at - 1])

    def both() -> Column:
        nonlocal at
        parts = [factor()]
        while at < len(items) and not word("OR", ")"):
            at += word("AND")
            parts.append(factor())
        return reduce(lambda a, b: a & b, parts)

    def either() -> Column:
        nonlocal at
        parts = [both()]
        while word("OR"):
            at += 1
            parts.append(both())
        return reduce(lambda a, b: a | b, parts)

    out = either()
    if at != len(items):
        raise ExpressionError(f"{items[at]} is left over")
    return out


def column_names(on: object) -> set[str]:
    """The columns of an expression or a condition, as they are written."""
    if isinstance(on, str):
        return set() if on.upper() in ("AND", "OR", "NOT", "(", ")") else {on}
    if getattr(on, "kind", None) is not None:
        return {on.value} if on.kind == "COLUMN" else set()
    if hasattr(on, "lv"):
        return column_names(on.lv) | column_names(on.rv)
    return set().union(*map(column_names, on)) if isinstance(on, (list, tuple)) else set()


def equal_pairs(items: list | tuple | Pred | None) -> list[tuple[str, str]] | None:
    """The column pairs, if the list is nothing but equalities of two columns joined by AND."""
    items = [items] if isinstance(items, Pred) else list(items or [])
    name = lambda x: x if isinstance(x, str) else x.value if getattr(x, "kind", "") == "COLUMN" else None
    pairs = []
    for item in items:
        if isinstance(item, str) and item.upper() == "AND":
            continue
        if not isinstance(item, Pred) or item.op != "EQ" or not (name(item.lv) and name(item.rv)):
            return None
        pairs.append((name(item.lv), name(item.rv)))
    return pairs
