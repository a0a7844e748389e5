"""IN, EXISTS and scalar subqueries, plain and correlated, as joins.

NOT IN keeps SQL's meaning of NULL but is spelled as hash anti-joins: a null-aware condition would become a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.functions.expr import compile_expr
from plandag.functions.predicate import COMPARE, Pred, column_names, compile_predicates, equal_pairs
from plandag.plans.stage import Proj


def membership(left: DataFrame, right: DataFrame, value: object, member: object, negate: bool) -> DataFrame:
    """left rows whose value is (not) among the members.

    NOT IN: nothing qualifies if a member is NULL; a NULL value qualifies only against no members at all.
    The facts about the members are one row, whatever their number, so it is broadcast.
    """
    x, y = compile_expr(value), compile_expr(member)
    if not negate:
        return left.join(right, x == y, "left_semi")
    facts = right.agg(F.count(F.lit(1)).alias("__members"), F.count_if(y.isNull()).alias("__nulls"))
    out = left.join(right, x == y, "left_anti").join(F.broadcast(facts), how="cross")
    return out.where((F.col("__nulls") == 0) & (x.isNotNull() | (F.col("__members") == 0))).drop("__members", "__nulls")


def any_row(left: DataFrame, right: DataFrame, where: object, negate: bool) -> DataFrame:
    """All left rows if right has a row that satisfies the condition (negate: has none), else none."""
    cond = compile_predicates(where)
    one = (right if cond is None else right.where(cond)).select(F.lit(1).alias("__one")).limit(1)
    return left.join(F.broadcast(one), F.lit(True), "left_anti" if negate else "left_semi")


def correlated_membership(left: DataFrame, right: DataFrame, value: object, member: object, on: object, right_name: str, negate: bool) -> DataFrame:
    """left rows whose value is (not) among the members of the right rows that satisfy the correlation."""
    x, y = compile_expr(value), compile_expr(member)
    correlated = compile_predicates(on)
    if not negate:
        return left.join(right, (x == y) & correlated, "left_semi")
    may_be_null = lambda df, c: df.select(c).schema[0].nullable
    out = left.where(x.isNotNull()).join(right, (x == y) & correlated, "left_anti")
    if may_be_null(right, y):
        out = exists(out, right.where(y.isNull()), on, right_name, True)
    if may_be_null(left, x):
        out = out.unionAll(exists(left.where(x.isNull()), right, on, right_name, True))
    return out


FLIPPED = {"LT": "GT", "LE": "GE", "GT": "LT", "GE": "LE", "EQ": "EQ"}


def sides(on: object, own: Callable[[str], bool]) -> tuple[list, list[tuple[object, object]], list[tuple[object, str, object]]] | None:
    """A condition that is nothing but comparisons joined by AND, taken apart: those of right columns alone, the pairs (left, right) that must
    be equal, and the inequalities as (left, op, right). None if it is anything else."""
    alone, pairs, ordered = [], [], []
    for item in [on] if isinstance(on, Pred) else list(on or []):
        if isinstance(item, str) and item.upper() == "AND":
            continue
        if not isinstance(item, Pred):
            return None
        of = [{own(n) for n in column_names(x)} for x in (item.lv, item.rv)]
        if of[0] | of[1] == {True}:
            alone.append(item)
        elif item.op in FLIPPED and of in ([{False}, {True}], [{True}, {False}]):
            lv, op, rv = (item.lv, item.op, item.rv) if of[1] == {True} else (item.rv, FLIPPED[item.op], item.lv)
            if op == "EQ":
                pairs.append((lv, rv))
            else:
                ordered.append((lv, op, rv))
        else:
            return None
    return alone, pairs, ordered


def exists(left: DataFrame, right: DataFrame, on: object, right_name: str, negate: bool) -> DataFrame:
    """left rows for which some right row (negate: none) satisfies the condition.

    One inequality beside any number of equalities holds for some right row if it holds for the largest or smallest one of its key: right is
    summed up to that, so no pairs of rows are tried. Other conditions are left to Catalyst.
    """
    how = "left_anti" if negate else "left_semi"
    parts = sides(on, lambda name: name.startswith(f"{right_name}.") or ("." not in name and name in right.columns))
    if parts is None or len(parts[2]) != 1:
        return left.join(right, compile_predicates(on), how)
    alone, pairs, [(value, op, bound)] = parts
    if alone:
        right = right.where(compile_predicates(alone))
    most = (F.max if op in ("LT", "LE") else F.min)(compile_expr(bound)).alias("__bound")
    if not pairs:
        found = F.coalesce(COMPARE[op](compile_expr(value), right.select(most).scalar()), F.lit(False))
        return left.where(~found if negate else found)
    sub = right.groupBy(*[compile_expr(b).alias(f"__k{k}") for k, (_, b) in enumerate(pairs)]).agg(most)
    same = [compile_expr(a) == F.col(f"__k{k}") for k, (a, _) in enumerate(pairs)]
    return left.join(sub, reduce(lambda a, b: a & b, [*same, COMPARE[op](compile_expr(value), F.col("__bound"))]), how)


def aggregate(how: str, expr: object) -> Column:
    if how == "COUNTSTAR":
        return F.count(F.lit(1))
    functions = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "COUNTDISTINCT": F.count_distinct, "MIN": F.min, "MAX": F.max}
    return functions[how](compile_expr(expr))


def scalar_compare(left: DataFrame, right: DataFrame, compare: tuple[object, str], scalar: Proj, on: object, right_name: str) -> DataFrame:
    """left rows for which ``value op (select scalar from right where on)`` holds.

    Equalities only: right is aggregated once for each key and joined; counts of no rows are 0.
    Any other correlation is left to Catalyst's decorrelation of scalar subqueries.
    """
    value, op = compare
    expr = compile_expr(scalar.expr) if scalar.how == "COLUMNNAME" else aggregate(scalar.how, scalar.expr)
    own = lambda name: name.startswith(f"{right_name}.") or ("." not in name and name in right.columns)
    pairs = [(a, b) if own(b) else (b, a) for a, b in equal_pairs(on) or []]
    if pairs and all(own(b) and not own(a) for a, b in pairs):
        keys = [F.col(b).alias(f"__k{k}") for k, (_, b) in enumerate(pairs)]
        sub = right.groupBy(*keys).agg(expr.alias("__scalar"))
        cond = None
        for k, (a, _) in enumerate(pairs):
            cond = (same := F.col(a) == F.col(f"__k{k}")) if cond is None else cond & same
        got = F.coalesce(F.col("__scalar"), F.lit(0)) if scalar.how.startswith("COUNT") else F.col("__scalar")
        out = left.join(sub, cond, "left" if scalar.how.startswith("COUNT") else "inner").where(COMPARE[op](compile_expr(value), got))
        return out.drop("__scalar", *[f"__k{k}" for k in range(len(pairs))])
    outer = {name: F.col(name).outer() for name in column_names(on) if not own(name)}
    sub = right.where(compile_predicates(_outer(on, outer))).select(expr.alias("__scalar"))  # agg() would resolve the outer columns too early
    return left.where(COMPARE[op](compile_expr(value), sub.scalar()))


def _outer(on: object, outer: dict[str, Column]) -> object:
    """The same condition, with the columns of the outer query marked."""
    if isinstance(on, str):
        return outer.get(on, on)
    if getattr(on, "kind", None) is not None:
        return outer.get(on.value, on) if on.kind == "COLUMN" else on
    if hasattr(on, "lv"):
        return type(on)(_outer(on.lv, outer), on.op, _outer(on.rv, outer))
    return type(on)(_outer(x, outer) for x in on) if isinstance(on, (list, tuple)) else on
