"""Joins on any condition. Catalyst takes the equalities as keys and picks the strategy from sizes it has measured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.functions.expr import compile_expr
from plandag.functions.predicate import Pred, column_names, compile_predicates

HOW = {"INNER_JOIN": "inner", "LEFT_OUTER_JOIN": "left", "RIGHT_OUTER_JOIN": "right", "FULL_OUTER_JOIN": "full", "CROSS_JOIN": "cross"}

#: A spread join deals each side that it can into so many parts, and the pairs of parts to so many tasks.
PARTS, TASKS = 24, 96


def join(left: DataFrame, right: DataFrame, on: object, how: str) -> DataFrame:
    """The whole condition stands in ON, so outer joins keep their residual parts. No condition: every pair."""
    cond = compile_predicates(on)
    if cond is None:
        return left.crossJoin(right)
    return left.join(right, cond, "inner" if how == "cross" else how)


def spread_join(left: DataFrame, right: DataFrame, on: object, how: str, own: Callable[[str], bool]) -> DataFrame:
    """The same rows as join(), for conditions by which a few keys, or none, make far more rows than there are in the inputs.

    How many rows a key makes isn't seen in the bytes of the inputs, by which Spark deals out work, so one task could make them all. Here an
    inner join makes every pair of a left and a right part in one task. An outer join deals out the rows that it keeps, and copies the others
    to all parts. Equalities stay keys. own: whether a name is a left column.
    """
    cond, keys = compile_predicates(on), equalities(on, own)
    part, each = F.spark_partition_id(), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))

    def dealt(df: DataFrame, name: str, cell: Callable[[Column, Column], Column] | None, of: list) -> DataFrame:
        """cell: of the row's own part and of each of the other side's; None: each part gets a copy."""
        if cell:
            df = df.repartition(PARTS).withColumn("__part", part)
            df = df.withColumn("__each", each if how == "inner" else F.lit(0)).withColumn(name, cell(F.col("__part"), F.col("__each"))).drop("__part", "__each")
        else:
            df = df.withColumn(name, each)
        return df.repartition(TASKS, *map(compile_expr, of), F.col(name))

    left = dealt(left, "__left", None if how == "right" else lambda own, other: own * PARTS + other if how == "inner" else own, [a for a, _ in keys])
    right = dealt(right, "__right", None if how == "left" else lambda own, other: other * PARTS + own if how == "inner" else own, [b for _, b in keys])
    return left.join(right, cond & (F.col("__left") == F.col("__right")), how).drop("__left", "__right")


def equalities(on: object, own: Callable[[str], bool]) -> list[tuple[object, object]]:
    """The (left, right) expressions that must be equal, of a condition that is nothing but comparisons joined by AND; else none."""
    pairs = []
    for item in [on] if isinstance(on, Pred) else list(on):
        if isinstance(item, str) and item.upper() == "AND":
            continue
        if not isinstance(item, Pred):
            return []
        of = [{own(n) for n in column_names(x)} for x in (item.lv, item.rv)]
        if item.op == "EQ" and of in ([{True}, {False}], [{False}, {True}]):
            pairs.append((item.lv, item.rv) if of[0] == {True} else (item.rv, item.lv))
    return pairs
