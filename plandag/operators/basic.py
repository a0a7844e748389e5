"""Filters, unions and the raw-block filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plandag.functions.predicate import COMPARE, Pred, compile_predicates


def filter_rows(df: DataFrame, where: object) -> DataFrame:
    cond = compile_predicates(where)
    return df if cond is None else df.where(cond)


def union(frames: list[DataFrame], distinct: bool) -> DataFrame:
    """By column name; distinct also drops rows that occur twice within one input, as in SQL."""
    out = reduce(lambda a, b: a.unionByName(b), frames)
    return out.distinct() if distinct else out


def block_filter(df: DataFrame, where: list[Pred] | None, mask: tuple[str, ...] | None) -> DataFrame:
    """Comparisons joined by AND with blank-padded strings; a comparison with NULL fails. Columns outside the mask become NULL."""
    from plandag.functions.expr import compile_expr

    kinds = {f.name: f.dataType for f in df.schema}
    padded = lambda x: isinstance(x, str) and isinstance(kinds.get(x), T.StringType) or getattr(x, "kind", "") == "STRING" or getattr(x, "kind", "") == "COLUMN" and isinstance(kinds.get(x.value), T.StringType)
    side = lambda x: F.rtrim(compile_expr(x)) if padded(x) else compile_expr(x)
    for pred in where or []:
        df = df.where(COMPARE[pred.op](side(pred.lv), side(pred.rv)))
    if mask is None:
        return df
    return df.select(*[F.col(f.name) if f.name in mask else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
