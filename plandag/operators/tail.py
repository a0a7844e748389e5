"""What follows every kind: group, project, filter the groups, order, limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plandag.functions.expr import compile_expr
from plandag.functions.predicate import compile_predicates
from plandag.operators.subqueries import aggregate
from plandag.plans.stage import AGGREGATES, Stage, StageError


def grouped(df: DataFrame, stage: Stage) -> DataFrame:
    """Partial and final hash aggregation. A bare column outside the keys gives the value of some row of the group."""
    keys = {k.rpartition(".")[2]: F.col(k) for k in stage.group_by}
    out, after = [], []
    for p in stage.project:
        name = p.expr if isinstance(p.expr, str) else p.expr.value if getattr(p.expr, "kind", "") == "COLUMN" else None
        if p.how in AGGREGATES:
            out.append(aggregate(p.how, p.expr).alias(p.alias))
            after.append(F.col(p.alias))
        elif name is not None and name.rpartition(".")[2] in keys:
            after.append(F.col(f"__key_{name.rpartition('.')[2]}").alias(p.alias))
        else:
            out.append(F.first(compile_expr(p.expr)).alias(p.alias))
            after.append(F.col(p.alias))
    named = [col.alias(f"__key_{k}") for k, col in keys.items()]
    if not out:
        return df.select(*named).distinct().select(*after)
    return (df.groupBy(*named) if named else df).agg(*out).select(*after)


def tail(df: DataFrame, stage: Stage) -> DataFrame:
    if stage.group_by or any(p.how in AGGREGATES for p in stage.project):
        if not stage.project:
            raise StageError(f"{stage.alias}: groups without output columns")
        df = grouped(df, stage)
    elif stage.project:
        df = df.select(*[compile_expr(p.expr).alias(p.alias) for p in stage.project])
    elif len(set(df.columns)) < len(df.columns):
        raise StageError(f"{stage.alias}: the inputs share column names; name the output columns")
    if (cond := compile_predicates(stage.having)) is not None:
        df = df.where(cond)
    if stage.order_by:
        df = df.orderBy(*[F.col(name).desc() if way == "DESC" else F.col(name).asc() for name, way in stage.order_by])
    if stage.offset:
        df = df.offset(stage.offset)
    return df if stage.limit is None else df.limit(stage.limit)
