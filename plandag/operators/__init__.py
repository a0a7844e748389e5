"""One function for each kind of stage, each from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plandag.operators import joins, subqueries
from plandag.operators.basic import block_filter, filter_rows, union
from plandag.operators.tail import tail
from plandag.plans.stage import Stage


def run_stage(stage: Stage, inputs: list[DataFrame]) -> DataFrame:
    """Combines the inputs as the kind says, then groups, projects, filters groups, orders and limits."""
    kind = stage.kind
    frames = [df.alias(name.rpartition(":")[2]) for df, name in zip(inputs, stage.inputs, strict=True)]
    right_name = stage.inputs[-1].rpartition(":")[2]
    if kind in ("FULL_SCAN", "INDEX_SCAN", "AGGREGATION", "FILTER"):
        df = filter_rows(frames[0], stage.where)
    elif kind == "INDEX_TABLE_SCAN":
        df = filter_rows(joins.join(*frames, stage.on, "left_semi"), stage.where)
    elif kind in joins.HOW and stage.spread:
        left_name = stage.inputs[0].rpartition(":")[2]
        own = lambda name: name.startswith(f"{left_name}.") or ("." not in name and name in frames[0].columns)
        df = filter_rows(joins.spread_join(*frames, stage.on, joins.HOW[kind], own), stage.where)
    elif kind in joins.HOW:
        df = filter_rows(joins.join(*frames, stage.on, joins.HOW[kind]), stage.where)
    elif kind == "UNION":
        df = union(frames, stage.distinct)
    elif kind == "IN":
        df = filter_rows(subqueries.membership(*frames, stage.compare[0], stage.on, stage.negate), stage.where)
    elif kind == "EXIST":
        df = filter_rows(subqueries.any_row(*frames, stage.on, stage.negate), stage.where)
    elif kind == "DEPENDENCY_EXIST":
        df = filter_rows(subqueries.exists(*frames, stage.on, right_name, stage.negate), stage.where)
    elif kind == "DEPENDENCY_IN":
        df = filter_rows(subqueries.correlated_membership(*frames, *stage.compare, stage.on, right_name, stage.negate), stage.where)
    elif kind == "DEPENDENCY_INNER_JOIN":
        df = filter_rows(subqueries.scalar_compare(*frames, stage.compare, stage.scalar, stage.on, right_name), stage.where)
    else:
        df = block_filter(frames[0], stage.where, stage.mask)
    return tail(df, stage)
