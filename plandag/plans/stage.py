"""A plan stage: what to read, how to combine it, and the tail that every kind shares."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import NamedTuple

from plandag.functions.expr import LITERAL_TYPES, Tok
from plandag.functions.predicate import Pred


class StageError(ValueError):
    """A stage, or a list of them, that can't be run."""


AGGREGATES = ("SUM", "AVG", "COUNT", "COUNTSTAR", "COUNTDISTINCT", "MIN", "MAX")


class Proj(NamedTuple):
    """An output column. how: COLUMNNAME for a plain expression, or an aggregate."""

    alias: str
    expr: object = None
    how: str = "COLUMNNAME"


#: Number of inputs of each kind.
KINDS = {
    "FULL_SCAN": 1, "INDEX_SCAN": 1, "INDEX_TABLE_SCAN": 2, "AGGREGATION": 1, "FILTER": 1, "INNER_JOIN": 2, "LEFT_OUTER_JOIN": 2, "RIGHT_OUTER_JOIN": 2, "FULL_OUTER_JOIN": 2,
    "CROSS_JOIN": 2, "UNION": 2, "IN": 2, "EXIST": 2, "DEPENDENCY_INNER_JOIN": 2, "DEPENDENCY_EXIST": 2, "DEPENDENCY_IN": 2, "BLOCK_FILTER": 1,
}


def is_kind(x: object) -> bool:
    """Whether a token can be of this kind."""
    return isinstance(x, str) and (x in ("COLUMN", "OPERATOR", "CAST", *LITERAL_TYPES) or x.startswith("DECIMAL("))


@dataclass(frozen=True)
class Stage:
    """inputs: tables or aliases of earlier stages. on: condition of a join, a correlation or a membership.

    negate: NOT IN, NOT EXISTS. scalar and compare: for DEPENDENCY_INNER_JOIN, ``compare[0] compare[1] (select scalar)``.
    spread: deals a join's work out evenly, for conditions by which each row meets a share of the other table.
    where: filter on the input of one-input kinds, on the joined rows else. mask: columns that BLOCK_FILTER keeps; the others become NULL.
    """

    kind: str
    inputs: tuple[str, ...]
    alias: str
    where: object = None
    on: object = None
    project: tuple[Proj, ...] = ()
    group_by: tuple[str, ...] = ()
    having: object = None
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int = 0
    negate: bool = False
    distinct: bool = False
    scalar: Proj | None = None
    compare: tuple[object, str] | None = None
    mask: tuple[str, ...] | None = None
    spread: bool = False

    def validate(self) -> None:
        if self.kind not in KINDS:
            raise StageError(f"{self.alias}: no such kind: {self.kind}")
        if len(self.inputs) != KINDS[self.kind] and not (self.kind == "UNION" and len(self.inputs) > 1):
            raise StageError(f"{self.alias}: {self.kind} takes {KINDS[self.kind]} inputs, not {len(self.inputs)}")
        if self.kind.endswith("OUTER_JOIN") and self.on is None:
            raise StageError(f"{self.alias}: an outer join needs a condition")
        if self.spread and (self.kind not in ("INNER_JOIN", "LEFT_OUTER_JOIN", "RIGHT_OUTER_JOIN") or not self.on):
            raise StageError(f"{self.alias}: only an inner, left or right join with a condition can be spread")
        if self.kind in ("IN", "DEPENDENCY_EXIST", "DEPENDENCY_IN", "DEPENDENCY_INNER_JOIN") and self.on is None:
            raise StageError(f"{self.alias}: {self.kind} needs a condition")
        if self.kind in ("IN", "DEPENDENCY_IN", "DEPENDENCY_INNER_JOIN") and self.compare is None:
            raise StageError(f"{self.alias}: {self.kind} needs the compared value")
        if self.kind == "DEPENDENCY_INNER_JOIN" and self.scalar is None:
            raise StageError(f"{self.alias}: no subquery column")
        for p in self.project:
            if p.how not in ("COLUMNNAME", *AGGREGATES):
                raise StageError(f"{self.alias}: no such aggregate: {p.how}")
        if len({p.alias for p in self.project}) < len(self.project):
            raise StageError(f"{self.alias}: an output name occurs twice")
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise StageError(f"{self.alias}: negative limit or offset")

    @staticmethod
    def from_json(text: str) -> Stage:
        """Tokens are ``["COLUMN", "x"]`` pairs of a known kind, or ``{"kind":, "value":}``; predicates ``{"lv":, "op":, "rv":}``, connectors plain strings.
        What BETWEEN, IN and NOTIN compare with is a list of operands, whatever it looks like."""

        def read(x: object) -> object:
            if isinstance(x, dict) and "kind" in x:
                return Tok(x["kind"], x["value"])
            if isinstance(x, dict):
                several = x["op"] in ("BETWEEN", "IN", "NOTIN")
                return Pred(read(x["lv"]), x["op"], [read(y) for y in x["rv"]] if several else read(x.get("rv")))
            if isinstance(x, list):
                return Tok(*x) if len(x) == 2 and is_kind(x[0]) and not isinstance(x[1], (list, dict)) else [read(y) for y in x]
            return x

        d = json.loads(text)
        proj = lambda p: Proj(p["alias"], read(p.get("expr")), p.get("how", "COLUMNNAME"))
        for k in ("where", "on", "having"):
            d[k] = read(d.get(k))
        d["project"] = tuple(map(proj, d.get("project", ())))
        d["scalar"] = proj(d["scalar"]) if d.get("scalar") else None
        d["compare"] = (read(d["compare"][0]), read(d["compare"][1])) if d.get("compare") else None
        for k in ("inputs", "group_by"):
            d[k] = tuple(d.get(k, ()))
        d["order_by"] = tuple(map(tuple, d.get("order_by", ())))
        d["mask"] = tuple(d["mask"]) if d.get("mask") is not None else None
        return Stage(**d)
