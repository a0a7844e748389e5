"""Runs a list of stages: each alias is bound to a lazy DataFrame, the last one is the result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plandag.operators import run_stage
from plandag.plans.stage import Stage, StageError
from plandag.sources.catalog import Catalog


@dataclass
class Pipeline:
    """No stage is materialised: Catalyst sees the whole DAG as one plan, and reuses equal exchanges of shared stages.

    count_rows: the rows that stages scan from tables and keep are counted while an action runs. Filters then stay above the scans.
    """

    catalog: Catalog
    bound: dict[str, DataFrame] = field(default_factory=dict)
    count_rows: bool = False
    seen: dict[str, dict[str, Observation]] = field(default_factory=dict)

    def submit(self, stage: Stage) -> DataFrame:
        stage.validate()
        if stage.alias in self.bound:
            raise StageError(f"{stage.alias} is bound already")
        inputs = [self.read(name) for name in stage.inputs]
        if self.count_rows:
            tables = [name.partition(":")[0] not in self.bound for name in stage.inputs]
            own = self.seen.setdefault(stage.alias, {})
            inputs = [self.observed(df, own, f"scanned {k}") if scan else df for k, (df, scan) in enumerate(zip(inputs, tables, strict=True))]
        out = run_stage(stage, inputs)
        self.bound[stage.alias] = self.observed(out, self.seen[stage.alias], "kept") if self.count_rows else out
        return self.bound[stage.alias]

    @staticmethod
    def observed(df: DataFrame, own: dict[str, Observation], what: str) -> DataFrame:
        own[what] = Observation()
        return df.observe(own[what], F.count(F.lit(1)).alias("rows"))

    def counts(self) -> dict[str, dict[str, int]]:
        """For each stage, the rows scanned from tables and the rows kept. To be asked once an action over the last stage has ended."""
        got = {alias: {what: seen.get["rows"] for what, seen in own.items()} for alias, own in self.seen.items()}
        return {alias: {"scanned": sum(n for what, n in own.items() if what != "kept"), "kept": own["kept"]} for alias, own in got.items()}

    def read(self, name: str) -> DataFrame:
        """``table`` or ``table:alias``; the alias names the input within its stage, for self-joins."""
        name = name.partition(":")[0]
        return self.bound[name] if name in self.bound else self.catalog.table(name)

    def run(self, stages: Iterable[Stage]) -> DataFrame:
        out = None
        for stage in stages:
            out = self.submit(stage)
        if out is None:
            raise StageError("no stages")
        return out

    def end(self) -> None:
        """Forgets the bound stages, and frees those that a caller has persisted."""
        for df in self.bound.values():
            df.unpersist()
        self.bound.clear()
        self.seen.clear()
