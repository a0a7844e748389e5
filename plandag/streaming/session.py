"""Queries whose stages arrive one at a time, with counters of scanned and kept rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plandag.plans.pipeline import Pipeline
from plandag.plans.stage import Stage, StageError
from plandag.sources.catalog import Catalog


@dataclass
class QuerySession:
    """submit() only extends the plan; what the last stage returns is read by result(), and end() frees the query."""

    catalog: Catalog
    pipelines: dict[int, Pipeline] = field(default_factory=dict)
    last: dict[int, str] = field(default_factory=dict)
    count_rows: bool = False

    def submit(self, query: int, stage: Stage) -> None:
        self.pipelines.setdefault(query, Pipeline(self.catalog, count_rows=self.count_rows)).submit(stage)
        self.last[query] = stage.alias

    def result(self, query: int) -> DataFrame:
        if query not in self.last:
            raise StageError(f"query {query} has no stages")
        return self.pipelines[query].bound[self.last[query]]

    def counts(self, query: int) -> dict[str, dict[str, int]]:
        """Rows scanned and kept by each stage, once the result has been read; the session must have been made with count_rows."""
        return self.pipelines[query].counts()

    def end(self, query: int) -> None:
        self.last.pop(query, None)
        if query in self.pipelines:
            self.pipelines.pop(query).end()


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df with a row counter that fills while an action runs; ``.get`` gives {"rows": n}."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
