"""A plan over an unbounded table: each micro-batch of the growing table runs through the same stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plandag.plans.pipeline import Pipeline
from plandag.plans.stage import Stage
from plandag.sources.catalog import Catalog


def run_on_stream(stream: DataFrame, name: str, catalog: Catalog, stages: list[Stage], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the stages over each batch, bound under name beside the catalog's other tables. sink gets (result, batch id) and must be idempotent by id."""

    def batch(df: DataFrame, epoch: int) -> None:
        own = Catalog(df.sparkSession, catalog.root, {**catalog.tables, name: df})
        sink(Pipeline(own).run(stages), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
