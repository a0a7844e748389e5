"""plandag: analytical plans written as small DAGs of stages, compiled to lazy Spark DataFrames."""

from plandag.plans.pipeline import Pipeline
from plandag.plans.stage import Proj, Stage, StageError
from plandag.sources.catalog import Catalog

__all__ = ["Catalog", "Pipeline", "Proj", "Stage", "StageError"]
