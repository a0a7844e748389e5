"""Named tables. A table is a lazy DataFrame; its filters and columns reach the file scan through Catalyst."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def overlay(base: DataFrame, key: str | list[str], deleted: DataFrame | None = None, inserted: DataFrame | None = None) -> DataFrame:
    """base without the rows whose key is in deleted, and with those of inserted.

    Rows that replace a base row come with their key in deleted. A NULL key never matches, so such base rows stay.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = base if deleted is None else base.join(deleted.select(*keys).distinct(), keys, "left_anti").select(*base.columns)
    return out if inserted is None else out.unionByName(inserted.select(*base.columns))


@dataclass
class Catalog:
    spark: SparkSession
    root: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
        """A registered table, or else ``root/name.fmt``."""
        if name not in self.tables:
            if fmt not in FORMATS:
                raise ValueError(f"no such format: {fmt}")
            self.tables[name] = self.spark.read.format(fmt).options(**options).load(f"{self.root}/{name}.{fmt}")
        return self.tables[name]

    def subset(self, name: str, files: list[str], fmt: str = "parquet", **options: str) -> DataFrame:
        """The rows of some of a table's files: paths, or names within ``root/name.fmt``. Its columns are those of the whole table."""
        whole = self.table(name, fmt, **options)
        known = {path: path for path in whole.inputFiles()} | {path.rpartition("/")[2]: path for path in whole.inputFiles()}
        if unknown := [f for f in files if f not in known]:
            raise ValueError(f"{name} has no such files: {unknown}")
        if not files:
            return whole.limit(0)
        return self.spark.read.format(fmt).options(**options).schema(whole.schema).load([known[f] for f in files])

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def with_overlay(self, name: str, key: str | list[str], deleted: DataFrame | None = None, inserted: DataFrame | None = None) -> DataFrame:
        self.tables[name] = overlay(self.table(name), key, deleted, inserted)
        return self.tables[name]

    def metadata(self, name: str) -> dict:
        """Columns with their types, and the files behind a table."""
        df = self.table(name)
        return {"columns": [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "files": df.inputFiles()}
