"""What becomes of a result: files, a columnar dictionary, or a box of text."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    out = df.write.format(fmt).mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def columns(df: DataFrame, rows: int | None = None) -> dict[str, list]:
    """All rows by column, on the driver; rows: the first so many only. A result of any size is read by column_batches()."""
    return (df if rows is None else df.limit(rows)).toArrow().to_pydict()


def column_batches(df: DataFrame, rows: int = 10_000) -> Iterator[dict[str, list]]:
    """All rows by column, so many at a time; the driver holds a partition at most."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == rows:
            yield dict(zip(df.columns, map(list, zip(*held, strict=True)), strict=True))
            held = []
    if held:
        yield dict(zip(df.columns, map(list, zip(*held, strict=True)), strict=True))


def _cell(value: object, digits: int | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()[:10] if not isinstance(value, datetime.datetime) or value.time() == datetime.time() else value.isoformat(" ")
    if digits is not None and isinstance(value, (float, Decimal)):
        return f"{value:.{digits}f}"
    return str(value)


def box(df: DataFrame, rows: int | None = None, digits: int | None = None) -> str:
    """All rows as a table of text, left aligned; rows: the first so many, with a last line that says so if there are more. digits: decimals of floats."""
    data = columns(df, None if rows is None else rows + 1)
    more = rows is not None and any(len(v) > rows for v in data.values())
    data = {k: v[:rows] for k, v in data.items()}
    cells = {k: [k, *(_cell(x, digits) for x in v)] for k, v in data.items()}
    widths = {k: max(map(len, v)) for k, v in cells.items()}
    rule = "+" + "+".join("-" * (w + 2) for w in widths.values()) + "+"
    line = lambda r: "|" + "|".join(f" {cells[k][r]:<{w}} " for k, w in widths.items()) + "|"
    n = max((len(v) for v in data.values()), default=0)
    tail = [f"(the first {n} rows; there are more)"] if more else []
    return "\n".join([rule, line(0), rule, *(line(r) for r in range(1, n + 1)), *([rule] if n else []), *tail])
