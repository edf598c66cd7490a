"""Registry of this package's queries, and helpers all its operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import prepare

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a function (session, folder) -> DataFrame under its own name."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        QUERIES[fn.__name__] = (run, sql)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores, whichever no column of ``df`` bears."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def cells_for(rows: int, rows_per_cell: int) -> int:
    """How many cells keep each near ``rows_per_cell`` rows; one rule at every size."""
    return max(1, -(-rows // rows_per_cell))


def once_per_worker(key: str, make):
    """What ``make`` returns, kept for later tasks of the same Python worker process."""
    import sys
    import types

    kept = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
