"""Tables laid out for the reports: a directory per day, and buckets by pool within it.

A filter on days then reads the directories of these days alone, and joins and aggregations on the pool
of tables with equal buckets need no exchange. The layout is declared once, where a table is written; a
reader gets the same columns as from plain files, with the day beside them.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.time import as_date

DAY = "block_date"


def write_table(
    df: DataFrame, name: str, ts: str = "block_timestamp", key: str = "pool_address", buckets: int = 64, path: str | None = None
) -> None:
    """Write ``df`` as table ``name`` with a directory per day of ``ts`` and ``buckets`` by ``key`` in each.

    Rows are dealt by day and bucket first, so a day has one file per bucket however many tasks read the source.
    A hot pool and day is one bucket of one day; the size of a day's bucket is what ``buckets`` is chosen by.
    """
    if DAY in df.columns:
        raise ValueError(f"{DAY} is the layout's own column")
    dated = df.withColumn(DAY, F.to_date(ts))
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    writer = (
        dated.repartition(DAY, bucket).write.mode("overwrite").format("parquet")
        .partitionBy(DAY).bucketBy(buckets, key).sortBy(key)
    )
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_days(spark: SparkSession, name: str, first: date | str, last: date | str, ts: str = "block_timestamp") -> DataFrame:
    """Rows of table ``name`` from ``first`` to ``last``, both included, without the layout's column.

    The day cuts the directories and the range of ``ts`` row groups within them. Rows without a time are of no day.
    """
    lo, hi = as_date(first), as_date(last)
    rows = spark.table(name).filter(F.col(DAY).between(F.lit(lo), F.lit(hi)))
    in_time = (F.col(ts) >= F.lit(str(lo)).cast("timestamp_ntz")) & (
        F.col(ts) < F.lit(str(hi + timedelta(days=1))).cast("timestamp_ntz")
    )
    return rows.filter(in_time).drop(DAY)
