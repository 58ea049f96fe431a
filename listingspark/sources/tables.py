"""Tables that batches write: one Parquet folder a batch, so that a batch which is repeated replaces what it wrote before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]
_NOTHING_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class BatchTable:
    """Rows by key under ``path/batch=N``; of a key's rows the one of the last batch counts.

    A batch writes the keys that it touches and nothing else. Spark moves a batch's files into place when all its tasks are
    done, so a writer that is lost leaves no rows, and its batch is written again under the same number.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def rows(self, before: int | None = None) -> DataFrame | None:
        """All rows of all batches, or of those before one; None while there are none."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in _NOTHING_YET:
                return None
            raise
        return found if before is None else found.filter(F.col("batch") < before)

    def current(self, before: int | None = None) -> DataFrame | None:
        """The row of every key, as it is or as it was before a batch. Each task keeps one row a key before the shuffle."""
        found = self.rows(before)
        if found is None:
            return None
        names = [n for n in found.columns if n not in (*self.keys, "batch")]
        last = found.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(True).alias("_"), *names), "batch").alias("r"))
        return last.select(*self.keys, *[F.col(f"r.{n}").alias(n) for n in names])

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def upsert(self, incoming: DataFrame, merge: Merge, batch: int) -> None:
        """Write what ``merge`` makes of the incoming rows and the rows that their keys had before this batch.

        ``merge`` gets None while the table has no rows.
        """
        incoming = cut_lineage(incoming, "incoming")
        base = self.current(batch)
        if base is not None:
            base = base.join(incoming.select(*self.keys).distinct(), self.keys, "left_semi")
        self.write(merge(base, incoming), batch)

    def compacted(self, path: str) -> BatchTable:
        """A new table with the current rows in one batch; the old one's folder can then go."""
        table = BatchTable(self.spark, path, *self.keys)
        found = self.current()
        if found is not None:
            table.write(found, self.rows().agg(F.max("batch")).first()[0])
        return table


def drop_expired_days(spark: SparkSession, table: str, day: str, keep: str, first_day: str) -> int:
    """Retention on a catalog table that is partitioned by day: days before ``first_day`` are dropped unread, the rows of
    that day which don't satisfy ``keep`` go, later days are not touched. Returns how many days were dropped."""
    days = sorted(r.partition.split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    gone = [d for d in days if d < first_day]
    if gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION ({day} = '{d}')" for d in gone))
    if first_day in days:
        own = f"{day} = DATE'{first_day}'"
        left = cut_lineage(spark.table(table).filter(own).filter(keep), "kept-day")
        left.drop(day).createOrReplaceTempView("_kept_day")
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({day} = '{first_day}') SELECT * FROM _kept_day")
        spark.catalog.dropTempView("_kept_day")
    return len(gone)
