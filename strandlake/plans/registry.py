"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to Python at a time.
BATCH_BYTES = 1 << 22

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. From now on Python gets BATCH_BYTES of rows at a time, about, however many a task has; a smaller number that is set stays."""
    have = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < have <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ABC = "abcdefghijklmnopqrstuvwxyz"
_ACGT = ("acgt" * 7)[:26]
#: A text as bases, in SQL.
DNA = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_ABC}', '{_ACGT}')"
#: A text as bases in their own case with full stops as N, in SQL.
GAPPED = f"translate(regexp_replace(text, '[^A-Za-z.]', '', 'g'), '{_ABC + _ABC.upper()}.', '{_ACGT + _ACGT.upper()}N')"
#: Events as intervals of their user, in SQL.
EVENTS = "SELECT user_id, floor(epoch(ts))::BIGINT AS beg, floor(epoch(ts))::BIGINT + floor(value)::BIGINT + 60 AS \"end\", event_id FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    beg = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))").cast("long")
    return table(spark, sf_dir, "events").select("user_id", beg.alias("beg"), (beg + F.floor("value").cast("long") + 60).alias("end"), "event_id")
