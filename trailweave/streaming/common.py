"""Running a stream over files to its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which keyed processors need, for streams that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_to_end(
    spark: SparkSession, build: Callable[[DataFrame], DataFrame], out: str, schema: str, row: str, at: str, last: Callable[[], DataFrame] | None, ahead: int, late: list[int] | None = None
) -> DataFrame:
    """Runs ``build(closing)`` in append mode over what is there now into parquet under ``out`` and returns its rows.

    ``closing`` is a stream of rows of schema ``row`` that the built one reads beside its source. With ``last``
    (a frame of one row with the largest ``at`` of the source) a row of nulls ``ahead`` later follows the data, so
    that the watermark passes everything. ``late`` is given the number of rows that came behind the watermark.
    """
    closing, names = f"{out}/closing", [x.split()[0] for x in row.split(", ")]
    spark.createDataFrame([], row).write.mode("ignore").parquet(closing)
    job = build(spark.readStream.schema(row).parquet(closing)).writeStream.format("parquet").option("path", f"{out}/rows")
    job = job.option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True)

    def run() -> None:
        query = job.start()
        query.awaitTermination()
        if late is not None:
            late.extend(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)

    run()
    if last is not None:
        kinds = dict(x.split() for x in row.split(", "))
        moved = last().select(F.col(at).alias(at))
        shift = F.col(at) + ahead if kinds[at] == "long" else (F.col(at) + F.make_dt_interval(secs=F.lit(ahead / 1_000_000))).cast(kinds[at])
        moved.select(*[shift.alias(n) if n == at else F.lit(None).cast(kinds[n]).alias(n) for n in names]).write.mode("append").parquet(closing)
        run()
    return spark.read.schema(schema).parquet(f"{out}/rows")
