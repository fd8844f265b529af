"""The forward log: an idempotent keyed merge, its freshness gate, and the streams that feed it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "symbol", "signal_time")
#: Minutes between a signal and its detection up to which it counts as live.
FRESH_MINUTES = 30


def merged(held: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = KEYS, closed: str = "closed", once: tuple[str, ...] = ()) -> DataFrame:
    """``held`` with ``fresh`` put in: new keys are added, closed rows stay as they are, of open ones every column takes
    the fresh value, but those in ``once`` only where they are still missing. Merging the same rows again changes nothing.
    Keys are unique on either side."""
    cols = [c for c in held.columns if c not in keys]
    h = held.select(*keys, F.struct(*cols).alias("_h"))
    f = fresh.select(*keys, F.struct(*cols).alias("_f"))
    both = h.join(f, list(keys), "full")
    fixed = F.col("_f").isNull() | F.coalesce(F.col(f"_h.{closed}"), F.lit(False))
    pick = lambda c: F.coalesce(F.col(f"_h.{c}"), F.col(f"_f.{c}")) if c in once else F.coalesce(F.col(f"_f.{c}"), F.col(f"_h.{c}"))
    return both.select(*keys, *(F.when(fixed & F.col("_h").isNotNull(), F.col(f"_h.{c}")).otherwise(pick(c)).alias(c) for c in cols)).select(held.columns)


def live(log: DataFrame, minutes: float = FRESH_MINUTES) -> DataFrame:
    """``log`` with lag_min and whether the row was found in time."""
    lag = (F.unix_seconds(F.col("detected_at").cast("timestamp")) - F.unix_seconds(F.col("signal_time").cast("timestamp"))) / 60.0
    return log.withColumn("lag_min", lag).withColumn("is_live", F.coalesce(F.col("lag_min").between(0, minutes), F.lit(False)))


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type", time: str = "ts", value: str = "value") -> DataFrame:
    """Bars of a stream of ticks: a bar is given out once the watermark has passed its end."""
    order = F.struct(time, "event_id")
    grouped = ticks.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key).alias("symbol"))
    bars = grouped.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("n"))
    return bars.select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "n")


def unseen(rows: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """A stream without rows whose key came before, within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def read_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """A log that ``into_log`` keeps: of every day the last version, or the last one ``before`` a number. None without any.
    Columns are those of the log and ``day``."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    held = held if before is None else held.where(F.col("version") < before)
    last = held.groupBy("day").agg(F.max("version").alias("version"))  # one row a day, from the folders' names
    return held.join(F.broadcast(last), ["day", "version"]).drop("version")


def into_log(path: str, keys: tuple[str, ...] = KEYS, closed: str = "closed", once: tuple[str, ...] = (), time: str = "signal_time") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch into a log under ``path``, which ``read_log`` reads.

    The log is kept by the day of ``time``, and a batch writes new versions of the days that it has rows of, from the last
    versions before it; all other days stay as they are. A batch that runs again writes the same versions again, so
    restarts change nothing. Rows without a time are one day; columns called ``day`` and ``version`` aren't allowed.
    """

    def put(batch: DataFrame, number: int) -> None:
        day = F.concat(F.lit("d"), F.coalesce(F.date_format(time, "yyyyMMdd"), F.lit("none"))).alias("day")  # read back as a text
        fresh = batch.select("*", day)
        held = read_log(batch.sparkSession, path, number)
        if held is None:
            held = fresh.limit(0)
        touched = held.join(F.broadcast(fresh.select("day").distinct()), "day", "left_semi").select(fresh.columns)
        merged(touched, fresh, keys, closed, once).write.mode("overwrite").partitionBy("day").parquet(f"{path}/version={number}")

    return put
