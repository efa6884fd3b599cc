"""Streaming forms of the position-ordered operators; each also runs on a batch.

Position is event time: what lies behind the watermark is settled and dropped
from the state, late rows are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sliding_sums(rows: DataFrame, time: str, value: str, window: str, step: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums over sliding windows."""
    out = rows.withWatermark(time, late).groupBy(*by, F.window(time, window, step))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(rows: DataFrame, time: str, value: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Clusters of rows closer than ``gap``."""
    out = rows.withWatermark(time, late).groupBy(*by, F.session_window(time, gap))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def first_of_key(rows: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """One row of each key within the watermark: the de-duplication of molecules."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def earliest_of_key(rows: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """The first row in time of each key of a batch."""
    own = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*own), time).alias("_row")).select(*keys, "_row.*")


def not_late(rows: DataFrame, time: str, arrival: str, late_seconds: int, bin_rows: int = 1 << 16) -> DataFrame:
    """Rows of a batch no more than so far behind the latest that arrived before them; later ones are dropped, as by a watermark.

    Running maxima go in two levels, bins of the order of arrival and then within,
    so no task orders all rows.
    """
    bin_of = F.floor(F.col(arrival) / bin_rows)
    tops = rows.groupBy(bin_of.alias("_bin")).agg(F.max(time).alias("_top"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_bin", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_bin").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.withColumn("_bin", bin_of).withColumn("_seen", F.max(time).over(inside)).join(tops, "_bin")
    seen = F.greatest("_seen", "_before")
    kept = keyed.filter(seen.isNull() | (F.col(time) >= seen - F.make_dt_interval(secs=F.lit(late_seconds))))
    return kept.select(*rows.columns)


def write_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, to Parquet, exactly once per checkpoint."""
    return rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
