"""Row-local operators and mergeable counts over streams. The reference has no streams; this only shows that its stateless blocks
work on streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import real


def windowed_histogram(stream: DataFrame, time: str, column: str, bins: int, low: float, high: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a fixed-range histogram for each time window, late rows up to a watermark."""
    v = real(F.col(column))
    at = F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins))
    kept = stream.where((v >= low) & (v <= high) & ~F.isnan(v)).withWatermark(time, late)
    return kept.groupBy(F.window(time, width), at.alias("bin")).agg(F.count("*").alias("count"))
