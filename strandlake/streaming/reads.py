"""The stateless operators on streams, and counts over event time.

Filters and classifications are column expressions, so they hold for streams as they are. Region filters
join the stream with a static table of regions. Counts need a watermark, beyond which late rows are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import ON_REFERENCE, cigar_sum, read_filter


def filtered(reads: DataFrame, text: str) -> DataFrame:
    """The rows of a stream (or table) that pass a filter."""
    return reads.where(read_filter(text))


def in_regions(reads: DataFrame, regions: DataFrame, width: int = 1 << 14) -> DataFrame:
    """The rows of a stream that overlap a static table of regions (contig, beg, stop), once each.

    A read is looked up in each bin that it touches, however far it reaches. Regions are merged first; of those that a
    read meets, it passes with the one whose predecessor ends before the read, in the first bin where the two meet.
    """
    stop = F.col("pos") - 1 + cigar_sum(F.col("cigar"), ON_REFERENCE)
    one = reads.withColumns({"__beg": F.col("pos") - 1, "__stop": stop})
    bins = F.sequence(F.floor(F.col("__beg") / width), F.floor((F.col("__stop") - 1) / width))
    each = one.where("__beg < __stop").withColumn("__bin", F.explode(bins))
    lists = first_bins(regions, width).select(F.col("contig").alias("__contig"), F.col("bin").alias("__b"), "__r")
    both = each.join(lists, (F.col("rname") == F.col("__contig")) & (F.col("__bin") == F.col("__b")))
    begins = F.floor(F.col("__beg") / width)
    first = F.exists("__r", lambda x: (x["beg"] < F.col("__stop")) & (x["stop"] > F.col("__beg")) & (x["before"] <= F.col("__beg")) & (F.greatest(x["bin"], begins) == F.col("__bin")))
    return both.where(first).select(*reads.columns)


def first_bins(regions: DataFrame, width: int) -> DataFrame:
    """contig, bin, __r: the disjoint covered stretches that touch a bin, with the end of the one before each (or -1) and its first bin."""
    from pyspark.sql import Window

    order = Window.partitionBy("contig").orderBy("beg", "stop")
    whole = regions.where("contig is not null and beg < stop").select("contig", "beg", "stop").distinct()
    far = whole.withColumn("__far", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = far.withColumn("__i", F.sum(F.when(F.col("beg") <= F.col("__far"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("contig", "__i").agg(F.min("beg").alias("beg"), F.max("stop").alias("stop"))
    merged = merged.withColumn("before", F.coalesce(F.lag("stop").over(Window.partitionBy("contig").orderBy("beg")), F.lit(-1).cast("long")))
    each = merged.select("contig", "beg", "stop", "before", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("stop") - 1) / width))).alias("bin"))
    return each.groupBy("contig", "bin").agg(F.collect_list(F.struct("beg", "stop", "before", F.floor(F.col("beg") / width).alias("bin"))).alias("__r"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """beg, key and n per tumbling window of event time."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, window), F.col(key)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("beg"), F.col(key), "n")
