"""Reads and regions beside the bases of a reference that they need.

A reference is cut into overlapping pieces; what asks for bases is joined with the one piece that holds all of them and
keeps just these, so no row carries a whole contig and no contig is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces' lengths: a request goes to the first that is as long as it. A text can't be longer than the last.
PIECES = (1 << 12, 1 << 18, 1 << 24, 1 << 31)


def with_bases(rows: DataFrame, references: DataFrame, contig: str, beg: Column, stop: Column) -> DataFrame:
    """``rows`` with __from, __bases and __size: the bases [beg, stop) of their contig as far as they exist, where they begin, and the contig's length.

    references: name, seq. Where the contig is unknown __size is NULL, and so are all where a bound is NULL.
    """
    known = references.select(F.col("name").alias("__name"), F.col("seq").cast("binary").alias("__seq")).where("__name is not null")
    level = F.lit(None).cast("int")
    for n, size in reversed(list(enumerate(PIECES))):
        level = F.when(F.col("__stop") - F.col("__beg") <= size, n).otherwise(level)
    asked = rows.withColumns({"__beg": F.greatest(beg, F.lit(0)).cast("long"), "__stop": stop.cast("long")}).withColumn("__level", F.when(F.col("__stop") > F.col("__beg"), level))
    levels = [r[0] for r in asked.select("__level").distinct().collect() if r[0] is not None]
    pieces = None
    for n in sorted(levels) or [0]:
        size = PIECES[n]
        each = known.select("__name", "__seq", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("__seq") - 1, F.lit(0)) / size))).alias("__n"))
        each = each.select("__name", F.lit(n).alias("__level"), "__n", F.expr(f"substring(__seq, cast(__n * {size} + 1 as int), {min(2 * size, 2**31 - 1)})").alias("__piece"))
        pieces = each if pieces is None else pieces.unionByName(each)
    width = F.element_at(F.array(*[F.lit(s).cast("long") for s in PIECES]), F.col("__level") + 1)
    asked = asked.withColumn("__n", F.floor(F.col("__beg") / width))
    sizes = known.select(F.col("__name").alias(contig), F.octet_length("__seq").cast("long").alias("__size"))
    found = asked.join(sizes, contig, "left").join(pieces.withColumnRenamed("__name", contig), [contig, "__level", "__n"], "left")
    at = (F.col("__beg") - F.col("__n") * width + 1).cast("int")
    own = F.substring(F.col("__piece"), at, (F.col("__stop") - F.col("__beg")).cast("int")).cast("string")
    return found.select(*rows.columns, F.col("__beg").alias("__from"), F.coalesce(own, F.when(F.col("__size").isNotNull() & F.col("__beg").isNotNull(), "")).alias("__bases"), "__size")
