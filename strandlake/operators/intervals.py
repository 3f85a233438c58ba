"""Interval joins, region texts and overlap modes. Intervals are 0-based and half-open: [beg, stop)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest position that a region text, and that an index, can hold. Fixed values.
POSITION_MAX = (2**31 - 1) << 32 | 2**31 - 1
INDEX_MAX = 2**35


#: Bins grow by this factor from level to level; an interval lies on the lowest level where it touches at most so many bins (and one).
LEVEL = 64
#: Bounds of a measured bin width.
LEAST_WIDTH, MOST_WIDTH = 64, 1 << 14
#: Comparisons that one bin may take before it is split, and how many bins are split: those that take the most.
PAIRS, SPLITS = 1 << 24, 10_000
#: Positions whose running counts one window holds.
BLOCK = 1 << 14


def _whole(df: DataFrame) -> DataFrame:
    return df.where("contig is not null and beg < stop")


def _lengths(*sides: DataFrame) -> tuple[int, set[int], list[tuple]]:
    """(the larger of the sides' median lengths, how many bits lengths less one have, each side's first begin and last end); one pass over each side's bounds."""
    length, medians, bits, ranges = F.col("stop") - F.col("beg"), [1], set(), []
    for s in sides:
        median, found, *ends = _whole(s).agg(F.percentile_approx(length, 0.5, 1000), F.collect_set(F.length(F.bin(length - 1))), F.min("beg"), F.max("stop")).first()
        medians.append(median or 1)
        bits |= set(found)
        ranges.append(tuple(ends))
    return int(max(medians)), bits, ranges


def _range(df: DataFrame) -> tuple:
    """The first begin and the last end of all intervals, on whichever contig; None if there are none."""
    return tuple(_whole(df).agg(F.min("beg"), F.max("stop")).first())


def _within(df: DataFrame, ends: tuple) -> DataFrame:
    """The rows that may overlap anything between ``ends``; the others meet nothing there, so nothing need be made of them."""
    first, last = ends
    return df.where(F.lit(False)) if first is None else df.where((F.col("beg") < last) & (F.col("stop") > first))


def _near(median: int) -> int:
    """A power of two near the median: then few pairs that share a bin don't overlap."""
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (median - 1).bit_length()))


def _level(width: int) -> Column:
    """The level that an interval lies on, for lengths up to 2 ** 62."""
    length, out = F.col("stop") - F.col("beg"), F.lit(0)
    size, level = width * LEVEL, 1
    while size < 2**62:
        out, size, level = F.when(length > size, level).otherwise(out), size * LEVEL, level + 1
    return out


def _levels(width: int, bits: set[int]) -> list[int]:
    """The levels that intervals of such lengths lie on, of which there are ten at most. Widths are powers of two; a length less one of n bits is at most 2 ** n."""
    one, step = width.bit_length() - 1, LEVEL.bit_length() - 1
    return sorted({max(0, -(-(b - one) // step) - 1) for b in bits}) or [0]


def _binned(df: DataFrame, width: int, levels: list[int], right: bool) -> DataFrame:
    """A row per bin that an interval touches: columns __n (level), __long (which side is the one on its own level) and __b.

    On a level, the left side's own intervals meet all that the right side has there and below (__long false), and what
    the left side has below meets the right side's own (__long true): shorter ones meet on finer levels.
    """

    def of(level: int) -> Column:
        bits = width.bit_length() - 1 + level * (LEVEL.bit_length() - 1)
        bins = F.sequence(F.shiftright("beg", bits), F.shiftright(F.col("stop") - 1, bits))
        below, own = F.col("__level") < level, F.col("__level") == level
        if right:
            roles = F.when(own & F.lit(level > levels[0]), F.array(F.lit(False), F.lit(True))).when(own | below, F.array(F.lit(False)))
        else:
            roles = F.when(own, F.array(F.lit(False))).when(below, F.array(F.lit(True)))
        each = F.flatten(F.transform(roles, lambda long: F.transform(bins, lambda b: F.struct(F.lit(level).alias("__n"), long.alias("__long"), b.alias("__b")))))
        return F.coalesce(each, F.array().cast("array<struct<__n:int,__long:boolean,__b:bigint>>"))

    out = df.withColumn("__level", _level(width)) if len(levels) > 1 else df.withColumn("__level", F.lit(levels[0]))
    return out.withColumn("__bin", F.explode(F.concat(*map(of, levels)))).select(*df.columns, "__bin.*")


BIN = ["contig", "__n", "__long", "__b"]


def _split(left: DataFrame, right: DataFrame) -> DataFrame:
    """The SPLITS bins that take the most comparisons, if more than PAIRS, and in how many blocks (__ni, __nj) their sides go.

    What other bins take is at most a part in SPLITS of all comparisons, or PAIRS; so this is all that must be split, and can be broadcast.
    """
    counts = left.groupBy(*BIN).agg(F.count("*").alias("l")).join(right.groupBy(*BIN).agg(F.count("*").alias("r")), BIN)
    cost, side = F.col("l").cast("double") * F.col("r"), int(PAIRS**0.5)
    most = counts.where(cost > PAIRS).orderBy(cost.desc()).limit(SPLITS)
    return most.select(*BIN, F.ceil(F.col("l") / side).cast("int").alias("__ni"), F.ceil(F.col("r") / side).cast("int").alias("__nj"))


def _in_blocks(rows: DataFrame, split: DataFrame, mine: str, other: str) -> DataFrame:
    """``rows`` with __i and __j: a row of a split bin goes to one block of its own side, once for each of the other's."""
    plain = [f"`{c}`" for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    # A row's input partition spreads copies, and is the same when a task runs again.
    own = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.coalesce(f"__n{mine}", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(split), BIN, "left")
    return rows.withColumn(f"__{mine}", own).withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"__n{other}", F.lit(1)) - 1))).drop("__ni", "__nj")


def interval_join(left: DataFrame, right: DataFrame, how: str = "inner", width: int | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` (contig, beg, stop and other columns) that overlap on one contig.

    how: inner, left_semi or left_anti. Empty intervals, and those with nulls, overlap nothing. In an inner join the
    columns of ``right`` get the prefix ``r_``. Both sides are dealt by (contig, bin), so that no contig is one hot key;
    the bins' ``width`` (a power of two) is measured if it isn't given. Long intervals lie in wider bins, a pair meets on
    the coarser of its two levels and counts in the one bin there where its overlap begins; bins in which both sides are dense
    are split by blocks of both. Semi and anti joins make no pairs: they look up overlap_counts of each distinct interval of ``left``.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how}")
    if how != "inner":
        asked = _within(left.select("contig", "beg", "stop"), _range(right)).distinct()
        hits = overlap_counts(asked, right).where("n > 0").drop("n")
        return left.join(hits, ["contig", "beg", "stop"], how).select(*left.columns)
    median, bits, (of_left, of_right) = _lengths(left, right)
    width = width or _near(median)
    levels = _levels(width, bits)
    l, r = _binned(_within(_whole(left), of_right), width, levels, False), _binned(_within(_whole(right), of_left), width, levels, True)
    split = _split(l, r)
    key = [*BIN, "__i", "__j"]
    l, r = _in_blocks(l, split, "i", "j"), _in_blocks(r, split, "j", "i")
    # Dealt by number: the sides' sizes, by which tasks would be merged, say little of how many pairs they make.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l = l.repartition(tasks, *key)
    r = r.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in r.columns]).repartition(tasks, *[f"r_{c}" for c in key])
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"r_{c}"))
    # The bin where the overlap begins: bins' widths are powers of two, so it is a shift by the level's number of bits.
    bits_ = width.bit_length() - 1 + (F.col("__n") * (LEVEL.bit_length() - 1) if len(levels) > 1 else F.lit(levels[0] * (LEVEL.bit_length() - 1)))
    here = F.col("__b") == F.call_function("shiftright", F.greatest("beg", "r_beg"), bits_)
    found = l.join(r, same & (F.col("beg") < F.col("r_stop")) & (F.col("stop") > F.col("r_beg")) & here)
    return found.select(*left.columns, *[f"r_{c}" for c in right.columns])


def overlap_counts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """contig, beg, stop and n for distinct intervals ``asked``: how many of ``rows`` overlap each. Empty intervals and those with nulls are left out.

    That many begin before the interval's end, less those that end at or before its begin. Both are running counts over
    positions: begins and ends are summed per position first, so what a block of positions holds is bounded by its width, and blocks'
    totals are carried along each contig. No pairs are made, and neither long intervals nor dense places cost more.
    """
    asked = _whole(asked).select("contig", "beg", "stop")
    rows = _within(rows, _range(asked))  # what ends before all of asked counts as begun and as ended
    none = F.lit(0).cast("long")
    ends = lambda d, begins, stops: d.select("contig", F.explode(F.array(F.struct(F.col("beg").alias("at"), begins.alias("b"), none.alias("s")), F.struct(F.col("stop").alias("at"), none.alias("b"), stops.alias("s")))).alias("x")).select("contig", "x.*")
    one = F.lit(1).cast("long")
    points = ends(_whole(rows), one, one).unionByName(ends(asked, none, none))
    points = points.groupBy("contig", "at").agg(F.sum("b").alias("b"), F.sum("s").alias("s")).withColumn("block", F.shiftright("at", BLOCK.bit_length() - 1))
    before = Window.partitionBy("contig").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("contig", "block").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    carried = carried.select("contig", "block", F.coalesce(F.sum("b").over(before), none).alias("cb"), F.coalesce(F.sum("s").over(before), none).alias("cs"))
    here = Window.partitionBy("contig", "block").orderBy("at")
    sums = points.select("contig", "block", "at", (F.sum("b").over(here) - F.col("b")).alias("b"), F.sum("s").over(here).alias("s")).join(carried, ["contig", "block"])
    sums = sums.select("contig", "at", (F.col("b") + F.col("cb")).alias("begun"), (F.col("s") + F.col("cs")).alias("ended"))
    found = asked.join(sums.select("contig", F.col("at").alias("stop"), "begun"), ["contig", "stop"]).join(sums.select("contig", F.col("at").alias("beg"), "ended"), ["contig", "beg"])
    return found.select("contig", "beg", "stop", (F.col("begun") - F.col("ended")).alias("n"))


def count_per_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """contig, beg, stop, region_idx and n: overlapping rows of each region, regions without any included."""
    n = overlap_counts(regions.select("contig", "beg", "stop").distinct(), rows)
    return regions.join(n, ["contig", "beg", "stop"], "left").select("contig", "beg", "stop", "region_idx", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Region:
    """contig None stands for a whole file ("."); [beg, stop) 0-based."""

    contig: str | None
    beg: int = 0
    stop: int = POSITION_MAX


class RegionError(ValueError):
    pass


#: Suffixes of decimal numbers. Fixed values.
SCALE = {"": 1, "k": 1_000, "K": 1_000, "m": 1_000_000, "M": 1_000_000, "g": 1_000_000_000, "G": 1_000_000_000}


def parse_position(text: str, thousands: bool = True) -> int:
    """'1,000', '1.5k', '2e3' and the like as an integer; thousands separators unless they part a list."""
    plain = text.replace(",", "") if thousands else text
    m = re.fullmatch(r"(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?([kKmMgG]?)", plain)
    if not m:
        raise RegionError(f"not a position: {text}")
    whole, part, power, unit = m[1], m[2] or "", int(m[3] or 0), SCALE[m[4]]
    digits = int(whole + part) * unit
    shift = power - len(part)
    return digits * 10**shift if shift >= 0 else digits // 10**-shift


def parse_region(text: str, known: Callable[[str], bool] | None = None, one_position: bool = False, in_list: bool = False) -> Region:
    """'chr1:100-200' (1-based, closed) as a Region.

    Braces quote a name with colons; otherwise the last colon parts name and range, unless the whole text
    is a known name (an error if both are). 'chr1:100' goes on to the end, or is one base; 'chr1:-50'
    starts at the beginning; '.' is everything.
    """
    if text == ".":
        return Region(None)
    if text.startswith("{"):
        end = text.find("}")
        if end < 0 or text[end + 1 : end + 2] not in ("", ":"):
            raise RegionError(f"unbalanced braces: {text}")
        name, span = text[1:end], text[end + 2 :] if text[end + 1 :] else None
    else:
        name, colon, span = text.rpartition(":")
        if not colon:
            name, span = text, None
        elif known is not None:
            whole, part = known(text), known(name)
            if whole and part:
                raise RegionError(f"ambiguous region: {text}")
            if whole:
                name, span = text, None
    if known is not None and not known(name):
        raise RegionError(f"unknown contig: {name}")
    if span is None or span == "":
        return Region(name)
    number = lambda s: parse_position(s, thousands=not in_list)
    if span.startswith("-"):
        return Region(name, 0, number(span[1:]))
    low, dash, high = span.partition("-")
    beg = max(number(low) - 1, 0)
    stop = number(high) if high else beg + 1 if one_position and not dash else POSITION_MAX
    if beg >= stop:
        raise RegionError(f"empty region: {text}")
    return Region(name, beg, stop)


def parse_region_line(line: Column, kind: str) -> Column:
    """A line of a region file as struct(contig, beg, stop, payload), NULL for blank and comment lines.

    bed: 0-based, half-open. tab: 1-based, closed, the end is the start where it is missing. reg: name:from-to
    or a bare name for all of the contig. The fourth column (tab: third on one-position lines) is the payload.
    """
    part = F.split(line, r"[ \t]+")
    at = lambda i: F.try_element_at(part, F.lit(i + 1))
    number = lambda c: c.try_cast("long")
    rest = F.array_join(F.slice(part, 4, F.greatest(F.size(part) - 3, F.lit(0))), "\t")
    if kind == "bed":
        out = F.struct(at(0).alias("contig"), F.coalesce(number(at(1)), F.lit(0).cast("long")).alias("beg"), F.coalesce(number(at(2)), F.lit(INDEX_MAX)).alias("stop"), F.nullif(rest, F.lit("")).alias("payload"))
    elif kind == "tab":
        beg = number(at(1))
        ok = F.when(beg == 0, F.raise_error(F.lit("positions start at 1")).cast("long")).otherwise(F.coalesce(beg - 1, F.lit(0).cast("long")))
        stop = F.when(beg.isNull(), F.lit(INDEX_MAX)).otherwise(F.coalesce(number(at(2)), beg))
        out = F.struct(at(0).alias("contig"), ok.alias("beg"), stop.alias("stop"), F.nullif(rest, F.lit("")).alias("payload"))
    elif kind == "reg":
        beg, stop = F.regexp_extract(line, r":(\d+)", 1), F.regexp_extract(line, r":\d*-(\d+)", 1)
        out = F.struct(F.regexp_extract(line, r"^([^:\s]+)", 1).alias("contig"), F.coalesce(number(beg) - 1, F.lit(0).cast("long")).alias("beg"), F.coalesce(number(stop), F.when(F.instr(line, "-") > 0, F.lit(INDEX_MAX)).otherwise(number(beg)), F.lit(INDEX_MAX)).alias("stop"), F.lit(None).cast("string").alias("payload"))
    else:
        raise ValueError(f"unknown kind of line: {kind}")
    return F.when(~line.rlike(r"^\s*(#|$)"), out)


def record_span(pos: Column, ref: Column, end: Column) -> Column:
    """0-based, half-open [pos - 1, ...) of a variant record: END if it is given, else the length of REF."""
    return F.coalesce(F.greatest(end, pos), pos - 1 + F.octet_length(ref)).cast("long")


def variant_overlaps(mode: str, pos: Column, ref: Column, alts: Column, end: Column, beg: Column, stop: Column) -> Column:
    """Whether a variant (1-based pos) meets [beg, stop).

    pos: its first base lies inside. record: its span meets it. variant: what an ALT changes meets it; for an
    insertion both bases beside it must lie inside.
    """
    at = pos - 1
    if mode == "pos":
        return (at >= beg) & (at < stop)
    if mode == "record":
        return (at < stop) & (record_span(pos, ref, end) > beg)
    if mode != "variant":
        raise ValueError(f"unknown overlap mode: {mode}")
    n = F.octet_length(ref)

    def one(alt: Column) -> Column:
        m = F.octet_length(alt)
        same = (at >= beg) & (at < stop)
        deletion = (at + m < stop) & (at + n > beg)
        insertion = (at >= beg) & (at < stop) & (at + 1 < stop)
        return F.when(n == m, same).when(n > m, deletion).otherwise(insertion)

    return F.when(end.isNotNull(), (at < stop) & (F.greatest(end, pos) > beg)).otherwise(F.exists(alts, one))


def bin_of(beg: Column, stop: Column) -> Column:
    """The smallest bin of the usual five-level scheme that holds [beg, stop)."""
    last = stop - 1
    level = lambda shift, first: F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.lit(first) + F.shiftright(beg, shift))
    return F.coalesce(level(14, 4681), level(17, 585), level(20, 73), level(23, 9), level(26, 1), F.lit(0).cast("long"))
