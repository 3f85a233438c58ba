"""Named queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, kernels
from ..functions import records as R
from ..functions import scalars as S
from ..functions import variants as V
from ..functions.filters import Compiler, cigar_sum, flag_filter, hard_clip, read_filter, read_symbols, read_tags, soft_clip
from ..operators import fastx, indels, intervals, pileup
from ..operators import variants as vo
from ..sources import indexed
from ..sources import text as T
from ..sources.bam import SCHEMA as BAM_SCHEMA
from ..sources.bam import BamSource
from ..sources.bcf import BcfSource
from ..sources.bgzf import BgzfSource
from ..sources.cram import CramSource
from ..sources.files import FastqSource, LineSource, listed, removed, shared_folder
from .views import reads, select_sql, view

A, I, DENSE, VV = (f"({select_sql(v)})" for v in ("alignments", "intervals", "dense_intervals", "variants"))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Reference bases that a view's CIGAR covers, in SQL.
SPAN = "case cigar when '5S30M5S' then 30 when '40M' then 40 when '10M3I27M' then 37 when '20M10D20M' then 50 else 135 end"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def spans(df: DataFrame) -> DataFrame:
    """contig, beg, stop of alignments."""
    return df.withColumns({"contig": F.col("rname"), "beg": F.col("pos") - 1, "stop": F.col("pos") - 1 + cigar_sum(F.col("cigar"), "MDN=X")})


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """All intervals."""
    return view(spark, sf, "intervals")


HIT = f"i.contig = a.rname and a.pos - 1 < i.stop and a.pos - 1 + {SPAN} > i.beg"


@query(f"with a as {A}, i as (select * from {I}) select rname, count(*) as n from a where (flag & 4) = 0 and mapq >= 30 and exists (select 1 from i where {HIT}) group by rname")
def mapped_reads_in_regions(spark, sf):
    good = reads(spark, sf).where(read_filter("mapq >= 30 && !flag.unmap"))
    hits = intervals.interval_join(spans(good).select("rec_idx", "rname", "contig", "beg", "stop"), regions(spark, sf).select("contig", "beg", "stop"), "left_semi")
    return hits.groupBy("rname").agg(F.count("*").alias("n"))


@query(f"select rname, count(*) as n, cast(sum(pos) as bigint) as sum_pos from {A} where (flag & 1) = 1 and (flag & 1284) = 0 and (flag & 48) <> 48 group by rname")
def flag_filter_counts(spark, sf):
    return view(spark, sf, "alignments").where(flag_filter(F.col("flag"), 1, 0x504, 0x30)).groupBy("rname").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def filtered(text: str) -> Query:
    return lambda spark, sf: reads(spark, sf).where(read_filter(text)).groupBy("rname").agg(F.count("*").alias("n"), F.sum("rec_idx").alias("ids"))


def filter_query(name: str, text: str, where: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = filtered(text), f"select rname, count(*) as n, cast(sum(rec_idx) as bigint) as ids from {A} where {where} group by rname"


filter_query("expr_numeric_filter", "mapq >= 20 && pos + 2 * mapq < 5000 || rlen > 100", f"(mapq >= 20 and pos + 2 * mapq < 5000) or {SPAN} > 100")
filter_query("expr_regex_filter", 'cigar =~ "[ID]" && qname !~ "7$"', "regexp_matches(cigar, '[ID]') and not regexp_matches(qname, '7$')")
filter_query("expr_undefined_logic", "[NM] > 2 || !exists([XX]) && !([NM] >= 0)", "nm = 0")
filter_query("expr_tag_default", "default([NM], 9) >= 4", "(case when nm = 0 then 9 else nm end) >= 4")
filter_query("expr_string_compare", 'rname == "chr2" || rname > "chr3" && qname < "q5"', "(rname = 'chr2' or rname > 'chr3') and qname < 'q5'")


@query(
    f"select rname, count(case when least(q, mapq) >= 20 then 1 end) as a, count(case when greatest(q, mapq) <= 20 then 1 end) as b, count(case when (9 * q + mapq) / cast(10 as double) >= 20 and (9 * q + mapq) / cast(10 as double) <= 30 then 1 end) as c, count(*) as n "
    f"from (select *, rec_idx % 60 as q from {A}) group by rname"
)
def expr_qualities(spark, sf):
    """Filters on raw qualities: nine of one kind and one that equals the mapping quality, as a SAM line prints them."""
    rows = reads(spark, sf).withColumn("qual", F.concat(F.repeat(F.char(33 + F.col("rec_idx") % 60), 9), F.char(33 + F.col("mapq"))))
    count = lambda text: F.count(F.when(read_filter(text), 1))
    return rows.groupBy("rname").agg(count("min(qual) >= 20").alias("a"), count("max(qual) <= 20").alias("b"), count("avg(qual) >= 20 && avg(qual) <= 30").alias("c"), F.count("*").alias("n"))


_MATE = f"(select *, case when rec_idx % 3 = 0 then '*' else concat('chr', cast(rec_idx % 5 + 1 as varchar)) end as mate, case when rec_idx % 4 = 0 then 0 else pos + 100 end as place, 40 as qlen from {A})"


@query(
    "select rname, count(case when mate = 'chr2' or mate = '*' then 1 end) as a, count(case when place > 5000 or place = 0 then 1 end) as b, count(case when ref_id >= 2 and rec_idx % 5 <> 1 then 1 end) as c, "
    f"count(case when qlen = 40 and length(seq) * (case when rec_idx % 6 = 0 then 0 else 1 end) < 40 then 1 end) as d, cast(sum(case when rec_idx % 2 = 0 then 250 else -250 end) as bigint) as e from {_MATE} group by rname"
)
def expr_mates(spark, sf):
    """Symbols of the mate and of the read's length; reads without bases take theirs from the CIGAR."""
    r = F.col("rec_idx")
    mate = F.when(r % 3 != 0, F.concat(F.lit("chr"), (r % 5 + 1).cast("string")))
    rows = reads(spark, sf).withColumns({"rnext": mate, "pnext": F.when(r % 4 != 0, F.col("pos") + 100), "next_ref_id": (r % 5).cast("int"), "tlen": F.when(r % 2 == 0, 250).otherwise(-250), "seq": F.when(r % 6 == 0, "").otherwise(F.col("seq"))})
    count = lambda text: F.count(F.when(read_filter(text), 1))
    value = Compiler(read_symbols(), read_tags)
    return rows.groupBy("rname").agg(
        count('rnext == "chr2" || mrname == "*"').alias("a"), count("pnext > 5000 || mpos == 0").alias("b"), count("refid >= 2 && mrefid != 1").alias("c"),
        count("qlen == 40 && length(seq) < 40").alias("d"), F.sum(value("tlen").number).cast("long").alias("e"),
    )


@query(f"select rname, cast(sum(flag & 20) as bigint) as a, cast(sum((flag | 3) & 255) as bigint) as b, cast(sum(xor(flag, 85)) as bigint) as c, cast(sum(mapq % 7) as bigint) as d, cast(sum(-1 - mapq) as bigint) as e from {A} group by rname")
def expr_bitwise(spark, sf):
    value = Compiler(read_symbols(), read_tags)
    texts = {"a": "flag & 20", "b": "(flag | 3) & 0xff", "c": "flag ^ 85", "d": "mapq % 7", "e": "~mapq"}
    return reads(spark, sf).groupBy("rname").agg(*[F.sum(value(t).number).cast("long").alias(k) for k, t in texts.items()])


@query(f"select rname, round(sum(sqrt(mapq)), 6) as a, round(sum(ln(pos)), 6) as b, cast(sum(octet_length(encode(seq))) as bigint) as c, cast(sum(case when mapq % 10 = 0 then 0 else cast(1 as double) end) as bigint) as d, round(sum(power(mapq, 2)), 6) as e, round(sum(exp(-mapq / cast(10 as double))), 6) as f from {A} group by rname")
def expr_functions(spark, sf):
    value = Compiler(read_symbols(), read_tags)
    df = reads(spark, sf)
    return df.groupBy("rname").agg(
        F.round(F.sum(value("sqrt(mapq)").number), 6).alias("a"), F.round(F.sum(value("log(pos)").number), 6).alias("b"), F.sum(value("length(seq)").number).cast("long").alias("c"),
        F.sum(F.when(value("exists(1 / (mapq % 10) ) && mapq % 10").truth, 1).otherwise(0)).cast("long").alias("d"), F.round(F.sum(value("pow(mapq, 2)").number), 6).alias("e"),
        F.round(F.sum(value("exp(-mapq / 10)").number), 6).alias("f"),
    )


@query(f"with a as {A}, i as (select * from {I}) select i.region_idx, count(*) as n, cast(sum(a.rec_idx) as bigint) as ids from a join i on {HIT} group by i.region_idx")
def interval_overlap_inner(spark, sf):
    both = intervals.interval_join(spans(view(spark, sf, "alignments")).select("contig", "beg", "stop", "rec_idx"), regions(spark, sf))
    return both.groupBy(F.col("r_region_idx").alias("region_idx")).agg(F.count("*").alias("n"), F.sum("rec_idx").alias("ids"))


@query(f"with a as {A}, i as (select * from {I}) select a.rec_idx, a.rname, a.pos from a where exists (select 1 from i where {HIT})")
def interval_overlap_semi(spark, sf):
    rows = spans(view(spark, sf, "alignments")).select("contig", "beg", "stop", "rec_idx", "rname", "pos")
    return intervals.interval_join(rows, regions(spark, sf), "left_semi").select("rec_idx", "rname", "pos")


@query(f"with a as {A}, i as (select * from {I}) select a.rec_idx, a.rname, a.pos from a where not exists (select 1 from i where {HIT})")
def interval_targets_anti(spark, sf):
    rows = spans(view(spark, sf, "alignments")).select("contig", "beg", "stop", "rec_idx", "rname", "pos")
    return intervals.interval_join(rows, regions(spark, sf), "left_anti").select("rec_idx", "rname", "pos")


@query(f"with a as {A}, i as (select * from {DENSE}) select i.region_idx, i.contig, cast(count(a.rec_idx) as bigint) as n from i left join a on {HIT} group by i.region_idx, i.contig")
def separate_regions(spark, sf):
    rows = spans(view(spark, sf, "alignments")).select("contig", "beg", "stop")
    return intervals.count_per_region(rows, view(spark, sf, "dense_intervals")).select("region_idx", "contig", F.col("n").cast("long"))


@query(f"with a as {A}, i as (select * from {I}) select i.region_idx, a.rec_idx from a join i on {HIT}")
def multi_region_dup(spark, sf):
    rows = spans(view(spark, sf, "alignments")).select("contig", "beg", "stop", "rec_idx")
    return intervals.interval_join(rows, regions(spark, sf)).select(F.col("r_region_idx").alias("region_idx"), "rec_idx")


@query(f"with a as {A}, i as (select * from {I}) select a.rec_idx, min(i.region_idx) as region_idx from a join i on {HIT} group by a.rec_idx")
def multi_region_dedup(spark, sf):
    return multi_region_dup(spark, sf).groupBy("rec_idx").agg(F.min("region_idx").alias("region_idx"))


OVERLAP = {
    "pos": "v.pos - 1 >= i.beg and v.pos - 1 < i.stop",
    "record": "v.pos - 1 < i.stop and coalesce(greatest(v.info_end, v.pos), v.pos - 1 + length(v.ref)) > i.beg",
    "variant": "case when v.info_end is not null then v.pos - 1 < i.stop and greatest(v.info_end, v.pos) > i.beg when length(v.ref) = length(v.alt) then v.pos - 1 >= i.beg and v.pos - 1 < i.stop when length(v.ref) > length(v.alt) then v.pos - 1 + length(v.alt) < i.stop and v.pos - 1 + length(v.ref) > i.beg else v.pos - 1 >= i.beg and v.pos < i.stop end",
}


def overlap_query(mode: str) -> None:
    def run(spark, sf):
        v = view(spark, sf, "variants").withColumn("beg", F.col("pos") - 1)
        v = v.withColumn("stop", F.greatest(F.coalesce("info_end", F.lit(0)), F.col("pos") + F.length("ref"), F.col("pos") + F.length("alt")) + 1)
        both = intervals.interval_join(v, regions(spark, sf).select("contig", "beg", "stop", "region_idx"))
        alts, end = F.array("alt"), F.col("info_end")
        return both.where(intervals.variant_overlaps(mode, F.col("pos"), F.col("ref"), alts, end, F.col("r_beg"), F.col("r_stop"))).select("rec_idx", F.col("r_region_idx").alias("region_idx"))

    QUERIES[f"overlap_mode_{mode}"] = run
    ORACLE_SQL[f"overlap_mode_{mode}"] = f"with v as {VV}, i as (select * from {I}) select v.rec_idx, i.region_idx from v join i on v.contig = i.contig and {OVERLAP[mode]}"


for _mode in OVERLAP:
    overlap_query(_mode)


def _ops(pattern: str) -> str:
    return f"cast(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+){pattern}', 1), lambda x: cast(x as bigint))), 0) as bigint)"


@query(f"select cigar, count(*) as n, {_ops('[MDN=X]')} as rlen, {_ops('[MIS=X]')} as qlen, {_ops('S')} as sclen, {_ops('H')} as hclen, cast(sum(pos + {SPAN} - 1) as bigint) as sum_end from {A} group by cigar")
def cigar_metrics(spark, sf):
    c = F.col("cigar")
    df = view(spark, sf, "alignments").withColumn("e", F.col("pos") + cigar_sum(c, "MDN=X") - 1)
    return df.groupBy("cigar").agg(F.count("*").alias("n"), F.sum("e").alias("sum_end")).select("cigar", "n", cigar_sum(c, "MDN=X").alias("rlen"), cigar_sum(c, "MIS=X").alias("qlen"), soft_clip(c).alias("sclen"), hard_clip(c).alias("hclen"), "sum_end")


PASS = "(flag & 1796) = 0 and mapq >= 10"


@query(f"select rname, position, count(*) as depth from (select rname, unnest(range(pos, pos + {SPAN})) as position from {A} where {PASS}) group by rname, position")
def pileup_depth(spark, sf):
    return pileup.depth(pileup.selected(view(spark, sf, "alignments"), min_mapq=10))


@query(f"select rname, position, count(case when i = 0 then 1 end) as depth_0, count(case when i = 1 then 1 end) as depth_1 from (select rname, rec_idx % 2 as i, unnest(range(pos, pos + {SPAN})) as position from {A} where {PASS}) group by rname, position")
def pileup_multi_input(spark, sf):
    d = pileup.depth(pileup.selected(view(spark, sf, "alignments"), min_mapq=10).withColumn("i", F.col("rec_idx") % 2), by=("rname", "i"))
    return d.groupBy("rname", "position").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("depth"))), F.lit(0)).cast("long").alias(f"depth_{i}") for i in (0, 1)])


BLOCKS = "case cigar when '5S30M5S' then [{'r': 0, 'q': 5, 'n': 30, 'o': 'M'}] when '40M' then [{'r': 0, 'q': 0, 'n': 40, 'o': 'M'}] when '10M3I27M' then [{'r': 0, 'q': 0, 'n': 10, 'o': 'M'}, {'r': 10, 'q': 13, 'n': 27, 'o': 'M'}] when '20M10D20M' then [{'r': 0, 'q': 0, 'n': 20, 'o': 'M'}, {'r': 20, 'q': 20, 'n': 10, 'o': 'D'}, {'r': 30, 'q': 20, 'n': 20, 'o': 'M'}] else [{'r': 0, 'q': 0, 'n': 15, 'o': 'M'}, {'r': 15, 'q': 15, 'n': 100, 'o': 'N'}, {'r': 115, 'q': 15, 'n': 20, 'o': 'M'}] end"


@query(
    f"with b as (select rname, pos, flag, seq, unnest({BLOCKS}) as b from {A} where {PASS}), c as (select rname, flag, seq, b, pos, unnest(range(0, b.n)) as k from b) "
    "select rname, pos + b.r + k as position, case b.o when 'D' then '*' when 'N' then case when (flag & 16) <> 0 then '<' else '>' end else case when (flag & 16) <> 0 then lower(substr(seq, cast(b.q + k + 1 as bigint), 1)) else upper(substr(seq, cast(b.q + k + 1 as bigint), 1)) end end as base, count(*) as n from c group by 1, 2, 3"
)
def pileup_bases(spark, sf):
    return pileup.base_counts(pileup.selected(view(spark, sf, "alignments"), min_mapq=10))


@query(
    f"with b as (select rec_idx, rname, pos, flag, mapq, cigar, seq, {SPAN} as span, unnest({BLOCKS}) as b from {A} where {PASS}), c as (select *, unnest(range(0, b.n)) as k from b), "
    "t as (select rec_idx, rname, pos + b.r + k as position, concat(case when b.r + k = 0 then concat('^', chr(cast(33 + least(mapq, 93) as int))) else '' end, "
    "case b.o when 'D' then '*' when 'N' then case when (flag & 16) <> 0 then '<' else '>' end else case when (flag & 16) <> 0 then lower(substr(seq, cast(b.q + k + 1 as bigint), 1)) else upper(substr(seq, cast(b.q + k + 1 as bigint), 1)) end end, "
    "case when cigar = '10M3I27M' and b.r + k = 9 then concat('+3', case when (flag & 16) <> 0 then lower(substr(seq, 11, 3)) else upper(substr(seq, 11, 3)) end) when cigar = '20M10D20M' and b.r + k = 19 then concat('-10', repeat(case when (flag & 16) <> 0 then 'n' else 'N' end, 10)) else '' end, "
    "case when b.r + k = span - 1 then '$' else '' end) as t from c) select rname, position, count(*) as depth, string_agg(t, '' order by rec_idx, t) as bases from t group by rname, position"
)
def pileup_columns(spark, sf):
    """The text of all columns."""
    return pileup.columns(pileup.selected(view(spark, sf, "alignments"), min_mapq=10))


@query(
    f"with b as (select rec_idx, rname, pos, flag, mapq, cigar, seq, {SPAN} as span, unnest({BLOCKS}) as b from {A} where {PASS}), c as (select *, unnest(range(0, b.n)) as k from b), "
    "t as (select rec_idx, rec_idx % 2 as i, rname, pos + b.r + k as position, concat(case when b.r + k = 0 then concat('^', chr(cast(33 + least(mapq, 93) as int))) else '' end, "
    "case b.o when 'D' then '*' when 'N' then case when (flag & 16) <> 0 then '<' else '>' end else case when (flag & 16) <> 0 then lower(substr(seq, cast(b.q + k + 1 as bigint), 1)) else upper(substr(seq, cast(b.q + k + 1 as bigint), 1)) end end, "
    "case when cigar = '10M3I27M' and b.r + k = 9 then concat('+3', case when (flag & 16) <> 0 then lower(substr(seq, 11, 3)) else upper(substr(seq, 11, 3)) end) when cigar = '20M10D20M' and b.r + k = 19 then concat('-10', repeat(case when (flag & 16) <> 0 then 'n' else 'N' end, 10)) else '' end, "
    "case when b.r + k = span - 1 then '$' else '' end) as t from c) select rname, position, count(*) as depth, count(*) filter (i = 0) as depth_0, count(*) filter (i = 1) as depth_1, coalesce(string_agg(t, '' order by rec_idx, t) filter (i = 0), '') as bases_0, coalesce(string_agg(t, '' order by rec_idx, t) filter (i = 1), '') as bases_1 from t group by rname, position"
)
def pileup_synchronized(spark, sf):
    """Two inputs' columns side by side."""
    df = view(spark, sf, "alignments").withColumn("input", F.col("rec_idx") % 2)
    return pileup.synchronized(pileup.selected(df, min_mapq=10), 2)


@query()
def pileup_qualities(spark, sf):
    """The qualities of all columns, after mates have settled them between them."""
    df = view(spark, sf, "alignments").withColumn("qual", F.repeat(F.char(43 + F.col("rec_idx") % 20), 40))
    return pileup.columns(pileup.selected(df, min_mapq=10)).select("rname", "position", "depth", "quals")


@query(
    f"with a as (select *, pos + {SPAN} as e from {A}), x as (select *, case when qname = lag(qname) over (partition by rname order by rec_idx) then 0 else 1 end as nw from a), "
    "y as (select *, sum(nw) over (partition by rname order by rec_idx) as island from x), z as (select *, count(*) over (partition by rname, island) as n, max(e) over (partition by rname, island) - min(pos) over (partition by rname, island) as len, row_number() over (partition by rname, island order by pos, case when (flag & 64) <> 0 then 0 else 1 end, rec_idx) as k from y) "
    "select rec_idx, cast(case when n < 2 then 0 when k = 1 then len else -len end as bigint) as tlen_new from z"
)
def tlen_islands(spark, sf):
    return pileup.template_lengths(view(spark, sf, "alignments")).select("rec_idx", F.col("tlen_new").cast("long"))


BIN = "case " + " ".join(f"when (beg >> {s}) = ((stop - 1) >> {s}) then {f} + (beg >> {s})" for s, f in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))) + " else 0 end"


@query(f"select rname, {BIN} as bin, count(*) as n, min(beg) as low, max(stop) as high from (select rname, pos * 97 as beg, pos * 97 + {SPAN} as stop from {A}) group by 1, 2")
def index_bins(spark, sf):
    df = view(spark, sf, "alignments").select("rname", (F.col("pos") * 97).alias("beg"), (F.col("pos") * 97 + cigar_sum(F.col("cigar"), "MDN=X")).alias("stop"))
    return df.groupBy("rname", intervals.bin_of(F.col("beg"), F.col("stop")).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("beg").alias("low"), F.max("stop").alias("high"))


CLASS = "case when alt = '*' then 32 when alt in ('<*>') then 0 when alt like '<%' then 8 when alt = 'ACG[chr2:5[' then 16 when ref = 'ACGT' then 1 when ref = 'G' then 1 when ref = 'A' and alt = 'T' then 1 when alt = 'ACC' then 68 when ref = 'AC' then 132 when ref = 'ACG' then 2 else -1 end"


@query(f"select {CLASS.replace('68', '4 + 64').replace('132', '4 + 128')} as kind, cast(case when alt = '*' then 0 when alt = '<*>' then 0 when alt like '<%' or alt like '%[%' then -1000 when ref = 'ACGT' then 1 when alt = 'ACC' then 2 when ref = 'AC' then -1 when ref = 'ACG' then 3 else 1 end as int) as len, count(*) as n from {VV} group by 1, 2")
def variant_classify(spark, sf):
    c = V.classify(F.col("ref"), F.col("alt"))
    return view(spark, sf, "variants").groupBy(c["kind"].alias("kind"), F.coalesce(c["len"], F.lit(-1000)).alias("len")).agg(F.count("*").alias("n"))


@query(f"select rec_idx, cast(greatest(length(ref), coalesce(greatest(info_end - pos + 1, 1), 0), coalesce(case when alt like '<%' and alt <> '<*>' then abs(svlen) + 1 end, 0)) as bigint) as span from {VV}")
def variant_span(spark, sf):
    v = view(spark, sf, "variants")
    return v.select("rec_idx", V.reference_length(F.col("pos"), F.col("ref"), F.array("alt"), F.col("info_end"), F.array("svlen")).alias("span"))


@query("select p_partkey as id, cast(greatest(a, b) * (greatest(a, b) + 1) // 2 + least(a, b) as bigint) as g from (select p_partkey, p_partkey % 7 as a, p_size % 5 as b from part)")
def genotype_index(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), V.genotype_index(F.col("p_partkey") % 7, F.col("p_size") % 5).cast("long").alias("g"))


@query(f"select rec_idx, replace(replace(replace(gt, '2', '9'), '1', '.'), '9', '1') as gt, rec_idx % 5 + 1 as ac_2, concat(cast(rec_idx % 3 as varchar), ',', cast(rec_idx % 7 as varchar)) as ad, concat(cast(rec_idx as varchar), ',', cast(rec_idx + 3 as varchar), ',', cast(rec_idx + 5 as varchar)) as pl from {VV}")
def allele_remove(spark, sf):
    v, one = view(spark, sf, "variants"), F.array(F.lit(1))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    r = F.col("rec_idx")
    return v.select(
        "rec_idx", V.remap_genotype(F.col("gt"), one).alias("gt"), V.drop_alleles(F.array(r % 11, r % 5 + 1), "A", one, F.lit(3))[0].alias("ac_2"),
        text(V.drop_alleles(F.array(r % 3, r % 5, r % 7), "R", one, F.lit(3))).alias("ad"), text(V.drop_alleles(F.array(*[r + i for i in range(6)]), "G", one, F.lit(3))).alias("pl"),
    )


def synced_inputs(spark: SparkSession, sf: str) -> list[DataFrame]:
    v = view(spark, sf, "variants")
    return [v.where(F.col("rec_idx") % k == 0) for k in (2, 3, 5)]


_LAST = "(select * from (select *, row_number() over (partition by contig, pos order by rec_idx desc) as k from {v} where rec_idx % {m} = 0) where k = 1)"
_A3 = [_LAST.format(v=VV, m=m) for m in (2, 3, 5)]


@query(f"select contig, pos, a.alt as alt_0, b.alt as alt_1, c.alt as alt_2 from {_A3[0]} a full join {_A3[1]} b using (contig, pos) full join {_A3[2]} c using (contig, pos)")
def synced_full_outer(spark, sf):
    return vo.synced(synced_inputs(spark, sf)).select("contig", "pos", *[F.col(f"in_{i}.alt").alias(f"alt_{i}") for i in range(3)])


@query(f"select contig, pos, rec_idx, ref, alt from {_A3[0]}")
def synced_last_wins(spark, sf):
    return vo.last_of_position(synced_inputs(spark, sf)[0]).select("contig", "pos", "rec_idx", "ref", "alt")


_PAIR = f"select contig, pos, concat(ref, '>', alt) as v, rec_idx from {VV}"


@query(f"select contig, pos, {', '.join(f'max(case when rec_idx % {m} = 0 then v end) as in_{i}' for i, m in enumerate((2, 3, 5)))} from ({_PAIR}) where rec_idx % 2 = 0 or rec_idx % 3 = 0 or rec_idx % 5 = 0 group by contig, pos, v")
def allele_pairing_exact(spark, sf):
    return vo.paired(synced_inputs(spark, sf), "exact").drop("row")


@query()
def allele_pairing(spark, sf):
    return vo.paired(synced_inputs(spark, sf), "both_ref")


@query(f"select contig, count(*) as n, cast(sum(pos) as bigint) as sum_pos, cast(sum(case when rec_idx % 4 = 0 then 0 else rec_idx % 50 + rec_idx % 9 end) as bigint) as sum_pl from {VV} group by contig")
def sweep_pl_sum(spark, sf):
    r = F.col("rec_idx")
    return vo.pl_sums(view(spark, sf, "variants").withColumn("pl", F.when(r % 4 != 0, F.array(r % 50, F.lit(None).cast("long"), r % 9))))


FASTQ = "select doc_id as rec_idx, concat('r', cast(doc_id as varchar(20)), ':AC', case when doc_id % 3 = 0 then '/1' when doc_id % 3 = 1 then '/2' else '' end) as name, concat(cast(doc_id % 2 + 1 as varchar(20)), ':', case when doc_id % 5 = 0 then 'Y' else 'N' end, ':0:ACGT') as definition, substr(repeat('ACGTN', 20), cast(doc_id % 7 + 1 as int), 30) as seq, repeat('I', 30) as qual from documents"


def fastq(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.selectExpr(
        "doc_id as rec_idx", "concat('r', cast(doc_id as string), ':AC', case when doc_id % 3 = 0 then '/1' when doc_id % 3 = 1 then '/2' else '' end) as name",
        "concat(cast(doc_id % 2 + 1 as string), ':', case when doc_id % 5 = 0 then 'Y' else 'N' end, ':0:ACGT') as definition", "substr(repeat('ACGTN', 20), cast(doc_id % 7 + 1 as int), 30) as seq", "repeat('I', 30) as qual",
    )


@query(f"select concat('r', cast(rec_idx as varchar)) as qname, cast(case when rec_idx % 3 = 0 then 77 when rec_idx % 3 = 1 then 141 when rec_idx % 2 = 0 then 77 else 141 end + case when rec_idx % 5 = 0 then 512 else 0 end as int) as flag, seq, 'AC' as rx, 'ACGT' as bc from ({FASTQ})")
def fastq_to_sam(spark, sf):
    r = fastx.fastq_to_reads(fastq(spark, sf), casava=True, umi=True)
    return r.select("qname", "flag", "seq", F.col("aux")["RX"]["value"].alias("rx"), F.col("aux")["BC"]["value"].alias("bc"))


@query(f"select rec_idx, concat('@', qname, case when (flag & 64) <> 0 then '/1' when (flag & 128) <> 0 then '/2' else '' end, chr(10), seq, chr(10), '+', chr(10), repeat('B', 40)) as record from {A}")
def sam_to_fastq(spark, sf):
    return reads(spark, sf).select("rec_idx", fastx.fastq_text().alias("record"))


@query(f"select case when (flag & 64) <> 0 then 'read1' when (flag & 128) <> 0 then 'read2' else 'single' end as part, count(*) as n, cast(sum(length(seq)) as bigint) as bases from {A} group by 1")
def fastx_split(spark, sf):
    return view(spark, sf, "alignments").groupBy(fastx.mate_of(F.col("flag")).alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("long").alias("bases"))


@query("select concat('chr', cast(o_orderkey % 5 + 1 as varchar)) as name, o_orderkey % 900 as beg, least(o_orderkey % 900 + 120, 1000) as stop, substr(repeat(substr('ACGTTGCAAC', cast(o_orderkey % 5 + 1 as int), 5), 200), cast(o_orderkey % 900 + 1 as int), 120) as seq from orders")
def faidx_fetch(spark, sf):
    ref = spark.range(5).select(F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("name"), F.repeat(F.expr("substr('ACGTTGCAAC', cast(id + 1 as int), 5)"), 200).alias("seq"))
    r = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("concat('chr', o_orderkey % 5 + 1) as contig", "o_orderkey % 900 as beg", "o_orderkey % 900 + 120 as stop")
    return fastx.subsequence(ref, r)


@query("select concat('>', concat('s', cast(p_partkey as varchar)), ' length: ', cast(40 + p_size as varchar), chr(10), substr(repeat('ACGTTGCA', 20), 1, cast(least(50, 40 + p_size) as int)), case when 40 + p_size > 50 then concat(chr(10), substr(repeat('ACGTTGCA', 20), 51, cast(p_size - 10 as int))) else '' end) as fa from part")
def fasta_wrap(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("concat('s', p_partkey) as name", "substr(repeat('ACGTTGCA', 20), 1, 40 + p_size) as seq")
    return p.select(T.fasta_text().alias("fa"))


@query(f"select concat_ws(chr(9), qname, cast(flag as varchar), rname, cast(pos as varchar), cast(mapq as varchar), cigar, '*', '0', '0', seq, '*', case when nm > 0 then concat('NM:i:', cast(nm as varchar)) end) as line from {A}")
def sam_text(spark, sf):
    return reads(spark, sf).withColumn("aux_order", F.map_keys("aux")).select(T.sam_line().alias("line"))


@query("select l_orderkey as id, coalesce(list_sort(list(l_partkey))[2], -1) as second from lineitem group by l_orderkey")
def kth_smallest(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.coalesce(S.kth_smallest(F.collect_list("l_partkey"), 1), F.lit(-1)).cast("long").alias("second"))


@query(f"select rname, cast(dense_rank() over (order by first) - 1 as bigint) as id from (select rname, min(rec_idx) as first from {A} group by rname)")
def string_ids(spark, sf):
    from pyspark.sql import Window

    # The ids of distinct names: one row per name reaches the ordered window.
    first = view(spark, sf, "alignments").groupBy("rname").agg(F.min("rec_idx").alias("first"))
    return first.select("rname", (F.dense_rank().over(Window.orderBy("first")) - 1).cast("long").alias("id"))


@query("select p_partkey as id, case when p_size = 0 then 0 else cast(power(2, ceil(log2(p_size * 37))) as bigint) end as up, p_partkey * 65536 + p_size as packed from part")
def power_and_offset(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), S.round_up_power(F.col("p_size") * 37).alias("up"), S.pack_offset(F.col("p_partkey"), F.col("p_size")).alias("packed"))


@query("select p_partkey as id, cast(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(p_brand, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 31 + c) & 4294967295) as bigint) as h from part")
def name_hash(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), S.x31(F.col("p_brand")).alias("h"))


_CHOOSE = "case when {k} = 0 or {k} = {n} then 0 else lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) end"
_CHANCE = "exp({} + {} - {})".format(_CHOOSE.format(n="(a + b)", k="k"), _CHOOSE.format(n="(c + d)", k="(a + c - k)"), _CHOOSE.format(n="(a + b + c + d)", k="(a + c)"))


@query(
    "with g as (select l_returnflag, l_linestatus, count(*) % 40 + 1 as a, count(distinct l_suppkey) % 30 + 2 as b, count(distinct l_partkey) % 20 + 3 as c, 17 as d from lineitem group by l_returnflag, l_linestatus), "
    f"t as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from g), p as (select *, {_CHANCE} as p from t), q as (select *, max(case when k = a then p end) over (partition by l_returnflag, l_linestatus) as own from p) "
    "select l_returnflag, l_linestatus, round(max(own), 9) as p, round(least(sum(case when k <= a then p end), 1), 9) as low, round(least(sum(case when k >= a then p end), 1), 9) as high, round(least(sum(case when p <= own * (1 + 1e-7) then p end), 1), 9) as two from q group by l_returnflag, l_linestatus"
)
def fisher_exact(spark, sf):
    g = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg((F.count("*") % 40 + 1).alias("a"), (F.countDistinct("l_suppkey") % 30 + 2).alias("b"), (F.countDistinct("l_partkey") % 20 + 3).alias("c"))
    found = g.select("l_returnflag", "l_linestatus", S.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.lit(17)).alias("f"))
    return found.select("l_returnflag", "l_linestatus", *[F.round(F.col(f"f.{k}"), 9).alias(n) for k, n in (("p", "p"), ("left", "low"), ("right", "high"), ("two", "two"))])


@query("select event_id, case when event_id % 6 = 0 then 'VCF' when event_id % 6 = 1 then 'SAM' when event_id % 6 = 2 then 'FASTA' when event_id % 6 = 3 then 'FASTQ' when event_id % 6 = 4 then 'BED' else 'unknown' end as format from events")
def format_detect(spark, sf):
    line = F.expr("case event_id % 6 when 0 then concat('##fileformat=VCFv4.', event_id % 6) when 1 then concat('@HD\\tVN:1.', event_id % 7) when 2 then concat('>s', event_id) when 3 then concat('@r', event_id) when 4 then concat('chr1\\t', event_id, '\\t', event_id + 5) else event_type end")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.text_format(line).alias("format"))


@query("select p_partkey as id, least(p_partkey * 7, 127) as value, p_partkey * 7 > 127 as failed from part")
def clamped_integers(spark, sf):
    c = S.clamped_integer(F.concat((F.col("p_partkey") * 7).cast("string"), F.lit("xyz")), 8)
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), c["value"].alias("value"), c["failed"].alias("failed"))


@query("select distinct p_partkey % 8 as k, reverse(translate(substr(repeat('ACGTTGCA', 20), cast(p_partkey % 8 + 1 as int), 25), 'ACGT', 'TGCA')) as rc from part")
def reverse_complement(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey % 8 as k").distinct()
    return p.select("k", S.reverse_complement(F.expr("substr(repeat('ACGTTGCA', 20), cast(k + 1 as int), 25)")).alias("rc"))



#: Made-up references go to reads in stretches: positions that a stretch serves, and bases that it has besides on both sides. Multiples of 8.
STRETCH, BESIDE = 1 << 10, 1 << 8


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Reads without skips on stretches of their contigs: rname 'chr1:2' and the position in it."""
    qual = F.repeat(F.char(F.lit(33) + F.col("rec_idx") % 8 * 5), 40)
    df = pileup.selected(reads(spark, sf)).where("cigar in ('40M', '10M3I27M', '20M10D20M', '5S30M5S')")
    n = F.floor((F.col("pos") - 1) / STRETCH)
    first = F.greatest(n * STRETCH - BESIDE, F.lit(0))
    return df.select("rec_idx", F.concat_ws(":", "rname", n.cast("string")).alias("rname"), (F.col("pos") - first).alias("pos"), "cigar", "seq", "flag", qual.alias("qual"))


def contigs(df: DataFrame) -> DataFrame:
    """name, seq: the stretches that reads lie on, of five made-up references that have no end; each repeats 8 bases of its own."""
    bases = F.expr("substr('ACGTTGCAACGGTTAC', cast(substr(substring_index(rname, ':', 1), 4) as int), 8)")
    size = F.when(F.col("rname").endswith(":0"), STRETCH + BESIDE).otherwise(STRETCH + 2 * BESIDE)
    return df.select("rname").distinct().select(F.col("rname").alias("name"), F.repeat(bases, (size / 8).cast("int")).alias("seq"))


#: Selected reads without skips, their reference's 8 bases and their matched blocks and deletions, in SQL; the position says which of the 8 comes first.
MATCHED = f"(select *, substr('ACGTTGCAACGGTTAC', cast(substr(rname, 4) as int), 8) as motif, {BLOCKS} as blocks, rec_idx % 8 * 5 as q from {A} where (flag & 1796) = 0 and cigar <> '3H15M100N20M5S')"
_BASE = "substr(motif, cast((pos - 1 + b.r + k) % 8 + 1 as bigint), 1)"
#: '=' for each match, the reference's base for a mismatch, ^ and small letters for a deletion.
_MARKS = (
    f"array_to_string(list_transform(blocks, lambda b: case when b.o = 'D' then concat('^', lower(array_to_string(list_transform(range(b.n), lambda k: {_BASE}), ''))) "
    f"else array_to_string(list_transform(range(b.n), lambda k: case when substr(seq, cast(b.q + k + 1 as bigint), 1) = {_BASE} then '=' else {_BASE} end), '') end), '')"
)
_MISSES = "cast(length(regexp_replace(marks, '[^ACGT]', '', 'g')) as int)"


@query(
    f"select rec_idx, concat(array_to_string(list_transform(regexp_extract_all(marks, '=*([ACGT]|\\^[acgt]+)'), lambda x: concat(cast(length(regexp_extract(x, '^=*')) as varchar), upper(ltrim(x, '=')))), ''), cast(length(regexp_extract(marks, '=*$')) as varchar)) as md_new, "
    f"cast({_MISSES} + case cigar when '10M3I27M' then 3 when '20M10D20M' then 10 else 0 end as int) as nm_new from (select *, {_MARKS} as marks from {MATCHED})"
)
def md_nm(spark, sf):
    df = matched(spark, sf)
    return kernels.with_md_nm(df, contigs(df)).select("rec_idx", "md_new", "nm_new")


@query(
    f"select rec_idx, cast(case when t > 40 then -1 else floor(sqrt((40 - greatest(t, 0)) / cast(40 as double)) * 40 + cast(0.499 as double)) end as int) as cap from "
    "(select rec_idx, case when wrong > 0 then wrong * least(q, 33) - cast(4.343 as double) * (wrong * ln(bases * 2) - lgamma(wrong + 1)) else 0 end + clipped / cast(5 as double) as t from "
    f"(select *, case when q >= 13 then {_MISSES} else 0 end as wrong, case cigar when '5S30M5S' then 30 when '10M3I27M' then 37 else 40 end as bases, case cigar when '5S30M5S' then 10 * q else 0 end as clipped from (select *, {_MARKS} as marks from {MATCHED})))"
)
def mapq_cap(spark, sf):
    df = matched(spark, sf)
    return kernels.with_mapq_cap(df, contigs(df)).select("rec_idx", "cap")


@query()
def baq_extended(spark, sf):
    df = matched(spark, sf)
    found = kernels.with_alignment_quality(df, contigs(df), extended=True)
    return found.select("rec_idx", kernels.baq_tag(F.col("qual"), F.col("baq")).alias("bq"))


@query()
def baq(spark, sf):
    df = matched(spark, sf)
    return kernels.with_alignment_quality(df, contigs(df)).select("rec_idx", F.concat_ws(",", F.transform("baq", lambda x: x.cast("string"))).alias("baq"))


_LOCAL = (
    "e as (select id, marks, unnest(range(1, length(marks) + 1)) as k from (select id, regexp_replace(marks, '\\^[acgt]+', '', 'g') as marks from m)), "
    # Mismatches lie where the matches before them end; the ones before them don't count.
    "x as (select id, length(regexp_replace(left(marks, k - 1), '[ACGT]', '', 'g')) as place from e where substr(marks, k, 1) <> '='), "
    "d as (select id, rec_idx, unnest(range(40)) as i from m), q as (select id, i, 2 + (rec_idx + i * 7) % 40 as ql from d), "
    "y as (select m.*, d.i, a.ql - a.ql // 3 - case when d.i = 8 then 0 when d.i >= 32 then z.ql else b.ql end as above, f.lowest from m join d using (id) join q a using (id, i) left join q b on b.id = d.id and b.i = d.i - 1 join q z on z.id = d.id and z.i = 31 "
    "join (select id, min(ql) as lowest from q join m using (id) where i < length(regexp_extract(seq, '^A+|^C+|^G+|^T+')) and i < 8 group by id) f on f.id = d.id), "
    "p as (select id, i, sum(case when i >= place - 100 and i < place - 50 then 5 when i >= place - 50 and i < place + 50 then 10 when i >= place + 50 and i < place + 100 then 5 else 0 end) as n from d join x using (id) group by id, i), "
    "s as (select y.*, case when i < 8 then 0 else greatest(0, above - case when i = 8 then lowest else 0 end) end + case cigar when '5S30M5S' then 120 else 0 end + coalesce(n, 0) as score from y left join p using (id, i)), "
    f"c as (select id, rname, pos + b.r + k as position, b.q + case b.o when 'M' then k else 0 end + 1 as i from (select id, rname, pos, b, unnest(range(b.n)) as k from (select id, rname, pos, unnest({BLOCKS}) as b from m))), "
    "h as (select s.id, s.i, s.score, length(regexp_extract(substr(seq, i + 1), '^A+|^C+|^G+|^T+')) + length(regexp_extract(reverse(left(seq, i)), concat('^', substr(seq, i + 1, 1), '*'))) - 1 as run from s) "
)


@query(
    f"with m as materialized (select *, {_MARKS} as marks, row_number() over () as id from {MATCHED}), {_LOCAL}"
    "select c.rname, c.position, count(*) as n, round(sum(case when c.i < 40 then h.score / cast(10 as double) else h.score end), 3) as nm_local, cast(sum(case when c.i < 40 then h.run else 0 end) as bigint) as homopolymer "
    "from c join h on h.id = c.id and h.i = least(c.i, 39) group by c.rname, c.position"
)
def pileup_local_nm(spark, sf):
    """Per position: what speaks against the reads there, from their qualities, mismatches (MD) and clips nearby, and the runs of equal bases that they show."""
    df = matched(spark, sf).withColumn("qual", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.char(35 + (F.col("rec_idx") + i * 7) % 40)), ""))
    df = kernels.with_md_nm(df, contigs(df)).withColumnRenamed("md_new", "md")
    # Back from stretches to contigs.
    first = F.greatest(F.substring_index("rname", ":", -1).cast("long") * STRETCH - BESIDE, F.lit(0))
    df = df.withColumns({"pos": F.col("pos") + first, "rname": F.substring_index("rname", ":", 1)})
    c = pileup.local_nm_cells(df, [])
    return c.groupBy("rname", "position").agg(F.count("*").alias("n"), F.round(F.sum("nm_local"), 3).alias("nm_local"), F.sum("homopolymer").alias("homopolymer"))


@query()
def indel_scores(spark, sf):
    """Each candidate indel of the variants, in the bases of the made-up references, against each selected read that spans it."""
    df = matched(spark, sf).drop("flag")
    v = view(spark, sf, "variants").where("length(ref) <> length(alt) and alt rlike '^[A-Za-z]+$'")
    # The same stretches as the reads; a read may reach into the next one.
    n = F.floor((F.col("pos") - 1) / STRETCH)
    v = v.select("rec_idx", "contig", "pos", "ref", "alt", F.explode(F.array(n - 1, n)).alias("n")).where("n >= 0")
    first = F.greatest(F.col("n") * STRETCH - BESIDE, F.lit(0))
    motif = F.expr("repeat(substr('ACGTTGCAACGGTTAC', cast(substr(contig, 4) as int), 8), 3)")
    # Their alleles' lengths, on the reference's bases there.
    own = F.substr(motif, ((F.col("pos") - 1) % 8 + 1).cast("int"), F.greatest(F.length("ref"), F.length("alt")))
    v = v.select("rec_idx", F.concat_ws(":", "contig", F.col("n").cast("string")).alias("contig"), (F.col("pos") - first).alias("pos"), F.substr(own, F.lit(1), F.length("ref")).alias("ref"), F.substr(own, F.lit(1), F.length("alt")).alias("alt"))
    return indels.indel_scores(df, v, contigs(df)).withColumnsRenamed({"read": "rec_idx", "variant": "variant_idx"})


_CALLS = (
    f"select rec_idx, rname, pos, cigar, cast(case when (flag & 16) <> 0 then 40 - c.p else c.p - 1 end as int) as \"offset\", '+' as strand, c.code as code, c.pr as probability from "
    "(select *, unnest([{'p': cs[2], 'code': 'm', 'pr': 200}, {'p': cs[5], 'code': 'm', 'pr': 100}, {'p': az[1], 'code': 'a', 'pr': 7}]) as c from "
    "(select *, list_filter(range(1, 41), lambda i: substr(original, i, 1) = 'C') as cs, list_filter(range(1, 41), lambda i: substr(original, i, 1) = 'A') as az from "
    f"(select *, case when (flag & 16) <> 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as original from {A})))"
)


@query("select rec_idx, \"offset\", strand, code, cast(probability as int) as probability from (" + _CALLS.replace("'+' as strand", "case when c.code = 'a' then '-' else '+' end as strand") + ")")
def base_mods(spark, sf):
    df = view(spark, sf, "alignments").select("rec_idx", "flag", "seq", F.lit("C+m,1,2;A-a,0").alias("mm"), F.array(F.lit(200), F.lit(100), F.lit(7)).alias("ml"))
    return kernels.modifications(df)


@query(
    f"with a as (select * from {A} where (flag & 1) = 1 and (flag & 12) = 0), g as (select qname, rname, count(*) as n from a group by qname, rname having count(*) = 2), "
    "p as (select a.*, row_number() over (partition by a.qname, a.rname order by pos, rec_idx) as k from a join g using (qname, rname)) "
    "select x.qname, x.rname, x.rec_idx as first, y.rec_idx as second from p x join p y on x.qname = y.qname and x.rname = y.rname and x.k = 1 and y.k = 2"
)
def mate_pairs(spark, sf):
    return pileup.mates(view(spark, sf, "alignments")).select("qname", "rname", F.col("a.rec_idx").alias("first"), F.col("b.rec_idx").alias("second"))


_X31 = "list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(qname, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 31 + c) & 4294967295)"
#: The steps of the integer hash that says which mate keeps a base.
_WANG = [f"select *, {_X31} as h from pair", "select * replace ((h + xor((h << 15) & 4294967295, 4294967295)) & 4294967295 as h) from w0", "select * replace (xor(h, h >> 10) as h) from w1", "select * replace ((h + ((h << 3) & 4294967295)) & 4294967295 as h) from w2", "select * replace (xor(h, h >> 6) as h) from w3", "select * replace ((h + xor((h << 11) & 4294967295, 4294967295)) & 4294967295 as h) from w4", "select *, (xor(h, h >> 16) & 1) = 0 as keep from w5"]


@query(
    f"with a as (select *, 10 + rec_idx % 20 as q from {A} where (flag & 1) = 1 and (flag & 12) = 0), g as (select qname, rname from a group by qname, rname having count(*) = 2), "
    "o as (select a.*, row_number() over (partition by qname, rname order by pos, rec_idx, flag, cigar, seq) as k from a join g using (qname, rname)), pair as (select qname, rname from g), "
    + ", ".join(f"w{i} as ({x})" for i, x in enumerate(_WANG))
    + f", c as (select qname, rname, k, seq, q, cast(unnest(range(40)) as bigint) as i, pos, {BLOCKS} as blocks from o), "
    "m as (select *, list_transform(list_filter(blocks, lambda b: b.o = 'M' and b.q <= i and i < b.q + b.n), lambda b: pos + b.r + i - b.q)[1] as p, substr(seq, i + 1, 1) as base from c), "
    "x as (select m.*, n.q as other, n.base as shown from m left join m as n on m.qname = n.qname and m.rname = n.rname and m.k <> n.k and m.p = n.p), "
    "y as (select x.*, w6.keep from x join w6 using (qname, rname)), "
    "z as (select qname, rname, k, list(cast(case when other is null then q when base = shown then case when keep = (k = 1) then least(q + other, 200) else 0 end "
    "when case when q <> other then q > other else keep = (k = 1) end then floor(cast(0.8 as double) * greatest(q, other)) else 0 end as int) order by i) as qual_new from y group by qname, rname, k) "
    "select o.rec_idx, array_to_string(z.qual_new, ',') as qual_new from o join z using (qname, rname, k)"
)
def overlap_quality(spark, sf):
    df = reads(spark, sf).withColumn("qual", F.repeat(F.char(F.lit(43) + F.col("rec_idx") % 20), 40))
    return pileup.overlap_qualities(df).select("rec_idx", F.concat_ws(",", F.transform("qual_new", lambda x: x.cast("string"))).alias("qual_new"))


@query("select p_partkey as id, p_size as dp, case when p_size % 3 = 0 then -1 else p_size % 7 end as second, p_size % 2 = 0 as flag from part")
def info_typed(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    info = F.concat(F.lit("DP="), F.col("p_size").cast("string"), F.lit(";AF=1,"), F.when(F.col("p_size") % 3 == 0, ".").otherwise((F.col("p_size") % 7).cast("string")), F.when(F.col("p_size") % 2 == 0, ";DB").otherwise(""))
    v = p.select("p_partkey", info.alias("i"))
    af = V.values_of(V.info_of(F.col("i"), "AF"), "int")
    return v.select(F.col("p_partkey").alias("id"), V.values_of(V.info_of(F.col("i"), "DP"), "int")[0].alias("dp"), F.coalesce(af[1], F.lit(-1)).alias("second"), V.info_of(F.col("i"), "DB").isNotNull().alias("flag"))


@query("select p_partkey as id, case p_size % 3 when 0 then 'q10' when 1 then 'q10' else 's50;q10' end as filters, case when p_size % 2 = 0 then 'DP=9;AF=0.5' else 'AF=0.5;DP=9' end as info from part")
def record_edit(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    filters = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("PASS"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("q10"))).otherwise(F.array(F.lit("s50")))
    info = F.when(F.col("p_size") % 2 == 0, F.lit("DP=1;AF=0.5")).otherwise(F.lit("AF=0.5;XX=1"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(R.add_filter(filters, "q10"), ";").alias("filters"), R.set_info(R.set_info(info, "DP", F.lit("9")), "XX", None).alias("info"))


@query("select p_partkey as id, concat('c', cast(p_size as varchar), '|.|a', cast(p_partkey as varchar)) as samples from part")
def sample_translate(spark, sf):
    s = F.array(F.array(F.concat(F.lit("a"), F.col("p_partkey").cast("string"))), F.array(F.lit("b")), F.array(F.concat(F.lit("c"), F.col("p_size").cast("string"))))
    out = R.translate_samples(s, R.sample_order(["A", "B", "C"], ["C", "D", "A"]))
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(out, lambda x: F.array_join(x, ":")), "|").alias("samples"))


@query("select l_orderkey as id, cast(count(distinct l_partkey % 200) as bigint) as n from lineitem group by l_orderkey")
def bit_set_count(spark, sf):
    g = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey") % 200).alias("v"))
    return g.select("id", R.bits_count(R.bit_set(F.col("v"), 4)).alias("n"))


@query("select p_partkey as id, cast(epoch(make_timestamp(2000 + cast(p_size // 12 as bigint), 1, 1, 0, 0, 0.0) + to_months(cast(p_size % 12 as int)) + to_days(cast(p_partkey % 400 as int)) + to_hours(cast(p_size as bigint))) as bigint) as t from part")
def utc_time(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), R.utc_seconds(F.lit(2000), F.col("p_size") + 1, F.col("p_partkey") % 400 + 1, F.col("p_size"), F.lit(0), F.lit(0)).alias("t"))


@query("select p_partkey as id, coalesce(nullif(strpos(p_name, substr(p_name, 3, 2)) - 1, -1), -1) as at, case when p_size % 2 = 0 then concat('a\\tb\\\\', cast(p_size as varchar)) else '\\\"x\\\"' end as shown from part")
def text_tools(spark, sf):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a\tb\\"), F.col("p_size").cast("string"))).otherwise(F.lit('"x"'))
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(R.find_text(F.col("p_name"), F.substring("p_name", 3, 2)), F.lit(-1)).cast("long").alias("at"), R.escaped(raw).alias("shown"))


@query("select event_type, count(*) as n, count(case when regexp_matches(m, '\\.\\s*$') then 1 end) as stops, count(case when regexp_matches(m, '^[a-z]') then 1 end) as lower from (select event_type, concat(case when event_id % 2 = 0 then 'Read ' else 'read ' end, event_type, case when event_id % 3 = 0 then '.' else '' end) as m from events) group by event_type")
def log_style(spark, sf):
    m = F.concat(F.when(F.col("event_id") % 2 == 0, "Read ").otherwise("read "), "event_type", F.when(F.col("event_id") % 3 == 0, ".").otherwise(""))
    s = R.log_style(m)
    has = lambda n: F.count(F.when(F.array_contains(s, n), 1))
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), has("full_stop").alias("stops"), has("lower_case").alias("lower"))


@query(f"select contig, count(*) as n from (select contig, pos, lag(pos) over (partition by contig order by rec_idx % 100, rec_idx) as before from {VV}) where pos < before group by contig")
def unsorted_records(spark, sf):
    v = view(spark, sf, "variants").withColumn("rec_idx", F.col("rec_idx") % 100 * 1_000_000_000 + F.col("rec_idx"))
    return vo.unsorted(v).groupBy("contig").agg(F.count("*").alias("n"))


@query("select distinct concat('c', cast(o_orderkey % 3 as varchar)) as contig, o_orderkey % 50 as beg, o_orderkey % 50 + 10 as stop, concat('n', cast(o_orderkey % 4 as varchar)) as payload from orders where o_orderkey % 7 <> 0")
def bed_lines(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    line = F.when(F.col("o_orderkey") % 7 == 0, "# skip").otherwise(F.concat_ws("\t", F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")), (F.col("o_orderkey") % 50).cast("string"), (F.col("o_orderkey") % 50 + 10).cast("string"), F.concat(F.lit("n"), (F.col("o_orderkey") % 4).cast("string"))))
    return T.parse_bed(o.select(line.alias("line"), F.col("o_orderkey").alias("rec_idx"))).select("contig", "beg", "stop", "payload").distinct()


@query("select p_partkey as id, concat(chr(cast(73 - p_size % 9 as int)), chr(cast(53 - p_partkey % 5 as int))) as qual, 'I5' as back from part")
def baq_apply_revert(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    tag = F.concat(F.char(F.lit(64) + F.col("p_size") % 9), F.char(F.lit(64) + F.col("p_partkey") % 5))
    done = S.shifted_qualities(F.lit("I5"), tag)
    return p.select(F.col("p_partkey").alias("id"), done.alias("qual"), S.shifted_qualities(done, tag, apply=False).alias("back"))


@query(f"select rname, cast(sum(case when (flag & 16) <> 0 then 1 else 0 end) as bigint) as reverse, count(*) as n, min(rec_idx) as first from {A} where mapq >= 40 group by rname")
def limited_view(spark, sf):
    good = reads(spark, sf).where(read_filter("mapq >= 40"))
    return good.groupBy("rname").agg(F.sum(F.when(F.col("flag").bitwiseAND(16) != 0, 1).otherwise(0)).cast("long").alias("reverse"), F.count("*").alias("n"), F.min("rec_idx").alias("first"))


@query(f"select rec_idx, qname from {A} where mapq >= 45 order by rec_idx limit 100")
def first_records(spark, sf):
    return reads(spark, sf).where(read_filter("mapq >= 45")).orderBy("rec_idx").limit(100).select("rec_idx", "qname")


_PLACE = f"list_transform(list_filter({BLOCKS}, lambda b: b.o = 'M' and b.q <= \"offset\" and \"offset\" < b.q + b.n), lambda b: pos + b.r + \"offset\" - b.q)[1]"


@query(f"select rname, position, code, count(*) as n, cast(sum(probability) as bigint) as p from (select rname, code, probability, {_PLACE} as position from ({_CALLS.replace('from ' + A, 'from ' + A + ' where (flag & 1796) = 0')})) where position is not null group by rname, position, code")
def base_mod_pileup(spark, sf):
    """Modified bases per reference position: rname, position, code, n and the sum of probabilities."""
    df = pileup.selected(view(spark, sf, "alignments")).withColumns({"mm": F.lit("C+m,1,2;A-a,0"), "ml": F.array(F.lit(200), F.lit(100), F.lit(7))})
    calls = kernels.modifications(df, keep=["rname", "pos", "cigar"])
    at = calls.select("rname", pileup.position_of(F.col("pos"), F.col("cigar"), F.col("offset")).alias("position"), "code", "probability").where("position is not null")
    return at.groupBy("rname", "position", "code").agg(F.count("*").alias("n"), F.sum("probability").alias("p"))


#: Headers of the files that the round trips write.
SAM_HEADER = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:chr{i}\tLN:2000000000\n" for i in range(1, 6))
VCF_HEADER = (
    "##fileformat=VCFv4.3\n" + "".join(f"##contig=<ID=chr{i}>\n" for i in range(1, 6)) + '##FILTER=<ID=PASS,Description="All passed">\n##INFO=<ID=END,Number=1,Type=Integer,Description="End">\n'
    '##INFO=<ID=SVLEN,Number=A,Type=Integer,Description="Length">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n'
)


def through_files(rows: DataFrame, kind: str, options: dict[str, str], read: Callable[[SparkSession, str], DataFrame], result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes ``rows``, reads the files again and keeps ``result`` of them; the files go."""
    spark = rows.sparkSession
    for source in (BamSource, BcfSource, BgzfSource, CramSource, FastqSource, LineSource):
        spark.dataSource.register(source)
    folder, out = shared_folder(spark, kind), shared_folder(spark, f"{kind}-result")
    if kind == "text":
        rows.write.text(folder)
    else:
        rows.write.format(kind).options(**options).mode("append").save(folder)
    result(read(spark, folder)).write.parquet(out)
    removed(spark, folder)
    return spark.read.parquet(out)


def read_sums(df: DataFrame) -> DataFrame:
    value = F.col("aux")["NM"]["value"].cast("long")
    return df.groupBy("rname", "cigar").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("flag").alias("flag"), F.sum("mapq").alias("mapq"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("nm"), F.min("seq").alias("low"), F.max("qname").alias("high"))


READ_SUMS = f"select rname, cigar, count(*) as n, cast(sum(pos) as bigint) as pos, cast(sum(flag) as bigint) as flag, cast(sum(mapq) as bigint) as mapq, cast(sum(nm) as bigint) as nm, min(seq) as low, max(qname) as high from {A} group by rname, cigar"


def ordered_reads(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).withColumn("aux_order", F.map_keys("aux"))


@query(READ_SUMS)
def bam_round_trip(spark, sf):
    """All reads written as BAM files and read back in byte ranges."""
    names = [x.split()[0] for x in BAM_SCHEMA.replace("map<string,struct<type:string,value:string>>", "map").split(", ")]
    rows = ordered_reads(spark, sf).select(*names)
    return through_files(rows, "bam", {"header": SAM_HEADER}, lambda s, p: s.read.format("bam").option("splitBytes", 1 << 20).load(p), read_sums)


@query(READ_SUMS.replace(f"from {A}", f"from (select * replace (case when (flag & 4) <> 0 then '*' else cigar end as cigar, case when (flag & 4) <> 0 then 0 else mapq end as mapq) from {A})"))
def cram_round_trip(spark, sf):
    """All reads written as CRAM files and read back by containers. The format keeps neither CIGAR nor mapping quality of reads with the unmapped flag."""
    names = [x.split()[0] for x in BAM_SCHEMA.replace("map<string,struct<type:string,value:string>>", "map").split(", ")]
    rows = ordered_reads(spark, sf).select(*names)
    return through_files(rows, "cram", {"header": SAM_HEADER}, lambda s, p: s.read.format("cram").option("splitBytes", 1 << 20).load(p), read_sums)


@query(READ_SUMS)
def sam_round_trip(spark, sf):
    """All reads written as SAM files with a header and read back."""
    lines = ordered_reads(spark, sf).select(T.sam_line().alias("line"))
    return through_files(lines, "lines", {"header": SAM_HEADER, "extension": "sam"}, lambda s, p: T.parse_sam(T.numbered_lines(s, p)), read_sums)


def vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    info = F.concat_ws(";", F.when(F.col("info_end").isNotNull(), F.concat(F.lit("END="), F.col("info_end").cast("string"))), F.when(F.col("svlen").isNotNull(), F.concat(F.lit("SVLEN="), F.col("svlen").cast("string"))))
    none = F.lit(None).cast("string")
    rows = view(spark, sf, "variants").select("contig", "pos", none.alias("id"), "ref", F.array("alt").alias("alts"), none.cast("float").alias("qual"), F.array(F.lit("PASS")).alias("filters"), info.alias("info"), F.array(F.lit("GT")).alias("format"), F.array(F.array("gt")).alias("samples"))
    return rows.select(T.vcf_line().alias("line"))


def variant_sums(lines: DataFrame) -> DataFrame:
    v = T.parse_vcf(lines)
    number = lambda key: F.sum(V.values_of(V.info_of(F.col("info"), key), "long")[0]).alias(key.lower())
    return v.groupBy("contig", "ref", F.col("alts")[0].alias("alt"), F.col("samples")[0][0].alias("gt")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.coalesce(number("END"), F.lit(0)).alias("end_"), F.coalesce(number("SVLEN"), F.lit(0)).alias("svlen"))


VARIANT_SUMS = f"select contig, ref, alt, gt, count(*) as n, cast(sum(pos) as bigint) as pos, cast(coalesce(sum(info_end), 0) as bigint) as end_, cast(coalesce(sum(svlen), 0) as bigint) as svlen from {VV} group by contig, ref, alt, gt"


@query(VARIANT_SUMS)
def vcf_round_trip(spark, sf):
    """All variants written as block-compressed VCF files and read back by blocks."""
    read = lambda s, p: bgzf_lines(s, p)
    return through_files(vcf_lines(spark, sf), "lines", {"header": VCF_HEADER, "extension": "vcf.gz"}, read, variant_sums)


@query(READ_SUMS.replace(f"from {A}", f"from {A} a where exists (select 1 from {I} i where {HIT})"))
def sorted_bam_regions(spark, sf):
    """All reads written as one sorted BAM file with an index, of which those that any interval meets are read back by the index."""
    names = [x.split()[0] for x in BAM_SCHEMA.replace("map<string,struct<type:string,value:string>>", "map").split(", ")]
    folder, out = shared_folder(spark, "sorted"), shared_folder(spark, "sorted-result")
    path = f"{folder}/reads.bam"
    indexed.write_sorted(ordered_reads(spark, sf).select(*names), path, SAM_HEADER, "bam")
    read_sums(indexed.read_regions(spark, path, "bam", regions(spark, sf), size=1 << 20)).write.parquet(out)
    removed(spark, folder)
    return spark.read.parquet(out)


@query(VARIANT_SUMS.replace(f"from {VV}", f"from {VV} where contig in ('chr2', 'chr4') and pos >= 200 and pos < 450"))
def bcf_pushed_filter(spark, sf):
    """All variants written as one sorted BCF file with an index; a filter on contig and position is looked up in it."""
    spark.dataSource.register(BcfSource)
    folder, out = shared_folder(spark, "sorted"), shared_folder(spark, "sorted-result")
    path, pushing = f"{folder}/variants.bcf", "spark.sql.python.filterPushdown.enabled"
    indexed.write_sorted(vcf_lines(spark, sf), path, VCF_HEADER, "bcf")
    before = spark.conf.get(pushing)
    spark.conf.set(pushing, "true")
    try:
        lines = spark.read.format("bcf").options(positions="true", pushdown="true").load(path).where("contig in ('chr2', 'chr4') and pos >= 200 and pos < 450")
        variant_sums(lines.select("line", "rec_idx")).write.parquet(out)
    finally:
        spark.conf.set(pushing, before)
    removed(spark, folder)
    return spark.read.parquet(out)


_ODD = "concat_ws(chr(9), contig, cast(pos as varchar(20)), '.', ref, alt, concat(cast(rec_idx % 90 as varchar(20)), '.0'), 'PASS', concat('END=', case when rec_idx % 10 = 0 then 'x' else '' end, cast(rec_idx as varchar(20))), 'GT:DP:GT:AD', concat(case rec_idx % 5 when 0 then '/' when 1 then '|' else '' end, gt, ':', cast(rec_idx % 50 as varchar(20)), ':0/0', case when rec_idx % 3 = 0 then ':1,2' else '' end))"


@query(
    f"select rec_idx, case when rec_idx % 10 = 0 then {_ODD} else concat_ws(chr(9), contig, cast(pos as varchar), '.', ref, alt, cast(rec_idx % 90 as varchar), 'PASS', concat('END=', cast(rec_idx as varchar)), 'GT:DP:AD', "
    "concat(case when rec_idx % 5 = 0 and gt like '%|%' then '/' when rec_idx % 5 = 1 and gt like '%/%' then '|' else '' end, gt, ':', cast(rec_idx % 50 as varchar), case when rec_idx % 3 = 0 then ':1,2' else ':.' end)) end as line, "
    f"rec_idx % 10 <> 0 as typed from {VV}"
)
def vcf_canonical(spark, sf):
    """Variant lines with keys that are there twice, phasing marks before the first allele and missing values; a tenth has an END that is no number."""
    header = '##INFO=<ID=END,Number=1,Type=Integer,Description="e">\n##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts'
    return T.canonical_vcf(view(spark, sf, "variants").select("rec_idx", F.expr(_ODD.replace("chr(9)", "char(9)")).alias("line")), header)


def bgzf_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all block-gzip files of a folder."""
    out = None
    for path in listed(folder, (".gz",)):
        each = spark.read.format("bgzf").load(path)
        out = each if out is None else out.unionByName(each)
    empty = spark.createDataFrame([], "line string")
    return (out if out is not None else empty).withColumn("rec_idx", F.lit(0))


@query(VARIANT_SUMS)
def bcf_round_trip(spark, sf):
    """All variants written as BCF files and read back in byte ranges."""
    return through_files(vcf_lines(spark, sf), "bcf", {"header": VCF_HEADER}, lambda s, p: s.read.format("bcf").option("splitBytes", 1 << 18).load(p), variant_sums)


@query(f"select seq, qual, substr(definition, 1, 3) as d, count(*) as n, min(name) as low, max(name) as high from ({FASTQ}) group by seq, qual, d")
def fastq_round_trip(spark, sf):
    """Sequences written as FASTQ files and read back in byte ranges."""
    text = F.concat(F.lit("@"), "name", F.lit(" "), "definition", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    sums = lambda df: df.groupBy("seq", "qual", F.substring("definition", 1, 3).alias("d")).agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"))
    rows = fastq(spark, sf).select(text.alias("line"))
    return through_files(rows, "lines", {"extension": "fastq"}, lambda s, p: s.read.format("fastq").option("splitBytes", 1 << 16).load(p), sums)


@query(f"select contig, case when rec_idx % 6 = 0 then null else gt end as gt, count(*) as n from {VV} group by 1, 2")
def genotype_extract(spark, sf):
    """The first sample's genotype; records without GT have none."""
    v = view(spark, sf, "variants")
    bare = F.col("rec_idx") % 6 == 0
    keys = F.when(bare, F.array(F.lit("DP"))).otherwise(F.array(F.lit("DP"), F.lit("GT")))
    samples = F.array(F.when(bare, F.array(F.lit("9"))).otherwise(F.array(F.lit("9"), F.col("gt"))))
    return v.select("contig", V.genotypes_of(keys, samples)[0].alias("gt")).groupBy("contig", "gt").agg(F.count("*").alias("n"))


@query(f"select rname, case nm when 0 then null when 1 then 'first' when 2 then 'second' end as library, count(*) as n from {A} where nm < 3 group by 1, 2")
def library_of_read_group(spark, sf):
    """Reads by the library of their read group: of three, one has a library each and one has none."""
    header = "@HD\tVN:1.6\n@RG\tID:g0\tSM:x\n@RG\tID:g1\tLB:first\tSM:x\n@RG\tID:g2\tSM:y\tLB:second\n"
    tag = F.create_map(F.lit("RG"), F.struct(F.lit("Z").alias("type"), F.concat(F.lit("g"), F.col("nm").cast("string")).alias("value")))
    found = R.with_library(reads(spark, sf).withColumn("aux", tag), header)
    kept = found.where(read_filter('library == "first" || library == "second" || [RG] == "g0"'))
    return kept.groupBy("rname", "library").agg(F.count("*").alias("n"))


@query(
    "select concat('r', cast(rec_idx as varchar)) as qname, cast(77 + 64 * k as int) as flag, case when k = 0 then seq else reverse(seq) end as seq, concat('ACG-', substr(seq, 1, 4)) as bc, 'III JJJJ' as qt "
    f"from ({FASTQ}) cross join (select unnest([0, 1]) as k)"
)
def fastq_pairs(spark, sf):
    """Two files of reads and two of index reads, whose records belong together by their place."""
    one = fastq(spark, sf).select(F.concat(F.lit("r"), F.col("rec_idx").cast("string")).alias("name"), F.lit(None).cast("string").alias("definition"), "seq", "qual", (F.col("rec_idx") * 7).alias("rec_idx"))
    two = one.withColumns({"seq": F.reverse("seq"), "rec_idx": F.col("rec_idx") * 3})
    i1, i2 = one.withColumns({"seq": F.lit("ACG"), "qual": F.lit("III")}), one.withColumns({"seq": F.substring("seq", 1, 4), "qual": F.lit("JJJJ")})
    r = fastx.paired_reads(one, two, i1, i2)
    return r.select("qname", "flag", "seq", F.col("aux")["BC"]["value"].alias("bc"), F.col("aux")["QT"]["value"].alias("qt"))


@query(
    "select rec_idx, concat_ws(chr(9), contig, cast(pos as varchar), '.', 'T', case when rec_idx % 2 = 0 then 'A' else 'C' end, '.', 'PASS', concat('AC=', cast(case when rec_idx % 2 = 0 then 2 else 1 end as varchar), ';DB;CIPOS=', case when rec_idx % 2 = 0 then '3,4' else '1,2' end), 'GT:AD:PL', "
    f"concat(case when rec_idx % 2 = 0 then './1' else '1/.' end, ':', case when rec_idx % 2 = 0 then '9,5' else '9,7' end, ':', case when rec_idx % 2 = 0 then '0,30,50' else '0,10,20' end)) as line from {VV}"
)
def allele_removal(spark, sf):
    """Lines with two ALTs, of which the first or the second goes with all that belongs to it."""
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), F.lit("T"), F.lit("C,A"), F.lit("."), F.lit("PASS"), F.lit("AC=1,2;DB;CIPOS=1,2,3,4"), F.lit("GT:AD:PL"), F.lit("1/2:9,7,5:0,10,20,30,40,50"))
    v = view(spark, sf, "variants").select("rec_idx", line.alias("line"), F.array(F.when(F.col("rec_idx") % 2 == 0, 1).otherwise(2)).alias("gone"))
    return alleles.remove_alleles(v).select("rec_idx", "line")
