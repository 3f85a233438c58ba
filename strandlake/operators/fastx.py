"""Conversions between alignments and FASTA or FASTQ records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .references import with_bases

#: Flags of unmapped reads: first, second, single; failed filter. Fixed values.
FIRST, SECOND, SINGLE, FAILED = 77, 141, 4, 512


def fastq_to_reads(fastx: DataFrame, casava: bool = False, umi: bool = False, barcode_tag: str = "BC", tags: bool = False, second_name: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """Unmapped alignments of FASTQ records (name, definition, seq, qual, rec_idx).

    A name's /1 or /2 goes and makes a first or second read; else, with ``casava``, the definition's
    'read:filtered:control:index' does, whose Y sets the failed flag and whose index becomes a barcode. With
    ``umi`` the last ':' part of a name, unless all digits, becomes RX, + written as -. With ``tags`` the
    definition's SAM tags (XX:T:value between white space) are taken over; with ``second_name`` the
    definition's first word is the name. ``beside``: columns that stay.
    """
    definition = F.coalesce("definition", F.lit(""))
    name = F.coalesce(F.nullif(F.regexp_extract(definition, r"^(\S+)", 1), F.lit("")), "name") if second_name else F.col("name")
    mate = F.regexp_extract(name, r"/([12])$", 1)
    plain = F.regexp_replace(name, r"/[12]$", "")
    pattern = r"^(\d+):([YN]):(\d+)(?::(\S*))?"
    part = lambda i: F.regexp_extract(definition, pattern, i) if casava else F.lit("")
    number = F.when(mate != "", mate).otherwise(part(1))
    flag = F.when(number == "1", FIRST).when(number == "2", SECOND).otherwise(SINGLE) + F.when(part(2) == "Y", FAILED).otherwise(0)
    last = F.regexp_extract(plain, r":([^:]+)$", 1)
    is_umi = (last != "") & ~last.rlike(r"^\d+$") & last.rlike(r"^[ACGTNacgtn+_-]+$") if umi else F.lit(False)
    tag = lambda v: F.struct(F.lit("Z").alias("type"), v.alias("value"))
    entries = F.array(F.when(is_umi, F.struct(F.lit("RX").alias("key"), tag(F.translate(last, "+", "-")).alias("value"))), F.when((part(4) != "") & F.lit(barcode_tag != "0"), F.struct(F.lit(barcode_tag).alias("key"), tag(part(4)).alias("value"))))
    entries = F.filter(entries, lambda e: e.isNotNull())
    if tags:
        found = F.filter(F.split(definition, r"\s+"), lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
        given = F.transform(found, lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, F.lit(6), F.lit(2**31 - 1)).alias("value")).alias("value")))
        entries = F.concat(F.filter(entries, lambda e: ~F.exists(given, lambda g: g["key"] == e["key"])), given)
    qname = F.when(is_umi, F.regexp_replace(plain, r":[^:]+$", "")).otherwise(plain)
    return fastx.select(
        qname.alias("qname"), flag.cast("int").alias("flag"), F.lit(None).cast("string").alias("rname"), F.lit(None).cast("long").alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"),
        F.lit(None).cast("string").alias("rnext"), F.lit(None).cast("long").alias("pnext"), F.lit(0).alias("tlen"), "seq", "qual", F.map_from_entries(entries).alias("aux"), F.transform(entries, lambda e: e["key"]).alias("aux_order"), "rec_idx", *beside,
    )


def numbered(records: DataFrame, width: int = 1 << 20) -> DataFrame:
    """``records`` with place: 0, 1, 2, ... in order of rec_idx. Rows are ordered in blocks of ``width`` numbers of rec_idx; only blocks' sizes are summed up in order."""
    blocks = records.withColumn("__block", F.floor(F.col("rec_idx") / width))
    sizes = blocks.groupBy("__block").agg(F.count("*").alias("n"))
    before = sizes.select("__block", (F.sum("n").over(Window.orderBy("__block")) - F.col("n")).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__block").orderBy("rec_idx")) - 1
    return blocks.withColumn("__here", here).join(before, "__block").select(*records.columns, (F.col("__before") + F.col("__here")).alias("place"))


def paired_reads(first: DataFrame, second: DataFrame | None, index1: DataFrame | None = None, index2: DataFrame | None = None, barcode_tag: str = "BC", **options) -> DataFrame:
    """Unmapped alignments of FASTQ files whose records belong together by their place: two reads of a template, and its index reads.

    Both reads (flags 77 and 141) get the index reads' bases, joined by '-', and qualities (QT), joined by a space. Files of
    different lengths are an error. ``second`` None: single reads. Other options as in fastq_to_reads.
    """
    sides = [x for x in (first, second, index1, index2) if x is not None]
    whole = None
    for i, side in enumerate(sides):
        one = numbered(side).select("place", F.struct(*side.columns).alias(f"__{i}"))
        whole = one if whole is None else whole.join(one, "place", "full")
    missing = F.lit(False)
    for i in range(len(sides)):
        missing = missing | F.col(f"__{i}").isNull()
    whole = whole.withColumn("place", F.when(missing, F.raise_error(F.lit("files of different lengths")).cast("long")).otherwise(F.col("place")))
    reads = 1 if second is None else 2
    bases = F.concat_ws("-", *[F.col(f"__{i}.seq") for i in range(reads, len(sides))])
    quals = F.concat_ws(" ", *[F.col(f"__{i}.qual") for i in range(reads, len(sides))])
    out = None
    for i in range(reads):
        one = fastq_to_reads(whole.select(f"__{i}.name", f"__{i}.definition", f"__{i}.seq", f"__{i}.qual", (F.col("place") * reads + i).alias("rec_idx"), bases.alias("__bases"), quals.alias("__quals")), barcode_tag=barcode_tag, beside=("__bases", "__quals"), **options)
        one = one if reads == 1 else one.withColumn("flag", F.col("flag").bitwiseAND(FAILED) + (FIRST, SECOND)[i])
        out = one if out is None else out.unionByName(one)
    if len(sides) > reads:
        tag = lambda c: F.struct(F.lit("Z").alias("type"), F.col(c).alias("value"))
        new = F.create_map(F.lit(barcode_tag), tag("__bases"), F.lit("QT"), tag("__quals"))
        out = out.withColumn("aux", F.map_concat(F.map_filter("aux", lambda k, v: ~k.isin(barcode_tag, "QT")), new)).withColumn("aux_order", F.map_keys("aux"))
    return out.drop("__bases", "__quals")


def interleaved_reads(records: DataFrame, **options) -> DataFrame:
    """Unmapped alignments of one FASTQ file in which a template's two reads follow one another; an odd number of records is an error."""
    placed = numbered(records)
    half = lambda i: placed.where(F.col("place") % 2 == i).drop("place")
    return paired_reads(half(0), half(1), **options)


def mate_of(flag: Column) -> Column:
    """read1, read2 or single; a read with both bits is read1."""
    return F.when(flag.bitwiseAND(64) != 0, "read1").when(flag.bitwiseAND(128) != 0, "read2").otherwise("single")


def fastq_text(suffix: bool = True) -> Column:
    """The four lines of an alignment row; no reverse complement for reverse reads. Missing qualities are 'B' each."""
    name = F.concat("qname", F.when(mate_of(F.col("flag")) == "read1", "/1").when(mate_of(F.col("flag")) == "read2", "/2").otherwise("")) if suffix else F.col("qname")
    qual = F.coalesce("qual", F.repeat(F.lit("B"), F.length("seq")))
    return F.concat(F.lit("@"), name, F.lit("\n"), "seq", F.lit("\n+\n"), qual)


def subsequence(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """name, beg, stop, seq for regions (contig, beg, stop; 0-based) of sequences (name, seq); the end is clamped, a start beyond it is an error."""
    both = with_bases(regions.select("contig", "beg", "stop"), sequences, "contig", F.col("beg"), F.col("stop")).where("__size is not null")
    ok = F.when(F.col("beg") >= F.col("__size"), F.raise_error(F.concat(F.lit("beyond the end of "), "contig")).cast("long")).otherwise(F.col("beg"))
    return both.select(F.col("contig").alias("name"), ok.alias("beg"), F.least("stop", "__size").alias("stop"), F.col("__bases").alias("seq"))
