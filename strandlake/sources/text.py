"""Readers and writers of text formats: SAM, VCF, BED, FASTA and FASTQ.

Plain and gzip-compressed files are read by Spark's text source; block-compressed ones, which it can't
split, by ``sources.bgzf``.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAM_FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, rec_idx: lines with a number that grows with their place in the file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("rec_idx"))


def parse_sam(lines: DataFrame, skip_bad: bool = False) -> DataFrame:
    """Alignment columns of lines (line, rec_idx); header lines go. A line of fewer than 11 fields is an error, or goes."""
    rows = lines.where(~F.col("line").startswith("@") & (F.col("line") != "")).withColumn("f", F.split("line", "\t"))
    bad = (F.size("f") < 11) | F.try_element_at("f", F.lit(2)).try_cast("int").isNull() | F.try_element_at("f", F.lit(4)).try_cast("long").isNull()
    if skip_bad:
        rows = rows.where(~bad)
    else:
        rows = rows.withColumn("f", F.when(bad, F.raise_error(F.concat(F.lit("not an alignment line: "), "line")).cast("array<string>")).otherwise(F.col("f")))
    at = lambda i: F.try_element_at("f", F.lit(i))
    given = lambda c, none: F.when(c != none, c)
    tags = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    aux = F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, F.lit(6), F.lit(2**31 - 1)).alias("value")))))
    return rows.select(
        at(1).alias("qname"), at(2).cast("int").alias("flag"), given(at(3), "*").alias("rname"), given(at(4).cast("long"), 0).alias("pos"), given(at(5).cast("int"), 255).alias("mapq"), at(6).alias("cigar"),
        F.when(at(7) == "=", at(3)).when(at(7) != "*", at(7)).alias("rnext"), given(at(8).cast("long"), 0).alias("pnext"), at(9).cast("int").alias("tlen"), F.when(at(10) == "*", "").otherwise(at(10)).alias("seq"), given(at(11), "*").alias("qual"),
        aux.alias("aux"), F.transform(tags, lambda t: F.substring(t, 1, 2)).alias("aux_order"), "rec_idx",
    )


def sam_line(aux: bool = True) -> Column:
    """The text line of an alignments row."""
    text = lambda c, none: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none))
    core = F.concat_ws("\t", text("qname", "*"), text("flag", "0"), text("rname", "*"), text("pos", "0"), text("mapq", "255"), text("cigar", "*"), F.when(F.col("rnext") == F.col("rname"), "=").otherwise(text("rnext", "*")), text("pnext", "0"), text("tlen", "0"), text("seq", "*"), text("qual", "*"))
    if not aux:
        return core
    tags = F.transform("aux_order", lambda t: F.concat(t, F.lit(":"), F.col("aux")[t]["type"], F.lit(":"), F.col("aux")[t]["value"]))
    return F.concat_ws("\t", core, tags)


def parse_vcf(lines: DataFrame) -> DataFrame:
    """contig, pos, id, ref, alts, qual, filters, info, format, samples, rec_idx of lines; header lines go."""
    f = F.split("line", "\t")
    at = lambda i: F.try_element_at(f, F.lit(i))
    given = lambda c: F.when(c != ".", c)
    rows = lines.where(~F.col("line").startswith("#") & (F.col("line") != ""))
    return rows.select(
        at(1).alias("contig"), at(2).cast("long").alias("pos"), given(at(3)).alias("id"), at(4).alias("ref"), F.coalesce(F.split(given(at(5)), ","), F.array().cast("array<string>")).alias("alts"),
        given(at(6)).cast("float").alias("qual"), F.coalesce(F.split(given(at(7)), ";"), F.array().cast("array<string>")).alias("filters"), at(8).alias("info"),
        F.split(at(9), ":").alias("format"), F.transform(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))), lambda s: F.split(s, ":")).alias("samples"), "rec_idx",
    )


def vcf_line() -> Column:
    text = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    qual = F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("long").cast("string")).otherwise(F.col("qual").cast("string"))
    core = F.concat_ws("\t", "contig", F.col("pos").cast("string"), text(F.col("id")), "ref", text(F.array_join("alts", ",")), text(qual), text(F.array_join("filters", ";")), text(F.col("info")))
    return F.when(F.size("samples") > 0, F.concat_ws("\t", core, F.array_join("format", ":"), F.array_join(F.transform("samples", lambda s: F.array_join(s, ":")), "\t"))).otherwise(core)


def plain_genotype(gt: Column) -> Column:
    """A genotype without the phasing mark before its first allele where that says no more than the others: /0/1, |0|1, |1 and /. lose it; |0/1, /0|1, /1 and |. keep it. Empty ones become '.'."""
    first, rest = F.left(gt, F.lit(1)), F.substr(gt, F.lit(2))
    second = F.regexp_extract(rest, "[/|]", 0)
    implied = F.when(second == "", ((first == "|") & (rest != ".")) | ((first == "/") & (rest == "."))).otherwise(second == first)
    return F.when(gt == "", ".").when(first.isin("/", "|") & implied, rest).otherwise(gt)


#: What the text of a number may look like, by the header's type. Fixed values.
NUMBERS = {"Integer": r"^[+-]?\d+$", "Float": r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"}


def canonical_vcf(lines: DataFrame, header: str) -> DataFrame:
    """``lines`` of VCF records, with ``line`` in canonical form and ``typed``: whether the header's types allow that.

    FORMAT keys that are there twice keep their first place and value, samples get a '.' for values they lack, genotypes go
    through plain_genotype, QUAL is written as a number; a record without FORMAT under a header with samples gets '.' for it and each
    sample. A record whose numbers aren't of the type that the header gives their INFO or FORMAT field, or whose POS isn't a number,
    stays as it is, and no other record is touched by that. Header lines stay too.
    """
    kinds = {k: {m[0]: m[1] for m in re.findall(rf"^##{k}=<ID=([^,>]+),.*?Type=(Integer|Float)", header, re.M)} for k in ("INFO", "FORMAT")}
    samples = max(0, len(next((x for x in header.splitlines() if x.startswith("#CHROM")), "").split("\t")) - 9)
    f = F.split("line", "\t")
    at = lambda i: F.coalesce(F.get(f, i), F.lit(""))

    def wrong(key: Column, value: Column, of: dict[str, str]) -> Column:
        out = F.lit(False)
        for kind, pattern in NUMBERS.items():
            names = [k for k, t in of.items() if t == kind]
            if names:
                out = out | (key.isin(*names) & F.exists(F.split(value, ","), lambda v: (v != ".") & ~v.rlike(pattern)))
        return out

    info = F.exists(F.split(at(7), ";"), lambda x: F.contains(x, F.lit("=")) & wrong(F.substring_index(x, "=", 1), F.substr(x, F.instr(x, "=") + 1), kinds["INFO"]))
    rows = lines.withColumns({"__keys": F.split(at(8), ":"), "__samples": F.transform(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))), lambda s: F.split(s, ":"))})
    keys = F.col("__keys")
    bad = F.exists("__samples", lambda s: F.exists(F.transform(s, lambda v, i: F.coalesce(wrong(F.get(keys, i), v, kinds["FORMAT"]), F.lit(False))), lambda x: x))
    record = ~F.col("line").startswith("#") & (F.size(f) >= 8)
    rows = rows.withColumn("typed", record & at(1).rlike(r"^\d+$") & (at(5).rlike(NUMBERS["Float"]) | (at(5) == ".")) & ~info & ~bad)
    kept = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: F.array_position(keys, F.get(keys, i)) == i + 1)
    rows = rows.withColumn("__kept", kept)
    number = at(5).try_cast("double")
    qual = F.when(at(5) == ".", ".").when(number == F.floor(number), number.cast("long").cast("string")).otherwise(at(5).try_cast("float").cast("string"))
    core = F.concat_ws("\t", F.slice(f, 1, 5), qual, at(6), at(7))
    value = lambda s, i: F.coalesce(F.get(s, i), F.lit("."))
    sample = lambda s: F.array_join(F.transform("__kept", lambda i: F.when(F.get(keys, i) == "GT", plain_genotype(value(s, i))).otherwise(value(s, i))), ":")
    full = F.concat_ws("\t", core, F.array_join(F.transform("__kept", lambda i: F.get(keys, i)), ":"), F.transform("__samples", sample))
    short = F.concat(core, F.lit("\t." * (samples + 1 if samples else 0)))
    line = F.when(~F.col("typed"), F.col("line")).when(F.size(f) >= 10, full).when(F.size(f) == 8, short).otherwise(F.col("line"))
    return rows.withColumn("line", line).drop("__keys", "__samples", "__kept")


def parse_bed(lines: DataFrame) -> DataFrame:
    """contig, beg, stop, payload, region_idx."""
    from ..operators.intervals import parse_region_line

    rows = lines.select(parse_region_line(F.col("line"), "bed").alias("r"), F.col("rec_idx").alias("region_idx")).where("r is not null")
    return rows.select("r.*", "region_idx")


def parse_gff(lines: DataFrame) -> DataFrame:
    """contig, source, type, beg, stop, score, strand, phase, attributes (map), rec_idx; 0-based, half-open. Comments, directives and sequences go."""
    f = F.split("line", "\t")
    at = lambda i: F.nullif(F.try_element_at(f, F.lit(i)), F.lit("."))
    rows = lines.where(~F.col("line").startswith("#") & (F.size(f) >= 8))
    pairs = F.filter(F.transform(F.split(F.coalesce(at(9), F.lit("")), ";"), lambda x: F.split(F.trim(x), "=", 2)), lambda p: F.size(p) == 2)
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0], p[1])))
    return rows.select(
        at(1).alias("contig"), at(2).alias("source"), at(3).alias("type"), (at(4).cast("long") - 1).alias("beg"), at(5).cast("long").alias("stop"), at(6).cast("double").alias("score"),
        at(7).alias("strand"), at(8).cast("int").alias("phase"), attributes.alias("attributes"), "rec_idx",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, definition, seq, rec_idx: a record begins at each '>' that starts a line; sequences may have several lines."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"), F.monotonically_increasing_id().alias("rec_idx"))
    head, body = F.regexp_extract("v", r"^([^\r\n]*)", 1), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.where("trim(v) <> ''").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(head, r"^\S*", "")), F.lit("")).alias("definition"), body.alias("seq"), "rec_idx")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, definition, seq, qual, rec_idx. Sequences and qualities may have several lines; qualities end when they are as long.

    Records are found per file (a quality line may start with '@', so no line shows by itself where one begins).
    """

    def records(batches):
        import pyarrow as pa

        for b in batches:
            for i, data in zip(b.column("rec_idx").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines, at, out = data.decode().splitlines(), 0, []
                while at < len(lines):
                    if not lines[at]:
                        at += 1
                        continue
                    if not lines[at].startswith("@"):
                        raise ValueError(f"a FASTQ record starts with @, not {lines[at][:20]!r}")
                    name, _, definition = lines[at][1:].partition(" ")
                    at += 1
                    seq: list[str] = []
                    while at < len(lines) and not lines[at].startswith("+"):
                        seq.append(lines[at])
                        at += 1
                    at += 1
                    need, qual = sum(map(len, seq)), ""
                    while len(qual) < need and at < len(lines):
                        qual += lines[at]
                        at += 1
                    if len(qual) != need:
                        raise ValueError(f"{name}: {need} bases but {len(qual)} qualities")
                    out.append((name, definition or None, "".join(seq), qual, (i << 33) + len(out)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "definition", "seq", "qual", "rec_idx"])

    files = spark.read.format("binaryFile").load(path).select("content", F.monotonically_increasing_id().alias("rec_idx"))
    return files.mapInArrow(records, "name string, definition string, seq string, qual string, rec_idx long")


def fasta_text(width: int = 50) -> Column:
    """'>name length: N' and the sequence in lines of ``width``."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")
    return F.concat(F.lit(">"), "name", F.lit(" length: "), F.length("seq").cast("string"), F.lit("\n"), body)
