"""Sorted files: index of ranges against the index of the whole, pushed filters, tables of regions; what is read is counted."""

import io
import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bam, bcf, bgzf, index, indexed

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:b\tLN:900000\n@SQ\tSN:a\tLN:900000\n@SQ\tSN:empty\tLN:5\n"
VCF = '##fileformat=VCFv4.3\n##contig=<ID=b>\n##contig=<ID=a>\n##INFO=<ID=END,Number=1,Type=Integer,Description="e">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
SPAN = {"50M": 50, "20M9000N30M": 9050, "10S40M": 40}


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        pos = 5000 if i % 3 == 0 else rng.randrange(1, 800000)  # a third in one place
        seq = "".join(rng.choice("ACGT") for _ in range(50))
        rows.append((f"q{i}", 0, None if i % 500 == 0 else "ba"[i % 2], None if i % 500 == 0 else pos, 9, rng.choice([*SPAN]), None, None, 0, seq, "".join(chr(33 + rng.randrange(60)) for _ in range(50)), {"NM": ("i", str(i))}, ["NM"]))
    fields = bam.SCHEMA.rsplit(", rec_idx", 1)[0]
    for source in (bam.BamSource, bcf.BcfSource, bgzf.BgzfSource):
        spark.dataSource.register(source)
    return spark.createDataFrame(rows, fields).repartition(5)


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    rows = [(f"{rng.choice('ab')}\t{rng.randrange(1, 700000)}\tv{i}\t{rng.choice(['A', 'ACGT'])}\tT\t.\t.\t{'END=' + str(700000 + i) if i % 50 == 0 else '.'}",) for i in range(9000)]
    return spark.createDataFrame(rows, "line string").repartition(4)


def whole_index(path, kind):
    with open(path, "rb") as f:
        return {"bam": lambda: index.bai_bytes(index.index_bam(f)), "vcf": lambda: index.tbi_bytes(index.index_lines(f, "vcf")), "bcf": lambda: index.csi_bytes(indexed.partial_index(f, "bcf", 0, 1 << 40))}[kind]()


@pytest.mark.parametrize("kind", ["bam", "vcf", "bcf"])
def test_sorted_files_and_their_indexes(spark, reads, lines, tmp_path, kind):
    extension, ending, _ = indexed.KINDS[kind]
    path = f"{tmp_path}/x{extension}"
    rows, header = (reads, HEADER) if kind == "bam" else (lines, VCF)
    done = indexed.write_sorted(rows, path, header, kind).collect()
    assert len(done) == 1 and done[0]["records"] == rows.count()
    data = (tmp_path / f"x{extension}").read_bytes()
    assert len(data) == done[0]["size"] and bgzf.ends_well(data)
    made = (tmp_path / f"x{extension}.{ending}").read_bytes()
    assert made == whole_index(path, kind)  # the pieces' indexes, put together
    if kind == "bam":
        blocks = bam.Blocks(io.BytesIO(data))
        bam.read_header(blocks)
        seen = []
        while (n := blocks.int()) is not None:
            seen.append(bam.decode_record(blocks.read(n), bam.references_of(HEADER)))
        places = [("ba".index(r[2]), r[3]) if r[2] else (9, 0) for r in seen]
        assert places == sorted(places) and sorted(r[0] for r in seen) == sorted(r["qname"] for r in reads.collect())
    for size in (3000, 40_000, 1 << 30):  # by ranges of any size
        (tmp_path / f"x{extension}.{ending}").unlink()
        built = indexed.build_indexes(spark, str(tmp_path), kind, size).collect()
        assert [r["file"] for r in built] == [path] and built[0]["chunks"] > 10
        assert (tmp_path / f"x{extension}.{ending}").read_bytes() == made
    assert not [x for x in tmp_path.iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")]


def test_unsorted_files_are_refused(spark, tmp_path):
    rows = [{"qname": f"q{i}", "flag": 0, "rname": "b", "pos": p, "mapq": 9, "cigar": "4M", "rnext": None, "pnext": None, "tlen": 0, "seq": "ACGT", "qual": None} for i, p in enumerate([*range(5000, 1, -1)])]
    (tmp_path / "x.bam").write_bytes(bam.write_bam(HEADER, rows))
    for size in (900, 1 << 30):
        with pytest.raises(Exception, match="not sorted"):
            indexed.build_indexes(spark, f"{tmp_path}/x.bam", "bam", size)




@pytest.mark.parametrize("kind", ["bam", "vcf", "bcf"])
def test_filters_and_regions(spark, reads, lines, tmp_path, kind):
    extension, _, _ = indexed.KINDS[kind]
    path = f"{tmp_path}/x{extension}"
    indexed.write_sorted(reads if kind == "bam" else lines, path, HEADER if kind == "bam" else VCF, kind)
    source, contig = {"bam": ("bam", "rname"), "vcf": ("bgzf", "contig"), "bcf": ("bcf", "contig")}[kind]
    load = lambda push=False: spark.read.format(source).options(positions="true", pushdown=str(push), splitBytes=4000).load(path)
    name = "qname" if kind == "bam" else "line"
    all_rows = {r[name]: r for r in load().where(f"{contig} is not null").collect()}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for where, keep in (
            (f"{contig} = 'a' and pos >= 300000 and pos < 300900", lambda c, p: c == "a" and 300000 <= p < 300900),
            (f"{contig} in ('a', 'nowhere') and pos = 5000", lambda c, p: c == "a" and p == 5000),
            (f"{contig} = 'b' and pos > 799990 or {contig} = 'a' and pos < 9", lambda c, p: (c == "b" and p > 799990) or (c == "a" and p < 9)),
            (f"{contig} = 'b' and pos > 20 and pos < 10", lambda c, p: False),
        ):
            got = sorted(r[name] for r in load(True).where(where).collect())
            assert got == sorted(n for n, r in all_rows.items() if keep(r[contig], r["pos"]))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    # What a pushed filter reads.
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    reader = {"bam": bam.PushedBamReader, "vcf": bgzf.PushedBgzfReader, "bcf": bcf.PushedBcfReader}[kind]({"path": path, "positions": "true"})
    filters = [EqualTo((contig,), "a"), GreaterThan(("pos",), 500_000), LessThan(("pos",), 504_000)]
    assert list(reader.pushFilters(filters)) == filters
    parts, size = reader.partitions(), (tmp_path / f"x{extension}").stat().st_size
    assert parts and sum((x.stop >> 16) - (x.start >> 16) for x in parts) < size / 4
    # A table of regions.
    rng = random.Random(3)
    regions = [(rng.choice("ab"), b := rng.randrange(800000), b + rng.choice([1, 300, 20_000])) for _ in range(25)] + [("a", 4990, 5001), ("a", 4995, 5000), ("nowhere", 1, 9), ("b", 7, 7), (None, 1, 2), ("a", 1 << 33, 1 << 34)]
    table = spark.createDataFrame(regions, "contig string, beg long, stop long")

    def span(r):
        if kind == "bam":
            return r["pos"] - 1, r["pos"] - 1 + SPAN[r["cigar"]]
        f = r["line"].split("\t")
        return r["pos"] - 1, int(f[7][4:]) if f[7] != "." else r["pos"]

    got = indexed.read_regions(spark, path, kind, table, size=2000)
    want = sorted(n for n, r in all_rows.items() if any(c == r[contig] and b < e and span(r)[0] < e and span(r)[1] > b for c, b, e in regions))
    assert sorted(r[name] for r in got.collect()) == want and len(want) > 100
    few = indexed.region_parts(spark, path, kind, spark.createDataFrame([("a", 500_000, 504_000)], "contig string, beg long, stop long"), 2000).collect()
    assert sum((x["stop"] >> 16) - (x["start"] >> 16) for x in few) < size / 4
    none = indexed.read_regions(spark, path, kind, table.where("contig = 'nowhere'"))
    assert none.count() == 0 and none.select(F.col(name)).columns == [name]
