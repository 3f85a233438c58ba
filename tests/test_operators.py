import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.functions import variants as V
from strandlake.functions.filters import cigar_sum, hard_clip, soft_clip
from strandlake.operators import intervals, pileup
from strandlake.operators.variants import pair_alleles, synced
from strandlake.sources import bgzf
from strandlake.sources import text as T


@pytest.mark.parametrize("width", [None, 16])
@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("pairs", [1 << 24, 9])
def test_interval_join_against_brute_force(spark, how, width, pairs, monkeypatch):
    """Short intervals and ones that lie on coarser levels (width 16: longer than 1,024 and than 65,536), with bins whole and split."""
    monkeypatch.setattr(intervals, "PAIRS", pairs)
    rng = random.Random(1)
    make = lambda n: [(f"c{rng.randrange(2)}", b := rng.randrange(500), b + rng.randrange(0, 120), i) for i in range(n)]
    left, right = [*make(80), (None, 1, 5, 900), ("c0", None, 5, 901)], make(60)
    left += left[:3]  # repeated rows stay
    columns = "contig string, beg long, stop long, i long"
    left += [("c0", 0, 3000, 910), ("c1", 100, 20_000, 911), ("c1", 450, 460, 912)]
    right += [("c1", 0, 300_000, 910), ("c0", 40, 4000, 911)]
    got = intervals.interval_join(spark.createDataFrame(left, columns), spark.createDataFrame(right, columns), how, width=width)
    meets = lambda a, b: None not in a[:3] and a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and a[2] > b[1]
    if how == "inner":
        assert sorted((r["i"], r["r_i"]) for r in got.collect()) == sorted((a[3], b[3]) for a in left for b in right if meets(a, b))
    else:
        assert sorted(r["i"] for r in got.collect()) == sorted(a[3] for a in left if any(meets(a, b) for b in right) == (how == "left_semi"))


def test_levels_are_those_of_the_intervals(spark):
    """_levels, from lengths' bits, holds exactly what _level deals."""
    lengths = [*range(1, 40), *(2**k + d for k in range(2, 40) for d in (-1, 0, 1))]
    rows = spark.createDataFrame([(0, n) for n in lengths], "beg long, stop long")
    for width in (1, 16, 64, 1 << 14):
        level = {r["stop"]: r["n"] for r in rows.select("stop", intervals._level(width).alias("n")).collect()}
        for n in lengths:
            assert intervals._levels(width, {(n - 1).bit_length()}) == [level[n]]


def test_dense_bins_are_split(spark, monkeypatch):
    """A hundredth of all positions holds half of both sides: no task makes twice the pairs of the median one."""
    monkeypatch.setattr(intervals, "PAIRS", 1 << 10)
    rng = random.Random(5)
    place = lambda: rng.randrange(4000, 4400) if rng.random() < 0.5 else rng.randrange(40_000)
    make = lambda n: [("c", b := place(), b + 60, i) for i in range(n)]
    left, right = (spark.createDataFrame(make(n), "contig string, beg long, stop long, i long") for n in (6000, 3000))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = intervals.interval_join(left, right).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pairs = sorted(r["count"] for r in got)
    want = left.alias("a").join(right.alias("b"), F.expr("a.beg < b.stop and a.stop > b.beg")).count()
    assert sum(pairs) == want and len(pairs) == 8 and pairs[-1] < 2 * pairs[4]


def test_overlap_counts(spark):
    rng = random.Random(6)
    make = lambda n: [(f"c{rng.randrange(3)}", b := rng.randrange(60_000), b + rng.choice([0, 1, 50, 20_000, 10**9])) for _ in range(n)]
    asked, rows = [*{*make(150)}, ("c9", 1, 2)], [*make(400), (None, 1, 2), ("c0", None, 4), ("c0", 5, None)]
    got = intervals.overlap_counts(*(spark.createDataFrame(x, "contig string, beg long, stop long") for x in (asked, rows)))
    want = {(*a, sum(None not in b and b[1] < b[2] and a[0] == b[0] and a[1] < b[2] and a[2] > b[1] for b in rows)) for a in asked if a[1] < a[2]}
    assert {tuple(r) for r in got.collect()} == want


def test_regions():
    r = intervals.parse_region
    assert r("chr1") == intervals.Region("chr1")
    assert r("chr1:100-200") == intervals.Region("chr1", 99, 200)
    assert r("chr1:1,000-2,000") == intervals.Region("chr1", 999, 2000)
    assert r("chr1:-50") == intervals.Region("chr1", 0, 50)
    assert r("chr1:100", one_position=True) == intervals.Region("chr1", 99, 100)
    assert r("chr1:100").stop == intervals.POSITION_MAX
    assert r("{a:b}:5-6") == intervals.Region("a:b", 4, 6)
    assert r("a:1-2", known={"a:1-2"}.__contains__) == intervals.Region("a:1-2")
    assert r(".") == intervals.Region(None)
    assert intervals.parse_position("1.5k") == 1500 and intervals.parse_position("2e3") == 2000
    for bad in ("chr1:5-4", "chr1:x", "{a"):
        with pytest.raises(intervals.RegionError):
            r(bad)
    with pytest.raises(intervals.RegionError):
        r("a:1-2", known={"a:1-2", "a"}.__contains__)


def test_region_lines(spark):
    df = spark.createDataFrame([("bed", "c\t10\t20\tx\ty"), ("tab", "c\t10\t20"), ("tab", "c\t10"), ("reg", "c:5-9"), ("reg", "c"), ("bed", "# no")], "k string, l string")
    got = df.select("k", F.when(F.col("k") == "bed", intervals.parse_region_line(F.col("l"), "bed")).when(F.col("k") == "tab", intervals.parse_region_line(F.col("l"), "tab")).otherwise(intervals.parse_region_line(F.col("l"), "reg")).alias("r")).collect()
    assert [tuple(x["r"])[:3] if x["r"] else None for x in got] == [("c", 10, 20), ("c", 9, 20), ("c", 9, 10), ("c", 4, 9), ("c", 0, intervals.INDEX_MAX), None]
    assert got[0]["r"]["payload"] == "x\ty"


def test_cigars(spark):
    df = spark.createDataFrame([("5S30M5S",), ("3H2S10M1D4M2S3H",), ("*",), (None,), ("4H",), ("10S",)], "c string")
    got = df.select(cigar_sum(F.col("c"), "MDN=X").alias("r"), soft_clip(F.col("c")).alias("s"), hard_clip(F.col("c")).alias("h")).collect()
    assert [r["r"] for r in got] == [30, 15, 0, 0, 0, 0]
    assert got[0]["s"] == 10 and got[1]["s"] == 4 and got[1]["h"] == 6 and got[4]["h"] == 8


CLASSES = [("A", "T", 1, 1), ("A", "A", 0, 0), ("A", "a", 1, 1), ("A", ".", 0, 0), ("A", "X", 0, 0), ("A", "*", 32, 0), ("A", "<*>", 0, 0), ("A", "<DEL>", 8, None), ("A", "AC", 68, 1), ("AC", "A", 132, -1), ("AC", "ac", 0, 0), ("ACG", "TCA", 2, 3), ("A", "A[chr2:5[", 16, None), ("A", "]chr2:5]A", 16, None), ("ACGT", "AcgA", 1, 1), ("ACT", "AGGT", 8, 1), ("GCAT", "GT", 132, -2), ("GT", "GCAT", 68, 2), ("ACGT", "TG", 8, -4)]


def test_classes(spark):
    df = spark.createDataFrame(CLASSES, "ref string, alt string, kind int, len int")
    got = df.select("ref", "alt", V.classify(F.col("ref"), F.col("alt")).alias("c")).collect()
    assert [(r["ref"], r["alt"], r["c"]["kind"], r["c"]["len"]) for r in got] == CLASSES


def test_alleles(spark):
    one = F.array(F.lit(1))
    got = spark.range(1).select(V.remap_genotype(F.lit("0/1|2/."), one).alias("g"), V.drop_alleles(F.array(*map(F.lit, range(6))), "G", one, F.lit(3)).alias("p"), V.values_of(F.lit("1,.,3"), "int").alias("v"), V.info_of(F.lit("A=1;B;AB=2"), "AB").alias("i"), V.info_of(F.lit("A=1;B"), "B").alias("f")).first()
    assert got["g"] == "0/.|1/." and got["p"] == [0, 3, 5] and got["v"] == [1, None, 3] and got["i"] == "2" and got["f"] == ""


def test_pairing_takes_each_record_once():
    site = [(0, "A>T"), (1, "A>T"), (2, "A>C"), (0, "A>AC"), (2, "A>AC")]
    for mode in ("exact", "snps", "indels", "both", "any", "some"):
        groups = pair_alleles(site, mode)
        assert sorted((i, v) for g in groups for i, v in g.items()) == sorted(site)
    assert pair_alleles(site, "exact")[0] == {0: "A>T", 1: "A>T"}
    assert pair_alleles(site, "snps")[0] == {0: "A>T", 1: "A>T", 2: "A>C"}


def test_pairing_by_sets_and_kinds():
    """A site's (input, variant) records, the mode, and who goes together."""
    multi = [(0, "A>C,A>G"), (1, "A>C"), (2, "A>AT")]
    assert pair_alleles([(0, "A>C,A>G"), (1, "A>G,A>C"), (2, "A>C")], "exact") == [{0: "A>C,A>G", 1: "A>G,A>C"}, {2: "A>C"}]
    assert pair_alleles(multi, "some") == [{0: "A>C,A>G", 1: "A>C"}, {2: "A>AT"}]
    assert pair_alleles(multi, "any") == [{0: "A>C,A>G", 1: "A>C", 2: "A>AT"}]
    assert {0: "A>C", 1: "A>AT,A>C"} in pair_alleles([(0, "A>C"), (1, "A>AT,A>C")], "snps")
    assert pair_alleles([(0, "AC>GT"), (1, "A>G")], "both") == [{0: "AC>GT"}, {1: "A>G"}]  # two bases for two are no SNP
    kinds = [(0, "A>C"), (1, "A>."), (2, "A>AT")]
    assert sorted(map(sorted, pair_alleles(kinds, "snps_ref"))) == [[0, 1], [2]]
    assert sorted(map(sorted, pair_alleles(kinds, "indels_ref"))) == [[0], [1, 2]]
    assert sorted(map(sorted, pair_alleles(kinds, "both_ref"))) == [[0, 1], [2]]
    # Kinds that fit better go first: the other SNP before the reference.
    assert pair_alleles([(0, "A>C"), (1, "A>."), (1, "A>G")], "both_ref")[0] == {0: "A>C", 1: "A>G"}


def test_synced(spark):
    a = spark.createDataFrame([("c", 1, 1, "x"), ("c", 1, 2, "y"), ("c", 5, 3, "z")], "contig string, pos long, rec_idx long, alt string")
    b = spark.createDataFrame([("c", 5, 1, "q")], a.schema)
    got = {(r["contig"], r["pos"]): (r["in_0"] and r["in_0"]["alt"], r["in_1"] and r["in_1"]["alt"]) for r in synced([a, b], ("alt",)).collect()}
    assert got == {("c", 1): ("y", None), ("c", 5): ("z", "q")}


def test_pileup_text(spark):
    rows = [("r1", 0, "s", 1, 60, "4M2D4M", "ACGTACGT", 1), ("r2", 16, "s", 3, 30, "2M1I3M", "GTTACG", 2), ("r3", 0, "s", 3, 99, "2M2N2M", "GTCC", 3)]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, rec_idx long")
    got = {r["position"]: (r["depth"], r["bases"]) for r in pileup.columns(df).collect()}
    assert got[1] == (1, "^]A")
    assert got[4] == (3, "T-2NNt+1tT")
    assert got[5][1] == "*a>" and got[10] == (1, "T$")
    depth = {r["position"]: r["depth"] for r in pileup.depth(df).collect()}
    assert depth == {p: d for p, (d, _) in got.items()}


def test_pileup_qualities(spark):
    """Mates set against each other in each column, by a plain version; others keep their qualities."""
    from strandlake.functions.scalars import wang, x31

    rng = random.Random(11)
    rows = []
    for i in range(40):
        for flag, shift in ((99, 0), (147, rng.randrange(0, 6))) if i % 4 else ((0, 0),):
            rows.append((f"n{i}", flag, "c", 10 * i + 1 + shift, 60, rng.choice(["10M", "4M2D6M", "3M2N7M"]), "".join(rng.choice("AC") for _ in range(10)), "".join(chr(33 + rng.choice([10, 20, 90])) for _ in range(10)) if i != 7 else None, len(rows)))
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, rec_idx long")
    odd = {r["qname"]: r["k"] for r in df.select("qname", (wang(x31(F.col("qname"))).bitwiseAND(1) == 1).alias("k")).distinct().collect()}
    shown: dict = {}
    for n, flag, _, pos, _, cigar, seq, qual, i in rows:
        at, k = pos, 0
        for size, op in ((int(a), b) for a, b in __import__("re").findall(r"(\d+)(.)", cigar)):
            for j in range(size):
                read = k + (j if op == "M" else 0)
                shown.setdefault(at + j, []).append([n, flag & 16, seq[read] if op == "M" else "*" if op == "D" else ">", 255 if qual is None else ord(qual[read]) - 33])
            at, k = at + size, k + (size if op == "M" else 0)
    for column in shown.values():
        for i, a in enumerate(column):
            for b in column[i + 1 :]:
                if a[0] != b[0] or a[1] == b[1]:
                    continue
                x, y, keep = a[3], b[3], odd[a[0]]
                if (a[2] == "*") != (b[2] == "*"):
                    a[3], b[3] = (min(x + y, 200), int(0.8 * y)) if a[2] == "*" else (int(0.8 * x), min(x + y, 200))
                elif a[2] == b[2]:
                    a[3] = b[3] = min(x + y, 200)
                elif x == y:
                    a[3] = b[3] = int(0.8 * x)
                else:
                    a[3], b[3] = (int(0.8 * x), 0) if x > y else (0, int(0.8 * y))
                    continue
                a[3], b[3] = (a[3], 0) if keep else (0, b[3])
    want = {p: "".join(chr(min(126, 33 + x[3])) for x in column) for p, column in shown.items()}
    assert {r["position"]: r["quals"] for r in pileup.columns(df).collect()} == want


def test_scalars(spark):
    row = spark.range(1).select(
        S.round_up_power(F.lit(5)).alias("up"), S.unpack_offset(S.pack_offset(F.lit(7), F.lit(9))).alias("o"), S.x31(F.lit("ab")).alias("x"), S.clamped_integer(F.lit("300x"), 8).alias("c"),
        S.clamped_integer(F.lit("-129"), 8).alias("d"), S.fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("f"), S.data_url(F.lit("data:;base64,SGk=")).alias("u"), S.data_url(F.lit("data:,a%20b")).alias("v"),
        S.file_extension(F.lit("a/b.bam"), ".bai", True).alias("e"), S.file_extension(F.lit("http://h/b.bam?x=1"), ".bai", False).alias("g"),
    ).first()
    assert row["up"] == 8 and tuple(row["o"]) == (7, 9) and row["x"] == 97 * 31 + 98 and tuple(row["c"]) == (127, 3, True) and tuple(row["d"]) == (-128, 4, True)
    assert abs(row["f"]["two"] - 0.4857142857) < 1e-6 and abs(row["f"]["left"] - 0.9857142857) < 1e-6
    assert bytes(row["u"]) == b"Hi" and bytes(row["v"]) == b"a b" and row["e"] == "a/b.bai" and row["g"] == "http://h/b.bam.bai?x=1"


def test_block_gzip(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 97) for i in range(20000)]
    data = "\n".join(lines).encode() + b"\n"
    packed = bgzf.compress(data)
    assert bgzf.decompress(packed) == data and bgzf.ends_well(packed) and bgzf.read_gzi(bgzf.gzi_bytes(bgzf.gzi(packed))) == bgzf.gzi(packed)
    assert bgzf.detect(bgzf.compress(b"##fileformat=VCFv4.3\n")) == ("VCF", "bgzf") and bgzf.detect(b"@SQ\tSN:a") == ("SAM", "none")
    (tmp_path / "x.gz").write_bytes(packed)
    spark.dataSource.register(bgzf.BgzfSource)
    for size in (20000, 70000, 1 << 24):
        got = spark.read.format("bgzf").option("splitBytes", size).load(str(tmp_path / "x.gz"))
        assert sorted(r["line"] for r in got.collect()) == sorted(lines)


def test_text_formats(spark, tmp_path):
    line = "r1\t99\tc1\t5\t60\t3M\t=\t9\t7\tACG\tIII\tNM:i:1\tRG:Z:a b"
    (tmp_path / "a.sam").write_text(f"@HD\tVN:1.6\n{line}\n")
    reads = T.parse_sam(T.numbered_lines(spark, str(tmp_path / "a.sam")))
    assert [r["l"] for r in reads.select(T.sam_line().alias("l")).collect()] == [line]
    vcf = "c1\t5\t.\tA\tC,T\t30\tPASS\tDP=5\tGT:AD\t0/1:1,2\t./.:."
    (tmp_path / "a.vcf").write_text(f"##fileformat=VCFv4.3\n#CHROM\n{vcf}\n")
    assert [r["l"] for r in T.parse_vcf(T.numbered_lines(spark, str(tmp_path / "a.vcf"))).select(T.vcf_line().alias("l")).collect()] == [vcf]
    (tmp_path / "a.fa").write_text(">s1 about it\nACGT\nAC\n>s2\nGG\n")
    assert [tuple(r)[:3] for r in T.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("rec_idx").collect()] == [("s1", "about it", "ACGTAC"), ("s2", None, "GG")]
    (tmp_path / "a.fq").write_text("@q1 d\nAC\nGT\n+\n@@\nII\n@q2\nA\n+\nI\n")
    assert [tuple(r)[:4] for r in T.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("rec_idx").collect()] == [("q1", "d", "ACGT", "@@II"), ("q2", None, "A", "I")]


def test_order_over_blocks(spark):
    """Islands of names and unsorted records, with blocks of a few rows."""
    from strandlake.operators.variants import unsorted

    rng = random.Random(4)
    rows, n = [], 0
    for i in range(400):
        n += rng.randrange(1, 4)
        rows.append((rng.choice(["c1", "c2", None]), n, rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(100)))
    df = spark.createDataFrame(rows, "rname string, rec_idx long, qname string, pos long").repartition(3)
    want, last, at = {}, {}, {}
    bad = []
    for c, i, q, p in rows:
        if c not in last or last[c][0] != q:
            at[c] = at.get(c, 0) + 1
        if c in last and p < last[c][1]:
            bad.append(i)
        last[c] = q, p
        want[i] = at[c]
    for width in (3, 50, 1 << 20):
        assert {r["rec_idx"]: r["island"] for r in pileup.islands(df, width).collect()} == want
        assert sorted(r["rec_idx"] for r in unsorted(df.withColumnRenamed("rname", "contig"), width).collect()) == bad


def test_allele_removal():
    from strandlake.functions.alleles import without_alleles

    head = "c\t7\t.\tG\tA,T,C\t.\t.\t"
    info = "AC=1,2,3;FLAG;AD=9,1,2,3;CIPOS=-1,1,-2,2,-3,3;MEINFO=a,1,2,+,b,3,4,-,c,5,6,+;RN=1,2,1;RUC=2,1,3,1;RUB=5,6,7,8,9,10,11;XX=7,8,9"
    got = without_alleles(head + info, [2]).split("\t")
    assert got[4] == "A,C" and got[7] == "AC=1,3;FLAG;AD=9,1,3;CIPOS=-1,1,-3,3;MEINFO=a,1,2,+,c,5,6,+;RN=1,1;RUC=2,1;RUB=5,6,11;XX=7,8,9"
    keys = "GT:AD:PL:EC:LAA:LAD:LPL:LEC"
    pl = ",".join(f"p{j}{i}" for i in range(4) for j in range(i + 1))
    full = f"{head}.\t{keys}\t0|2:9,1,2,3:{pl}:x,y,z:2,3:5,6,7:a,b,c,d,e,f:u,v\t3:.:1,2,3,4:.:.:5:a:."
    one, two = without_alleles(full, [2]).split("\t")[9:]
    assert one == "0|.:9,1,3:p00,p01,p11,p03,p13,p33:x,z:2:5,7:a,d,f:v" and two == "2:.:1,2,4:.:.:5:a:."
    assert without_alleles(full, [1, 2, 3]).split("\t")[4:8] == [".", ".", ".", "."] and without_alleles(head + "XX=1,2,3", [1], info={"XX": "A"}).endswith("XX=2,3")
    with pytest.raises(ValueError):
        without_alleles(full, [4])


def test_genotypes_and_libraries(spark):
    from strandlake.functions.records import with_library

    df = spark.createDataFrame([(["DP", "GT"], [["1", "0/1"], ["2", "."]]), (["DP"], [["1"]])], "f array<string>, s array<array<string>>")
    assert [r["g"] for r in df.select(V.genotypes_of(F.col("f"), F.col("s")).alias("g")).collect()] == [["0/1", "."], None]
    with pytest.raises(Exception, match="without its genotype"):
        spark.createDataFrame([(["DP", "GT"], [["1"]])], df.schema).select(V.genotypes_of(F.col("f"), F.col("s"))).collect()
    reads = spark.createDataFrame([({"RG": ("Z", "a")},), ({"RG": ("Z", "b")},), ({},)], "aux map<string,struct<type:string,value:string>>")
    assert [r["library"] for r in with_library(reads, "@RG\tID:a\tLB:lib one\n@RG\tID:b\n").collect()] == ["lib one", None, None]
    assert [r["library"] for r in with_library(reads, "@HD\tVN:1.6\n").collect()] == [None] * 3


def test_fastq_files_that_belong_together(spark):
    from strandlake.operators import fastx

    make = lambda n, step, s: spark.createDataFrame([(f"r{i}/{s}", "XA:i:5 1:Y:0:AC x", "ACGT"[: 1 + i % 4], "IIII"[: 1 + i % 4], i * step) for i in range(n)], "name string, definition string, seq string, qual string, rec_idx long").repartition(3)
    got = fastx.paired_reads(make(50, 1 << 19, 1), make(50, 3, 2), casava=True).orderBy("rec_idx").collect()
    assert [(r["qname"], r["flag"]) for r in got] == [(f"r{i // 2}", (77, 141)[i % 2]) for i in range(100)]
    single = fastx.paired_reads(make(5, 1, ""), None, make(5, 2, ""), tags=True, second_name=False).orderBy("rec_idx").collect()
    assert [r["aux"]["BC"]["value"] for r in single] == ["A", "AC", "ACG", "ACGT", "A"] and all(r["aux"]["XA"]["value"] == "5" and r["aux"]["QT"]["value"] for r in single)
    both = fastx.interleaved_reads(make(6, 9, "")).orderBy("rec_idx").collect()
    assert [(r["qname"], r["flag"]) for r in both] == [(f"r{i}/", (77, 141)[i % 2]) for i in range(6)]
    for bad in (lambda: fastx.paired_reads(make(5, 1, 1), make(4, 1, 2)), lambda: fastx.interleaved_reads(make(5, 1, ""))):
        with pytest.raises(Exception, match="different lengths"):
            bad().collect()


def test_extended_alignment_quality(spark):
    from strandlake.functions import kernels

    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    rows = [(i, "c", 20 + i * 5, "30M2D28M", ref[19 + i * 5 : 49 + i * 5] + ref[51 + i * 5 : 79 + i * 5], "I" * 58) for i in range(30)]
    df = spark.createDataFrame(rows, "rec_idx long, rname string, pos long, cigar string, seq string, qual string")
    refs = spark.createDataFrame([("c", ref)], "name string, seq string")
    plain = {r["rec_idx"]: r["baq"] for r in kernels.with_alignment_quality(df, refs).collect()}
    more = kernels.with_alignment_quality(df, refs, extended=True)
    for r in more.withColumn("bq", kernels.baq_tag(F.col("qual"), F.col("baq"))).collect():
        assert all(a <= b <= 40 for a, b in zip(plain[r["rec_idx"]], r["baq"])) and r["bq"] == "".join(chr(64 + 40 - b) for b in r["baq"])


def test_synchronized_pileups(spark):
    """Each input's columns are those of its reads alone, mates of other inputs aside; blocks of reads make no difference."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        for flag in (99, 147) if i % 3 else (0,):
            rows.append((f"n{i % 40}", flag, "c", 5 * (i % 20) + rng.randrange(4) + 1, 60, rng.choice(["10M", "4M2D6M", "3M2I5M", "2S3M2N5M"]), "".join(rng.choice("ACGT") for _ in range(10)), "".join(chr(33 + rng.randrange(60)) for _ in range(10)), len(rows), i % 2))
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, rec_idx long, input int").repartition(3)
    for with_quality in (df, df.drop("qual")):
        names = ["depth", "bases"] + (["quals"] if "qual" in with_quality.columns else [])
        whole = {r["position"]: [r[n] for n in names] for r in pileup.columns(with_quality).collect()}
        assert {r["position"]: [r[n] for n in names] for r in pileup.columns(with_quality, block=3).collect()} == whole
        got = {r["position"]: r for r in pileup.synchronized(with_quality, 3).collect()}
        assert got.keys() == whole.keys() and all(r["depth"] == whole[p][0] for p, r in got.items())
        for i in range(3):
            own = {r["position"]: [r[n] for n in names] for r in pileup.columns(with_quality.where(F.col("input") == i)).collect()}
            assert {p: [r[f"{n}_{i}"] for n in names] for p, r in got.items() if r[f"depth_{i}"]} == own
