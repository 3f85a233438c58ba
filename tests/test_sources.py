import json
import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bam, faidx
from strandlake.sources.text import parse_sam, sam_line
from strandlake.streaming.reads import filtered, in_regions, windowed_counts

HEADER = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:5000\n@SQ\tSN:c2\tLN:700\n"


def lines(n):
    return [f"r{i}\t{99 if i % 2 else 147}\tc{i % 2 + 1}\t{i + 1}\t{i % 60}\t3M1I2M\t=\t{i + 50}\t{i}\tACGTAN\tIIIIII\tNM:i:{i - 3}\tXB:B:s,1,-2\tRG:Z:a b\tXA:A:q" for i in range(n)] + ["u\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*"]


def rows(spark, n):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines(n))], "line string, rec_idx long")
    return parse_sam(df)


def test_bam_round_trip(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    reads = rows(spark, 300).repartition(3)
    reads.write.format("bam").option("header", HEADER).mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("bam").load(str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 3
    assert sorted(r["l"] for r in back.select(sam_line().alias("l")).collect()) == sorted(lines(300))


def test_bam_splits(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    data = bam.write_bam(HEADER, [r.asDict(recursive=True) for r in rows(spark, 4000).orderBy("rec_idx").collect()])
    (tmp_path / "a.bam").write_bytes(data)
    with (tmp_path / "a.bam").open("rb") as f:
        points = bam.split_points(f, 700)
    assert len(points) == 6
    (tmp_path / "a.bam.splits").write_text(json.dumps(points))
    back = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    assert back.rdd.getNumPartitions() == 6
    assert [r["l"] for r in back.orderBy("rec_idx").select(sam_line().alias("l")).collect()] == lines(4000)


def test_faidx(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">a one\nACGT\nAC\n>b\nGG\n")
    got = {r["name"]: r for r in faidx.build(spark, str(tmp_path / "x.fa")).collect()}
    assert tuple(got["a"])[2:6] == (6, 7, 4, 5) and tuple(got["b"])[2:6] == (2, 18, 2, 3)
    (tmp_path / "x.fq").write_bytes(b"@a\nACGT\n+\n@III\n@b\nGG\n+\nII\n")
    got = [tuple(r)[1:] for r in faidx.build(spark, str(tmp_path / "x.fq")).collect()]
    assert got == [("a", 4, 3, 4, 5, 10), ("b", 2, 18, 2, 3, 23)]
    at, n = faidx.byte_range(F.lit(3), F.lit(6))
    row = faidx.build(spark, str(tmp_path / "x.fa")).where("name = 'a'").select(at.alias("a"), n.alias("n")).first()
    assert (tmp_path / "x.fa").read_bytes()[row["a"] : row["a"] + row["n"]].replace(b"\n", b"") == b"TAC"


def test_streams(spark, tmp_path):
    from strandlake.plans.views import reads

    table = reads(spark, "/root/testdata/sf0.001")
    table.select([c for c in table.columns if c != "library"]).withColumn("library", F.lit("x")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    regions = spark.createDataFrame([("chr1", 100, 900), ("chr2", 0, 5), ("chr1", 700, 1200)], "contig string, beg long, stop long")
    out = in_regions(filtered(stream, "mapq >= 20"), regions).select("rec_idx")
    q = out.writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    want = in_regions(filtered(table, "mapq >= 20"), regions).count()
    assert spark.table("hits").count() == want > 0
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_indexes(spark, tmp_path):
    import io
    import random

    from strandlake.sources import bgzf, index

    spark.dataSource.register(bam.BamSource)
    rng = random.Random(1)
    header = "@SQ\tSN:a\tLN:900000\n@SQ\tSN:b\tLN:900000\n"
    made = sorted((rng.randrange(2), rng.randrange(1, 800000), rng.choice(["50M", "20M9000N30M", "10S40M"])) for _ in range(4000))
    rows = [{"qname": f"q{i}", "flag": 0, "rname": "ab"[c], "pos": p, "mapq": 9, "cigar": g, "rnext": None, "pnext": None, "tlen": 0, "seq": "ACGTA" * 10, "qual": None} for i, (c, p, g) in enumerate(made)]
    (tmp_path / "x.bam").write_bytes(bam.write_bam(header, rows))
    with (tmp_path / "x.bam").open("rb") as f:
        built = index.index_bam(f)
    span = {"50M": 50, "20M9000N30M": 9050, "10S40M": 40}
    for name, data in (("x.bam.bai", index.bai_bytes(built)), ("x.bam.csi", index.csi_bytes(built))):
        (tmp_path / name).write_bytes(data)
        assert list(index.read_index(data).rows()) == list(built.rows())
        for region, lo, hi in (("a:1000-2000", 999, 2000), ("b:400,000-460,000", 399999, 460000), ("b:899,000-900,000", 898999, 900000)):
            got = spark.read.format("bam").option("region", region).load(str(tmp_path / "x.bam"))
            want = sorted(r["qname"] for r in rows if r["rname"] == region[0] and r["pos"] - 1 < hi and r["pos"] - 1 + span[r["cigar"]] > lo)
            assert sorted(r["qname"] for r in got.collect()) == want
        (tmp_path / name).unlink()
    text = "".join(f"{'ab'[c]}\t{p}\t{p + 10}\n" for c, p, _ in made).encode()
    t = index.index_text(io.BytesIO(bgzf.compress(text)), (0, 1, 2), zero_based=True)
    again = index.read_index(index.tbi_bytes(t))
    assert again.names == ["a", "b"] and list(again.rows()) == list(t.rows())
    assert index.candidates("d/x.bam")[:2] == ["d/x.bam.csi", "d/x.csi"] and index.candidates("a##idx##b") == ["b"]


def test_bcf_round_trip(spark, tmp_path):
    from strandlake.sources import bcf
    from strandlake.sources.text import parse_vcf, vcf_line

    header = (
        '##fileformat=VCFv4.3\n##contig=<ID=c1>\n##contig=<ID=c2>\n##FILTER=<ID=PASS,Description="">\n##FILTER=<ID=q10,Description="x">\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n'
        '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">\n##INFO=<ID=TX,Number=1,Type=String,Description="x">\n##INFO=<ID=END,Number=1,Type=Integer,Description="x">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="x">\n##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">\n##FORMAT=<ID=GL,Number=G,Type=Float,Description="x">\n##FORMAT=<ID=FT,Number=1,Type=String,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n'
    )
    lines = [
        "c1\t5\trs1\tA\tC,T\t30\tPASS\tDP=300;AF=0.5,.;DB;TX=a b\tGT:AD:GL:FT\t0/1:1,2,3:0.5,-1,2:ok\t.|2:.:.:longer",
        "c2\t70000\t.\tACGT\t.\t.\t.\t.\tGT\t0\t./.", "c1\t9\t.\tN\t<DEL>\t0.25\tq10\tEND=100000;DP=-70000\tAD\t7\t8,70000", "c2\t1\tx\tA\tG\t3\tPASS\tTX=" + "z" * 40 + "\tFT\ta\tb",
    ]
    (tmp_path / "a.bcf").write_bytes(bcf.write_bcf(header, lines))
    spark.dataSource.register(bcf.BcfSource)
    back = spark.read.format("bcf").load(str(tmp_path / "a.bcf")).orderBy("rec_idx")
    assert [r["line"] for r in back.collect()] == lines
    assert [r["l"] for r in parse_vcf(back).orderBy("rec_idx").select(vcf_line().alias("l")).collect()] == lines


def test_bam_in_byte_ranges(spark, tmp_path):
    """Many small ranges, of which some begin in the middle of records and of blocks without a record's start."""
    spark.dataSource.register(bam.BamSource)
    made = [r.asDict(recursive=True) for r in rows(spark, 3000).orderBy("rec_idx").collect()]
    rng = random.Random(6)
    for r in made:
        r["seq"] = "".join(rng.choice("ACGT") for _ in range(60))
        r["qual"], r["cigar"] = "".join(chr(33 + rng.randrange(60)) for _ in range(60)), "60M"
    made[1500] |= {"seq": "ACGT" * 40_000, "qual": "".join(chr(33 + rng.randrange(60)) for _ in range(160_000)), "cigar": "160000M"}  # over more than one block
    (tmp_path / "a.bam").write_bytes(bam.write_bam(HEADER, made))
    back = spark.read.format("bam").option("splitBytes", 9000).load(str(tmp_path / "a.bam"))
    assert back.rdd.getNumPartitions() > 10
    assert [r["qname"] for r in back.orderBy("rec_idx").collect()] == [r["qname"] for r in made]


def test_fastq_in_byte_ranges(spark, tmp_path):
    from strandlake.sources.files import FastqSource

    spark.dataSource.register(FastqSource)
    made = [(f"r{i}", f"d {i}" if i % 3 else None, "ACGTN"[: i % 5 + 1] * 7, "@+I!5"[: i % 5 + 1] * 7) for i in range(900)]
    (tmp_path / "a.fq").write_text("".join(f"@{n}{' ' + d if d else ''}\n{s}\n+\n{q}\n" for n, d, s, q in made))
    for size in (97, 1000, 1 << 20):
        back = spark.read.format("fastq").option("splitBytes", size).load(str(tmp_path / "a.fq"))
        assert [tuple(r)[:4] for r in back.orderBy("rec_idx").collect()] == made


def test_sinks_and_regions(spark, tmp_path):
    """SAM and VCF lines written block-compressed with a header, indexed, and read by region; BCF likewise."""
    from strandlake.sources import bcf, bgzf, index
    from strandlake.sources.files import LineSource

    for source in (LineSource, bgzf.BgzfSource, bcf.BcfSource):
        spark.dataSource.register(source)
    header = '##fileformat=VCFv4.3\n##contig=<ID=c1>\n##contig=<ID=c2>\n##FILTER=<ID=PASS,Description="">\n##INFO=<ID=END,Number=1,Type=Integer,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
    made = [f"c{c}\t{p}\t.\tACGT\tA\t.\tPASS\t{'END=' + str(p + 900) if p % 50 == 0 else '.'}" for c in (1, 2) for p in range(1, 60_000, 7)]
    df = spark.createDataFrame([(x,) for x in made], "line string").coalesce(1)
    df.write.format("lines").option("header", header).option("extension", "vcf.gz").mode("append").save(str(tmp_path / "v"))
    df.write.format("bcf").option("header", header).mode("append").save(str(tmp_path / "b"))
    path = str(tmp_path / "v" / "part-00000.vcf.gz")
    assert bgzf.decompress(open(path, "rb").read()).decode() == header + "".join(x + "\n" for x in made)
    with open(path, "rb") as f:
        built = index.index_lines(f, "vcf")
    region, lo, hi = "c2:30000-30500", 29_999, 30_500
    want = [x for x in made if index.line_meets(x, "vcf", region)]
    assert 70 < len(want) < 100 and all(index.line_span(x, "vcf")[2] > lo for x in want)
    for indexed in (False, True):
        if indexed:
            open(path + ".tbi", "wb").write(index.tbi_bytes(built))
        got = spark.read.format("bgzf").option("region", region).option("preset", "vcf").load(path)
        assert sorted(r["line"] for r in got.collect()) == sorted(want)
    back = spark.read.format("bcf").option("splitBytes", 5000).load(str(tmp_path / "b"))
    assert back.rdd.getNumPartitions() > 3 and [r["line"] for r in back.orderBy("rec_idx").collect()] == made
    got = spark.read.format("bcf").option("region", region).load(str(tmp_path / "b"))
    assert sorted(r["line"] for r in got.collect()) == sorted(want)
    sam = spark.createDataFrame([(x,) for x in lines(50)], "line string").repartition(2)
    sam.write.format("lines").option("header", HEADER).option("extension", "sam").mode("append").save(str(tmp_path / "s"))
    files = sorted((tmp_path / "s").glob("part-*.sam"))
    assert len(files) == 2 and all(f.read_text().startswith(HEADER) for f in files)
    assert sorted(r["l"] for r in parse_sam(spark.read.text(str(tmp_path / "s")).selectExpr("value as line", "0L as rec_idx")).select(sam_line().alias("l")).collect()) == sorted(lines(50))


def test_gff(spark):
    from strandlake.sources.index import line_span
    from strandlake.sources.text import parse_gff

    df = spark.createDataFrame([("##gff-version 3",), ("c1\tx\tgene\t11\t20\t.\t+\t.\tID=g1;Name=a=b",), ("c1\tx\tCDS\t11\t20\t0.5\t-\t2\t.",)], "line string").withColumn("rec_idx", F.lit(0))
    got = [tuple(r)[:-1] for r in parse_gff(df).collect()]
    assert got == [("c1", "x", "gene", 10, 20, None, "+", None, {"ID": "g1", "Name": "a=b"}), ("c1", "x", "CDS", 10, 20, 0.5, "-", 2, {})]
    assert line_span("c1\tx\tgene\t11\t20", "gff") == ("c1", 10, 20) and line_span("q\t0\tc\t5\t9\t3M10N2M", "sam") == ("c", 4, 19)


def test_cram_round_trip(spark, tmp_path):
    """Written by three tasks and read again: all fields; = and X come back as M, and reads without a place have quality 0."""
    from strandlake.sources import cram

    spark.dataSource.register(cram.CramSource)
    reads = rows(spark, 300).repartition(3)
    reads.write.format("cram").option("header", HEADER).mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("cram").load(str(tmp_path / "out"))
    want = [x.replace("\t255\t", "\t0\t") if x.startswith("u") else x for x in lines(300)]
    assert sorted(r["l"] for r in back.select(sam_line().alias("l")).collect()) == sorted(want)


def test_cram_regions_and_containers(spark, tmp_path, monkeypatch):
    from strandlake.sources import cram

    monkeypatch.setattr(cram, "RECORDS", 100)
    spark.dataSource.register(cram.CramSource)
    rng = random.Random(2)
    header = "@SQ\tSN:a\tLN:900000\n@SQ\tSN:b\tLN:900000\n@RG\tID:x\tLB:y\n"
    made = sorted((rng.randrange(2), rng.randrange(1, 800000), rng.choice(["50M", "20M9000N30M", "10S40M", "5H20M2I28M", "25M3D2P25M"])) for _ in range(2000))
    rows_ = [{"qname": f"q{i}", "flag": 0, "rname": "ab"[c], "pos": p, "mapq": 9, "cigar": g, "rnext": None, "pnext": None, "tlen": 0, "seq": "ACGTN" * 10 if i % 7 else "", "qual": "IJ" * 25 if i % 3 and i % 7 else None} for i, (c, p, g) in enumerate(made)]
    path = tmp_path / "x.cram"
    path.write_bytes(b"".join(cram.cram_parts(header, rows_)))
    size = path.stat().st_size
    with path.open("rb") as f:
        assert cram.read_header(f) == header and len(list(cram.containers(f, size))) == 20
        entries = cram.crai(f, size)
    assert cram.read_crai(cram.crai_bytes(entries)) == entries and len(entries) in (20, 21)
    back = spark.read.format("cram").option("splitBytes", 3000).load(str(path))
    assert back.rdd.getNumPartitions() > 5
    got = back.orderBy("rec_idx").collect()
    assert [(r["qname"], r["rname"], r["pos"], r["mapq"], r["cigar"], r["seq"], r["qual"]) for r in got] == [tuple(r[k] for k in ("qname", "rname", "pos", "mapq", "cigar", "seq", "qual")) for r in rows_]
    span = {"50M": 50, "20M9000N30M": 9050, "10S40M": 40, "5H20M2I28M": 48, "25M3D2P25M": 53}
    for indexed in (False, True):
        if indexed:
            (tmp_path / "x.cram.crai").write_bytes(cram.crai_bytes(entries))
        for region, lo, hi in (("a:1000-20000", 999, 20000), ("b:400,000-460,000", 399999, 460000)):
            found = spark.read.format("cram").option("region", region).load(str(path))
            want = sorted(r["qname"] for r in rows_ if r["rname"] == region[0] and r["pos"] - 1 < hi and r["pos"] - 1 + span[r["cigar"]] > lo)
            assert sorted(r["qname"] for r in found.collect()) == want and found.rdd.getNumPartitions() <= 20
    path.write_bytes(path.read_bytes()[:-60] + b"x" * 60)
    with path.open("rb") as f, pytest.raises(ValueError):
        for c in cram.containers(f, size):
            f.seek(c.data)
            list(cram.decode_container(f.read(c.end - c.data), header))


def test_cram_parts():
    """Integers, prefix codes, features against a reference, mates within a slice."""
    from strandlake.sources import cram

    for n in (0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**31 - 1, -1, -5):
        assert cram.Cursor(cram.itf8(n)).itf8() == n and cram.Cursor(cram.ltf8(n)).ltf8() == n
    assert cram.Cursor(cram.ltf8(2**60 + 3)).ltf8() == 2**60 + 3 and cram.itf8(128) == b"\x80\x80" and cram.itf8(-1) == b"\xff\xff\xff\xff\x0f"
    assert cram.codes([7, 8, 9], [2, 1, 2]) == {(1, 0): 8, (2, 2): 7, (2, 3): 9}
    values = cram.Series(bytes([0b01011101, 0b00100101, 0b10000000]), {})
    coded = values.reader(cram.HUFFMAN, cram.Cursor(bytes([3, 7, 8, 9, 3, 2, 1, 2])))
    assert [coded() for _ in range(4)] == [8, 7, 9, 7]  # 0 10 11 10
    head = cram.Header(b"".join(len(x).to_bytes(1, "big") + x for x in (b"\x01SM" + bytes([0b00011011] * 5), b"\x00", b"\x00")))
    assert head.substitutes() == {"A": "CGTN", "C": "AGTN", "G": "ACTN", "T": "ACGN", "N": "ACGT"}
    ref = "ACGTACGTAC"
    r = {"contig": 0, "pos": 2, "size": 9}
    features = [(1, "S", b"TT"), (4, "X", 1), (5, "I", b"G"), (6, "D", 2), (8, "b", b"NN")]
    # From the second base on: C matches, G is replaced by the base of code 1, TA are deleted, CG match, NN are given.
    assert cram._placed(r, features, ["c"], head.substitutes(), lambda c, a, b: ref[a:b], False) == ("2S2M1I2D4M", "TTCCGCGNN") and r["end"] == 9
    mates = [{"next": 1, "flag": 67, "contig": 0, "pos": 5, "end": 14, "name": "a", "nc": -1, "np": 0, "tlen": 0}, {"next": None, "flag": 147, "contig": 0, "pos": 20, "end": 29, "name": None, "nc": -1, "np": 0, "tlen": 0}]
    cram._join_mates(mates)
    assert [(m["np"], m["tlen"], m["flag"], m["name"]) for m in mates] == [(20, 25, 67 | 32, "a"), (5, -25, 147, "a")]


def test_rans():
    """Packed here by the reverse of each step."""
    import struct
    from collections import Counter, defaultdict

    from strandlake.sources.cram import rans

    def spread(counts):
        total = sum(counts.values())
        f = {s: max(1, n * 4000 // total) for s, n in sorted(counts.items())}
        f[max(f, key=f.get)] += 4096 - sum(f.values())
        return f

    def listed(found, item):
        out, keys, i = b"", sorted(found), 0
        out += bytes((keys[0],))
        run = 0
        for i, s in enumerate(keys):
            out += item(found[s])
            if run:
                run -= 1
                continue
            if i + 1 < len(keys):
                out += bytes((keys[i + 1],))
                if keys[i + 1] == s + 1:
                    while i + 2 + run < len(keys) and keys[i + 2 + run] == s + 2 + run:
                        run += 1
                    out += bytes((run,))
            else:
                out += b"\0"
        return out + (b"\0" if run or len(keys) > 1 and not out.endswith(b"\0") else b"")

    def size(f):
        return bytes((f,)) if f < 128 else bytes((0x80 | f >> 8, f & 255))

    rng = random.Random(1)
    for order in (0, 1):
        data = bytes(rng.choice(b"AACCCGTNxy~") for _ in range(1003))
        quarter = len(data) // 4
        if order == 0:
            plan = [(i & 3, None, data[i]) for i in range(len(data))]
            tables = {None: spread(Counter(data))}
            head = listed(tables[None], size)
        else:
            plan = [(k, data[k * quarter + i - 1] if i else 0, data[k * quarter + i]) for i in range(quarter) for k in range(4)]
            plan += [(3, data[i - 1], data[i]) for i in range(4 * quarter, len(data))]
            seen = defaultdict(Counter)
            for _, before, s in plan:
                seen[before][s] += 1
            tables = {b: spread(c) for b, c in seen.items()}
            head = listed(tables, lambda t: listed(t, size))
        start = {b: {s: sum(f for t, f in table.items() if t < s) for s in table} for b, table in tables.items()}
        state, tail = [1 << 23] * 4, bytearray()
        for k, before, s in reversed(plan):
            f, x = tables[before][s], state[k]
            while x >= (1 << 19) * f:
                tail.append(x & 255)
                x >>= 8
            state[k] = x // f << 12 | x % f + start[before][s]
        body = head + struct.pack("<4I", *state) + bytes(reversed(tail))
        assert rans(bytes((order,)) + struct.pack("<II", len(body), len(data)) + body) == data


def test_bam_files_put_together(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    made = [r.asDict(recursive=True) for r in rows(spark, 3000).orderBy("rec_idx").collect()]
    for i, part in enumerate((made[:5], made[5:2000], made[2000:])):
        (tmp_path / f"{i}.bam").write_bytes(bam.write_bam(HEADER, part))
    files = [(tmp_path / f"{i}.bam").open("rb") for i in range(3)]
    (tmp_path / "all.bam").write_bytes(b"".join(bam.concatenate(files)))
    back = spark.read.format("bam").option("splitBytes", 20_000).load(str(tmp_path / "all.bam"))
    assert [r["l"] for r in back.orderBy("rec_idx").select(sam_line().alias("l")).collect()] == lines(3000)
    (tmp_path / "x.bam").write_bytes(bam.write_bam("@SQ\tSN:z\tLN:5\n", []))
    with pytest.raises(ValueError):
        list(bam.concatenate([files[0], (tmp_path / "x.bam").open("rb")]))


def test_reads_over_many_bins_pass_once(spark):
    """Spliced reads that reach over several bins, regions that touch, nest and repeat, rows without a place."""
    rng = random.Random(12)
    reads, regions = [], []
    for i in range(200):
        skip = rng.choice([0, 0, 30, 200])
        reads.append((i, rng.choice(["c1", "c2"]), rng.randrange(1, 900), f"5M{skip}N5M" if skip else "10M"))
    reads += [(900, None, None, "*"), (901, "c1", None, "*"), (902, "c1", 5, "*"), reads[0], reads[0]]
    for _ in range(25):
        b = rng.randrange(900)
        regions.append((rng.choice(["c1", "c2", "c3"]), b, b + rng.choice([0, 1, 8, 60])))
    regions += [regions[0], (None, 0, 900)]
    df = spark.createDataFrame(reads, "rec_idx long, rname string, pos long, cigar string").repartition(3)
    span = lambda c: sum(int(x) for x in c.replace("N", " ").replace("M", " ").split()) if c != "*" else 0
    meets = lambda r, g: r[1] == g[0] and g[1] < g[2] and span(r[3]) and r[2] - 1 < g[2] and r[2] - 1 + span(r[3]) > g[1]
    want = sorted(r[0] for r in reads if r[1] and r[2] and any(meets(r, g) for g in regions))
    for width in (16, 64, 1 << 14):
        got = in_regions(df, spark.createDataFrame(regions, "contig string, beg long, stop long"), width)
        assert sorted(r["rec_idx"] for r in got.collect()) == want
    assert 60 < len(want) < 190
