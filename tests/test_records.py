import pytest
from pyspark.sql import functions as F

from strandlake.functions import records as R


def test_vcf_header():
    text = '##fileformat=VCFv4.3\n##INFO=<ID=DP,Number=1,Type=Integer,Description="a, b">\n##FILTER=<ID=q10,Description="x">\n##contig=<ID=c1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n'
    h = R.VcfHeader.parse(text)
    assert h.text() == text and h.samples == ["A", "B"] and h.ids["INFO"]["DP"]["Description"] == "a, b"
    h.add("##INFO=<ID=DP,Number=2>")
    assert h.text() == text
    other = R.VcfHeader.parse(text)
    assert other.remove("FILTER", "q10") and not other.remove("FILTER", "q10") and h.missing_from(other) == [("FILTER", "q10")] and not other.missing_from(h)


def test_sam_header():
    h = R.append_to_sam_header("@SQ\tSN:a\tLN:1\n", "HD", {"VN": "1.6"})
    assert h.startswith("@HD\tVN:1.6\n@SQ")
    assert R.append_to_sam_header(h, "RG", {"ID": "x"}).endswith("@RG\tID:x\n")
    for kind, tags in (("HD", {"VN": "1"}), ("SQ", {"SN": "a"})):
        with pytest.raises(ValueError):
            R.append_to_sam_header(h, kind, tags)


def test_edits(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    keys, samples = R.set_format(a("GT", "DP"), F.array(a("0/1", "3"), a("1/1")), "AD", a("7", "8"))
    row = spark.range(1).select(
        R.add_filter(a("PASS"), "q").alias("f1"), R.add_filter(a("q", "s"), "q").alias("f2"), R.add_filter(a("q"), "PASS").alias("f3"), R.remove_filter(a("q"), "q").alias("f4"), R.has_filter(a("PASS"), ".").alias("h"),
        R.set_info(F.lit("."), "A", F.lit("1")).alias("i1"), R.set_info(F.lit("A"), "A", None).alias("i2"), R.set_info(F.lit("AB=1;A=2"), "A", F.lit("3")).alias("i3"), keys.alias("k"), samples.alias("s"),
        R.bit_set(a(0, 63, 64, 64), 2).alias("b"), R.utc_seconds(F.lit(1970), F.lit(13), F.lit(1), F.lit(24), F.lit(-1), F.lit(61)).alias("t"), R.escaped(F.lit("a" * 20), 10).alias("e"), R.find_text(F.lit("abc"), F.lit("z")).alias("z"),
    ).first()
    assert (row["f1"], row["f2"], row["f3"], row["f4"], row["h"]) == (["q"], ["q", "s"], ["PASS"], ["PASS"], True)
    assert (row["i1"], row["i2"], row["i3"]) == ("A=1", ".", "AB=1;A=3")
    assert row["k"] == ["GT", "DP", "AD"] and row["s"] == [["0/1", "3", "7"], ["1/1", ".", "8"]]
    assert row["b"] == [1 - 2**63, 1] and row["t"] == 366 * 86400 + 1 and row["e"] == "a" * 7 + "..." and row["z"] is None
    with pytest.raises(Exception, match="before 1970"):
        spark.range(1).select(R.utc_seconds(F.lit(1969), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).collect()


def test_rand48():
    x = R.rand48(1, 3)
    assert x == [R.rand48(1, 2)[0], *x[1:]] and abs(x[0] - 0.0416303447718782) < 1e-12
