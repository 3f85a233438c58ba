"""Genotype prefixes, FORMAT keys that are there twice, missing values and samples, records that the header's types refuse."""

from strandlake.sources import text as T


def test_plain_genotypes(spark):
    from pyspark.sql import functions as F

    want = {"/0/1": "0/1", "|0|1": "0|1", "|0/1": "|0/1", "/0|1": "/0|1", "|1": "1", "/1": "/1", "|.": "|.", "/.": ".", "0/1": "0/1", "": ".", ".": ".", "/1/2|3": "1/2|3"}
    got = spark.createDataFrame([(k,) for k in want], "g string").select("g", T.plain_genotype(F.col("g")).alias("n")).collect()
    assert {r["g"]: r["n"] for r in got} == want


def test_canonical_records(spark):
    header = "\n".join([
        "##fileformat=VCFv4.4", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="q">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb",
    ])
    rows = [
        ("c\t5\t.\tA\tT\t30.0\tPASS\tDP=4;AF=0.5,1e-3;X=y\tGT:GQ:GT\t/0/1:7:9\t|1", "c\t5\t.\tA\tT\t30\tPASS\tDP=4;AF=0.5,1e-3;X=y\tGT:GQ\t0/1:7\t1:.", True),
        ("c\t6\t.\tA\tT\t.\t.\t.", "c\t6\t.\tA\tT\t.\t.\t.\t.\t.\t.", True),
        ("c\t7\t.\tA\tT\t.\t.\tDP=four\tGT\t/0/1\t/0/1", None, False),
        ("c\t8\t.\tA\tT\t.\t.\tAF=.\tGQ:GT\tx:/0/1\t1:0/1", None, False),
        ("c\tten\t.\tA\tT\t.\t.\t.\tGT\t/0/1\t/0/1", None, False),
        ("c\t9\t.\tA\tT\tnone\t.\t.\tGT\t/0/1\t/0/1", None, False),
        ("c\t10\t.\tA\tT\t2.5\tq\tAF=-1.5e3;DP=.\tGT:GQ\t./.:.\t.", "c\t10\t.\tA\tT\t2.5\tq\tAF=-1.5e3;DP=.\tGT:GQ\t./.:.\t.:.", True),
        ("##source=x", None, False), ("", None, False), ("c\t5", None, False),
    ]
    df = spark.createDataFrame([(i, r[0], "k") for i, r in enumerate(rows)], "i int, line string, samples string")
    got = {r["i"]: r for r in T.canonical_vcf(df, header).collect()}
    for i, (line, want, typed) in enumerate(rows):
        assert (got[i]["line"], got[i]["typed"], got[i]["samples"]) == (line if want is None else want, typed, "k")
    again = T.canonical_vcf(T.canonical_vcf(df, header).drop("typed"), header)
    assert {r["i"]: r["line"] for r in again.collect()} == {i: r["line"] for i, r in got.items()}
