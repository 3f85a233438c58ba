"""What one task of a pileup or of islands holds doesn't grow with the input."""

from strandlake.operators import pileup


def test_tasks_grow_with_rows(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pileup._tasks(spark.range(10), 100) == least
    assert pileup._tasks(spark.range(1_000), 100) == 10
    monkeypatch.setattr(pileup, "ROWS", 20)
    rows = [(i, f"q{i // 2}", "c", 64, 10 * i, "10M") for i in range(400)]
    df = spark.createDataFrame(rows, "rec_idx long, qname string, rname string, flag int, pos long, cigar string")
    assert pileup.islands(df, 16).rdd.getNumPartitions() == 20
