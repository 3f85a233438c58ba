"""separate_regions counts over intervals at all places, in the query and in its SQL alike."""

from collections import Counter

import duckdb
import pytest

from strandlake.plans.queries import ORACLE_SQL, QUERIES

SPANS = {0: 30, 1: 40, 2: 37, 3: 50, 4: 135}  # by l_linenumber % 5


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Orders' keys on both sides of 15,000 and far beyond, some that are equal by 75 and by 15,000, and a null; reads at positions 1 to 21,000."""
    path = str(tmp_path_factory.mktemp("sf"))
    lines = [(i, i * 29 % 3000, i * 3 % 11, i % 7 + 1, float(i % 50)) for i in range(1, 1200)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    orders = [(k, k * 13 % 997) for k in [*range(0, 1500, 75), *range(14_900, 15_100, 7), *range(300_000, 315_000, 61), 10**12 + 1]] + [(None, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    return path, lines, orders


def test_counts_over_all_places(spark, sf):
    path, lines, orders = sf
    a = [(s % 5, p * 7 + n - 1, p * 7 + n - 1 + SPANS[n % 5]) for _, p, s, n, _ in lines]
    want, met = Counter(), set()
    for k, c in orders:
        if k is None:
            want[k, f"chr{c % 5 + 1}", 0] += 1
            continue
        beg, stop = k % 15_000, k % 15_000 + 50 + c % 100
        n = sum(contig == c % 5 and x < stop and y > beg for contig, x, y in a)
        want[k, f"chr{c % 5 + 1}", n] += 1
        met |= {beg} if n else set()
    assert len(met) > 100 and max(met) > 14_000
    assert Counter(tuple(r) for r in QUERIES["separate_regions"](spark, path).collect()) == want
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    assert Counter(con.execute(ORACLE_SQL["separate_regions"]).fetchall()) == want
