"""What can't overlap anything on the other side isn't dealt."""

from strandlake.operators import intervals as I


def test_rows_beside_all_regions_are_left_out(spark):
    far = [("c", k, k + 10) for k in range(0, 50_000, 5)]
    near = [("c", 1_000, 1_020), ("c", 1_050, 1_055), ("d", 1_000, 1_010)]
    rows, regions = (spark.createDataFrame(x, "contig string, beg long, stop long") for x in (far, near))
    ends = I._range(regions)
    assert ends == (1_000, 1_055)
    assert I._within(rows, ends).count() == sum(b < 1_055 and e > 1_000 for _, b, e in far) < 20
    assert I._within(rows, (None, None)).count() == 0
    want = {(c, b, e): sum(x == c and lo < e and hi > b for x, lo, hi in far) for c, b, e in near}
    assert {(r["contig"], r["beg"], r["stop"]): r["n"] for r in I.overlap_counts(regions, rows).collect()} == want
    met = {r for r in far if any(r[0] == c and r[1] < e and r[2] > b for c, b, e in near)}
    assert {tuple(r) for r in I.interval_join(rows, regions, "left_semi").collect()} == met
    assert I.interval_join(rows, regions).count() == sum(want.values())
    assert I.interval_join(rows, regions, "left_anti").count() == len(far) - len(met)
